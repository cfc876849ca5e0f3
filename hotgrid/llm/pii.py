"""Personal data: base patterns, and a linear-chain conditional random field over word shapes.

The field labels white-space tokens around those that carry a digit or an at sign; other tokens cannot begin personal
data and are only context. It is trained by gradient ascent on a small labelled table of token sequences (by default a
bounded sample of documents, labelled by the base patterns) and decoded by Viterbi in numpy, all sequences of a batch at
once. What it finds beside the base spans is added.

Spans count code points, end exclusive; matches of one kind never overlap. A null text is like an empty one; with an
empty labelled table only base spans are found.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
MAX_FIT_DOCS = 3_000
MAX_LENGTH = 64  # tokens of one sequence; longer ones are cut there
SHAPE_RUNS = 24
GAP = 2  # plain tokens that may lie between two tokens of a sequence
ROUNDS, RATE, DECAY = 80, 0.2, 1e-4
MIN_FEATURE_COUNT = 2

Span = tuple[int, int, int]  # rank of the kind, start, end

_HINT = re.compile("[0-9@]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the looks back keep runs of digits linear: a match that does not start its run would have been found from the start
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_NUMBER = re.compile("[0-9-]+[.,;:]?")
_DIGITS = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from every at sign, the longest local part before it and the domain behind it."""
    upto = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > upto and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            upto = domain.end()
            yield start, upto
        else:
            upto = max(upto, at + 1)
        at = text.find("@", upto)


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by kind and start; matches that fail their test are dropped, not retried."""
    if not _HINT.search(text):
        return []
    out = [(0, *s) for s in emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


def sequences(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token spans of each sequence: tokens with a digit or at sign, at most ``GAP`` others between, one more at each end."""
    if not _HINT.search(text):
        return
    held: list[tuple[int, int]] = []
    before: list[tuple[int, int]] = []
    gap = 0
    for m in _TOKEN.finditer(text):
        if _HINT.search(m[0]):
            held = (held or before[-1:]) + [m.span()]
            gap = 0
        elif held:
            held.append(m.span())
            gap += 1
        if held and (gap > GAP or len(held) >= MAX_LENGTH):
            yield held[: len(held) - gap + 1] if gap > 1 else held
            held, gap = [], 0
        before = [m.span()]
    if held:
        yield held[: len(held) - gap + 1] if gap > 1 else held


def shape(token: str) -> str:
    """Word shape: X, x, d and u for upper, lower, digit and non-ASCII; runs are joined, those of digits with a length.

    Of more than ``SHAPE_RUNS`` runs the shape names the first and the last ones of the whole token.
    """
    out: list[str] = []
    for c in token:
        kind = "d" if "0" <= c <= "9" else "X" if "A" <= c <= "Z" else "x" if "a" <= c <= "z" else "u" if c > "\x7f" else c
        if out and out[-1][0] == kind:
            out[-1] += kind if len(out[-1]) < 9 else ""
        else:
            out.append(kind)
    if len(out) > SHAPE_RUNS:
        out = [*out[: SHAPE_RUNS // 2], "~", *out[-SHAPE_RUNS // 2 :]]
    return "".join(f"d{min(len(r), 9)}" if r[0] == "d" else r[0] for r in out)


def checksums(tokens: list[str]) -> list[str]:
    """For each token, whether the digits of the run of numbers it is in are as many as a card has, and check out."""
    out: list[str] = []
    at = 0
    while at < len(tokens):
        to = at
        while to < len(tokens) and _NUMBER.fullmatch(tokens[to]):
            to += 1
        digits = _DIGITS.sub("", "".join(tokens[at : max(to, at + 1)]))
        out += [str(luhn(digits)) if 16 <= len(digits) <= 19 else "none"] * max(to - at, 1)
        at = max(to, at + 1)
    return out


def features(tokens: list[str]) -> list[list[str]]:
    """Feature names of every token of a sequence."""
    shapes = [shape(t) for t in tokens]
    sums = checksums(tokens)
    out = []
    for i, (token, s) in enumerate(zip(tokens, shapes, strict=True)):
        digits = sum("0" <= c <= "9" for c in token)
        out.append(
            [
                "bias", f"s={s}", f"head={s[:2]}", f"tail={s[-2:]}", f"digits={min(digits, 20)}", f"all={digits == len(token)}",
                f"at={'@' in token}", f"dots={min(token.count('.'), 4)}", f"plus={token[:1] == '+'}", f"eq={'=' in token}",
                f"length={min(len(token) // 4, 8)}", f"before={shapes[i - 1] if i else '^'}",
                f"after={shapes[i + 1] if i + 1 < len(tokens) else '$'}", f"plain={not _HINT.search(token)}",
                f"check={sums[i]}",
            ]
        )
    return out


def tags_of(tokens: list[tuple[int, int]], spans: list[Span]) -> list[str]:
    """The tag of each token that ``spans`` give; a token belongs to the first span that it overlaps."""
    out = []
    last: Span | None = None
    for start, end in tokens:
        found = next((s for s in spans if s[1] < end and start < s[2]), None)
        out.append("O" if found is None else f"{'I' if found == last else 'B'}-{KINDS[found[0]]}")
        last = found
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass(frozen=True)
class Field:
    """Weights per feature and tag, and per pair of tags (row: previous; the last row is the start)."""

    index: dict[str, int]
    state: np.ndarray
    step: np.ndarray

    def emissions(self, batch: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (sequence, place, tag), padded, and the lengths. Unknown features have no weight."""
        lengths = np.array([len(s) for s in batch])
        out = np.zeros((len(batch), int(lengths.max(initial=1)), len(TAGS)))
        for i, seq in enumerate(batch):
            for j, names in enumerate(seq):
                known = [self.index[n] for n in names if n in self.index]
                out[i, j] = self.state[known].sum(axis=0)
        return out, lengths

    def decode(self, batch: list[list[list[str]]]) -> list[list[int]]:
        """Viterbi paths of all sequences at once."""
        if not batch:
            return []
        scores, lengths = self.emissions(batch)
        n, longest, _ = scores.shape
        best = scores[:, 0] + self.step[-1]
        back = np.zeros((n, longest, len(TAGS)), np.int64)
        for t in range(1, longest):
            reach = best[:, :, None] + self.step[:-1][None]
            back[:, t] = reach.argmax(axis=1)
            new = reach.max(axis=1) + scores[:, t]
            best = np.where((t < lengths)[:, None], new, best)
        paths = np.zeros((n, longest), np.int64)
        rows = np.arange(n)
        tag = best.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            paths[:, t] = tag
            tag = np.where((t < lengths) & (t > 0), back[rows, t, tag], tag)
        return [paths[i, : lengths[i]].tolist() for i in range(n)]


def train(table: list[tuple[list[str], list[str]]]) -> Field | None:
    """Maximum likelihood weights for labelled sequences (tokens, tags), or None without any."""
    if not table:
        return None
    named = [features(tokens) for tokens, _ in table]
    counts: dict[str, int] = {}
    for seq in named:
        for names in seq:
            for name in names:
                counts[name] = counts.get(name, 0) + 1
    index = {n: i for i, n in enumerate(sorted(n for n, c in counts.items() if c >= MIN_FEATURE_COUNT))}
    tag_index = {t: i for i, t in enumerate(TAGS)}
    lengths = np.array([len(s) for s in named])
    n, longest, k = len(named), int(lengths.max()), len(TAGS)
    gold = np.zeros((n, longest), np.int64)
    rows, cols = [], []  # (token, feature) pairs of all tokens; token = sequence * longest + place
    for i, (seq, (_, tags)) in enumerate(zip(named, table, strict=True)):
        gold[i, : len(tags)] = [tag_index[t] for t in tags]
        for j, names in enumerate(seq):
            known = [index[x] for x in names if x in index]
            rows += [i * longest + j] * len(known)
            cols += known
    rows, cols = np.array(rows), np.array(cols)
    valid = np.arange(longest)[None] < lengths[:, None]
    state, step = np.zeros((len(index), k)), np.zeros((k + 1, k))
    sums = [np.zeros_like(state), np.zeros_like(step)]
    total = int(lengths.sum())
    hot = np.eye(k)[gold] * valid[:, :, None]
    for _ in range(ROUNDS):
        scores = np.zeros((n * longest, k))
        np.add.at(scores, rows, state[cols])
        scores = scores.reshape(n, longest, k)
        ahead = np.zeros((n, longest, k))
        ahead[:, 0] = scores[:, 0] + step[-1]
        for t in range(1, longest):
            new = _log_sum(ahead[:, t - 1, :, None] + step[:-1][None], 1) + scores[:, t]
            ahead[:, t] = np.where(valid[:, t, None], new, ahead[:, t - 1])
        norm = _log_sum(ahead[:, -1], 1)
        behind = np.zeros((n, longest, k))
        pair = np.zeros((k, k))
        for t in range(longest - 2, -1, -1):
            reach = step[:-1][None] + (scores[:, t + 1] + behind[:, t + 1])[:, None, :]
            behind[:, t] = np.where(valid[:, t + 1, None], _log_sum(reach, 2), 0)
            joint = np.exp(ahead[:, t, :, None] + reach - norm[:, None, None])
            pair += joint[valid[:, t + 1]].sum(axis=0)
        marginal = np.exp(ahead + behind - norm[:, None, None]) * valid[:, :, None]
        grad = np.zeros_like(state)
        np.add.at(grad, cols, (hot - marginal).reshape(-1, k)[rows])
        grad_step = np.zeros_like(step)
        grad_step[-1] = (hot[:, 0] - marginal[:, 0]).sum(axis=0)
        grad_step[:-1] = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:]) - pair
        for weights, g, s in ((state, grad, sums[0]), (step, grad_step, sums[1])):
            g = g / total - DECAY * weights
            s += g * g
            weights += RATE * g / (np.sqrt(s) + 1e-8)
    return Field(index, state, step)


def labelled_table(docs: DataFrame, max_docs: int = MAX_FIT_DOCS) -> list[tuple[list[str], list[str]]]:
    """Token sequences and tags of at most about ``max_docs`` documents with digits or at signs, labelled by base spans.

    Documents are chosen by a hash of their ids, and at most four sequences a document by a hash of their tokens and tags.
    """
    hinted = docs.where(F.col("text").rlike("[0-9@]"))
    share = min(1.0, max_docs / max(1, hinted.count()))
    sample = hinted.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                for seq in sequences(text):
                    rows.append({"tokens": [text[a:b] for a, b in seq], "tags": tags_of(seq, spans)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    found = sample.select("text").mapInArrow(label, "tokens array<string>, tags array<string>")
    found = found.orderBy(F.xxhash64("tokens", "tags"), "tokens", "tags")
    return [(r["tokens"], r["tags"]) for r in found.limit(4 * max_docs).collect()]


def added_spans(text: str, tokens: list[tuple[int, int]], path: list[int], base: list[Span]) -> Iterator[Span]:
    """Spans of one decoded sequence that touch no base span, without surrounding punctuation."""
    runs: list[list[int]] = []
    for (start, end), tag in zip(tokens, path, strict=True):
        if tag == 0:
            continue
        kind = (tag - 1) // 2
        if tag % 2 == 0 and runs and runs[-1][0] == kind and runs[-1][3] == start:
            runs[-1][2] = end
        else:
            runs.append([kind, start, end, 0])
        gap = end
        while gap < len(text) and text[gap].isspace():
            gap += 1
        runs[-1][3] = gap  # where the next token would have to start to go on
    for kind, start, end, _ in runs:
        while start < end and text[start] in "\"'([{<,;:":
            start += 1
        while start < end and text[end - 1] in "\"')]}>,;:.!?":
            end -= 1
        if _HINT.search(text, start, end) and not any(s < end and start < e for _, s, e in base):
            yield kind, start, end


def found_spans(texts: list[str | None], field: Field | None) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and all spans, both by kind and start."""
    base = [base_spans(t or "") for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    if field is not None:
        places, batch = [], []
        for i, text in enumerate(texts):
            for seq in sequences(text or ""):
                places.append((i, seq))
                batch.append(features([text[a:b] for a, b in seq]))
        for at in range(0, len(batch), 2000):
            paths = field.decode(batch[at : at + 2000])
            for (i, seq), path in zip(places[at : at + 2000], paths, strict=True):
                added[i] += added_spans(texts[i], seq, path, base[i])
    return [(b, sorted(b + a)) for b, a in zip(base, added, strict=True)]


SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(text: Column, field: Field | None) -> Column:
    """Struct column (base, found) of span lists for a text column."""

    @F.arrow_udf(f"struct<base:{SPAN},found:{SPAN}>")
    def find(texts: pa.Array) -> pa.Array:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        rows = found_spans(texts.to_pylist(), field)
        lists = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in r[c]] for r in rows], pa.list_(span)) for c in (0, 1)]
        return pa.StructArray.from_arrays(lists, ["base", "found"])

    return find(text)


def joined(spans: Column) -> Column:
    """Text form of spans: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
