"""LM scoring by context-tree weighting: the code length of a text's bytes under all context depths at once.

After Willems, Shtarkov and Tjalkens (1995). A text's bytes (A-Z lower-cased) and an end symbol are coded bit by bit. Each
bit has a node in the binary tree over byte values, and each node a tree of contexts: the bytes before, nearest first, up
to ``DEPTH`` of them. A context's bits are estimated by Krichevsky and Trofimov's rule; at every depth the estimate and
what the deeper contexts say are mixed by how well either codes the training texts. So no depth has to be chosen, and an
unseen context says one half.

Counting is one table of grams (a context of full depth and its byte), shuffled by gram. The trees are worked through in
groups of grams that share their two nearest context bytes, so everything from depth two down stays in its group; depths
one and nought are tables of at most 256 * 255 and 255 nodes. Every distinct gram is scored once, whatever text it is in.
Texts are held in batches of a bounded size, and what a batch asks for and gets back is its distinct grams and words.

A word model with add-one smoothing is kept beside it as the base of comparison.

Edge cases: a null text is an empty one, whose score is that of the end symbol; a null id counts as the empty string when
texts are divided; every row is scored, also repeated ones; a text longer than a batch is a batch, read in blocks. Without
training texts every context is unseen: a bit costs one half, and the base is that of an empty vocabulary.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotgrid.llm.links import stage

DEPTH = 4
END = 255  # no byte of UTF-8; texts end with it, and before a text lie only such bytes
BATCH_BYTES, BATCH_DOCS = 16 << 20, 20_000
BLOCK_BYTES = 1 << 21
GRAMS_PER_GROUP, MIN_GROUPS = 200_000, 64
_HALF = np.log(0.5)
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]

BATCH = (
    "batch bigint, ids array<bigint>, held array<boolean>, sizes array<int>, texts binary, grams array<bigint>, gram_n array<bigint>, "
    "words array<binary>, word_n array<bigint>"
)
FIELDS = [c.split()[0] for c in BATCH.split(", ")]


# --- grams of texts ---


def gram_blocks(texts: list[bytes], depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (owner, gram): the text and the packed context and byte of every byte and end symbol, in order."""
    start = bytes([END]) * depth
    pieces: list[bytes] = []
    owners: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        whole = start + text + bytes([END])
        for at in range(0, len(text) + 1, BLOCK_BYTES):
            piece = whole[at : at + BLOCK_BYTES + depth]
            pieces.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= BLOCK_BYTES:
                yield _grams(pieces, owners, depth)
                pieces, owners, size = [], [], 0
    if pieces:
        yield _grams(pieces, owners, depth)


def _grams(pieces: list[bytes], owners: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of pieces, each led by ``depth`` bytes of context."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    grams = np.zeros(len(data) - depth, np.int64)
    for i in range(depth + 1):
        grams <<= 8
        grams |= data[i : len(data) - depth + i]
    within = np.ones(len(data), bool)
    ends = np.cumsum(sizes)
    for i in range(1, depth + 1):
        within[ends - i] = False  # a window that starts here would cross into the next piece
    return np.repeat(np.array(owners), sizes - depth), grams[within[: len(grams)]]


def distinct_grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of texts, in order, and how often each occurs."""
    return _merged([np.unique(g, return_counts=True) for _, g in gram_blocks(texts, depth)])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)


def text_batches(docs: DataFrame, held: Column, depth: int = DEPTH) -> DataFrame:
    """One row per batch of texts, with the distinct grams and words of it and how often its training texts have them."""

    def made(number: int, rows: list[tuple[int | None, bool, bytes]]) -> pa.RecordBatch:
        texts = [r[2] for r in rows]
        learnt = distinct_grams([t for t, r in zip(texts, rows, strict=True) if not r[1]], depth)
        other = distinct_grams([t for t, r in zip(texts, rows, strict=True) if r[1]], depth)
        grams, gram_n = _merged([learnt, (other[0], np.zeros_like(other[1]))])
        words: dict[bytes, int] = {}
        for text, row in zip(texts, rows, strict=True):
            for word, n in Counter(text.split()).items():
                words[word] = words.get(word, 0) + (0 if row[1] else n)
        columns = [
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([len(t) for t in texts], pa.int32()),
            pa.array(grams), pa.array(gram_n), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64()),
        ]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        packed = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists[:3], pa.array([packed], pa.binary()), *lists[3:]], FIELDS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for doc_id, is_held, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows.append((doc_id, is_held, text.lower()))  # of bytes, so only A-Z change
                size += len(text)
                if size >= BATCH_BYTES or len(rows) >= BATCH_DOCS:
                    yield made(number, rows)
                    number, rows, size = number + 1, [], 0
        if rows:
            yield made(number, rows)

    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("bigint"), held.alias("held"), text.alias("text")).mapInArrow(gather, BATCH)


# --- the trees ---


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log gamma(x) for x >= 0.5: Stirling's series at x + 16."""
    y = x + 16
    series = 1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series / y - sum(np.log(x + k) for k in range(16))


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of a sequence with so many zeros and ones by the Krichevsky-Trofimov rule."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Nodes:
    """The nodes of one depth and one bit position: counts, log estimate, and log weighted probability."""

    def __init__(self, contexts: np.ndarray, symbols: np.ndarray, n: np.ndarray, level: int, below: "Nodes | None"):
        prefix = (1 << level) | (symbols >> (8 - level))
        self.keys, self.at = np.unique((contexts << 8) | prefix, return_inverse=True)
        ones = (symbols >> (7 - level)) & 1
        size = len(self.keys)
        self.ones = np.bincount(self.at, weights=n * ones, minlength=size)
        self.zeros = np.bincount(self.at, weights=n * (1 - ones), minlength=size)
        self.estimate = log_estimate(self.zeros, self.ones)
        if below is None:
            self.deeper, self.weighted = None, self.estimate
        else:
            first = np.zeros(len(below.keys), np.int64)
            first[below.at] = self.at  # all grams of a deeper node lie in one node here
            self.deeper = np.bincount(first, weights=below.weighted, minlength=size)
            self.weighted = np.logaddexp(_HALF + self.estimate, _HALF + self.deeper)


def trees(grams: np.ndarray, n: np.ndarray, depth: int, top: int) -> Iterator[tuple[int, list[Nodes]]]:
    """For each of the 8 bit positions the nodes of depths ``depth`` down to ``top``."""
    contexts, symbols = grams >> 8, grams & 255
    for level in range(8):
        found: list[Nodes] = []
        for d in range(depth, top - 1, -1):
            own = contexts & ((1 << (8 * d)) - 1)
            found.append(Nodes(own, symbols, n, level, found[-1] if found else None))
        yield level, found


def _bit_estimate(zeros: np.ndarray, ones: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)


def _mixed(zeros, ones, estimate, deeper, weighted, bit, said):
    """The bit's probability at a depth, from what the next depth said."""
    own = np.exp(_HALF + estimate - weighted)
    return own * _bit_estimate(zeros, ones, bit) + np.exp(_HALF + deeper - weighted) * said


class Top:
    """Depths one and nought: arrays by nearest context byte and bit node, of bounded size."""

    def __init__(self, rows: pa.Table | None):
        self.zeros, self.ones, self.deeper = (np.zeros((256, 256)) for _ in range(3))
        if rows is not None and rows.num_rows:
            at = rows["near"].to_numpy(), rows["node"].to_numpy()
            self.zeros[at], self.ones[at], self.deeper[at] = (rows[c].to_numpy() for c in ("zeros", "ones", "weighted"))
        self.estimate = log_estimate(self.zeros, self.ones)
        self.weighted = np.logaddexp(_HALF + self.estimate, _HALF + self.deeper)
        self.zeros0, self.ones0, self.deeper0 = self.zeros.sum(0), self.ones.sum(0), self.weighted.sum(0)
        self.estimate0 = log_estimate(self.zeros0, self.ones0)
        self.weighted0 = np.logaddexp(_HALF + self.estimate0, _HALF + self.deeper0)

    def mix(self, near: np.ndarray, node: np.ndarray, bit: np.ndarray, said: np.ndarray) -> np.ndarray:
        at = near, node
        said = _mixed(self.zeros[at], self.ones[at], self.estimate[at], self.deeper[at], self.weighted[at], bit, said)
        return _mixed(
            self.zeros0[node], self.ones0[node], self.estimate0[node], self.deeper0[node], self.weighted0[node], bit, said
        )


def upper_rows(grams: np.ndarray, n: np.ndarray, depth: int) -> pa.RecordBatch:
    """(near, node, zeros, ones, weighted): what the depth-two nodes hand on to depth one."""
    out = []
    for _, found in trees(grams, n, depth, 2):
        two = found[-1]
        out.append(((two.keys >> 8) & 255, two.keys & 255, two.zeros, two.ones, two.weighted))
    near, node, *values = (np.concatenate(c) for c in zip(*out, strict=True))
    keys, back = np.unique(near << 8 | node, return_inverse=True)
    sums = [pa.array(np.bincount(back, weights=v, minlength=len(keys))) for v in values]
    return pa.RecordBatch.from_arrays([pa.array(keys >> 8), pa.array(keys & 255), *sums], ["near", "node", "zeros", "ones", "weighted"])


def gram_scores(grams: np.ndarray, n: np.ndarray, depth: int, top: Top) -> np.ndarray:
    """log10 of the probability of each gram's byte after its context."""
    total, symbols = np.zeros(len(grams)), grams & 255
    near = (grams >> 8) & 255
    for level, found in trees(grams, n, depth, 2):
        bit = (symbols >> (7 - level)) & 1
        said = _bit_estimate(found[0].zeros, found[0].ones, np.int64(1))[found[0].at]
        said = np.where(bit == 1, said, 1 - said)
        for nodes in found[1:]:
            at = nodes.at
            said = _mixed(nodes.zeros[at], nodes.ones[at], nodes.estimate[at], nodes.deeper[at], nodes.weighted[at], bit, said)
        total += np.log10(top.mix(near, (1 << level) | (symbols >> (8 - level)), bit, said))
    return total


def scored_grams(grams: DataFrame, depth: int) -> DataFrame:
    """(gram, score) for a table of all distinct grams and their training counts ``n``."""
    groups = max(MIN_GROUPS, -(-grams.count() // GRAMS_PER_GROUP))
    near = F.expr("shiftright(gram, 8) & 65535")
    grouped = grams.withColumn("part", F.pmod(F.xxhash64(near), F.lit(groups))).groupBy("part")

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return table["gram"].to_numpy(), table["n"].to_numpy().astype(float)

    def hand_up(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([upper_rows(*arrays(table), depth)])

    rows = grouped.applyInArrow(hand_up, "near bigint, node bigint, zeros double, ones double, weighted double")
    rows = rows.groupBy("near", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")])
    top = Top(rows.toArrow())  # at most 256 * 255 rows

    def score(table: pa.Table) -> pa.Table:
        return pa.table([table["gram"], pa.array(gram_scores(*arrays(table), depth, top))], ["gram", "score"])

    return grouped.applyInArrow(score, "gram bigint, score double")


# --- scores of texts ---


def scores(docs: DataFrame, held: Column, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; held rows are not learnt from."""
    content = stage(text_batches(docs, held, depth), "text_batches")
    asked = content.select("batch", F.explode("grams").alias("gram"))
    counted = content.select(F.explode(F.arrays_zip("grams", "gram_n")).alias("g"))
    grams = stage(counted.groupBy(F.col("g.grams").alias("gram")).agg(F.sum("g.gram_n").alias("n")), "grams", free=True)
    lookup = stage(scored_grams(grams, depth), "scored_grams", free=True)
    # two lists of one aggregate have the same order, and are half as large as one list of pairs
    gram_side = asked.join(lookup, "gram").groupBy("batch").agg(F.collect_list("gram").alias("gram"), F.collect_list("score").alias("score"))

    # a word has one row per batch at most, so its total goes to its rows without a second table
    uses = content.select("batch", F.posexplode(F.arrays_zip("words", "word_n")).alias("at", "w"))
    own = Window.partitionBy("word")
    uses = uses.select("batch", "at", F.col("w.words").alias("word"), F.col("w.word_n").alias("n")).withColumn("c", F.sum("n").over(own))
    uses = uses.withColumn("first", F.row_number().over(own.orderBy("batch")) == 1).where("c > 0").select("batch", "at", "c", "first")
    known = stage(uses, "known_words", free=True)
    of_words = known.where("first").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    learnt = content.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0))).first()[0]
    n_train, n_distinct = of_words[0] + learnt, of_words[1] + (learnt > 0)  # the end is a token of every text
    word_side = known.groupBy("batch").agg(F.collect_list("at").alias("at"), F.collect_list("c").alias("c"))

    names = ["ids", "held", "sizes", "texts", "gram", "score", "at", "c"]
    whole = content.select("batch", *names[:4]).join(gram_side, "batch").join(word_side, "batch", "left").select(*names)
    end_log, base_log = np.log10(learnt + 1.0), np.log10(n_train + n_distinct + 1.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in names if c != "texts"}
                texts = _unpacked(batch.column("texts")[i].as_buffer(), row["sizes"].to_numpy())
                logs = _word_logs(texts, row)
                base, n_tokens, n_known = [], [], []
                for text in texts:
                    own = Counter(text.split())
                    base.append(end_log + sum(n * logs.get(w, 0.0) for w, n in own.items()))
                    n_tokens.append(own.total() + 1)
                    n_known.append(sum(n for w, n in own.items() if w in logs) + (end_log > 0))
                n_tokens = np.array(n_tokens, np.int64)
                columns = [
                    row["ids"], row["held"], pa.array(n_tokens), pa.array(np.array(n_known, np.int64)),
                    pa.array(np.full(len(texts), n_train, np.int64)), pa.array(np.array(base) - n_tokens * base_log),
                    pa.array(_text_scores(texts, row["gram"].to_numpy(), row["score"].to_numpy(), depth)),
                ]
                yield pa.RecordBatch.from_arrays(columns, SCORED)

    kinds = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return whole.mapInArrow(score, kinds)


SCORED = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def _unpacked(packed: pa.Buffer, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes, dtype=np.int64)
    data = pa.decompress(packed, decompressed_size=int(sizes.sum(dtype=np.int64)), codec="zstd", asbytes=True)
    return [data[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _word_logs(texts: list[bytes], row: dict[str, pa.Array | None]) -> dict[bytes, float]:
    """log10(c + 1) of the batch's known words, which are numbered in the order in which its texts name them."""
    if row["at"] is None:
        return {}
    words = list(dict.fromkeys(w for t in texts for w in t.split()))
    return {words[i]: v for i, v in zip(row["at"].to_pylist(), np.log10(row["c"].to_numpy() + 1.0).tolist(), strict=True)}


class GramIndex:
    """Places of known grams: tables by hash, each for the grams that lost their slot in the one before."""

    def __init__(self, grams: np.ndarray):
        self.grams, self.tables = grams.view(np.uint64), []
        left = np.arange(len(grams), dtype=np.int32)
        while len(left):
            shift, factor = np.uint64(64 - max(4, (2 * len(left)).bit_length())), _FACTORS[len(self.tables) % len(_FACTORS)]
            slots = (self.grams[left] * factor) >> shift
            table = np.zeros(1 << int(64 - shift), np.int32)
            table[slots] = left
            self.tables.append((factor, shift, table))
            left = left[table[slots] != left]

    def places(self, asked: np.ndarray) -> np.ndarray:
        """Places of grams all of which are known."""
        asked = asked.view(np.uint64)
        out, left = np.zeros(len(asked), np.int32), np.arange(len(asked))
        for factor, shift, table in self.tables:
            found = table[(asked * factor) >> shift]
            hit = self.grams[found] == asked
            out[left[hit]] = found[hit]
            left, asked = left[~hit], asked[~hit]
            if not len(left):
                break
        return out


def _text_scores(texts: list[bytes], grams: np.ndarray, values: np.ndarray, depth: int) -> np.ndarray:
    index, out = GramIndex(grams), np.zeros(len(texts))
    for owner, found in gram_blocks(texts, depth):
        out += np.bincount(owner, weights=values[index.places(found)], minlength=len(texts))
    return out
