"""Secret scans: base patterns, and character Markov models for random strings that no pattern describes.

Two first-order models are trained from labelled tokens, one on random strings and one on ordinary identifiers. A long
token is a secret if the logarithm of the likelihood ratio, per character, is above a threshold calibrated on the same
tokens. Everything runs as column expressions; the models travel as one array literal of fixed size.

Spans count code points, end exclusive. A null text is like an empty one: no spans. Matches of one kind never overlap;
matches of different kinds may, but a random string that touches a base match is not reported again.
"""

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotgrid.llm.links import fresh, stage

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i:password|passwd|secret|token|api_?key)[\"' :=]"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"  # a shorter run never matches anywhere else within itself
TOKEN = "[A-Za-z0-9+/_-]+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
MIN_RANDOM = 20
MAX_FIT_DOCS = 20_000
MIN_IDENTIFIER = 6
SMOOTHING = 0.5
SUM_BLOCK = 128
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _none() -> Column:
    return F.array().cast(SPAN)


def _length(c: Column) -> Column:
    return F.char_length(c).cast("bigint")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, v: acc + v)


def _sums_before(values: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` of a function from a place to the sum of all values before it; sums are kept for whole blocks only."""
    block = F.lit(SUM_BLOCK)

    def blocks(v: Column) -> Column:
        ends = F.sequence(F.lit(0), F.floor(F.size(v) / block).cast("int"))
        sums = F.transform(ends, lambda k: _sum(F.slice(v, k * block + 1, block)))
        return _let(sums, lambda s: F.transform(s, lambda _, k: _sum(F.slice(s, F.lit(1), k))))

    def inner(v: Column, b: Column) -> Column:
        def before(i: Column) -> Column:
            k = F.floor(i / block).cast("int")
            return F.get(b, k) + _sum(F.slice(v, k * block + 1, i - k * block))

        return body(before)

    return _let(values, lambda v: _let(blocks(v), lambda b: inner(v, b)))


def _located(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of all matches: the text between them gives their places."""
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(values)).alias("gap"), values.alias("value"))

    def placed(pairs: Column) -> Column:
        def one(before: Callable[[Column], Column]) -> Column:
            def match(pair: Column, i: Column) -> Column:
                start = before(i) + _length(pair["gap"])
                return F.struct(start.alias("start"), (start + _length(pair["value"])).alias("end"), pair["value"].alias("value"))

            return F.transform(pairs, match)

        return _sums_before(F.transform(pairs, lambda p: _length(p["gap"]) + _length(p["value"])), one)

    return _let(pairs, placed)


def _spans(kind: str, found: Column) -> Column:
    rank = KINDS.index(kind)
    return F.transform(
        found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, by start and then kind. Matches that fail their test are dropped, not retried."""
    text = F.coalesce(text, F.lit(""))
    assign = F.filter(_located(text, ASSIGN), lambda m: F.char_length(F.regexp_extract(m["value"], "^" + ASSIGN, 2)) >= 8)
    access = F.filter(_located(text, ACCESS), lambda m: m["end"] - m["start"] >= 16)
    parts = F.concat(
        F.when(text.rlike(ASSIGN_HINT), _spans("assign", assign)).otherwise(_none()),
        F.when(text.contains("AKIA"), _spans("access", access)).otherwise(_none()),
        F.when(text.rlike(HEX), _spans("hex", _located(text, HEX))).otherwise(_none()),
    )
    return F.array_sort(parts.cast(SPAN))


@dataclass(frozen=True)
class Markov:
    """Log-likelihood ratios of character pairs (row: previous, column: next; 0 is any other character), and threshold."""

    ratios: list[float]
    threshold: float

    def score(self, token: Column) -> Column:
        """Mean log-likelihood ratio per pair, 0 for tokens of fewer than two characters."""
        table = F.split(F.lit(",".join(f"{r:.5f}" for r in self.ratios)), ",").cast("array<double>")
        width = len(ALPHABET) + 1
        n = F.char_length(token)
        # one pass over the characters: their places in the alphabet, then the ratios of neighbours
        places = F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(ALPHABET)))
        pairs = F.zip_with(F.slice(places, 1, n - 1), F.slice(places, 2, n - 1), lambda a, b: F.get(table, a * width + b))
        total = F.aggregate(pairs, F.lit(0.0), lambda acc, r: acc + r)
        return F.when(n >= 2, total / (n - 1)).otherwise(0.0)


def labelled_tokens(docs: DataFrame, max_docs: int = MAX_FIT_DOCS) -> DataFrame:
    """(token, secret) from at most about ``max_docs`` documents: values of base matches, and identifiers elsewhere.

    Tokens so long that they are candidates themselves have no label, so they are left out.
    """
    share = min(1.0, max_docs / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select("text")
    text = F.coalesce("text", F.lit(""))
    value = r"([A-Za-z0-9+/_-]+)[^A-Za-z0-9+/_-]*$"

    def labelled(tokens: Column, secret: bool) -> Column:
        return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(secret).alias("secret")))

    def matched(s: Column) -> Column:
        return F.regexp_extract(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), value, 1)

    rows = sample.withColumn("base", base_spans(F.col("text")))
    found = labelled(F.transform("base", matched), True)
    plain = labelled(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), False)
    tokens = rows.select(F.inline(F.when(F.size("base") > 0, found).otherwise(plain)))
    n = F.char_length("token")
    return tokens.where(F.when(F.col("secret"), n >= 8).otherwise(n.between(MIN_IDENTIFIER, MIN_RANDOM - 1)))


def train(tokens: DataFrame) -> Markov:
    """Models from labelled tokens (token, secret), counted in Spark; one row per pair and class comes back.

    Without any secret the random model is uniform; without identifiers the other one is.
    """
    tokens = stage(tokens, "tokens")
    width = len(ALPHABET) + 1
    pairs = tokens.where(F.char_length("token") >= 2).select(
        "secret", F.explode(F.expr("transform(sequence(1, char_length(token) - 1), i -> substring(token, i, 2))")).alias("pair")
    )
    counts = {True: [[SMOOTHING] * width for _ in range(width)], False: [[SMOOTHING] * width for _ in range(width)]}
    for r in pairs.groupBy("secret", "pair").agg(F.count(F.lit(1)).alias("n")).collect():  # at most 2 * 66 * 66 rows
        a, b = (ALPHABET.find(c) + 1 for c in r["pair"])
        counts[r["secret"]][a][b] += r["n"]
    ratios = [
        math.log(counts[True][a][b] / sum(counts[True][a])) - math.log(counts[False][a][b] / sum(counts[False][a]))
        for a in range(width)
        for b in range(width)
    ]
    score = Markov(ratios, 0.0).score(F.col("token"))
    marks = (
        tokens.select("secret", score.alias("score"), F.char_length("token").alias("n"))
        .groupBy("secret")
        .agg(F.percentile_approx("score", F.lit(0.9999), F.lit(10_000)).alias("high"), F.percentile_approx("score", F.lit(0.05)).alias("low"))
    )
    rows = {r["secret"]: r for r in marks.collect()}
    ordinary = max(0.0, rows[False]["high"]) if False in rows else 0.0
    random = rows[True]["low"] if True in rows else ordinary + 2.0
    return Markov(ratios, max(ordinary, (ordinary + random) / 2))


def all_spans(text: Column, base: Column, model: Markov) -> Column:
    """Base spans and, between them, random strings, by start and then kind."""
    text = F.coalesce(text, F.lit(""))
    long_token = f"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_RANDOM},}}"
    apart = F.filter(
        F.filter(_located(text, long_token), lambda m: model.score(m["value"]) > model.threshold),
        lambda m: ~F.exists(base, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])),
    )
    added = F.when(text.rlike(long_token), _spans("random", apart)).otherwise(_none())
    return F.array_sort(F.concat(base, added.cast(SPAN)))


def joined(spans: Column) -> Column:
    """Text form of spans: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, model: Markov, base: str, spans: str) -> DataFrame:
    """``docs`` with two array columns: the base spans, and all spans."""
    out = docs.withColumn(base, base_spans(F.col("text")))
    return out.withColumn(spans, all_spans(F.col("text"), F.col(base), model))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark`` (overlapping spans by one) and n_chars counted anew."""
    base, spans = fresh(docs, "base_spans"), fresh(docs, "all_spans")
    model = train(labelled_tokens(docs))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("upto"))
    text = F.col("text")

    def cut(start: Column, end: Column) -> Column:
        return F.substring(text, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        extended = F.struct(acc["out"].alias("out"), F.greatest(acc["upto"], s["end"]).alias("upto"))
        opened = F.struct(F.concat(acc["out"], cut(acc["upto"], s["start"]), F.lit(mark)).alias("out"), s["end"].alias("upto"))
        return F.when((s["start"] < acc["upto"]), extended).otherwise(opened)

    done = F.aggregate(F.col(spans), zero, step)
    cleaned = F.concat(done["out"], cut(done["upto"], _length(text)))
    out = scan(docs, model, base, spans)
    out = out.withColumn("text", F.when(F.size(spans) > 0, cleaned).otherwise(text)).drop(base, spans)
    return out.withColumn("n_chars", F.when(text.isNotNull(), _length(text)).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out
