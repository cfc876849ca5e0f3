"""Quality rules: an isolation forest over rule statistics finds anomalous documents.

Random trees split rule statistics at random points; a text that few splits isolate is anomalous (Liu, Ting, Zhou 2008).
Each tree is grown on ``TREE_ROWS`` rows of its own, as the method has it, drawn from all labelled documents. All labelled
documents calibrate the forest: which statistics it looks at (added while they find more of the bad rows), and the score
from which a document is anomalous (nearly all good rows must stay below it). Scores have ``GRID`` steps, so that the exact
counts of every score are a small table, however many rows there are.
"""

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotgrid.llm import stats
from hotgrid.llm.links import fresh, stage

TREES, TREE_ROWS, DEPTH = 128, 512, 9
TRIAL_TREES = 48
GRID = 1 << 16
STATISTICS = ("symbols", "repeats", "dup_lines", "punctuation", "upper", "word_length", "distinct", "digits")
PRIOR_WORDS = 20  # added to every denominator, so that short texts are not extreme by chance
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
CLEAN_LOSS = 0.0005
SEED = 7


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random tree of ``n`` rows."""
    n = np.maximum(n, 1).astype(float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def statistics_of(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The ``STATISTICS`` of each text, one row per text."""
    c, words = counts, counts["n_words"] + PRIOR_WORDS
    chars = c["word_chars"] + 5 * PRIOR_WORDS
    parts = [
        c["n_symbols"] / words, c["n_repeat_words"] / words, c["n_dup_lines"] / (c["n_lines"] + PRIOR_WORDS / 5),
        c["n_punct"] / words, c["n_upper"] / chars, chars / words, c["n_distinct"] / words, c["n_digits"] / words,
    ]
    return np.stack(parts, axis=1)


@dataclass(frozen=True)
class Forest:
    """Trees in heap order: children of node i are 2i+1 and 2i+2; a leaf has feature -1 and its path length."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    usual: float
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / usual path): near 1 for isolated rows, below 0.5 for ordinary ones."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[rows, np.maximum(f, 0)] >= split[node]))
            total += path[node]
        return np.round(2.0 ** (-total / len(self.feature) / max(self.usual, 1e-9)) * GRID) / GRID


def grow(x: np.ndarray, using: list[int], trees: int = TREES, seed: int = SEED) -> Forest:
    """A forest over the columns ``using`` of ``x``, without a threshold. No rows give one that scores all alike."""
    rng = np.random.default_rng(seed)
    apart = len(x) >= trees * TREE_ROWS
    nodes = 2 ** (DEPTH + 1) - 1
    feature, split = np.full((trees, nodes), -1), np.zeros((trees, nodes))
    path = np.zeros((trees, nodes))
    size = min(TREE_ROWS, len(x))
    for t in range(trees):
        open_nodes = [(0, 0, x[t * size : (t + 1) * size] if apart else x[rng.choice(len(x), size, replace=False)] if size else x)]
        while open_nodes:
            node, depth, rows = open_nodes.pop()
            low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
            wide = [f for f in using if len(rows) and high[f] > low[f]]
            if depth == DEPTH or len(wide) == 0:
                path[t, node] = depth + mean_path(np.array([len(rows)]))[0]
                continue
            f = rng.choice(wide)
            at = rng.uniform(low[f], high[f])
            feature[t, node], split[t, node] = f, at
            right = rows[:, f] >= at
            open_nodes += [(2 * node + 1, depth + 1, rows[~right]), (2 * node + 2, depth + 1, rows[right])]
    return Forest(feature, split, path, float(mean_path(np.array([size]))[0]), np.inf)


def quantile(scores: np.ndarray, counts: np.ndarray, q: float) -> float:
    """The ``q``-quantile of rising ``scores`` that occur ``counts`` times, between neighbours by share."""
    upto = np.cumsum(counts)
    place = q * (upto[-1] - 1)
    low, high = (float(scores[np.searchsorted(upto, at, "right")]) for at in (int(np.floor(place)), int(np.ceil(place))))
    return low + (high - low) * (place - np.floor(place))


def calibrate(scores: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """Threshold half-way between the scores nearly all good rows stay below and those most bad rows exceed.

    ``good`` and ``bad`` count the rows of each of the rising ``scores``. Where the two overlap it is the former; without good
    or bad rows nothing is anomalous.
    """
    if not good.sum() or not bad.sum():
        return float("inf")
    top = quantile(scores, good, 1 - CLEAN_LOSS)
    above = np.where(scores > top, bad, 0)
    return (top + quantile(scores, above, 0.05)) / 2 if above.sum() else top


def score_counts(rows: DataFrame, forests: list[Forest]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(scores, good rows, bad rows) of each forest over all ``rows`` (label, x): at most ``GRID`` + 1 scores each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).to_numpy().astype(np.int64)
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS))
            for f, forest in enumerate(forests):
                step = np.round(forest.score(x) * GRID).astype(np.int64)
                keys, n = np.unique(2 * step + label, return_counts=True)
                parts = [np.full(len(keys), f), keys // 2, keys % 2, n]
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)) for p in parts], ["forest", "step", "label", "n"])

    found = rows.select("label", "x").mapInArrow(count, "forest bigint, step bigint, label bigint, n bigint")
    table = found.groupBy("forest", "step").agg(
        F.sum(F.expr("if(label = 1, n, 0)")).alias("good"), F.sum(F.expr("if(label = 0, n, 0)")).alias("bad")
    ).toArrow().sort_by([("forest", "ascending"), ("step", "ascending")])
    forest, step, good, bad = (table[c].to_numpy() for c in ("forest", "step", "good", "bad"))
    return [(step[forest == f] / GRID, good[forest == f], bad[forest == f]) for f in range(len(forests))]


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PCT * counts["n_words"])


def choose_statistics(rows: DataFrame, x: np.ndarray, both: bool) -> list[int]:
    """Columns whose forest, grown on ``x``, finds most bad ones of ``rows`` while nearly all good ones stay; all columns unless
    there are rows of ``both`` labels."""
    if not both:
        return list(range(len(STATISTICS)))
    chosen: list[int] = []
    found = -1.0
    while found < 1:
        open_ones = sorted(set(range(len(STATISTICS))) - set(chosen))
        trials = []
        counted = score_counts(rows, [grow(x, [*chosen, f], TRIAL_TREES) for f in open_ones])
        for f, (scores, good, bad) in zip(open_ones, counted, strict=True):
            trials.append((float(bad[scores > calibrate(scores, good, bad)].sum() / bad.sum()), -f))
        if not trials or max(trials)[0] <= found:
            break
        found, f = max(trials)
        chosen.append(-f)
    return chosen


def fit(docs: DataFrame, labels: DataFrame) -> Forest:
    """Forest and threshold from all labelled documents that pass the base rules; each tree from ``TREE_ROWS`` of them."""

    @F.arrow_udf("array<double>")
    def ratios(counts: pa.Array) -> pa.Array:
        x = statistics_of({c: counts.field(c).to_numpy() for c in stats.COUNTS})
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(STATISTICS), pa.int32()), pa.array(x.ravel()))

    rows = stats.labelled(docs, labels, "quality")
    short, repeats = F.col("counts.n_words") < MIN_WORDS, 100 * F.col("counts.n_repeat_words") > MAX_REPEAT_PCT * F.col("counts.n_words")
    rows = stage(rows.where(~(short | repeats)).select("doc_id", "label", ratios("counts").alias("x")), "labelled")
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    # rows for all trees, in an order of their own: by a hash, ties by the id
    picked = rows.select("doc_id", "x", F.xxhash64("doc_id", F.lit(SEED)).alias("h")).orderBy("h", "doc_id").limit(TREES * TREE_ROWS)
    picked = picked.toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    x = np.array(picked["x"].combine_chunks().flatten().to_numpy()).reshape(-1, len(STATISTICS))
    forest = grow(x, choose_statistics(rows, x, len(n) == 2))
    counted = score_counts(rows, [forest])[0]
    return replace(forest, threshold=calibrate(*counted))


def judge(docs: DataFrame, forest: Forest, verdict: str) -> DataFrame:
    """``docs`` with a struct column ``verdict``: counts, base_failed, anomaly score and kept.

    A null text has no words, so it fails the base rules like an empty or short one. All other columns stay.
    """
    kind = stats.STRUCT[:-1] + ",base_failed:boolean,score:double,kept:boolean>"

    @F.arrow_udf(kind)
    def decide(texts: pa.Array) -> pa.Array:
        counts = stats.counts_of(texts)
        failed = base_failed(counts)
        score = forest.score(statistics_of(counts))
        parts = [pa.array(counts[c], pa.int64()) for c in stats.COUNTS]
        parts += [pa.array(failed), pa.array(score), pa.array(~failed & (score <= forest.threshold))]
        return pa.StructArray.from_arrays(parts, [*stats.COUNTS, "base_failed", "score", "kept"])

    return docs.withColumn(verdict, decide(F.col("text")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass the base rules and the forest, with all their columns."""
    verdict = fresh(docs, "verdict")
    return judge(docs, fit(docs, labels), verdict).where(F.col(verdict)["kept"]).drop(verdict)
