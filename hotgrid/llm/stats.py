"""Counts of every whole text that quality rules and the quality classifier are built on."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotgrid.llm.text import LINES, SPACED, Block, blocks, mix, windows

# One long per text each; see ``block_counts``.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_punct", "n_distinct", "n_wide", "longest_word",
)
STRUCT = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _tagged(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that also depend on the text they are in, and the index of that text."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return mix(hashes ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), owner


def _distinct_per_text(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    tagged, owner = _tagged(hashes, bounds)
    _, first = np.unique(tagged, return_index=True)
    return np.bincount(owner[first], minlength=len(bounds) - 1)


def block_counts(block: Block) -> dict[str, np.ndarray]:
    """All ``COUNTS`` of the texts of a block.

    Words are runs of bytes other than ASCII white space; a repeated word lies in a run of three words that the text
    has twice or more; a duplicate line has a word and equals an earlier line.
    """
    starts, ends, bounds = block.spans(SPACED)
    words = block.hashes(starts, ends)
    chars = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=chars[1:])
    lengths = chars[ends] - chars[starts]
    total = np.concatenate([[0], np.cumsum(lengths)])

    triples, at = windows(words, bounds, 3)
    repeated = np.zeros(len(words), bool)
    if len(triples):
        tagged, owner = _tagged(triples, at)
        _, back, count = np.unique(tagged, return_inverse=True, return_counts=True)
        first = np.arange(len(triples)) - at[owner] + bounds[owner]
        hit = first[count[back] > 1]
        for i in range(3):
            repeated[hit + i] = True
    marked = np.concatenate([[0], np.cumsum(repeated)])

    line_starts, line_ends, line_bounds = block.spans(LINES)
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    sums = np.concatenate([[0], np.cumsum(filled)])
    n_lines = np.diff(sums[line_bounds])
    lines = block.hashes(line_starts[filled], line_ends[filled])
    longest = np.zeros(block.size, np.int64)
    some = np.diff(bounds) > 0
    if some.any():
        longest[some] = np.maximum.reduceat(lengths, bounds[:-1][some])
    return {
        "n_words": np.diff(bounds),
        "word_chars": np.diff(total[bounds]),
        "n_symbols": block.per_text(_SYMBOL[block.data]),
        "n_dup_lines": n_lines - _distinct_per_text(lines, sums[line_bounds]),
        "n_repeat_words": np.diff(marked[bounds]),
        "n_lines": n_lines,
        "n_upper": block.per_text(_UPPER[block.data]),
        "n_digits": block.per_text(_DIGIT[block.data]),
        "n_punct": block.per_text(_PUNCT[block.data]),
        "n_distinct": _distinct_per_text(words, bounds),
        "n_wide": block.per_text(block.data >= 0xC0),
        "longest_word": longest,
    }


def counts_of(texts: pa.Array) -> dict[str, np.ndarray]:
    parts = [block_counts(b) for b in blocks(texts)]
    return {c: np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for c in COUNTS}


def counted(text: Column) -> Column:
    """Struct column of the counts of a text column."""

    @F.arrow_udf(STRUCT)
    def count(texts: pa.Array) -> pa.Array:
        counts = counts_of(texts)
        return pa.StructArray.from_arrays([pa.array(counts[c], pa.int64()) for c in COUNTS], list(COUNTS))

    return count(text)


RATIOS = (
    "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "words_per_line", "upper_share", "digit_share",
    "punct_per_word", "distinct_share", "wide_share", "longest_word",
)


def ratio_columns(c: Column) -> list[Column]:
    """The ``RATIOS`` as column expressions over a struct of counts; every ratio is 0 for a text without words."""
    words = F.greatest(c["n_words"], F.lit(1))
    chars = F.greatest(c["word_chars"], F.lit(1))
    lines = F.greatest(c["n_lines"], F.lit(1))
    values = [
        c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        c["n_words"] / lines, c["n_upper"] / chars, c["n_digits"] / chars, c["n_punct"] / words, c["n_distinct"] / words,
        c["n_wide"] / chars, c["longest_word"].cast("double"),
    ]
    return [v.alias(name) for v, name in zip(values, RATIOS, strict=True)]


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, max_rows: int) -> DataFrame:
    """(doc_id, label, counts) of at most about ``max_rows`` labelled documents, chosen by a hash of the id.

    Rows whose label is not 0 or 1 are ignored, of contradicting labels the smaller counts, and of repeated ids one row.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(target).cast("int").alias("label"))
    )
    share = min(1.0, max_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # max_rows bounds the broadcast side
    return texts.select("doc_id", "label", counted(F.col("text")).alias("counts")).dropDuplicates(["doc_id"])


def labelled(docs: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """(doc_id, label, counts) of every labelled document, by the rules of ``labelled_sample``; of a repeated id the text of smallest hash."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.min(target).cast("int").alias("label"))
    # counted before the join, so that no text is shuffled; few longs a text are
    counts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("h"), counted(F.col("text")).alias("counts"))
    rows = counts.join(known, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("h", "counts")).alias("c"))
    return rows.select("doc_id", "label", "c.counts")
