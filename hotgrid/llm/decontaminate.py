"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is ``size`` consecutive words of a benchmark item (the whole item if it is shorter) and must be contained whole.
A containment of 1 needs a prefix of one token, so each window is joined on its rarest shingle alone. Rarity is counted
over all documents, for the benchmark's shingles only. A document position that holds the shingle fixes where the window
would have to start and end: the bounds of the text rule out the rest, and what remains is compared word by word.

The benchmark is broadcast in blocks of a bounded number of words; with several blocks their hits are merged per
document. A null or wordless text has no windows and no hits; equal items are all reported.
"""

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotgrid.llm.links import fresh
from hotgrid.llm.text import ALNUM, U64, blocks, windows

WINDOW = 10
SHINGLE = 3
BLOCK_WORDS = 2_000_000  # of the benchmark that one pass over the documents carries along


@dataclass
class Windows:
    """Windows of one block of items: their words, and every item that has them."""

    items: dict[tuple[bytes, ...], list[int]] = field(default_factory=lambda: defaultdict(list))

    def add(self, item_id: int, words: list[bytes], size: int) -> None:
        for i in range(max(1, len(words) - size + 1) if words else 0):
            owners = self.items[tuple(words[i : i + size])]
            if item_id not in owners:
                owners.append(item_id)


def split_words(texts: pa.Array) -> Iterator[list[bytes]]:
    """Words of each text: runs of digits, letters and bytes of non-ASCII characters, with A-Z lowered."""
    for block in blocks(texts):
        starts, ends, bounds = block.spans(ALNUM)
        for i in range(block.size):
            at = range(bounds[i], bounds[i + 1])
            yield [block.raw(starts[j], ends[j]).lower() for j in at]


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` of the words, as ``windows`` gives them for a document."""
    block = next(blocks(pa.array([b" ".join(words).decode()])))
    starts, ends, bounds = block.spans(ALNUM)
    return windows(block.hashes(starts, ends, folded=True), bounds, k)[0]


def item_blocks(benchmark: DataFrame, size: int, block_words: int = BLOCK_WORDS) -> Iterator[Windows]:
    """The benchmark in blocks, streamed one partition at a time; only one block is in memory."""
    out, n = Windows(), 0
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    for row in items.toLocalIterator():
        words = next(split_words(pa.array([row["text"]])))
        out.add(row["item_id"], words, size)
        n += len(words)
        if n >= block_words:
            yield out
            out, n = Windows(), 0
    if out.items or not n:
        yield out


def shingle_counts(docs: DataFrame, wanted: dict[int, np.ndarray]) -> dict[int, dict[int, int]]:
    """How often the documents have each wanted shingle, by its number of words."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(len(v), np.int64) for k, v in shared.value.items()}
        for batch in batches:
            for block in blocks(batch.column(0)):
                starts, ends, bounds = block.spans(ALNUM)
                words = block.hashes(starts, ends, folded=True)
                for k, keys in shared.value.items():
                    found = windows(words, bounds, k)[0]
                    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    totals[k] += np.bincount(at[keys[at] == found], minlength=len(keys))
        for k, n in totals.items():
            used = np.flatnonzero(n)
            parts = [np.full(len(used), k), shared.value[k][used].view(np.int64), n[used]]
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)) for p in parts], ["k", "key", "n"])

    rows = docs.select("text").mapInArrow(count, "k bigint, key bigint, n bigint").groupBy("k", "key").agg(F.sum("n").alias("n"))
    out: dict[int, dict[int, int]] = {k: {} for k in wanted}
    for r in rows.toLocalIterator():  # at most one row per shingle of the block
        out[r["k"]][r["key"] & (2**64 - 1)] = r["n"]
    return out


def prefix_table(docs: DataFrame, block: Windows) -> dict[int, tuple[np.ndarray, list[list[tuple]]]]:
    """For each shingle length: sorted prefix shingles, and the windows (words, offset, items) that start from each."""
    by_k: dict[int, dict[tuple[bytes, ...], int]] = defaultdict(dict)
    for words in block.items:
        k = min(SHINGLE, len(words))
        for i in range(len(words) - k + 1):
            by_k[k][words[i : i + k]] = 0
    for k, shingles in by_k.items():
        for s in shingles:
            shingles[s] = int(shingle_hashes(list(s), k)[0])
    wanted = {k: np.unique(np.array(list(s.values()), U64)) for k, s in by_k.items()}
    counts = shingle_counts(docs, wanted) if wanted else {}
    starts: dict[int, dict[int, list[tuple]]] = {k: defaultdict(list) for k in by_k}
    for words, owners in block.items.items():
        k = min(SHINGLE, len(words))
        keys = [by_k[k][words[i : i + k]] for i in range(len(words) - k + 1)]
        offset = min(range(len(keys)), key=lambda i: (counts[k].get(keys[i], 0), i))
        if counts[k].get(keys[offset], 0):  # a window with a shingle that no document has occurs nowhere
            starts[k][keys[offset]].append((words, offset, owners))
    return {
        k: (np.array(sorted(t), U64), [t[key] for key in sorted(t)]) for k, t in starts.items() if t
    }


def contained(texts: pa.Array, table: dict[int, tuple[np.ndarray, list[list[tuple]]]]) -> pa.Array:
    """Per text: number of words, items with a window in it, and the word spans of those windows."""
    n_words: list[int] = []
    items: list[list[int]] = []
    spans: list[list[dict]] = []
    for block in blocks(texts):
        starts, ends, bounds = block.spans(ALNUM)
        words = block.hashes(starts, ends, folded=True)
        found_items: list[set[int]] = [set() for _ in range(block.size)]
        found_spans: list[set[tuple[int, int]]] = [set() for _ in range(block.size)]
        for k, (keys, entries) in table.items():
            shingles, at = windows(words, bounds, k)
            near = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
            hits = np.flatnonzero(keys[near] == shingles)
            owner = np.searchsorted(at, hits, "right") - 1
            for hit, text, entry in zip(hits.tolist(), owner.tolist(), near[hits].tolist(), strict=True):
                first, last = int(bounds[text]), int(bounds[text + 1])
                place = hit - int(at[text]) + first
                for window, offset, owners in entries[entry]:
                    low = place - offset
                    high = low + len(window)
                    if low < first or high > last:
                        continue
                    if all(block.raw(starts[j], ends[j]).lower() == w for j, w in zip(range(low, high), window, strict=True)):
                        found_items[text].update(owners)
                        found_spans[text].add((low - first, high - first))
        n_words += np.diff(bounds).tolist()
        items += [sorted(s) for s in found_items]
        spans += [[{"start": a, "end": b} for a, b in sorted(s)] for s in found_spans]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(spans, pa.list_(span))], ["n_words", "items", "spans"]
    )


HITS = "struct<n_words:bigint,items:array<bigint>,spans:array<struct<start:bigint,end:bigint>>>"


def _finder(table: Broadcast):
    @F.arrow_udf(HITS)
    def find(texts: pa.Array) -> pa.Array:
        return contained(texts, table.value)

    return find


def scan(docs: DataFrame, benchmark: DataFrame, hits: str, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with a struct column ``hits``: n_words, items (ids with a window in the text) and spans (word ranges)."""
    out = docs
    columns = []
    for block in item_blocks(benchmark, size, block_words):
        table = docs.sparkSession.sparkContext.broadcast(prefix_table(docs, block))  # of at most block_words windows
        columns.append(fresh(out, f"{hits}_{len(columns)}"))
        out = out.withColumn(columns[-1], _finder(table)(F.col("text")))
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(c)["items"] for c in columns]))))
    spans = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(c)["spans"] for c in columns]))))
    struct = F.struct(F.col(columns[0])["n_words"].alias("n_words"), items.alias("items"), spans.alias("spans"))
    return out.withColumn(hits, struct).drop(*[c for c in columns if c != hits])


def covered(spans: Column) -> Column:
    """Number of words in the union of sorted word spans."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))

    def step(acc: Column, s: Column) -> Column:
        fresh_words = F.greatest(s["end"] - F.greatest(s["start"], acc["upto"]), F.lit(0).cast("bigint"))
        return F.struct((acc["n"] + fresh_words).alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto"))

    return F.aggregate(spans, zero, step)["n"]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of any item occurs, with all their columns."""
    hits = fresh(docs, "hits")
    return scan(docs, benchmark, hits).where(F.size(F.col(hits)["spans"]) == 0).drop(hits)
