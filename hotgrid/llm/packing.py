"""Best-fit packing: a grouping genetic algorithm fills sequences of a fixed number of tokens.

Documents are tokenized and only longer ones are cut, into full pieces with the shorter one first. Full pieces are
sequences of their own. The others are dealt over shards of bounded size by a hash, so that copies and long documents
spread. Each shard is one packing problem, on which several islands breed packings (Falkenauer 1996): crossover injects
whole well-filled bins of one parent into the other, removes duplicates, dissolves the bins that lost documents and
best-fits what was displaced. Between epochs each island's elite migrates to the next island; the best packing wins.

A null text is packed like an empty one (its closing id alone); repeated rows are packed each; no row is dropped.
"""

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotgrid.llm.links import stage
from hotgrid.llm.text import small_batches

CAPACITY = 2048
END_ID = 0
SHARD_PIECES = 4096
ISLANDS, POPULATION, EPOCHS, CHILDREN = 2, 4, 2, 5
WELL_FILLED = 0.98


def vocabulary() -> str:
    """Path of the vocabulary file used unless another is named."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


class Encoder:
    """Ids of a byte-level BPE vocabulary file of the tokenizers library.

    Where ids rank the merges, as in this kind of file, the same ids come faster from tiktoken; texts with one of the
    file's special strings, or that it refuses, take the tokenizers library itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = [t["content"] for t in file["added_tokens"]]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in printable}
        chars |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(chars[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            try:
                return np.array(self.fast.encode_ordinary(text), np.uint32)
            except Exception:  # a pattern limit of the faster library, on unusual texts
                pass
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than the capacity."""
    first = length % capacity or capacity
    starts = [0, *range(first, length, capacity)]
    return [(s, (first if s == 0 else capacity)) for s in starts]


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every document, tokenized whole, with ``END_ID`` at its end."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        for batch in small_batches(batches):
            rows: list[tuple[int, int, int, int, int]] = []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                rows += [(i, p, s, n, zlib.crc32(ids[s : s + n].tobytes())) for p, (s, n) in enumerate(cut(len(ids), capacity))]
            table = np.array(rows, np.int64)
            columns = [batch.column(0).take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(table[:, c]) for c in (2, 3, 4)]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        tokenize, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def best_fit(lengths: list[int], items: list[int], bins: np.ndarray, fills: list[int], capacity: int) -> None:
    """Puts ``items`` (longest first) where they leave least room, opening bins as needed; fills in ``bins``."""
    open_bins: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if some bin has room r
    for b, fill in enumerate(fills):
        room = capacity - fill
        if room > 0:
            open_bins.setdefault(room, []).append(b)
            rooms |= 1 << room
    for i in items:
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            stack = open_bins[room]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i] = b
        fills[b] += n
        room -= n
        if room > 0:
            open_bins.setdefault(room, []).append(b)
            rooms |= 1 << room


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    fills = np.bincount(bins, weights=lengths)
    return -len(fills), float(((fills / capacity) ** 2).mean()) if len(fills) else 0.0


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of ``b`` with some well-filled bins of ``a``: bins of ``b`` that lose documents to them are dissolved."""
    fills = np.bincount(a, weights=lengths)
    well = np.flatnonzero(fills >= WELL_FILLED * capacity)
    well = well[rng.random(len(well)) < rng.uniform(0.05, 0.3)]
    injected = np.isin(a, well)
    kept = np.ones(int(b.max()) + 1, bool)
    kept[b[injected]] = False
    poor = np.bincount(b, weights=lengths, minlength=len(kept)) < WELL_FILLED * capacity
    kept &= ~(poor & (rng.random(len(kept)) < 0.5))
    stays = kept[b] & ~injected
    child = np.full(len(a), -1, np.int64)
    _, child[injected] = np.unique(a[injected], return_inverse=True)
    n = int(child.max()) + 1
    if stays.any():
        _, child[stays] = np.unique(b[stays], return_inverse=True)
        child[stays] += n
    placed = child >= 0
    new_fills = np.bincount(child[placed], weights=lengths[placed]).astype(np.int64).tolist() if placed.any() else []
    displaced = np.flatnonzero(~placed)
    noise = rng.uniform(0.9, 1.0, len(displaced))
    order = displaced[np.argsort(-lengths[displaced] * noise, kind="stable")]
    best_fit(lengths.tolist(), order.tolist(), child, new_fills, capacity)
    return child


def first_packing(lengths: np.ndarray, capacity: int, rng: np.random.Generator | None) -> np.ndarray:
    """Best-fit decreasing, in exact order or, with ``rng``, in a slightly shuffled one."""
    keys = -lengths.astype(float) * (1 if rng is None else rng.uniform(0.85, 1.0, len(lengths)))
    bins = np.full(len(lengths), -1, np.int64)
    best_fit(lengths.tolist(), np.argsort(keys, kind="stable").tolist(), bins, [], capacity)
    return bins


def breed(lengths: np.ndarray, population: list[np.ndarray], capacity: int, seed: int) -> list[np.ndarray]:
    """One epoch of an island: a population with the best first. It ends early at the least number of bins possible."""
    rng = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // capacity)
    while len(population) < POPULATION:
        population.append(first_packing(lengths, capacity, None if not population and seed % ISLANDS == 0 else rng))
    scored = sorted(((fitness(lengths, p, capacity), i, p) for i, p in enumerate(population)), key=lambda x: x[:2], reverse=True)
    serial = len(scored)
    for _ in range(CHILDREN):
        if -scored[0][0][0] <= least:
            break
        i, j = rng.choice(len(scored), 2, replace=False)
        child = crossover(lengths, scored[i][2], scored[j][2], capacity, rng)
        serial += 1
        scored = sorted([*scored, (fitness(lengths, child, capacity), serial, child)], key=lambda x: x[:2], reverse=True)[:POPULATION]
    return [p for _, _, p in scored]


def _epoch(islands: DataFrame, epoch: int, capacity: int) -> DataFrame:
    """Breeds every island (shard, island, lengths, population) on, each a row of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                population = [np.frombuffer(p, "<u2").astype(np.int64) for p in row["population"] if p is not None]
                out = breed(lengths, population, capacity, (row["shard"] * EPOCHS + epoch) * ISLANDS + row["island"])
                bins, quality = fitness(lengths, out[0], capacity)
                row |= {"population": [p.astype("<u2").tobytes() for p in out], "bins": -bins, "quality": quality}
                yield pa.RecordBatch.from_pylist([row], schema=kind)

    kind = pa.schema(
        [
            ("shard", pa.int64()), ("island", pa.int32()), ("lengths", pa.list_(pa.int32())), ("population", pa.list_(pa.binary())),
            ("bins", pa.int64()), ("quality", pa.float64()),
        ]
    )
    spread = islands.repartition("shard", "island").select("shard", "island", "lengths", "population")
    ddl = "shard bigint, island int, lengths array<int>, population array<binary>, bins bigint, quality double"
    return stage(spread.mapInArrow(run, ddl), "islands")


def packed(open_pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(uid, sequence_id, offset) for pieces (uid, length) shorter than the capacity; uid is unique."""
    count = open_pieces.count()
    n_shards = max(1, -(-count // shard_pieces))
    dealt = open_pieces.select(F.pmod(F.xxhash64("uid"), F.lit(n_shards)).alias("shard"), "uid", "length")
    shards = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("l"), "uid"))).alias("items"))
    shards = shards.select("shard", F.expr("transform(items, x -> int(-x.l))").alias("lengths"), F.expr("transform(items, x -> x.uid)").alias("uids"))
    shards = stage(shards, "shards")
    islands = shards.select(
        "shard",
        F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
        "lengths",
        F.array().cast("array<binary>").alias("population"),
    )
    state = _epoch(islands, 0, capacity)
    for epoch in range(1, EPOCHS):
        elite = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("population")[0].alias("guest"))
        joined = state.join(elite, ["shard", "island"])
        moved = joined.withColumn("population", F.concat(F.slice("population", 1, POPULATION - 1), F.array("guest")))
        state = _epoch(moved, epoch, capacity)
    order = Window.partitionBy("shard").orderBy("bins", F.desc("quality"), "island")
    best = state.withColumn("place", F.row_number().over(order)).where("place = 1").select("shard", F.col("population")[0].alias("packing"))

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bins = np.frombuffer(row["packing"], "<u2").astype(np.int64)
                lengths = np.array(row["lengths"], np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(lengths[order])
                first = np.searchsorted(bins[order], bins[order])
                offsets = ends - lengths[order] - (ends - lengths[order])[first]
                columns = [np.array(row["uids"], np.int64)[order], (row["shard"] << 16) + bins[order], offsets]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["uid", "sequence_id", "offset"])

    return shards.join(best, "shard").select("shard", "lengths", "uids", "packing").mapInArrow(lay_out, "uid bigint, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stage(pieces_of(docs, path, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    open_pieces = pieces.where(F.col("length") < capacity)
    full = pieces.where(F.col("length") == capacity)
    # full pieces take negative ids, shards the others
    alone = full.withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("bigint"))
    shared = open_pieces.join(packed(open_pieces.select("uid", "length"), capacity), "uid")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return alone.select(columns).unionByName(shared.select(columns))
