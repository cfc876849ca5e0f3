"""Helpers shared by the operators on pairs: staged tables, bounded filters, connected components."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotgrid.session import cut_lineage, free_shuffles

MAX_FILTER_BITS = 1 << 27
ARROW_BYTES = "4m"
_ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def stage(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet to the shared scratch folder and reads it back: lineage ends there.

    ``free`` has Spark delete what it shuffled for it. Meanwhile Arrow batches are at most ``ARROW_BYTES`` large, as each is held by the JVM and by its Python worker at once.
    """
    conf = df.sparkSession.conf
    before = conf.get(_ARROW_LIMIT)
    conf.set(_ARROW_LIMIT, ARROW_BYTES)
    try:
        out = cut_lineage(df, name)
    finally:
        conf.set(_ARROW_LIMIT, before)
    if free:
        free_shuffles(df.sparkSession)
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    x = keys.view(np.uint64)
    out = []
    for seed in _SEEDS:
        h = (x ^ (x >> np.uint64(29))) * np.uint64(seed)
        out.append((h ^ (h >> np.uint64(32))) & np.uint64(bits - 1))
    return out


def key_filter(keys: DataFrame, column: str, count: int) -> Broadcast:
    """A Bloom filter of the long ``column``, of at most ``MAX_FILTER_BITS`` bits (16 MB), built on the executors.

    It has false positives only: with more keys than it can hold, it lets more rows through and no result changes.
    """
    bits = min(MAX_FILTER_BITS, 1 << max(12, int(10 * max(count, 1)).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            for slot in _slots(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits):
                np.bitwise_or.at(flags, slot >> np.uint64(6), np.uint64(1) << (slot & np.uint64(63)))
        packed = flags.view(np.int64)
        used = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(packed[used])], ["word", "bits"])

    words = (
        keys.where(F.col(column).isNotNull())
        .select(F.col(column).cast("bigint"))
        .mapInArrow(build, "word bigint, bits bigint")
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(table)


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that the filter holds (all true members, and a few others)."""
    bits = len(table) * 64
    out = np.ones(len(keys), bool)
    for slot in _slots(keys, bits):
        out &= (table[slot >> np.uint64(6)] >> (slot & np.uint64(63)).view(np.int64)) & 1 == 1
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for every node that has an edge.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends by doubling, and contracts the
    edges to those ends. Within two rounds an end hooks or takes in another one, so rounds and doublings are logarithmic
    whatever the order of the ids, and neither needs a limit. Tables are staged; a busy node's rows are pre-aggregated.
    """
    edges = edges.select("a", "b").where("a <> b")
    both = stage(edges.union(edges.select("b", "a")).distinct(), "links")
    labels = None
    while True:
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("end"))
        hooks, open_rows = stage(hooks, "hooks"), 1
        while open_rows:
            ends = hooks.select(F.col("node").alias("end"), F.col("end").alias("further"))
            hooks = stage(hooks.join(ends, "end").select("node", F.col("further").alias("end"), (F.col("end") > F.col("further")).alias("moved")), "hooks")
            open_rows = hooks.where("moved").limit(1).count()
            hooks = hooks.drop("moved")
        if labels is None:
            labels = hooks.withColumnRenamed("end", "component")
        else:
            step = hooks.withColumnRenamed("node", "component")
            labels = stage(labels.join(step, "component", "left").select("node", F.coalesce("end", "component").alias("component")), "labels")
        a, b = (hooks.select(F.col("node").alias(c), F.col("end").alias(f"end_{c}")) for c in "ab")
        both = both.join(a, "a").join(b, "b").where("end_a <> end_b")
        both = stage(both.select(F.col("end_a").alias("a"), F.col("end_b").alias("b")).distinct(), "links")
        if not both.limit(1).count():
            return labels
