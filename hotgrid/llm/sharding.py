"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` equal cells. Virtual nodes of every shard sit on hashed cells; a key belongs to the next node
clockwise of its cell. Every shard has a capacity, and the capacities add up to the number of rows, one apart at most. A
shard first takes the keys of its own arcs; keys that find it full continue clockwise to the next node with room. So
counts are balanced exactly, and only overflow and the arcs of a new shard move when shards are added.

Only counts per cell, at most ``CELLS`` of them, reach the driver, where the overflow is settled; rows are ranked within
their cell. A null text counts as no bytes; a null id is placed by its text and row; repeated ids share a cell.
"""

import hashlib
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotgrid.llm.links import stage

CELLS = 1 << 13
NODES = 64
LAW = "rows"


def ring(n_shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes, clockwise. A cell that is taken already passes a node on to the next free one.

    Shards take cells one after the other, so a further shard leaves all nodes of the others where they are.
    """
    taken: dict[int, int] = {}
    for shard in range(n_shards):
        for node in range(nodes):
            cell = int.from_bytes(hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest(), "big") % CELLS
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = shard
    return sorted(taken.items())


def capacities(rows: int, n_shards: int) -> list[int]:
    return [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]


def settle(counts: dict[int, int], n_shards: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first) for all keys of all cells."""
    nodes = ring(n_shards)
    room = capacities(sum(counts.values()), n_shards)
    used: dict[int, int] = defaultdict(int)

    def give(cell: int, rank: int, n: int, shard: int) -> Iterator[tuple[int, int, int, int, int]]:
        if n:
            yield cell, rank, rank + n, shard, used[shard]
            used[shard] += n
            room[shard] -= n

    over: list[tuple[int, int, int, int]] = []
    at = 0
    for cell in sorted(counts):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        owner = at % len(nodes)
        shard = nodes[owner][1]
        n = min(counts[cell], room[shard])
        yield from give(cell, 0, n, shard)
        if n < counts[cell]:
            over.append((cell, n, counts[cell] - n, owner))
    for cell, rank, left, owner in over:
        while left:
            shard = nodes[owner % len(nodes)][1]
            n = min(left, room[shard])
            yield from give(cell, rank, n, shard)
            rank, left, owner = rank + n, left - n, owner + 1


def assign(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot) of every row; slots of a shard run from 0 without gaps."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text", F.monotonically_increasing_id()))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("place")
    )
    rows = stage(rows.withColumn("cell", F.pmod("place", F.lit(CELLS)).cast("int")), "placed")
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # CELLS rows at most
    parts = rows.sparkSession.createDataFrame(
        list(settle(counts, n_shards)), "cell int, first bigint, end bigint, shard int, slot bigint"
    )
    order = Window.partitionBy("cell").orderBy("place", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("bigint") - 1)
    met = ranked.join(F.broadcast(parts), "cell").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return met.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("slot") + F.col("rank") - F.col("first")).alias("slot")
    )
