"""Lattice operators: snapping, cell aggregates, neighbourhoods."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hotgrid import settings as S
from hotgrid.functions import spatial


def lattice(spark: SparkSession) -> DataFrame:
    """Every node of the lattice with its position."""
    cells = spark.range(S.N_LAT * S.N_LON).withColumnRenamed("id", "cell_id")
    return with_position(cells)


def with_position(cells: DataFrame) -> DataFrame:
    return cells.withColumn("cell_lat", spatial.cell_lat(F.col("cell_id"))).withColumn(
        "cell_lon", spatial.cell_lon(F.col("cell_id"))
    )


def inside_box(
    lat: Column,
    lon: Column,
    box: tuple[float, float, float, float] = (S.LAT_MIN, S.LAT_MAX, S.LON_MIN, S.LON_MAX),
) -> Column:
    """True inside the box, borders included; false for missing positions."""
    return F.coalesce(lat.between(box[0], box[1]) & lon.between(box[2], box[3]), F.lit(False))


def box_report(incidents: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """One row: kept and dropped incident counts of the box filter."""
    ok = inside_box(F.col("latitude"), F.col("longitude"), box)
    return incidents.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


def active_cells(incidents: DataFrame, min_cases: int = S.MIN_CASES_PER_CELL) -> DataFrame:
    """Cells with at least ``min_cases`` incidents."""
    counts = incidents.groupBy("cell_id").agg(F.count(F.lit(1)).alias("total_cases"))
    return counts.where(F.col("total_cases") >= min_cases)


def cell_profile(incidents: DataFrame) -> DataFrame:
    """Totals, severity counts, category variety and mean position per cell."""
    sev = F.col("severity_id")
    return incidents.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(sev == 1).alias("severe_cases"),
        F.count_if(sev == 2).alias("standard_cases"),
        F.count_if(sev == 3).alias("minor_cases"),
        F.count_distinct("category_id").alias("n_types"),
        F.avg("latitude").alias("mean_lat"),
        F.avg("longitude").alias("mean_lon"),
    )


def cells_within(cells: DataFrame, radius_km: float, group: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Pairs (cell_id, nbr_id, km) of listed cells at most ``radius_km`` apart, the cell itself included.

    The lattice bounds the number of offsets that can be in reach, so candidates are computed from the
    cell id, filtered by exact distance, and only then matched against the listed cells: one equi-join.
    """
    reach_i = math.floor(radius_km / (math.radians(1 / S.NODES_PER_DEG_LAT) * S.EARTH_RADIUS_KM))
    narrow = math.cos(math.radians(S.LAT_MAX)) * math.radians(1 / S.NODES_PER_DEG_LON) * S.EARTH_RADIUS_KM
    reach_j = math.floor(radius_km / narrow) + 1
    offsets = F.array(
        *[
            F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj"))
            for di in range(-reach_i - 1, reach_i + 2)
            for dj in range(-reach_j, reach_j + 1)
        ]
    )
    group = list(group)
    cell = F.col("cell_id")
    i, j = spatial.cell_row(cell) + F.col("o.di"), spatial.cell_col(cell) + F.col("o.dj")
    candidates = (
        cells.select(*group, "cell_id")
        .select("*", F.explode(offsets).alias("o"))
        .where(i.between(0, S.N_LAT - 1) & j.between(0, S.N_LON - 1))
        .select(*group, "cell_id", (i * S.N_LON + j).cast("bigint").alias("nbr_id"))
        .withColumn(
            "km",
            spatial.haversine_km(
                spatial.cell_lat(cell),
                spatial.cell_lon(cell),
                spatial.cell_lat(F.col("nbr_id")),
                spatial.cell_lon(F.col("nbr_id")),
            ),
        )
        .where(F.col("km") <= radius_km)
    )
    present = cells.select(*group, F.col("cell_id").alias("nbr_id"), *[F.col(c).alias(f"nbr_{c}") for c in carry])
    return candidates.join(present, [*group, "nbr_id"])


KNN_SIZES = (3, 6, 12, 24, 48, 96, 192, 384)


def nearest_cells(
    cells: DataFrame, k: int, group: Sequence[str] = (), carry: Sequence[str] = (), sizes: Sequence[int] = KNN_SIZES
) -> DataFrame:
    """The ``min(k, n-1)`` nearest other listed cells of each cell, by (distance in degrees, cell id).

    Each cell first picks the smallest square tile around it that holds more than ``k`` listed cells:
    its k-th neighbour is then no farther than the tile's diagonal. It searches the 3x3 block of tiles
    just wide enough to contain everything that near, so one equi-join on (size, tile) finds all
    candidates and the result is exact. Cells no tile satisfies search the whole lattice.
    """
    group = list(group)
    key = [*group, "cell_id"]
    lat_step, lon_step = S.NODES_PER_DEG_LON, S.NODES_PER_DEG_LAT  # degree distance scaled by 111 * 107
    diagonal = math.hypot(lat_step, lon_step)
    whole = max(S.N_LAT, S.N_LON)
    levels = [(b, math.ceil(diagonal * (b - 1) / min(lat_step, lon_step))) for b in sizes] + [(whole, whole)]
    level_list = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(t).alias("t")) for b, t in levels])

    base = cells.select(
        *key,
        *carry,
        spatial.cell_row(F.col("cell_id")).alias("i"),
        spatial.cell_col(F.col("cell_id")).alias("j"),
    )
    tile = [F.floor(F.col("i") / F.col("l.b")).alias("bi"), F.floor(F.col("j") / F.col("l.b")).alias("bj")]
    spread = base.select("*", F.explode(level_list).alias("l")).select("*", *tile)
    in_tile = Window.partitionBy(*group, "l", "bi", "bj")
    fits = (F.count(F.lit(1)).over(in_tile) > k) | (F.col("l.b") == whole)
    seekers = (
        spread.withColumn("fits", fits)
        .where("fits")
        .groupBy(*key)
        .agg(F.min("l").alias("l"), *[F.first(c).alias(c) for c in ("i", "j", *carry)])
    )
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    seekers = seekers.select("*", F.col("l.t").alias("t"), F.explode(around).alias("o")).select(
        *key,
        *carry,
        "i",
        "j",
        "t",
        (F.floor(F.col("i") / F.col("t")) + F.col("o.a")).alias("ti"),
        (F.floor(F.col("j") / F.col("t")) + F.col("o.b")).alias("tj"),
    )
    holders = base.select("*", F.explode(F.array(*[F.lit(t) for _, t in levels])).alias("t")).select(
        *group,
        "t",
        F.floor(F.col("i") / F.col("t")).alias("ti"),
        F.floor(F.col("j") / F.col("t")).alias("tj"),
        F.col("cell_id").alias("nbr_id"),
        F.col("i").alias("ni"),
        F.col("j").alias("nj"),
        *[F.col(c).alias(f"nbr_{c}") for c in carry],
    )
    d2 = F.pow((F.col("i") - F.col("ni")) * lat_step, 2) + F.pow((F.col("j") - F.col("nj")) * lon_step, 2)
    return (
        seekers.join(holders, [*group, "t", "ti", "tj"])
        .where(F.col("cell_id") != F.col("nbr_id"))
        .withColumn("d2", d2.cast("bigint"))
        .withColumn("nbr_rank", F.row_number().over(Window.partitionBy(*key).orderBy("d2", "nbr_id")))
        .where(F.col("nbr_rank") <= k)
        .select(*key, *carry, "nbr_id", "d2", "nbr_rank", *[f"nbr_{c}" for c in carry])
    )
