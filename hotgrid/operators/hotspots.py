"""Spatial hotspot statistics. Each runs for all layers and regions at once by grouping, not by looping."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotgrid import settings as S
from hotgrid.functions import labels
from hotgrid.operators import grid


def filter_incidents(
    incidents: DataFrame, category_id: int | None = None, region: str | None = None, dates: tuple | None = None
) -> DataFrame:
    """Optional category, region and inclusive time-range filters; all reach the scan."""
    out = incidents
    if category_id is not None:
        out = out.where(F.col("category_id") == category_id)
    if region is not None:
        out = out.where(F.col("region_name") == region)
    if dates is not None:
        out = out.where(F.col("ts").between(dates[0], dates[1]))
    return out


def layer_counts(incidents: DataFrame, per_region: bool = False, min_cases: int = S.MIN_CASES_PER_CELL) -> DataFrame:
    """Incidents per (layer[, region], cell) over the active grid; layers are 'overall' and every category.

    Counts per (cell, category) are made first; the activity test and the layer copy only touch those.
    """
    keys = ["region_name"] if per_region else []
    by_cat = incidents.groupBy("cell_id", *keys, "category_name").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("cell_id"))
    active = by_cat.withColumn("total", total).where(F.col("total") >= min_cases)
    if per_region:
        active = active.where(F.col("region_name").isNotNull())
    layered = active.select(
        *keys, "cell_id", "n", F.explode(F.array(F.lit("overall"), F.col("category_name"))).alias("layer")
    ).where(F.col("layer").isNotNull())
    return layered.groupBy("layer", *keys, "cell_id").agg(F.sum("n").alias("case_count"))


def drop_small_regions(
    counts: DataFrame, min_cells: int = 15, excluded: Sequence[str] = S.NON_TERRITORIAL
) -> DataFrame:
    """Keep (layer, region) groups with enough cells whose region has a territory."""
    sizes = counts.groupBy("layer", "region_name").agg(F.count(F.lit(1)).alias("n_cells"))
    keep = sizes.where((F.col("n_cells") >= min_cells) & ~F.col("region_name").isin(*excluded))
    return counts.join(keep.select("layer", "region_name"), ["layer", "region_name"], "left_semi")


def _with_group_stats(cells: DataFrame, counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Attach n, mean and sum of squares of the group; there are only as many groups as layers x regions."""
    stats = counts.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("case_count").alias("mean"),
        F.sum(F.col("case_count") * F.col("case_count")).alias("sum_sq"),
    )
    if group:
        return cells.join(stats, list(group))
    one = stats.select(F.struct("n", "mean", "sum_sq")).scalar()
    return cells.withColumn("_s", one).select(*cells.columns, "_s.n", "_s.mean", "_s.sum_sq")


def gi_star(counts: DataFrame, group: Sequence[str] = (), k: int = 8) -> DataFrame:
    """Getis-Ord Gi* per cell with row-standardised weights over the k nearest cells and the cell itself.

    ``counts`` has one row per (group, cell_id) with ``case_count``. Groups below three cells are left out.
    """
    key = [*group, "cell_id"]
    near = (
        grid.nearest_cells(counts, k, group, carry=["case_count"])
        .groupBy(*key, "case_count")
        .agg(F.sum("nbr_case_count").alias("nbr_sum"), F.count(F.lit(1)).alias("n_nbr"))
    )
    joined = _with_group_stats(near, counts, group)
    local = (F.col("nbr_sum") + F.col("case_count")) / (F.col("n_nbr") + 1)
    spread = F.sqrt(F.greatest(F.col("sum_sq") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    scale = spread * F.sqrt((F.col("n") / (F.col("n_nbr") + 1) - 1) / (F.col("n") - 1))
    z = F.when(scale > 0, (local - F.col("mean")) / scale).otherwise(F.lit(0.0))
    return (
        joined.where(F.col("n") >= 3)
        .withColumn("gi_zscore", z)
        .withColumn("gi_pvalue", labels.normal_two_sided_p(F.col("gi_zscore")))
        .withColumn("significance", labels.significance(F.col("gi_zscore")))
        .select(*key, "case_count", "gi_zscore", "gi_pvalue", "significance")
    )


LABELS = ("hot_99", "hot_95", "hot_90", "cold_99", "cold_95", "cold_90", "not_sig")


def label_summary(cells: DataFrame, by: Sequence[str] = ("layer",)) -> DataFrame:
    """Cells per significance label, absent labels as zero."""
    return cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_cells"),
        *[F.count_if(F.col("significance") == name).alias(name) for name in LABELS],
    )


def local_moran(counts: DataFrame, group: Sequence[str] = (), k: int = 8) -> DataFrame:
    """Local Moran's I with the quadrant of (cell, neighbours) relative to the group mean."""
    key = [*group, "cell_id"]
    near = (
        grid.nearest_cells(counts, k, group, carry=["case_count"])
        .groupBy(*key, "case_count")
        .agg(F.avg("nbr_case_count").alias("nbr_mean"))
    )
    joined = _with_group_stats(near, counts, group)
    own, lag = F.col("case_count") - F.col("mean"), F.col("nbr_mean") - F.col("mean")
    total_sq = F.col("sum_sq") - F.col("n") * F.col("mean") * F.col("mean")
    quadrant = (
        F.when((own > 0) & (lag > 0), "HH")
        .when((own <= 0) & (lag > 0), "LH")
        .when((own <= 0) & (lag <= 0), "LL")
        .otherwise("HL")
    )
    moran = F.when(total_sq > 0, (F.col("n") - 1) * own * lag / total_sq).otherwise(F.lit(0.0))
    return (
        joined.where(F.col("n") >= 3)
        .withColumn("lisa_i", moran)
        .withColumn("quadrant", quadrant)
        .select(*key, "case_count", "lisa_i", "quadrant")
    )


# Draws come from arithmetic on whole numbers, so that any engine can repeat them: fixed multipliers, a prime modulus.
DRAW_PRIME = 2_147_483_647
DRAW_CELL, DRAW_TRIAL, DRAW_STRATUM = 7_919, 104_729, 1_299_709
DRAW_STEPS = (48_271, 69_621, 16_807)
CELLS_PER_BLOCK = 128


def _scrambled(x: np.ndarray) -> np.ndarray:
    for factor in DRAW_STEPS:
        x = (x * factor + 11) % DRAW_PRIME
    return x


def _drawn_sums(cells: np.ndarray, slots: np.ndarray, n_nbr: np.ndarray, values: np.ndarray, trials: int, seed: int) -> np.ndarray:
    """Sums of ``n_nbr`` values of other cells for each cell and trial; ``values`` are those of the group, by slot."""
    others = len(values) - 1
    trial = np.arange(1, trials + 1, dtype=np.int64)
    start = (cells[:, None] * DRAW_CELL + trial * DRAW_TRIAL + seed) % DRAW_PRIME
    turn = _scrambled(start) * others // DRAW_PRIME
    sums = np.zeros(start.shape, np.int64)
    for stratum in range(int(n_nbr.max(initial=0))):
        has = n_nbr > stratum
        low = stratum * others // n_nbr
        width = (stratum + 1) * others // n_nbr - low
        draw = _scrambled((start + (stratum + 1) * DRAW_STRATUM) % DRAW_PRIME) * width[:, None] // DRAW_PRIME
        place = (turn + low[:, None] + draw) % others
        place += place >= slots[:, None]  # a cell never draws itself
        sums += np.where(has[:, None], values[np.minimum(place, others)], 0)
    return sums


def neighbour_redraws(
    counts: DataFrame, group: Sequence[str] = (), k: int = 8, trials: int = 999, seed: int = 42, parts: int = 8
) -> DataFrame:
    """(group, cell_id, nbr_sum, larger, smaller): of seeded redraws of a cell's neighbours, how many sum to at least, and
    to at most, what its neighbours have.

    A redraw takes distinct other cells of the group: the group is numbered in scrambled order, cut into one stratum per
    neighbour, and one cell is taken from each after a random turn. A group has no more cells than the lattice has nodes;
    its cells are dealt to ``parts`` tasks, each of which holds the group's counts.
    """
    key = [*group, "cell_id"]
    near = grid.nearest_cells(counts, k, group, carry=["case_count"]).groupBy(*key)
    near = near.agg(F.sum("nbr_case_count").alias("nbr_sum"), F.count(F.lit(1)).alias("n_nbr"))
    rows = counts.join(near, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    fields = {c: t for c, t in counts.dtypes if c in group}
    ddl = ", ".join([*[f"`{c}` {t}" for c, t in fields.items()], "cell_id bigint", "nbr_sum bigint", "larger int", "smaller int"])

    def redraw(table: pa.Table) -> pa.Table:
        cells = table["cell_id"].to_numpy().astype(np.int64)
        order = np.lexsort((cells, _scrambled((cells * DRAW_CELL + seed) % DRAW_PRIME)))
        table, cells, part = table.take(pa.array(order)), cells[order], table["part"][0].as_py()
        values, n_nbr = table["case_count"].to_numpy().astype(np.int64), table["n_nbr"].fill_null(0).to_numpy()
        own = np.flatnonzero((cells % parts == part) & (n_nbr > 0) & (len(cells) >= 3))
        nbr_sum = table["nbr_sum"].fill_null(0).to_numpy()[own]
        larger, smaller = np.zeros(len(own), np.int32), np.zeros(len(own), np.int32)
        for at in range(0, len(own), CELLS_PER_BLOCK):
            some = slice(at, at + CELLS_PER_BLOCK)
            sums = _drawn_sums(cells[own[some]], own[some], n_nbr[own[some]], values, trials, seed)
            larger[some] = (sums >= nbr_sum[some, None]).sum(axis=1)
            smaller[some] = (sums <= nbr_sum[some, None]).sum(axis=1)
        kept = table.take(pa.array(own)).select(list(fields))
        for name, column in (("cell_id", cells[own]), ("nbr_sum", nbr_sum), ("larger", larger), ("smaller", smaller)):
            kept = kept.append_column(name, pa.array(column))
        return kept

    rows = rows.select(*group, "part", F.col("cell_id").cast("bigint"), F.col("case_count").cast("bigint"), "nbr_sum", "n_nbr")
    return rows.groupBy(*group, "part").applyInArrow(redraw, ddl)


def _pseudo_p(extreme: Column, trials: int) -> Column:
    """Share of redraws, the real one included, in the smaller tail."""
    return (F.least(extreme, F.lit(trials) - extreme) + 1) / F.lit(trials + 1)


def permutation_p(counts: DataFrame, group: Sequence[str] = (), k: int = 8, trials: int = 999, seed: int = 42) -> DataFrame:
    """Gi* with a pseudo p-value: share of seeded redraws of the neighbours that are at least as extreme."""
    key = [*group, "cell_id"]
    drawn = neighbour_redraws(counts, group, k, trials, seed).select(*key, _pseudo_p(F.col("larger"), trials).alias("gi_pvalue"))
    scored = gi_star(counts, group, k).drop("gi_pvalue", "significance").join(drawn, key)
    return scored.withColumn("significance", labels.significance_zp(F.col("gi_zscore"), F.col("gi_pvalue")))


def local_moran_p(
    counts: DataFrame, group: Sequence[str] = (), k: int = 8, trials: int = 999, seed: int = 42, alpha: float = 0.05
) -> DataFrame:
    """Local Moran's I with a pseudo p-value under redrawn neighbours; the quadrant is ``ns`` where p exceeds ``alpha``.

    A redraw's I is at least the real one if its neighbours' sum lies on the same side, seen from the cell's own side of
    the mean; a cell at the mean has I = 0 whatever its neighbours are, so its p is 1.
    """
    key = [*group, "cell_id"]
    drawn = neighbour_redraws(counts, group, k, trials, seed)
    joined = _with_group_stats(local_moran(counts, group, k).join(drawn, key), counts, group)
    own = F.col("case_count") - F.col("mean")
    p = F.when(own > 0, _pseudo_p(F.col("larger"), trials)).when(own < 0, _pseudo_p(F.col("smaller"), trials)).otherwise(F.lit(1.0))
    out = joined.withColumn("lisa_p", p).withColumn("quadrant", F.when(p > alpha, "ns").otherwise(F.col("quadrant")))
    return out.select(*key, "case_count", "lisa_i", "lisa_p", "quadrant")


def density(counts: DataFrame, bandwidth_km: float = 2.0, reach: float = 4.0) -> DataFrame:
    """Gaussian kernel density per km² at each listed cell, summed over cells within ``reach`` bandwidths."""
    total = counts.agg(F.sum("case_count")).scalar()
    h2 = bandwidth_km * bandwidth_km
    weight = F.col("nbr_case_count") * F.exp(-F.col("km") * F.col("km") / F.lit(2 * h2))
    near = grid.cells_within(counts, reach * bandwidth_km, carry=["case_count"])
    dens = near.groupBy("cell_id").agg(F.sum(weight).alias("w"))
    return dens.select("cell_id", (F.col("w") / (total * F.lit(2 * 3.141592653589793 * h2))).alias("kde_density"))


def density_labels(dens: DataFrame) -> DataFrame:
    """Z-scores of the density surface (sample deviation) with significance labels."""
    mean, dev = dens.agg(F.avg("kde_density")).scalar(), dens.agg(F.stddev_samp("kde_density")).scalar()
    z = F.when(dev > 0, (F.col("kde_density") - mean) / dev).otherwise(F.lit(0.0))
    return dens.withColumn("gi_zscore", z).withColumn("significance", labels.significance(F.col("gi_zscore")))
