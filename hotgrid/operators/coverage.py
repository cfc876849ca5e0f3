"""Allocation of field units to cells: maximal coverage, baselines, briefings, scenario bundles.

A risk table has one row per (region, cell_id) with an integer ``risk`` weight; integers keep sums and
ties exact whatever the order of summation. Cells are bounded by the lattice.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotgrid import settings as S
from hotgrid.functions import labels, spatial
from hotgrid.operators import grid
from hotgrid.session import cut_lineage


def weigh(risk: DataFrame, column: str, scale: int = 1_000_000) -> DataFrame:
    """Integer risk weights from a floating score."""
    return risk.withColumn("risk", F.round(F.col(column) * scale).cast("bigint"))


def cell_regions(incidents: DataFrame) -> DataFrame:
    """Most frequent region of each cell; ties go to the smaller name."""
    counts = (
        incidents.where(F.col("region_name").isNotNull())
        .groupBy("cell_id", "region_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("top", F.max("n").over(Window.partitionBy("cell_id")))
    )
    return counts.groupBy("cell_id").agg(F.min(F.when(F.col("n") == F.col("top"), F.col("region_name"))).alias("region_name"))


def first_regions(incidents: DataFrame) -> DataFrame:
    """Region of the first incident (smallest id) of each cell."""
    return incidents.where(F.col("region_name").isNotNull()).groupBy("cell_id").agg(
        F.min_by("region_name", "incident_id").alias("region_name")
    )


def core_cells(
    cells: DataFrame, limit_km: float = S.CORE_GUARD_KM, min_cells: int = S.CORE_GUARD_MIN_CELLS
) -> DataFrame:
    """Drop cells far from their region's median position; regions below ``min_cells`` are left as they are."""
    placed = grid.with_position(cells)
    # median over lattice rows and columns: few distinct values, so the exact percentile stays small
    per = placed.groupBy("region_name").agg(
        F.percentile("cell_lat", F.lit(0.5)).alias("mid_lat"),
        F.percentile("cell_lon", F.lit(0.5)).alias("mid_lon"),
        F.count(F.lit(1)).alias("n_cells"),
    )
    km = spatial.haversine_km(F.col("mid_lat"), F.col("mid_lon"), F.col("cell_lat"), F.col("cell_lon"))
    return placed.join(per, "region_name").where((F.col("n_cells") < min_cells) | (km <= limit_km)).select(*cells.columns)


def scope_risk(
    risk: DataFrame, incidents: DataFrame, min_cells: int = S.CORE_GUARD_MIN_CELLS, limit_km: float = S.CORE_GUARD_KM
) -> DataFrame:
    """Risk cells of every region with enough cells: modal region, far cells dropped."""
    scoped = core_cells(risk.join(cell_regions(incidents), "cell_id"), limit_km, min_cells)
    enough = scoped.groupBy("region_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_cells)
    return scoped.join(enough.select("region_name"), "region_name", "left_semi")


def _pairs(cells: DataFrame, radius_km: float) -> DataFrame:
    """(region, seed, cell, risk of the cell) for every cell within reach of a seed of the same region."""
    near = grid.cells_within(cells.select("region_name", "cell_id", "risk"), radius_km, ["region_name"], carry=["risk"])
    return near.select("region_name", F.col("cell_id").alias("seed"), F.col("nbr_id").alias("cell_id"), F.col("nbr_risk").alias("risk"))


def greedy_coverage(
    cells: DataFrame, units: int = max(S.SCENARIOS), radius_km: float = S.PATROL_RADIUS_KM
) -> DataFrame:
    """Allocation per region: unit number, seed and each newly covered cell with its risk (long form).

    Every round takes, in all regions at once, the uncovered seed whose reach holds most uncovered risk;
    ties go to the higher own risk, then the smaller cell id. A plan for fewer units is the prefix of a
    plan for more.
    """
    cells = cut_lineage(cells.select("region_name", "cell_id", "risk"))
    pairs = _pairs(cells, radius_km)
    own = cells.select("region_name", F.col("cell_id").alias("seed"), F.col("risk").alias("own_risk"))
    pairs = cut_lineage(pairs.join(own, ["region_name", "seed"]))
    open_pairs, rounds = pairs, []
    for unit in range(1, units + 1):
        gains = open_pairs.groupBy("region_name", "seed", "own_risk").agg(
            F.sum("risk").alias("gain"), F.max(F.when(F.col("cell_id") == F.col("seed"), 1)).alias("open_seed")
        )
        best = (
            gains.where((F.col("open_seed") == 1) & (F.col("gain") > 0))
            .groupBy("region_name")
            .agg(F.max(F.struct("gain", "own_risk", (-F.col("seed")).alias("neg"))).alias("b"))
            .select("region_name", (-F.col("b.neg")).alias("seed"))
        )
        taken = open_pairs.join(best, ["region_name", "seed"]).select("region_name", "seed", "cell_id", "risk")
        taken = cut_lineage(taken.withColumn("unit", F.lit(unit)))
        if taken.isEmpty():
            break
        rounds.append(taken)
        open_pairs = cut_lineage(open_pairs.join(taken.select("region_name", "cell_id"), ["region_name", "cell_id"], "left_anti"))
    if not rounds:
        return cells.where(F.lit(False)).select("region_name", F.col("cell_id").alias("seed"), "cell_id", "risk", F.lit(0).alias("unit"))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def allocations(plan: DataFrame) -> DataFrame:
    """One row per (region, unit): seed with position, cells covered, risk covered. A reach is a few cells."""
    rows = plan.groupBy("region_name", "unit", "seed").agg(
        F.count(F.lit(1)).alias("cells_covered"),
        F.sum("risk").alias("risk_covered"),
        F.sort_array(F.collect_list("cell_id")).alias("cell_ids"),
    )
    return rows.withColumn("center_lat", spatial.cell_lat(F.col("seed"))).withColumn("center_lon", spatial.cell_lon(F.col("seed")))


def random_coverage(
    cells: DataFrame, units: Sequence[int] = S.SCENARIOS, trials: int = S.RANDOM_TRIALS, radius_km: float = S.PATROL_RADIUS_KM
) -> DataFrame:
    """Mean covered share over repeatable random draws, per region and number of units.

    A draw orders the cells of a region by arithmetic on (cell, trial). A larger draw extends a smaller
    one, so each covered cell is kept once with the first seed that reaches it.
    """
    cells = cells.select("region_name", "cell_id", "risk")
    prime = 1_000_003
    # quadratic mixing modulo a prime
    base = F.pmod(F.col("cell_id") * 7_919 + F.col("trial") * 104_729, F.lit(prime))
    draw = F.pmod(base * base + F.col("trial") * 31 * base, F.lit(prime))
    order = Window.partitionBy("region_name", "trial").orderBy("draw", "cell_id")
    seeds = (
        cells.select("region_name", "cell_id", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
        .withColumn("draw", draw)
        .withColumn("unit", F.row_number().over(order))
        .where(F.col("unit") <= max(units))
        .select("region_name", "trial", "unit", F.col("cell_id").alias("seed"))
    )
    reached = (
        seeds.join(_pairs(cells, radius_km), ["region_name", "seed"])
        .groupBy("region_name", "trial", "cell_id", "risk")
        .agg(F.min("unit").alias("unit"))
    )
    per_trial = reached.groupBy("region_name", "trial").agg(
        *[F.sum(F.when(F.col("unit") <= k, F.col("risk")).otherwise(0)).alias(f"k{k}") for k in units]
    )
    mean = per_trial.groupBy("region_name").agg(*[(F.sum(f"k{k}") / trials).alias(f"k{k}") for k in units])
    return _shares(mean, cells, units, "random_pct")


def _shares(sums: DataFrame, cells: DataFrame, units: Sequence[int], name: str) -> DataFrame:
    total = cells.groupBy("region_name").agg(F.sum("risk").alias("total_risk"))
    pairs = F.array(*[F.struct(F.lit(k).alias("units"), F.col(f"k{k}").alias("covered")) for k in units])
    rows = total.join(sums, "region_name").select("region_name", "total_risk", F.explode(pairs).alias("p"))
    pct = F.when(F.col("total_risk") > 0, F.col("p.covered") / F.col("total_risk") * 100).otherwise(F.lit(0.0))
    return rows.select("region_name", "p.units", pct.alias(name))


def volume_coverage(
    cells: DataFrame, incidents: DataFrame, units: Sequence[int] = S.SCENARIOS, radius_km: float = S.PATROL_RADIUS_KM
) -> DataFrame:
    """Coverage when units stand at the busiest cells that are more than one radius apart."""
    cells = cells.select("region_name", "cell_id", "risk")
    volume = incidents.groupBy("region_name", "cell_id").agg(F.count(F.lit(1)).alias("volume"))
    ranked = cut_lineage(
        cells.join(volume, ["region_name", "cell_id"], "left").withColumn("volume", F.coalesce("volume", F.lit(0)))
    )
    pairs = cut_lineage(_pairs(cells, radius_km))
    free, seeds = ranked, []
    for unit in range(1, max(units) + 1):
        best = (
            free.groupBy("region_name")
            .agg(F.max(F.struct("volume", "risk", (-F.col("cell_id")).alias("neg"))).alias("b"))
            .select("region_name", (-F.col("b.neg")).alias("seed"), F.lit(unit).alias("unit"))
        )
        reach = cut_lineage(best.join(pairs, ["region_name", "seed"]).select("region_name", "unit", "cell_id", "risk"))
        seeds.append(reach)
        free = cut_lineage(free.join(reach.select("region_name", "cell_id"), ["region_name", "cell_id"], "left_anti"))
    every = seeds[0]
    for s in seeds[1:]:
        every = every.unionByName(s)
    first = every.groupBy("region_name", "cell_id", "risk").agg(F.min("unit").alias("unit"))
    sums = first.groupBy("region_name").agg(
        *[F.sum(F.when(F.col("unit") <= k, F.col("risk")).otherwise(0)).alias(f"k{k}") for k in units]
    )
    return _shares(sums, cells, units, "statusquo_pct")


def greedy_shares(plan: DataFrame, cells: DataFrame, units: Sequence[int] = S.SCENARIOS) -> DataFrame:
    sums = plan.groupBy("region_name").agg(
        *[F.sum(F.when(F.col("unit") <= k, F.col("risk")).otherwise(0)).alias(f"k{k}") for k in units]
    )
    return _shares(sums, cells, units, "greedy_pct")


def coverage_summary(greedy: DataFrame, random: DataFrame, statusquo: DataFrame) -> DataFrame:
    """Coverage of the plan and both baselines with uplifts, per region and number of units."""
    rows = greedy.join(random, ["region_name", "units"]).join(statusquo, ["region_name", "units"])
    g, r, q = F.round("greedy_pct", 2), F.col("random_pct"), F.col("statusquo_pct")
    times = lambda base, digits: F.when(base > 0, F.round(g / base, digits))
    return rows.select(
        "region_name",
        "units",
        F.round(r, 2).alias("random_pct"),
        F.round(q, 2).alias("statusquo_pct"),
        g.alias("greedy_pct"),
        labels.uplift_pct(g, r).alias("uplift_pct"),
        times(r, 1).alias("uplift_x"),
        labels.uplift_pct(g, q).alias("uplift_vs_statusquo_pct"),
        times(q, 2).alias("uplift_vs_statusquo_x"),
    )


def briefings(plan: DataFrame, incidents: DataFrame, days: int = S.BRIEFING_DAYS, top_types: int = 5) -> DataFrame:
    """Per (region, unit): recent incidents in its cells, leading categories, severity mix and a sentence."""
    last = incidents.agg(F.max("ts")).scalar()
    recent = incidents.where(F.col("ts") >= last - F.expr(f"INTERVAL {days} DAYS"))
    # recent incidents collapse to one row per (region, cell, category, severity) before the join
    facts = recent.groupBy("region_name", "cell_id", "category_name", "severity_name").agg(F.count(F.lit(1)).alias("n"))
    rows = plan.select("region_name", "unit", "cell_id").join(facts, ["region_name", "cell_id"])
    by_type = (
        rows.where(F.col("category_name").isNotNull())
        .groupBy("region_name", "unit", "category_name")
        .agg(F.sum("n").alias("n"))
        .withColumn("r", F.row_number().over(Window.partitionBy("region_name", "unit").orderBy(F.desc("n"), "category_name")))
        .where(F.col("r") <= top_types)
    )
    types = by_type.groupBy("region_name", "unit").agg(
        F.map_from_entries(
            F.transform(
                F.sort_array(F.collect_list(F.struct("r", "category_name", "n"))),
                lambda x: F.struct(x["category_name"], x["n"]),
            )
        ).alias("top_types"),
        F.min_by("category_name", "r").alias("lead_type"),
    )
    by_severity = rows.where(F.col("severity_name").isNotNull()).groupBy("region_name", "unit", "severity_name").agg(F.sum("n").alias("n"))
    severities = by_severity.groupBy("region_name", "unit").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity_name", "n")))).alias("severity_mix")
    )
    counts = rows.groupBy("region_name", "unit").agg(F.sum("n").alias("recent_incidents"))
    out = allocations(plan).drop("cell_ids")
    for part in (counts, types, severities):
        out = out.join(part, ["region_name", "unit"], "left")
    out = out.na.fill(0, ["recent_incidents"])
    # fixed value: briefing sentence
    text = F.concat(
        F.lit("Patrol "), F.col("unit").cast("string"),
        F.format_string(": Deploy to (%.4f, %.4f). ", F.col("center_lat"), F.col("center_lon")),
        F.lit("Covers "), F.col("cells_covered").cast("string"),
        F.lit(" cells with "), F.col("recent_incidents").cast("string"),
        F.lit(" recent incidents. Primary concern: "), F.coalesce("lead_type", F.lit("General")), F.lit("."),
    )
    return out.withColumn("description", text)


def map_text(m: Column) -> Column:
    """``key=value`` pairs of a small map, largest value first, then by key."""
    pairs = F.sort_array(
        F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    )
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), (-p["v"]).cast("string"))), ";")
    return F.coalesce(joined, F.lit(""))


def briefing_rollup(sheets: DataFrame, severe: str = "severe") -> DataFrame:
    """Per region: incidents over all its units, leading category, severe total."""
    per_type = (
        sheets.select("region_name", F.explode("top_types").alias("category_name", "n"))
        .groupBy("region_name", "category_name")
        .agg(F.sum("n").alias("n"))
    )
    lead = per_type.groupBy("region_name").agg(F.min(F.struct((-F.col("n")).alias("v"), "category_name")).alias("b"))
    sums = sheets.groupBy("region_name").agg(
        F.sum("recent_incidents").alias("total_incidents"),
        F.sum(F.coalesce(F.try_element_at("severity_mix", F.lit(severe)), F.lit(0))).alias("severe_total"),
    )
    return sums.join(lead, "region_name", "left").select(
        "region_name", "total_incidents", F.coalesce("b.category_name", F.lit("")).alias("top_type"),
        F.coalesce(-F.col("b.v"), F.lit(0)).alias("top_type_count"), "severe_total",
    )


def recommendation(sheets: DataFrame, severe: str = "severe") -> DataFrame:
    """One sentence per unit naming its two leading categories and severe cases."""
    pairs = F.sort_array(
        F.transform(F.map_entries("top_types"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    )
    focus = F.coalesce(F.array_join(F.transform(F.slice(pairs, 1, 2), lambda p: p["k"]), " and "), F.lit(""))
    n_severe = F.coalesce(F.try_element_at("severity_mix", F.lit(severe)), F.lit(0))
    # fixed value: recommendation sentence
    text = F.concat(
        F.format_string("Deploy patrol unit at (%.3f, %.3f). ", F.col("center_lat"), F.col("center_lon")),
        F.col("recent_incidents").cast("string"), F.lit(" incidents in last 30 days covering "),
        F.col("cells_covered").cast("string"), F.lit(" grid cells. Focus: "), focus, F.lit(". "),
        F.when(n_severe > 0, F.concat(n_severe.cast("string"), F.lit(" heinous cases require priority response. "))).otherwise(""),
    )
    return sheets.select("region_name", "unit", text.alias("recommendation"))


def mean_centre(allocated: DataFrame) -> DataFrame:
    return allocated.groupBy("region_name").agg(F.avg("center_lat").alias("lat"), F.avg("center_lon").alias("lon"))


def scenario_parts(plan: DataFrame, summary: DataFrame, sheets: DataFrame, units: Sequence[int] = S.SCENARIOS) -> DataFrame:
    """(region, units) -> summary, allocations and briefings; a scenario without all three is left out.

    A plan for k units is the first k units of the largest plan, so lists have at most k entries.
    """
    ks = F.explode(F.array(*[F.lit(k) for k in units])).alias("units")
    alloc = (
        allocations(plan)
        .select("*", ks)
        .where(F.col("unit") <= F.col("units"))
        .groupBy("region_name", "units")
        .agg(F.sort_array(F.collect_list(F.struct("unit", "seed", "cells_covered", "risk_covered"))).alias("allocations"))
    )
    notes = (
        sheets.select("region_name", "unit", "description", ks)
        .where(F.col("unit") <= F.col("units"))
        .groupBy("region_name", "units")
        .agg(F.sort_array(F.collect_list(F.struct("unit", "description"))).alias("briefings"))
    )
    cols = [c for c in summary.columns if c not in ("region_name", "units")]
    head = summary.select("region_name", "units", F.struct(*cols).alias("summary"))
    return head.join(alloc, ["region_name", "units"]).join(notes, ["region_name", "units"])


def scenario_bundle(parts: DataFrame) -> DataFrame:
    """One row per region: map ``p<k>`` -> {summary, allocations, briefings}."""
    entry = F.struct(
        F.concat(F.lit("p"), F.col("units").cast("string")).alias("key"), F.struct("summary", "allocations", "briefings").alias("value")
    )
    bundle = F.map_from_entries(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)))
    return parts.groupBy("region_name").agg(bundle.alias("scenarios")).withColumn("safe", labels.safe_label(F.col("region_name")))


def scenario_index(summary: DataFrame, volumes: DataFrame, default: str, units: Sequence[int] = S.SCENARIOS, shown: int = 6) -> DataFrame:
    """Regions having every scenario: the default region first, then by incident volume."""
    ready = summary.groupBy("region_name").agg(
        F.count_distinct("units").alias("n"), F.max(F.when(F.col("units") == shown, F.col("greedy_pct"))).alias("coverage")
    )
    rows = ready.where(F.col("n") == len(units)).join(volumes, "region_name", "left")
    order = Window.orderBy((F.col("region_name") != default).cast("int"), F.desc("n_cases"), "region_name")
    return rows.select(
        "region_name",
        labels.safe_label(F.col("region_name")).alias("safe"),
        F.coalesce("n_cases", F.lit(0)).alias("n_cases"),
        "coverage",
    ).withColumn("position", F.row_number().over(order))
