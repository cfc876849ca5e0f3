"""Lattice and hotspot queries."""

from functools import reduce

from pyspark.sql import functions as F

from hotgrid import settings as S
from hotgrid.functions import labels, periods, spatial
from hotgrid.operators import grid, hotspots
from hotgrid.plans.registry import cell_km, cell_lat, cell_lon, normal_p_sql, query, significance_sql, view
from hotgrid.sources import tables


@query(
    "enriched_incidents",
    "inc",
    "SELECT incident_id, station_id, CAST(region_id AS BIGINT) AS region_id, region_name, category_name, severity_name, cell_id FROM inc",
)
def enriched_incidents(spark, d):
    inc = tables.order_incidents(spark, d)
    return inc.select(
        "incident_id", "station_id", F.col("region_id").cast("bigint").alias("region_id"),
        "region_name", "category_name", "severity_name", "cell_id",
    )


@query(
    "grid_snap",
    "inc",
    f"""SELECT incident_id, cell_id, round({cell_lat('cell_id')}, 6) AS cell_lat, round({cell_lon('cell_id')}, 6) AS cell_lon FROM inc""",
)
def grid_snap(spark, d):
    inc = tables.order_incidents(spark, d)
    snapped = inc.withColumn("cell_id", spatial.cell_of(F.col("latitude"), F.col("longitude")))
    return grid.with_position(snapped).select(
        "incident_id", "cell_id", F.round("cell_lat", 6).alias("cell_lat"), F.round("cell_lon", 6).alias("cell_lon")
    )


@query("active_cells", "inc active", "SELECT cell_id, total_cases FROM active")
def active_cells(spark, d):
    return grid.active_cells(tables.order_incidents(spark, d))


@query(
    "lattice_occupancy",
    "inc",
    f"""WITH g AS (SELECT i * 493 + j AS cell_id FROM range(777) a(i), range(493) b(j)),
n AS (SELECT cell_id, count(*) AS n FROM inc GROUP BY cell_id)
SELECT cell_id // 493 AS lattice_row, count(*) AS nodes, count(n.n) AS occupied, CAST(coalesce(sum(n.n), 0) AS BIGINT) AS incidents
FROM g LEFT JOIN n USING (cell_id) GROUP BY 1""",
)
def lattice_occupancy(spark, d):
    counts = tables.order_incidents(spark, d).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    full = grid.lattice(spark).select("cell_id").join(counts, "cell_id", "left")
    return full.groupBy(spatial.cell_row(F.col("cell_id")).alias("lattice_row")).agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count("n").alias("occupied"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("incidents"),
    )


@query(
    "cell_profile",
    "inc",
    """SELECT cell_id, count(*) AS total_cases, count(*) FILTER (severity_id = 1) AS severe_cases,
  count(*) FILTER (severity_id = 2) AS standard_cases, count(*) FILTER (severity_id = 3) AS minor_cases,
  count(DISTINCT category_id) AS n_types, round(avg(latitude), 10) AS mean_lat, round(avg(longitude), 10) AS mean_lon
FROM inc GROUP BY cell_id""",
)
def cell_profile(spark, d):
    prof = grid.cell_profile(tables.order_incidents(spark, d))
    return prof.withColumn("mean_lat", F.round("mean_lat", 10)).withColumn("mean_lon", F.round("mean_lon", 10))


BOX = (12.5, 17.0, 74.0, 77.5)


@query(
    "box_filter",
    "inc",
    """SELECT count(*) FILTER (latitude BETWEEN 12.5 AND 17.0 AND longitude BETWEEN 74.0 AND 77.5) AS kept,
count(*) FILTER (NOT (latitude BETWEEN 12.5 AND 17.0 AND longitude BETWEEN 74.0 AND 77.5)) AS dropped FROM inc""",
)
def box_filter(spark, d):
    return grid.box_report(tables.order_incidents(spark, d), BOX)


@query(
    "temporal_features",
    "evt",
    """SELECT incident_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(month(ts) AS INTEGER) AS month,
CAST(year(ts) AS INTEGER) AS year, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, CAST(hour(ts) >= 22 OR hour(ts) < 6 AS INTEGER) AS is_night,
CASE WHEN hour(ts) BETWEEN 6 AND 13 THEN 0 WHEN hour(ts) BETWEEN 14 AND 21 THEN 1 ELSE 2 END AS shift FROM evt""",
)
def temporal_features(spark, d):
    from hotgrid.operators import panel

    return panel.time_parts(tables.event_incidents(spark, d)).select(
        "incident_id", "hour", "dow", "month", "year", "is_weekend", "is_night", "shift"
    )


@query(
    "period_labels",
    "inc",
    """SELECT incident_id, strftime(ts, '%Y-%m') AS month_period,
strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d') AS week_period,
strftime(ts, '%b ''%y') AS axis_label, date_diff('day', DATE '1995-01-01', CAST(ts AS DATE)) AS days_in FROM inc""",
)
def period_labels(spark, d):
    inc = tables.order_incidents(spark, d)
    month = periods.month_period(F.col("ts"))
    return inc.select(
        "incident_id",
        month.alias("month_period"),
        periods.week_period(F.col("ts")).alias("week_period"),
        periods.month_axis_label(month).alias("axis_label"),
        F.datediff(periods.day_of(F.col("ts")), F.lit("1995-01-01").cast("date")).cast("bigint").alias("days_in"),
    )


@query(
    "filtered_incidents",
    "inc",
    """SELECT region_name, count(*) AS n, count(DISTINCT cell_id) AS cells FROM inc
WHERE category_id = 1 AND ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' GROUP BY region_name""",
)
def filtered_incidents(spark, d):
    inc = hotspots.filter_incidents(
        tables.order_incidents(spark, d),
        category_id=1,
        dates=(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1999-12-31").cast("timestamp_ntz")),
    )
    return inc.groupBy("region_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cell_id").alias("cells"))


@query(
    "territorial_incidents",
    "inc",
    """SELECT region_name, count(*) AS n FROM inc WHERE region_name NOT IN ('NATION_3', 'NATION_7') AND region_name IS NOT NULL
AND station_id IS NOT NULL GROUP BY region_name""",
)
def territorial_incidents(spark, d):
    inc = tables.order_incidents(spark, d).na.drop(subset=["region_name", "station_id"])
    return (
        inc.where(~F.col("region_name").isin("NATION_3", "NATION_7")).groupBy("region_name").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "cells_within_2km",
    "inc active",
    f"""SELECT a.cell_id, b.cell_id AS nbr_id, round({cell_km('a.cell_id', 'b.cell_id')}, 6) AS km
FROM active a JOIN active b ON {cell_km('a.cell_id', 'b.cell_id')} <= 2.0""",
)
def cells_within_2km(spark, d):
    cells = grid.active_cells(tables.order_incidents(spark, d))
    return grid.cells_within(cells, 2.0).select("cell_id", "nbr_id", F.round("km", 6).alias("km"))


KNN_SQL = """SELECT a.cell_id, b.cell_id AS nbr_id,
CAST(pow((a.cell_id // 493 - b.cell_id // 493) * 107, 2) + pow((a.cell_id % 493 - b.cell_id % 493) * 111, 2) AS BIGINT) AS d2,
row_number() OVER (PARTITION BY a.cell_id ORDER BY pow((a.cell_id // 493 - b.cell_id // 493) * 107, 2) + pow((a.cell_id % 493 - b.cell_id % 493) * 111, 2), b.cell_id) AS nbr_rank
FROM active a JOIN active b ON a.cell_id <> b.cell_id QUALIFY nbr_rank <= 8"""


@query("nearest_cells", "inc active", KNN_SQL)
def nearest_cells(spark, d):
    cells = grid.active_cells(tables.order_incidents(spark, d))
    return grid.nearest_cells(cells, 8).withColumn("nbr_rank", F.col("nbr_rank").cast("bigint"))


def gi_view(source: str, group: str) -> str:
    """Brute-force Gi* in SQL over ``source`` grouped by ``group`` (comma separated)."""
    keys = [g.strip() for g in group.split(",")]
    same = " AND ".join(f"a.{g} = b.{g}" for g in keys)
    part = ", ".join(f"a.{g}" for g in keys)
    return f"""
SELECT {group}, cell_id, case_count, z AS gi_zscore, {normal_p_sql('z')} AS gi_pvalue, {significance_sql('z')} AS significance
FROM (
  SELECT {', '.join('k.' + g for g in keys)}, k.cell_id, k.case_count,
    CASE WHEN s.sd * sqrt((s.n / (k.m + 1) - 1) / (s.n - 1)) > 0
         THEN ((k.nbr + k.case_count) / (k.m + 1) - s.mean) / (s.sd * sqrt((s.n / (k.m + 1) - 1) / (s.n - 1))) ELSE 0.0 END AS z
  FROM (
    SELECT {group}, cell_id, case_count, sum(nbr_count) AS nbr, count(*) AS m FROM (
      SELECT {part}, a.cell_id, a.case_count, b.case_count AS nbr_count,
        row_number() OVER (PARTITION BY {part}, a.cell_id ORDER BY pow((a.cell_id // 493 - b.cell_id // 493) * 107, 2)
          + pow((a.cell_id % 493 - b.cell_id % 493) * 111, 2), b.cell_id) AS rk
      FROM {source} a JOIN {source} b ON {same} AND a.cell_id <> b.cell_id QUALIFY rk <= 8)
    GROUP BY {group}, cell_id, case_count) k
  JOIN (SELECT {group}, count(*) AS n, avg(case_count) AS mean,
          sqrt(greatest(sum(case_count * case_count) / count(*) - avg(case_count) * avg(case_count), 0)) AS sd
        FROM {source} GROUP BY {group}) s USING ({group})
  WHERE s.n >= 3)"""


view("gi_layers", gi_view("layers", "layer"))
view("gi_regions", gi_view("region_layers", "layer, region_name"))
ROUNDED = "round(gi_zscore, 6) AS gi_zscore, round(gi_pvalue, 6) AS gi_pvalue, significance"


def _rounded(df):
    return df.withColumn("gi_zscore", F.round("gi_zscore", 6)).withColumn("gi_pvalue", F.round("gi_pvalue", 6))


@query(
    "gi_star",
    "inc active layers gi_layers",
    f"SELECT cell_id, case_count, {ROUNDED} FROM gi_layers WHERE layer = 'overall'",
)
def gi_star(spark, d):
    inc = tables.order_incidents(spark, d)
    counts = inc.groupBy("cell_id").agg(F.count(F.lit(1)).alias("case_count")).where(F.col("case_count") >= S.MIN_CASES_PER_CELL)
    return _rounded(hotspots.gi_star(counts))


@query("gi_star_layers", "inc active layers gi_layers", f"SELECT layer, cell_id, case_count, {ROUNDED} FROM gi_layers")
def gi_star_layers(spark, d):
    return _rounded(hotspots.gi_star(hotspots.layer_counts(tables.order_incidents(spark, d)), ["layer"]))


def local_gi(spark, d):
    counts = hotspots.layer_counts(tables.order_incidents(spark, d), per_region=True)
    return hotspots.gi_star(hotspots.drop_small_regions(counts), ["layer", "region_name"])


@query(
    "gi_star_local",
    "inc active region_layers gi_regions",
    f"SELECT layer, region_name, cell_id, case_count, {ROUNDED} FROM gi_regions",
)
def gi_star_local(spark, d):
    return _rounded(local_gi(spark, d))


@query(
    "gi_star_top",
    "inc active layers gi_layers",
    f"""SELECT cell_id, case_count, {ROUNDED}, round({cell_lat('cell_id')}, 6) AS cell_lat, round({cell_lon('cell_id')}, 6) AS cell_lon,
row_number() OVER (ORDER BY round(gi_zscore, 6) DESC, cell_id) AS rank FROM gi_layers WHERE layer = 'overall' QUALIFY rank <= 20""",
)
def gi_star_top(spark, d):
    return top_hotspots(gi_star(spark, d), 20)


def top_hotspots(cells, n):
    """The n hottest cells, ranked."""
    from pyspark.sql import Window

    top = cells.orderBy(F.desc("gi_zscore"), "cell_id").limit(n)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("gi_zscore"), "cell_id")).cast("bigint"))
    return (
        grid.with_position(ranked)
        .withColumn("cell_lat", F.round("cell_lat", 6))
        .withColumn("cell_lon", F.round("cell_lon", 6))
    )


SUMMARY_COLS = ", ".join(f"count(*) FILTER (significance = '{s}') AS {s}" for s in hotspots.LABELS)


@query(
    "hotspot_summary",
    "inc active layers gi_layers",
    f"SELECT layer, count(*) AS total_cells, {SUMMARY_COLS} FROM gi_layers GROUP BY layer",
)
def hotspot_summary(spark, d):
    return hotspots.label_summary(hotspots.gi_star(hotspots.layer_counts(tables.order_incidents(spark, d)), ["layer"]))


@query(
    "hotspot_summary_local",
    "inc active region_layers gi_regions",
    f"SELECT layer, count(*) AS total_cells, {SUMMARY_COLS} FROM gi_regions GROUP BY layer",
)
def hotspot_summary_local(spark, d):
    return hotspots.label_summary(local_gi(spark, d))


LISA_SQL = """WITH st AS (SELECT layer, count(*) AS n, avg(case_count) AS mean, sum(case_count * case_count) AS sq FROM layers GROUP BY layer),
nb AS (SELECT layer, cell_id, case_count, avg(nc) AS lag FROM (
  SELECT a.layer, a.cell_id, a.case_count, b.case_count AS nc,
    row_number() OVER (PARTITION BY a.layer, a.cell_id ORDER BY pow((a.cell_id // 493 - b.cell_id // 493) * 107, 2)
      + pow((a.cell_id % 493 - b.cell_id % 493) * 111, 2), b.cell_id) AS rk
  FROM layers a JOIN layers b ON a.layer = b.layer AND a.cell_id <> b.cell_id QUALIFY rk <= 8) GROUP BY ALL)
SELECT layer, cell_id, case_count, round((n - 1) * (case_count - mean) * (lag - mean) / (sq - n * mean * mean), 6) AS lisa_i,
CASE WHEN case_count > mean AND lag > mean THEN 'HH' WHEN case_count <= mean AND lag > mean THEN 'LH'
     WHEN case_count <= mean AND lag <= mean THEN 'LL' ELSE 'HL' END AS quadrant
FROM nb JOIN st USING (layer) WHERE n >= 3"""


@query("local_moran", "inc active layers", LISA_SQL)
def local_moran(spark, d):
    out = hotspots.local_moran(hotspots.layer_counts(tables.order_incidents(spark, d)), ["layer"])
    return out.withColumn("lisa_i", F.round("lisa_i", 6))


KDE_VIEW = f"""SELECT a.cell_id, sum(b.total_cases * exp(-pow({cell_km('a.cell_id', 'b.cell_id')}, 2) / 8.0))
  / ((SELECT sum(total_cases) FROM active) * 2 * 3.141592653589793 * 4.0) AS kde_density
FROM active a JOIN active b ON {cell_km('a.cell_id', 'b.cell_id')} <= 8.0 GROUP BY a.cell_id"""
view("kde", KDE_VIEW)


def density(spark, d):
    cells = grid.active_cells(tables.order_incidents(spark, d)).withColumnRenamed("total_cases", "case_count")
    return hotspots.density(cells, 2.0)


@query("kde_surface", "inc active kde", "SELECT cell_id, round(kde_density, 9) AS kde_density FROM kde")
def kde_surface(spark, d):
    return density(spark, d).withColumn("kde_density", F.round("kde_density", 9))


@query(
    "kde_labels",
    "inc active kde",
    f"""WITH z AS (SELECT cell_id, (kde_density - avg(kde_density) OVER ()) / stddev_samp(kde_density) OVER () AS z FROM kde)
SELECT cell_id, round(z, 6) AS gi_zscore, {significance_sql('z')} AS significance FROM z""",
)
def kde_labels(spark, d):
    out = hotspots.density_labels(density(spark, d))
    return out.select("cell_id", F.round("gi_zscore", 6).alias("gi_zscore"), "significance")


def redraw_sql(source: str, group: str, trials: int = 999, seed: int = 42) -> str:
    """Views ending in ``drawn``(group, cell_id, nbr_sum, larger, smaller): the redraws of neighbours, draw by draw."""
    m = hotspots.DRAW_PRIME
    scramble = lambda x: reduce(lambda e, f: f"(({e}) * {f} + 11) % {m}", hotspots.DRAW_STEPS, x)
    return f"""rb AS (SELECT {group} AS g, cell_id, case_count, count(*) OVER (PARTITION BY {group}) - 1 AS others,
  row_number() OVER (PARTITION BY {group} ORDER BY {scramble(f'(cell_id * {hotspots.DRAW_CELL} + {seed}) % {m}')}, cell_id) - 1 AS slot FROM {source}),
rn AS (SELECT g, cell_id, sum(nc) AS nbr_sum, count(*) AS k FROM (
  SELECT a.g, a.cell_id, b.case_count AS nc,
    row_number() OVER (PARTITION BY a.g, a.cell_id ORDER BY pow((a.cell_id // 493 - b.cell_id // 493) * 107, 2)
      + pow((a.cell_id % 493 - b.cell_id % 493) * 111, 2), b.cell_id) AS rk
  FROM rb a JOIN rb b ON a.g = b.g AND a.cell_id <> b.cell_id QUALIFY rk <= 8) GROUP BY ALL),
rs AS (SELECT rb.g, rb.cell_id, slot, others, nbr_sum, k, t, s, (rb.cell_id * {hotspots.DRAW_CELL} + t * {hotspots.DRAW_TRIAL} + {seed}) % {m} AS start
  FROM rb JOIN rn USING (g, cell_id), range(1, {trials + 1}) a(t), range(0, 8) b(s) WHERE s < k AND others >= 2),
rp AS (SELECT g, cell_id, slot, nbr_sum, t, (({scramble('start')}) * others // {m} + s * others // k
  + ({scramble(f'(start + (s + 1) * {hotspots.DRAW_STRATUM}) % {m}')}) * ((s + 1) * others // k - s * others // k) // {m}) % others AS pos FROM rs),
rd AS (SELECT rp.g, rp.cell_id, rp.t, any_value(nbr_sum) AS nbr_sum, sum(case_count) AS drawn
  FROM rp JOIN rb ON rb.g = rp.g AND rb.slot = rp.pos + CAST(rp.pos >= rp.slot AS INTEGER) GROUP BY rp.g, rp.cell_id, rp.t),
drawn AS (SELECT g, cell_id, any_value(nbr_sum) AS nbr_sum, count(*) FILTER (drawn >= nbr_sum) AS larger, count(*) FILTER (drawn <= nbr_sum) AS smaller
  FROM rd GROUP BY g, cell_id)"""


@query(
    "gi_star_permutation",
    "inc",
    "WITH act AS (SELECT 1 AS one, cell_id, count(*) AS case_count FROM inc GROUP BY cell_id HAVING count(*) >= 5),\n"
    + redraw_sql("act", "one")
    + """,
st AS (SELECT count(*) AS n, avg(case_count) AS mean, sum(case_count * case_count) AS sq FROM act),
z AS (SELECT cell_id, case_count, least(larger, 999 - larger) AS tail,
  ((nbr_sum + case_count) / 9 - mean) / (sqrt(greatest(sq / n - mean * mean, 0)) * sqrt((n / 9 - 1) / (n - 1))) AS z FROM drawn JOIN act USING (cell_id), st)
SELECT cell_id, case_count, round(z, 6) AS gi_zscore, (tail + 1) / 1000 AS gi_pvalue,
  CASE WHEN tail + 1 <= 10 THEN CASE WHEN z > 0 THEN 'hot_99' ELSE 'cold_99' END WHEN tail + 1 <= 50 THEN CASE WHEN z > 0 THEN 'hot_95' ELSE 'cold_95' END
    WHEN tail + 1 <= 100 THEN CASE WHEN z > 0 THEN 'hot_90' ELSE 'cold_90' END ELSE 'not_sig' END AS significance FROM z""",
)
def gi_star_permutation(spark, d):
    inc = tables.order_incidents(spark, d)
    counts = inc.groupBy("cell_id").agg(F.count(F.lit(1)).alias("case_count")).where(F.col("case_count") >= S.MIN_CASES_PER_CELL)
    return hotspots.permutation_p(counts).withColumn("gi_zscore", F.round("gi_zscore", 6))


@query(
    "local_moran_p",
    "inc active layers",
    "WITH " + redraw_sql("layers", "layer") + """,
li AS (SELECT * FROM (""" + LISA_SQL + """)),
pm AS (SELECT layer, avg(case_count) AS mean FROM layers GROUP BY layer),
pv AS (SELECT li.*, CASE WHEN case_count > mean THEN (least(larger, 999 - larger) + 1) / 1000 WHEN case_count < mean THEN (least(smaller, 999 - smaller) + 1) / 1000
  ELSE 1.0::DOUBLE END AS p FROM li JOIN pm USING (layer) JOIN drawn ON drawn.g = li.layer AND drawn.cell_id = li.cell_id)
SELECT layer, cell_id, case_count, lisa_i, p AS lisa_p, CASE WHEN p > 0.05 THEN 'ns' ELSE quadrant END AS quadrant FROM pv""",
)
def local_moran_p(spark, d):
    out = hotspots.local_moran_p(hotspots.layer_counts(tables.order_incidents(spark, d)), ["layer"])
    return out.withColumn("lisa_i", F.round("lisa_i", 6))
