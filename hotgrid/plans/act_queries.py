"""Coverage, audit and narrative queries."""

from pyspark.sql import functions as F

from hotgrid.operators import audit, coverage, metrics, model, narrative, panel, series, trends
from hotgrid.plans import panel_queries as pq
from hotgrid.plans.registry import HAVERSINE, cell_km, cell_lat, cell_lon, query, view
from hotgrid.session import cut_lineage
from hotgrid.sources import tables

HALFLIFE = 365
UNITS = (4, 6, 8, 10)
RADIUS = 2.0

view(
    "modal",
    """SELECT cell_id, region_name FROM inc GROUP BY cell_id, region_name QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY count(*) DESC, region_name) = 1""",
)
view(
    "risk",
    f"""SELECT region_name, cell_id, CAST(round(r * 1000000) AS BIGINT) AS risk, r AS mean_risk FROM (
SELECT cell_id, sum(exp(-0.6931471805599453 / {HALFLIFE} * date_diff('day', CAST(ts AS DATE), (SELECT max(CAST(ts AS DATE)) FROM inc)))) AS r FROM inc GROUP BY cell_id) JOIN modal USING (cell_id)""",
)
view(
    "area",
    f"""WITH p AS (SELECT *, {cell_lat('cell_id')} AS la, {cell_lon('cell_id')} AS lo FROM risk),
m AS (SELECT region_name, median(la) AS mla, median(lo) AS mlo, count(*) AS n FROM p GROUP BY region_name)
SELECT region_name, cell_id, risk FROM (SELECT p.*, count(*) OVER (PARTITION BY region_name) AS left_n FROM p JOIN m USING (region_name)
  WHERE n < 20 OR {HAVERSINE.format(lat1='mla', lon1='mlo', lat2='la', lon2='lo')} <= 60) WHERE left_n >= 20""",
)
view(
    "reach",
    f"""SELECT a.region_name, a.cell_id AS seed, a.risk AS own, b.cell_id, b.risk FROM area a JOIN area b ON a.region_name = b.region_name AND {cell_km('a.cell_id', 'b.cell_id')} <= {RADIUS}""",
)


def _greedy_views() -> str:
    prev, names = "reach", []
    for i in range(1, max(UNITS) + 1):
        view(
            f"gb{i}",
            f"""SELECT region_name, seed FROM (SELECT region_name, seed, own, sum(risk) AS gain FROM {prev} GROUP BY ALL HAVING bool_or(cell_id = seed) AND sum(risk) > 0)
QUALIFY row_number() OVER (PARTITION BY region_name ORDER BY gain DESC, own DESC, seed) = 1""",
        )
        view(f"gt{i}", f"SELECT region_name, seed, cell_id, risk, {i} AS unit FROM {prev} SEMI JOIN gb{i} USING (region_name, seed)")
        view(f"go{i}", f"SELECT * FROM {prev} ANTI JOIN gt{i} USING (region_name, cell_id)")
        names += [f"gb{i}", f"gt{i}", f"go{i}"]
        prev = f"go{i}"
    view("plan", " UNION ALL ".join(f"SELECT * FROM gt{i}" for i in range(1, max(UNITS) + 1)))
    return " ".join(names) + " plan"


def _volume_views() -> str:
    view(
        "vol0",
        "SELECT a.region_name, a.cell_id, a.risk, coalesce(v, 0) AS v FROM area a LEFT JOIN (SELECT region_name, cell_id, count(*) AS v FROM inc GROUP BY ALL) USING (region_name, cell_id)",
    )
    names = ["vol0"]
    for i in range(1, max(UNITS) + 1):
        view(
            f"vr{i}",
            f"""SELECT r.region_name, r.cell_id, r.risk, {i} AS unit FROM reach r SEMI JOIN
(SELECT region_name, cell_id AS seed FROM vol{i - 1} QUALIFY row_number() OVER (PARTITION BY region_name ORDER BY v DESC, risk DESC, cell_id) = 1) b USING (region_name, seed)""",
        )
        view(f"vol{i}", f"SELECT * FROM vol{i - 1} ANTI JOIN vr{i} USING (region_name, cell_id)")
        names += [f"vr{i}", f"vol{i}"]
    every = " UNION ALL ".join(f"SELECT * FROM vr{i}" for i in range(1, max(UNITS) + 1))
    view("vplan", f"SELECT region_name, cell_id, risk, min(unit) AS unit FROM ({every}) GROUP BY ALL")
    return " ".join(names) + " vplan"


AREA = "inc modal risk area reach "
GREEDY = _greedy_views()
VOLUME = _volume_views()
_DRAW = "((cell_id * 7919 + trial * 104729) % 1000003)"
view(
    "rplan",
    f"""SELECT region_name, trial, cell_id, risk, min(unit) AS unit FROM (
  SELECT region_name, trial, cell_id AS seed, row_number() OVER (PARTITION BY region_name, trial ORDER BY ({_DRAW} * {_DRAW} + trial * 31 * {_DRAW}) % 1000003, cell_id) AS unit
  FROM area, (SELECT unnest(range(1, 21)) AS trial)) JOIN reach USING (region_name, seed) WHERE unit <= 10 GROUP BY ALL""",
)


def share_view(name: str, plan: str, trials: int = 1) -> str:
    return f"""SELECT region_name, units, sum(CASE WHEN unit <= units THEN p.risk ELSE 0 END) / {trials} / any_value(total) * 100 AS {name}
FROM {plan} p JOIN (SELECT region_name, sum(risk) AS total FROM area GROUP BY region_name) USING (region_name), (SELECT unnest([4, 6, 8, 10]) AS units) GROUP BY region_name, units"""


view("gshare", share_view("g", "plan"))
view("vshare", share_view("q", "vplan"))
view("rshare", share_view("r", "rplan", 20))
view(
    "summ",
    """SELECT region_name, units, round(r, 2) AS random_pct, round(q, 2) AS statusquo_pct, g2 AS greedy_pct,
CASE WHEN r > 0 THEN round((g2 - r) / r * 100, 1) ELSE 0 END AS uplift_pct, CASE WHEN r > 0 THEN round(g2 / r, 1) END AS uplift_x,
CASE WHEN q > 0 THEN round((g2 - q) / q * 100, 1) ELSE 0 END AS uplift_vs_statusquo_pct, CASE WHEN q > 0 THEN round(g2 / q, 2) END AS uplift_vs_statusquo_x
FROM (SELECT *, round(g, 2) AS g2 FROM gshare) JOIN vshare USING (region_name, units) JOIN rshare USING (region_name, units)""",
)
SUMMARY = AREA + GREEDY + " " + VOLUME + " rplan gshare vshare rshare summ"


def risk_cells(spark, d):
    inc = tables.order_incidents(spark, d)
    risk = coverage.weigh(panel.decayed_risk(inc, HALFLIFE), "fallback_risk")
    return cut_lineage(coverage.scope_risk(risk, inc).select("region_name", "cell_id", "risk"))


@query("cell_regions", "inc modal", "SELECT * FROM modal")
def cell_regions(spark, d):
    return coverage.cell_regions(tables.order_incidents(spark, d))


@query("scoped_risk", "inc modal risk area", "SELECT * FROM area")
def scoped_risk(spark, d):
    return risk_cells(spark, d)


def greedy(spark, d):
    return coverage.greedy_coverage(risk_cells(spark, d))


@query("greedy_coverage", AREA + GREEDY, "SELECT * FROM plan")
def greedy_coverage(spark, d):
    return greedy(spark, d)


@query(
    "allocations",
    AREA + GREEDY,
    f"""SELECT region_name, unit, seed, count(*) AS cells_covered, CAST(sum(risk) AS BIGINT) AS risk_covered, string_agg(CAST(cell_id AS VARCHAR), ',' ORDER BY cell_id) AS cell_ids,
round({cell_lat('seed')}, 6) AS center_lat, round({cell_lon('seed')}, 6) AS center_lon FROM plan GROUP BY region_name, unit, seed""",
)
def allocations(spark, d):
    out = coverage.allocations(greedy(spark, d))
    return out.withColumn("cell_ids", F.array_join(F.col("cell_ids").cast("array<string>"), ",")).withColumns(
        {c: F.round(c, 6) for c in ("center_lat", "center_lon")}
    )


@query("random_coverage", "inc modal risk area reach rplan rshare", "SELECT region_name, CAST(units AS INTEGER) AS units, round(r, 6) AS random_pct FROM rshare")
def random_coverage(spark, d):
    return coverage.random_coverage(risk_cells(spark, d)).withColumn("random_pct", F.round("random_pct", 6))


@query("statusquo_coverage", AREA + VOLUME + " vshare", "SELECT region_name, CAST(units AS INTEGER) AS units, round(q, 6) AS statusquo_pct FROM vshare")
def statusquo_coverage(spark, d):
    out = coverage.volume_coverage(risk_cells(spark, d), tables.order_incidents(spark, d))
    return out.withColumn("statusquo_pct", F.round("statusquo_pct", 6))


def summary_of(spark, d, cells, plan):
    return coverage.coverage_summary(
        coverage.greedy_shares(plan, cells),
        coverage.random_coverage(cells),
        coverage.volume_coverage(cells, tables.order_incidents(spark, d)),
    )


@query("coverage_summary", SUMMARY, "SELECT * REPLACE (CAST(units AS INTEGER) AS units) FROM summ")
def coverage_summary(spark, d):
    cells = risk_cells(spark, d)
    return summary_of(spark, d, cells, coverage.greedy_coverage(cells))


view("recent", "SELECT * FROM inc WHERE ts >= (SELECT max(ts) FROM inc) - INTERVAL 30 DAY")
view(
    "sheets",
    f"""WITH a AS (SELECT region_name, unit, seed, count(*) AS cells_covered, CAST(sum(risk) AS BIGINT) AS risk_covered FROM plan GROUP BY ALL),
r AS (SELECT p.region_name, p.unit, category_name, severity_name FROM plan p JOIN recent USING (region_name, cell_id)),
t AS (SELECT region_name, unit, category_name, count(*) AS n, row_number() OVER (PARTITION BY region_name, unit ORDER BY count(*) DESC, category_name) AS k FROM r GROUP BY region_name, unit, category_name QUALIFY k <= 5),
tt AS (SELECT region_name, unit, string_agg(category_name || '=' || n, ';' ORDER BY k) AS top_types, arg_min(category_name, k) AS lead,
  string_agg(category_name, ' and ' ORDER BY k) FILTER (k <= 2) AS focus FROM t GROUP BY ALL),
s AS (SELECT region_name, unit, severity_name, count(*) AS n FROM r GROUP BY ALL),
ss AS (SELECT region_name, unit, string_agg(severity_name || '=' || n, ';' ORDER BY n DESC, severity_name) AS severity_mix, coalesce(sum(n) FILTER (severity_name = 'severe'), 0) AS severe FROM s GROUP BY ALL),
c AS (SELECT region_name, unit, count(*) AS recent_incidents FROM r GROUP BY ALL)
SELECT region_name, unit, seed, cells_covered, risk_covered, coalesce(recent_incidents, 0) AS recent_incidents, coalesce(top_types, '') AS top_types, coalesce(severity_mix, '') AS severity_mix,
  coalesce(severe, 0) AS severe, coalesce(focus, '') AS focus, {cell_lat('seed')} AS la, {cell_lon('seed')} AS lo, coalesce(lead, 'General') AS lead
FROM a LEFT JOIN c USING (region_name, unit) LEFT JOIN tt USING (region_name, unit) LEFT JOIN ss USING (region_name, unit)""",
)
SHEETS = AREA + GREEDY + " recent sheets"


def sheets(spark, d, plan=None):
    return coverage.briefings(greedy(spark, d) if plan is None else plan, tables.order_incidents(spark, d))


@query(
    "briefings",
    SHEETS,
    """SELECT region_name, unit, seed, cells_covered, risk_covered, recent_incidents, top_types, severity_mix,
'Patrol ' || unit || printf(': Deploy to (%.4f, %.4f). ', la, lo) || 'Covers ' || cells_covered || ' cells with ' || recent_incidents || ' recent incidents. Primary concern: ' || lead || '.' AS description FROM sheets""",
)
def briefings(spark, d):
    out = sheets(spark, d)
    return out.select(
        "region_name", "unit", "seed", "cells_covered", "risk_covered", "recent_incidents",
        coverage.map_text(F.col("top_types")).alias("top_types"), coverage.map_text(F.col("severity_mix")).alias("severity_mix"), "description",
    )


@query(
    "briefing_rollup",
    SHEETS,
    """WITH t AS (SELECT region_name, split_part(x, '=', 1) AS c, sum(CAST(split_part(x, '=', 2) AS BIGINT)) AS n FROM (SELECT region_name, unnest(string_split(top_types, ';')) AS x FROM sheets WHERE top_types <> '') GROUP BY ALL),
b AS (SELECT region_name, c, n FROM t QUALIFY row_number() OVER (PARTITION BY region_name ORDER BY n DESC, c) = 1)
SELECT region_name, CAST(sum(recent_incidents) AS BIGINT) AS total_incidents, coalesce(any_value(c), '') AS top_type, CAST(coalesce(any_value(n), 0) AS BIGINT) AS top_type_count, CAST(sum(severe) AS BIGINT) AS severe_total
FROM sheets LEFT JOIN b USING (region_name) GROUP BY region_name""",
)
def briefing_rollup(spark, d):
    return coverage.briefing_rollup(sheets(spark, d))


@query(
    "recommendations",
    SHEETS,
    """SELECT region_name, unit, printf('Deploy patrol unit at (%.3f, %.3f). ', la, lo) || recent_incidents || ' incidents in last 30 days covering ' || cells_covered || ' grid cells. Focus: ' || focus || '. '
|| CASE WHEN severe > 0 THEN severe || ' heinous cases require priority response. ' ELSE '' END AS recommendation FROM sheets""",
)
def recommendations(spark, d):
    return coverage.recommendation(sheets(spark, d))


@query("allocation_centre", SHEETS, "SELECT region_name, round(avg(la), 6) AS lat, round(avg(lo), 6) AS lon FROM sheets GROUP BY region_name")
def allocation_centre(spark, d):
    out = coverage.mean_centre(coverage.allocations(greedy(spark, d)))
    return out.select("region_name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(
    "scenario_bundle",
    SUMMARY + " recent sheets",
    """SELECT region_name, region_name AS safe, 'p' || units AS scenario, any_value(greedy_pct) AS greedy_pct, count(*) AS n_allocations, count(*) AS n_briefings
FROM summ JOIN sheets USING (region_name) WHERE unit <= units GROUP BY region_name, units""",
)
def scenario_bundle(spark, d):
    """Every scenario inside every region's bundle, opened up again."""
    cells = risk_cells(spark, d)
    plan = coverage.greedy_coverage(cells)
    parts = coverage.scenario_parts(plan, summary_of(spark, d, cells, plan), sheets(spark, d, plan))
    opened = coverage.scenario_bundle(parts).select("region_name", "safe", F.explode("scenarios").alias("scenario", "v"))
    return opened.select(
        "region_name", "safe", "scenario", F.col("v.summary.greedy_pct").alias("greedy_pct"),
        F.size("v.allocations").cast("bigint").alias("n_allocations"), F.size("v.briefings").cast("bigint").alias("n_briefings"),
    )


@query(
    "scenario_index",
    SUMMARY,
    """SELECT region_name, replace(region_name, ' ', '_') AS safe, n_cases, coverage, CAST(row_number() OVER (ORDER BY CASE WHEN region_name = 'NATION_5' THEN 0 ELSE 1 END, n_cases DESC, region_name) AS INTEGER) AS position
FROM (SELECT region_name, max(greedy_pct) FILTER (units = 6) AS coverage FROM summ GROUP BY region_name HAVING count(DISTINCT units) = 4) JOIN (SELECT region_name, count(*) AS n_cases FROM inc GROUP BY region_name) USING (region_name)""",
)
def scenario_index(spark, d):
    volumes = tables.order_incidents(spark, d).groupBy("region_name").agg(F.count(F.lit(1)).alias("n_cases"))
    return coverage.scenario_index(coverage_summary(spark, d), volumes, "NATION_5")


# --- audits ------------------------------------------------------------------------
view("firsts", "SELECT cell_id, arg_min(region_name, incident_id) AS region_name FROM inc GROUP BY cell_id")
view(
    "disp",
    """SELECT region_name, avg(mean_risk) AS mean_risk, max(mean_risk) AS max_risk, sum(mean_risk) AS total_risk, count(*) AS n_cells, any_value(n_cases) AS n_cases, any_value(n_cases) / count(*) AS cases_per_cell
FROM (SELECT cell_id, mean_risk FROM risk) JOIN firsts USING (cell_id) JOIN (SELECT region_name, count(*) AS n_cases FROM inc GROUP BY region_name) USING (region_name) GROUP BY region_name""",
)
DISP = "inc modal risk firsts disp"
_D6 = ("mean_risk", "max_risk", "total_risk", "cases_per_cell")


def disparity(spark, d):
    inc = tables.order_incidents(spark, d)
    risk = panel.decayed_risk(inc, HALFLIFE).withColumnRenamed("fallback_risk", "mean_risk")
    return audit.region_disparity(risk.join(coverage.first_regions(inc), "cell_id"), inc)


@query("region_disparity", DISP, "SELECT region_name, n_cells, n_cases, " + ", ".join(f"round({c}, 6) AS {c}" for c in _D6) + " FROM disp")
def region_disparity(spark, d):
    return disparity(spark, d).withColumns({c: F.round(c, 6) for c in _D6})


view(
    "dmet",
    """SELECT round(max(mean_risk) / min(mean_risk), 2) AS max_min_ratio, round(stddev_pop(mean_risk) / avg(mean_risk), 4) AS coefficient_of_variation, count(*) AS n_regions,
round(sum((2 * i - n - 1) * mean_risk) / (any_value(n) * sum(mean_risk)), 4) AS gini_coefficient
FROM (SELECT *, row_number() OVER (ORDER BY mean_risk) AS i, count(*) OVER () AS n FROM disp)""",
)


def disparity_row(spark, d):
    out = audit.disparity_metrics(cut_lineage(disparity(spark, d)))
    return out.select(
        F.round("max_min_ratio", 2).alias("max_min_ratio"), F.round("coefficient_of_variation", 4).alias("coefficient_of_variation"),
        "n_regions", F.round("gini_coefficient", 4).alias("gini_coefficient"),
    )


@query("disparity_metrics", DISP + " dmet", "SELECT * FROM dmet")
def disparity_metrics(spark, d):
    return disparity_row(spark, d)


@query(
    "risk_extremes",
    DISP,
    """SELECT region_name, n_cases, CAST(p AS INTEGER) AS position, side FROM (SELECT *, row_number() OVER (ORDER BY round(mean_risk, 9) DESC, region_name) AS p, 'highest' AS side FROM disp UNION ALL
SELECT *, row_number() OVER (ORDER BY round(mean_risk, 9), region_name), 'lowest' FROM disp) WHERE p <= 5""",
)
def risk_extremes(spark, d):
    rows = cut_lineage(disparity(spark, d).withColumn("mean_risk", F.round("mean_risk", 9)))
    return audit.extremes(rows).select("region_name", "n_cases", "position", "side")


view(
    "rep",
    """WITH c AS (SELECT region_name, count(*) AS total_cases, count(x.case_id) AS cleared_cases FROM inc LEFT JOIN
(SELECT DISTINCT l_orderkey AS case_id FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1) x ON case_id = incident_id GROUP BY region_name),
m AS (SELECT median(cleared_cases / total_cases) AS median_rate FROM c)
SELECT region_name, total_cases, cleared_cases, cleared_cases / total_cases AS clearance_rate, median_rate,
least(greatest(median_rate / greatest(cleared_cases / total_cases, 0.01), 0.5), 2.0) AS reporting_weight,
CASE WHEN cleared_cases / total_cases < median_rate * 0.7 THEN 'low' WHEN cleared_cases / total_cases > median_rate * 1.3 THEN 'high' ELSE 'normal' END AS flag FROM c, m""",
)


def reporting(spark, d):
    return audit.reporting_weights(tables.order_incidents(spark, d), tables.charged_cases(spark, d))


_R6 = ("clearance_rate", "median_rate", "reporting_weight")


@query("reporting_bias", "inc rep", "SELECT region_name, total_cases, cleared_cases, flag, " + ", ".join(f"round({c}, 6) AS {c}" for c in _R6) + " FROM rep")
def reporting_bias(spark, d):
    return reporting(spark, d).withColumns({c: F.round(c, 6) for c in _R6})


view("rsum", "SELECT round(max(median_rate), 4) AS median_clearance_rate, count(*) FILTER (flag = 'low') AS regions_low, count(*) FILTER (flag = 'high') AS regions_high FROM rep")


def reporting_row(spark, d):
    return audit.reporting_summary(reporting(spark, d)).withColumn("median_clearance_rate", F.round("median_clearance_rate", 4))


@query("audit_report", DISP + " dmet rep rsum", "SELECT gini_coefficient, max_min_ratio, n_regions, median_clearance_rate, regions_low, regions_high FROM dmet, rsum")
def audit_report(spark, d):
    """The nested report, with the fields SQL can repeat."""
    report = audit.audit_report(disparity_row(spark, d), reporting_row(spark, d))
    return report.select(
        "disparity_metrics.gini_coefficient", "disparity_metrics.max_min_ratio", "disparity_metrics.n_regions",
        "reporting_bias.median_clearance_rate", "reporting_bias.regions_low", "reporting_bias.regions_high",
    )


# --- narratives ----------------------------------------------------------------------
def _feed(spark, d):
    return cut_lineage(series.anomaly_feed(series.rolling_anomalies(series.daily_series(tables.order_incidents(spark, d)))))


def _summary(spark, d):
    return cut_lineage(trends.region_summary(tables.order_incidents(spark, d)))


FEED = "inc summary daily rolling feed"


def alerts_sql(n_anomalies: str, min_yoy: int, limit: str) -> str:
    return f"""WITH a AS (SELECT 'alert' AS kind, rank AS source_rank, CASE WHEN severity = 'critical' THEN 'critical' WHEN zscore > 3 THEN 'high' ELSE 'medium' END AS severity,
  category_name || ' ' || CASE WHEN zscore > 0 THEN 'spike' ELSE 'drop' END || ' detected in ' || region_name AS title,
  observed || ' observed vs ' || printf('%.0f', round(expected)) || ' expected (' || CASE WHEN zscore > 0 THEN '+' ELSE '-' END || printf('%.0f', round(abs((observed - expected) / greatest(expected, 1.0) * 100))) || '%). Z-score: ' || printf('%.1f', round(zscore, 1)) AS detail, region_name
  FROM feed {n_anomalies}),
u AS (SELECT *, row_number() OVER (ORDER BY total_cases DESC, region_name) AS k FROM summary WHERE yoy_change_pct > {min_yoy} {limit}),
t AS (SELECT 'trend' AS kind, k AS source_rank, CASE WHEN yoy_change_pct > 15 THEN 'high' ELSE 'medium' END AS severity, region_name || printf(' crime trending +%.1f%% YoY', yoy_change_pct) AS title,
  latest_year_cases || ' cases in ' || latest_year || ', led by ' || top_type || printf('. Heinous: %.1f%%', severe_pct) AS detail, region_name FROM u),
x AS (SELECT * FROM a UNION ALL SELECT * FROM t)
SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, kind, source_rank) AS position FROM x"""


@query("alert_feed", FEED, alerts_sql("WHERE rank <= 12", 8, "QUALIFY k <= 5"))
def alert_feed(spark, d):
    return narrative.alert_feed(_feed(spark, d), _summary(spark, d))


@query("alert_ticker", FEED, alerts_sql("", 10, ""))
def alert_ticker(spark, d):
    return narrative.alert_feed(_feed(spark, d), _summary(spark, d), None, None, 10)


@query(
    "region_brief",
    FEED,
    """WITH p AS (SELECT region_name, count(*) AS n_alerts, count(*) FILTER (severity = 'critical') AS crit, arg_min(category_name, rank) AS fc, arg_min(zscore, rank) AS fz FROM feed GROUP BY region_name),
b AS (SELECT s.*, coalesce(n_alerts, 0) AS na, coalesce(crit, 0) AS nc, fc, fz, coalesce(yoy_change_pct, 0) AS y FROM summary s LEFT JOIN p USING (region_name)),
l AS (SELECT *, CASE WHEN nc > 0 OR y > 20 THEN 'CRITICAL' WHEN na >= 3 OR y > 10 THEN 'HIGH' WHEN na >= 1 OR y > 5 THEN 'MEDIUM' ELSE 'LOW' END AS level,
  CASE WHEN y > 2 THEN 'increasing' WHEN y < -2 THEN 'decreasing' ELSE 'stable' END AS trend FROM b)
SELECT region_name, level, trend, yoy_change_pct AS trend_pct, na AS n_alerts,
region_name || ' recorded ' || latest_year_cases || ' FIRs in ' || latest_year || CASE trend WHEN 'increasing' THEN printf(', up %.1f%% year-over-year', y) WHEN 'decreasing' THEN printf(', down %.1f%% year-over-year', abs(y)) ELSE '' END
 || '. Top offence: ' || top_type || ' (' || top_type_count || ' cases).' || CASE WHEN severe_pct > 10 THEN printf(' %.1f%% of cases are heinous offences.', severe_pct) ELSE '' END
 || CASE WHEN na > 0 THEN ' ' || na || ' active anomaly alert' || CASE WHEN na > 1 THEN 's' ELSE '' END || '.' ELSE '' END AS narrative,
CASE WHEN level IN ('CRITICAL', 'HIGH') THEN 'Increase patrol presence. Focus on ' || top_type || ' prevention.' || coalesce(' Priority: ' || fc || printf(' spike (z=%.1f).', round(fz, 1)), '')
 WHEN trend = 'increasing' THEN 'Monitor ' || top_type || ' trend. Consider preventive deployment.'
 ELSE printf('Maintain current deployment. Clearance rate: %.1f%%.', clearance_pct) END AS recommendation FROM l""",
)
def region_brief(spark, d):
    return narrative.region_brief(_summary(spark, d), _feed(spark, d))


@query(
    "area_level",
    FEED,
    """WITH x AS (SELECT (SELECT count(*) FROM feed) AS n_alerts, (SELECT avg(yoy_change_pct) FROM summary) AS y)
SELECT n_alerts, round(y, 6) AS mean_yoy, CASE WHEN n_alerts >= 8 OR y > 15 THEN 'CRITICAL' WHEN n_alerts >= 4 OR y > 8 THEN 'HIGH' WHEN n_alerts >= 2 OR y > 3 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM x""",
)
def area_level(spark, d):
    return narrative.area_level(_feed(spark, d), _summary(spark, d)).withColumn("mean_yoy", F.round("mean_yoy", 6))


@query(
    "kpis",
    "inc active layers gi_layers summary",
    """SELECT (SELECT CAST(sum(latest_year_cases) AS BIGINT) FROM summary) AS latest_year_cases, (SELECT count(*) FROM gi_layers WHERE layer = 'overall' AND starts_with(significance, 'hot')) AS hot_cells,
(SELECT count(*) FROM summary WHERE yoy_change_pct > 5) AS rising_regions""",
)
def kpis(spark, d):
    from hotgrid.plans import spatial_queries

    summary = trends.region_summary(tables.order_incidents(spark, d))
    hot = spatial_queries.gi_star(spark, d).agg(F.count_if(F.col("significance").startswith("hot"))).scalar()
    return summary.agg(
        F.sum("latest_year_cases").alias("latest_year_cases"), F.count_if(F.col("yoy_change_pct") > 5).alias("rising_regions")
    ).withColumn("hot_cells", hot)


# --- headline: all layers, a row per region ---------------------------------------------------
@query(
    "headline",
    pq.SCORED.replace("evt act_evt", "inc evt act_evt") + " test_cells pai modal risk area reach " + GREEDY + " " + VOLUME + " rplan gshare vshare rshare summ firsts disp dmet rep rsum",
    """SELECT region_name, (SELECT pai FROM pai WHERE area_pct = 5) AS pai_5pct, (SELECT hit_rate FROM pai WHERE area_pct = 5) AS hit_rate_5pct,
greedy_pct AS optimized_coverage_pct, statusquo_pct AS statusquo_coverage_pct, uplift_pct AS coverage_uplift_pct, uplift_vs_statusquo_pct, gini_coefficient, regions_low AS regions_flagged
FROM summ, dmet, rsum WHERE units = 6""",
)
def headline(spark, d):
    pai = metrics.accuracy_index(pq.scored_matrix(spark, d)).where(F.col("area_pct") == 5)
    row = coverage_summary(spark, d).where(F.col("units") == 6)
    gini = disparity_row(spark, d).select("gini_coefficient").scalar()
    low = reporting_row(spark, d).select("regions_low").scalar()
    return row.select(
        "region_name",
        pai.select("pai").scalar().alias("pai_5pct"),
        pai.select("hit_rate").scalar().alias("hit_rate_5pct"),
        F.col("greedy_pct").alias("optimized_coverage_pct"),
        F.col("statusquo_pct").alias("statusquo_coverage_pct"),
        F.col("uplift_pct").alias("coverage_uplift_pct"),
        "uplift_vs_statusquo_pct",
        gini.alias("gini_coefficient"),
        low.alias("regions_flagged"),
    )


@query(
    "model_narrative",
    pq.SCORED + " test_cells pai contrib",
    f"""WITH s AS (SELECT has_crime AS y, round(risk_score, 12) AS p FROM evt_scored WHERE split = 'test'),
r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS ar FROM s),
a AS (SELECT (sum(ar) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r),
g AS (SELECT feature, avg(abs(contribution)) AS v FROM contrib GROUP BY feature ORDER BY v DESC LIMIT 3)
SELECT printf('The model identifies %.1f%% of future crime in just 5%% of the area (AUC %.2f). ', hit_rate, auc) || printf('That is a %.1f× improvement over random deployment. ', pai)
|| 'Top prediction drivers: ' || (SELECT string_agg({pq._title_sql('feature')}, ', ' ORDER BY v DESC) FROM g) || '.' AS narrative FROM pai, a WHERE area_pct = 5""",
)
def model_narrative(spark, d):
    scored = cut_lineage(pq.scored_matrix(spark, d))
    pai = metrics.accuracy_index(scored).where(F.col("area_pct") == 5)
    test = scored.where(F.col("split") == "test").withColumn("p", F.round("risk_score", 12))
    auc = metrics.ranking_metrics(test, "has_crime", "p").select("auc").scalar()
    top = model.global_attribution(scored, pq.COEF, 3).withColumn("title", model.feature_title(F.col("feature")))
    drivers = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("mean_abs")).alias("k"), "title"))).alias("t"))
    drivers = drivers.select(F.array_join(F.transform("t", lambda x: x["title"]), ", ")).scalar()
    # the SQL divides 0.0 by 0 there, which sets the sign of its result (on x86)
    return pai.select(narrative.model_sentence(auc, F.col("hit_rate"), F.col("pai"), drivers, "-nan").alias("narrative"))
