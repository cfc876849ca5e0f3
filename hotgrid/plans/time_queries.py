"""Trend and series queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hotgrid.operators import series, trends
from hotgrid.plans.registry import normal_p_sql, query, view
from hotgrid.sources import tables

view(
    "summary",
    """
SELECT region_name, total_cases, CAST(ly AS INTEGER) AS latest_year, latest_year_cases, prior_year_cases,
  CASE WHEN prior_year_cases > 0 THEN round((latest_year_cases - prior_year_cases) / prior_year_cases * 100, 1) END AS yoy_change_pct,
  top_type, top_type_count, severe_count, round(severe_count / total_cases * 100, 1) AS severe_pct,
  round(cleared_count / total_cases * 100, 1) AS clearance_pct
FROM (
  SELECT region_name, ly, count(*) AS total_cases, count(*) FILTER (year(ts) = ly) AS latest_year_cases,
    count(*) FILTER (year(ts) = py) AS prior_year_cases, count(*) FILTER (severity_id = 1) AS severe_count,
    count(*) FILTER (status_id >= 3) AS cleared_count
  FROM inc, (SELECT max(y) AS ly, max(y) FILTER (y < (SELECT max(year(ts)) FROM inc)) AS py FROM (SELECT DISTINCT year(ts) AS y FROM inc))
  GROUP BY region_name, ly)
JOIN (SELECT region_name, category_name AS top_type, count(*) AS top_type_count FROM inc GROUP BY region_name, category_name
      QUALIFY row_number() OVER (PARTITION BY region_name ORDER BY count(*) DESC, category_name) = 1) USING (region_name)""",
)


@query("region_summary", "inc summary", "SELECT * FROM summary")
def region_summary(spark, d):
    return trends.region_summary(tables.order_incidents(spark, d))


view(
    "periods",
    """
SELECT freq, dim, label, period, count(*) AS n FROM (
  SELECT unnest(['M', 'W']) AS freq,
         unnest([strftime(ts, '%Y-%m'), strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d')]) AS period,
         category_name, severity_name FROM inc),
  LATERAL (SELECT unnest(['overall', 'category', 'severity']) AS dim, unnest(['ALL', category_name, severity_name]) AS label)
GROUP BY ALL""",
)


@query("period_counts", "inc periods", "SELECT * FROM periods")
def period_counts(spark, d):
    return trends.period_counts(tables.order_incidents(spark, d))


@query(
    "trimmed_trends",
    "inc periods",
    """WITH r AS (SELECT *, row_number() OVER w AS t, count(*) OVER (PARTITION BY freq, dim, label) AS len,
  row_number() OVER (PARTITION BY freq, dim, label ORDER BY n, period) AS r FROM periods WINDOW w AS (PARTITION BY freq, dim, label ORDER BY period)),
m AS (SELECT *, max(CASE WHEN r = len // 2 + 1 THEN n END) OVER (PARTITION BY freq, dim, label) AS med FROM r),
l AS (SELECT *, max(CASE WHEN n >= 0.5 * med THEN t END) OVER (PARTITION BY freq, dim, label) AS lst FROM m)
SELECT freq, dim, label, period, n FROM l WHERE len < 8 OR t <= coalesce(lst, 1)""",
)
def trimmed_trends(spark, d):
    return trends.trim_partial_tail(period_counts(spark, d), ["freq", "dim", "label"])


@query(
    "type_breakdown",
    "inc",
    """WITH s AS (SELECT unnest(['ALL', region_name]) AS scope, category_name, severity_id FROM inc)
SELECT scope, category_name, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY scope) * 100, 2) AS pct,
  round(count(*) FILTER (severity_id = 1) / count(*) * 100, 1) AS severe_pct,
  round(count(*) FILTER (severity_id = 2) / count(*) * 100, 1) AS standard_pct,
  round(count(*) FILTER (severity_id = 3) / count(*) * 100, 1) AS minor_pct
FROM s GROUP BY scope, category_name""",
)
def type_breakdown(spark, d):
    return trends.type_breakdown(tables.order_incidents(spark, d))


@query(
    "region_trends",
    "inc",
    """WITH s AS (SELECT region_name, unnest(['ALL', category_name]) AS type_label, ts, cell_id FROM inc)
SELECT region_name, type_label, 'monthly' AS kind, strftime(ts, '%Y-%m') AS item, count(*) AS n FROM s GROUP BY ALL
UNION ALL SELECT region_name, type_label, 'yearly', strftime(ts, '%Y'), count(*) FROM s GROUP BY ALL
UNION ALL SELECT region_name, type_label, 'total', 'total', count(*) FROM s GROUP BY ALL
UNION ALL (SELECT region_name, type_label, 'place', CAST(cell_id AS VARCHAR), count(*) FROM s GROUP BY region_name, type_label, cell_id
  QUALIFY row_number() OVER (PARTITION BY region_name, type_label ORDER BY count(*) DESC, cell_id) <= 5)""",
)
def region_trends(spark, d):
    return trends.region_trends(tables.order_incidents(spark, d))


@query(
    "region_trends_nested",
    "inc",
    """WITH s AS (SELECT region_name, unnest(['ALL', category_name]) AS type_label, ts FROM inc),
m AS (SELECT region_name, type_label, strftime(ts, '%Y-%m') AS item, count(*) AS n FROM s GROUP BY ALL)
SELECT region_name, type_label, string_agg(item || '=' || n, ';' ORDER BY item) AS monthly, CAST(sum(n) AS BIGINT) AS total FROM m GROUP BY region_name, type_label""",
)
def region_trends_nested(spark, d):
    nested = trends.nest_region_trends(region_trends(spark, d))
    text = F.array_join(F.transform("monthly", lambda x: F.concat(x["item"], F.lit("="), x["count"].cast("string"))), ";")
    return nested.select("region_name", "type_label", text.alias("monthly"), "total")


def _segments(spark, d):
    cust = tables.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return tables.order_incidents(spark, d).join(cust, F.col("station_id") == F.col("c_custkey"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SEG_SQL = ", ".join(f"count(*) FILTER (c_mktsegment = '{s}') AS \"{s}\"" for s in SEGMENTS)


@query(
    "type_by_segment",
    "inc",
    f"SELECT category_name, {SEG_SQL} FROM inc JOIN customer ON station_id = c_custkey GROUP BY category_name",
)
def type_by_segment(spark, d):
    return trends.crosstab(_segments(spark, d), "category_name", "c_mktsegment", SEGMENTS)


@query(
    "year_by_segment",
    "inc",
    f"SELECT CAST(year(ts) AS INTEGER) AS year, {SEG_SQL} FROM inc JOIN customer ON station_id = c_custkey GROUP BY 1",
)
def year_by_segment(spark, d):
    return trends.crosstab(_segments(spark, d).withColumn("year", F.year("ts")), "year", "c_mktsegment", SEGMENTS)


@query(
    "hour_by_severity",
    "evt",
    """SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) FILTER (severity_id = 1) AS "1", count(*) FILTER (severity_id = 2) AS "2",
count(*) FILTER (severity_id = 3) AS "3" FROM evt GROUP BY 1""",
)
def hour_by_severity(spark, d):
    evt = tables.event_incidents(spark, d).withColumn("hour", F.hour("ts"))
    return trends.crosstab(evt, "hour", "severity_id", [1, 2, 3])


@query(
    "segment_shares",
    "inc",
    """SELECT c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct
FROM inc JOIN customer ON station_id = c_custkey GROUP BY c_mktsegment""",
)
def segment_shares(spark, d):
    return trends.shares(_segments(spark, d), "c_mktsegment")


@query(
    "region_attribute_profile",
    "inc",
    """WITH s AS (SELECT region_name, c_mktsegment, subtype_id FROM inc JOIN customer ON station_id = c_custkey),
t AS (SELECT region_name, c_mktsegment AS dominant, count(*) AS n, sum(count(*)) OVER (PARTITION BY region_name) AS total FROM s GROUP BY region_name, c_mktsegment
  QUALIFY row_number() OVER (PARTITION BY region_name ORDER BY count(*) DESC, c_mktsegment) = 1)
SELECT region_name, CAST(total AS BIGINT) AS total, dominant, round(n / total * 100, 1) AS dominant_pct, median_value
FROM t JOIN (SELECT region_name, median(subtype_id) AS median_value FROM s GROUP BY region_name) USING (region_name)""",
)
def region_attribute_profile(spark, d):
    return trends.attribute_profile(_segments(spark, d), "region_name", "c_mktsegment", "subtype_id")


# --- series --------------------------------------------------------------------
view(
    "daily",
    """
SELECT region_name, category_name, CAST(u AS DATE) AS date, coalesce(n, 0) AS n FROM (
  SELECT region_name, category_name, unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS u
  FROM inc GROUP BY region_name, category_name) g
LEFT JOIN (SELECT region_name, category_name, CAST(ts AS DATE) AS u, count(*) AS n FROM inc GROUP BY ALL) c USING (region_name, category_name, u)""",
)
view(
    "rolling",
    """
SELECT region_name, category_name, date, n AS observed, round(s1 / 30, 2) AS expected, round(n - s1 / 30, 2) AS residual,
  round((30 * n - s1) / sqrt(30 * s2 - s1 * s1), 2) AS zscore,
  CASE WHEN abs((30 * n - s1) / sqrt(30 * s2 - s1 * s1)) >= 5 THEN 'critical' WHEN abs((30 * n - s1) / sqrt(30 * s2 - s1 * s1)) >= 4 THEN 'high'
       WHEN abs((30 * n - s1) / sqrt(30 * s2 - s1 * s1)) >= 3 THEN 'medium' ELSE 'low' END AS severity
FROM (SELECT *, count(*) OVER w AS w, CAST(sum(n) OVER w AS BIGINT) AS s1, CAST(sum(n * n) OVER w AS BIGINT) AS s2 FROM daily
      WINDOW w AS (PARTITION BY region_name, category_name ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
WHERE w = 30 AND 30 * s2 - s1 * s1 > 0 AND (30 * n - s1) * (30 * n - s1) >= 9 * (30 * s2 - s1 * s1)""",
)
view(
    "feed",
    """
SELECT region_name, category_name, date, observed, expected, zscore, severity, row_number() OVER (ORDER BY abs(zscore) DESC, region_name, category_name, date) AS rank,
  'Unusual ' || CASE WHEN zscore > 0 THEN 'spike' ELSE 'drop' END || ' in ' || category_name || ' cases in ' || region_name || ' on ' || CAST(date AS VARCHAR)
    || ': observed ' || observed || ' vs expected ' || expected || ' (z-score ' || zscore || ').' AS description
FROM (SELECT * FROM rolling QUALIFY row_number() OVER (PARTITION BY region_name, category_name, (date_diff('day', DATE '1970-01-01', date) + 719163) // 3 ORDER BY abs(zscore) DESC, date) = 1)
QUALIFY rank <= 20""",
)


def daily(spark, d):
    return series.daily_series(tables.order_incidents(spark, d))


def rolling(spark, d):
    return series.rolling_anomalies(daily(spark, d))


def feed(spark, d):
    return series.anomaly_feed(rolling(spark, d))


@query("daily_series", "inc daily", "SELECT * FROM daily")
def daily_series(spark, d):
    return daily(spark, d)


@query("rolling_anomaly", "inc daily rolling", "SELECT * FROM rolling")
def rolling_anomaly(spark, d):
    return rolling(spark, d)


@query(
    "seasonal_anomaly",
    "inc daily",
    """WITH a AS (SELECT *, count(*) OVER k AS len, avg(n) OVER (PARTITION BY region_name, category_name ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend,
  (date_diff('day', DATE '1970-01-01', date) % 7 + 7) % 7 AS slot FROM daily WINDOW k AS (PARTITION BY region_name, category_name)),
b AS (SELECT *, avg(n - trend) OVER (PARTITION BY region_name, category_name, slot) - avg(n - trend) OVER (PARTITION BY region_name, category_name) AS season FROM a WHERE len >= 60),
c AS (SELECT *, n - trend - season AS resid, stddev_pop(n - trend - season) OVER (PARTITION BY region_name, category_name) AS sd FROM b)
SELECT region_name, category_name, date, observed, severity, zscore FROM (
SELECT region_name, category_name, date, n AS observed, round(resid / sd, 2) AS zscore,
  CASE WHEN abs(resid / sd) >= 5 THEN 'critical' WHEN abs(resid / sd) >= 4 THEN 'high' WHEN abs(resid / sd) >= 3 THEN 'medium' ELSE 'low' END AS severity
FROM c WHERE sd > 1e-9 AND abs(resid) >= sd * 3)""",
)
def seasonal_anomaly(spark, d):
    return series.seasonal_anomalies(daily(spark, d)).select(
        "region_name", "category_name", "date", "observed", "severity", "zscore"
    )


@query("anomaly_feed", "inc daily rolling feed", "SELECT * FROM feed")
def anomaly_feed(spark, d):
    return feed(spark, d)


@query(
    "anomaly_cases",
    "inc daily rolling",
    """SELECT region_name, category_name, date, incident_id FROM rolling JOIN
(SELECT region_name, category_name, CAST(ts AS DATE) AS date, incident_id FROM inc) USING (region_name, category_name, date)""",
)
def anomaly_cases(spark, d):
    return series.anomaly_cases(tables.order_incidents(spark, d), rolling(spark, d))


@query(
    "anomaly_order",
    "inc daily rolling feed",
    """SELECT region_name, category_name, date, row_number() OVER (ORDER BY CASE WHEN observed > expected THEN 0 ELSE 1 END, date DESC, abs(zscore) DESC, region_name, category_name) AS position
FROM feed WHERE region_name NOT IN ('NATION_3') AND observed > 0 AND expected > 0""",
)
def anomaly_order(spark, d):
    """Feed entries that can be mapped: spikes first, then newest, then strongest."""
    kept = series.mappable(feed(spark, d), excluded=("NATION_3",))
    order = Window.orderBy(
        F.when(F.col("observed") > F.col("expected"), 0).otherwise(1),
        F.desc("date"), F.desc(F.abs("zscore")), "region_name", "category_name",
    )
    return kept.select("region_name", "category_name", "date", F.row_number().over(order).cast("bigint").alias("position"))


@query(
    "category_outlook",
    "inc daily rolling",
    """SELECT category_name, CASE WHEN spikes > drops THEN 'up' WHEN drops > spikes THEN 'down' ELSE 'stable' END AS direction,
  least(95, 50 + 8 * total) AS confidence,
  spikes || ' spike' || CASE WHEN spikes <> 1 THEN 's' ELSE '' END || ' across ' || regions || ' region' || CASE WHEN regions <> 1 THEN 's' ELSE '' END AS detail
FROM (SELECT category_name, count(*) FILTER (zscore > 0) AS spikes, count(*) FILTER (zscore <= 0) AS drops, count(*) AS total, count(DISTINCT region_name) AS regions
      FROM rolling GROUP BY category_name) ORDER BY confidence DESC, category_name LIMIT 6""",
)
def category_outlook(spark, d):
    return series.outlook(rolling(spark, d))


def _changepoint_sql(rounds: int) -> str:
    key = "region_name, category_name"
    parts = [
        f"""top AS MATERIALIZED (SELECT {key}, sum(n) AS v, count(*) AS days FROM daily GROUP BY {key})""",
        f"""p0 AS MATERIALIZED (SELECT {key}, date, row_number() OVER w - 1 AS t, CAST(coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c,
  avg(n) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS bef, avg(n) OVER (w ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS aft,
  0 AS s, count(*) OVER k AS e, 0 AS cs, CAST(sum(n) OVER k AS BIGINT) AS ce, NULL::INTEGER AS rnd
  FROM daily SEMI JOIN (SELECT * FROM top WHERE days >= 12) USING ({key})
  WINDOW w AS (PARTITION BY {key} ORDER BY date), k AS (PARTITION BY {key}))""",
    ]
    for r in range(1, rounds + 1):
        parts.append(
            f"""g{r} AS MATERIALIZED (SELECT *, CASE WHEN t - s >= 14 AND e - t >= 14 THEN (c - cs) * (c - cs) / (t - s) + (ce - c) * (ce - c) / (e - t) - (ce - cs) * (ce - cs) / (e - s) END AS gain FROM p{r - 1})"""
        )
        parts.append(
            f"""b{r} AS MATERIALIZED (SELECT {key}, t AS bt, c AS bc, s AS bs FROM g{r} WHERE gain IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY gain DESC, t) = 1)"""
        )
        parts.append(
            f"""p{r} AS MATERIALIZED (SELECT {key}, date, t, c, bef, aft, CASE WHEN s = bs AND t >= bt THEN bt ELSE s END AS s, CASE WHEN s = bs AND t < bt THEN bt ELSE e END AS e,
  CASE WHEN s = bs AND t >= bt THEN bc ELSE cs END AS cs, CASE WHEN s = bs AND t < bt THEN bc ELSE ce END AS ce,
  CASE WHEN t = bt THEN {r} ELSE rnd END AS rnd FROM p{r - 1} LEFT JOIN b{r} USING ({key}))"""
        )
    body = f"""SELECT {key}, date AS changepoint_date, CAST(rnd AS INTEGER) AS round, CASE WHEN aft - bef > 0 THEN 'increase' ELSE 'decrease' END AS direction,
round(abs(aft - bef), 2) AS magnitude FROM p{rounds} WHERE rnd IS NOT NULL AND t >= 7"""
    return "WITH " + ",\n".join(parts) + "\n" + body


@query("changepoints", "inc daily", _changepoint_sql(5))
def changepoints(spark, d):
    return series.changepoints(daily(spark, d))


EMERGING_SQL = f"""WITH m AS (SELECT cell_id, year(ts) * 12 + month(ts) - 1 AS m, count(*) AS n FROM inc GROUP BY ALL),
cells AS (SELECT cell_id, CAST(sum(n) AS BIGINT) AS total_cases FROM m GROUP BY cell_id HAVING sum(n) >= 5),
g AS (SELECT cell_id, t.m FROM cells, (SELECT unnest(range((SELECT min(m) FROM m), (SELECT max(m) FROM m) + 1)) AS m) t),
x AS (SELECT g.cell_id, g.m, coalesce(n, 0) AS n FROM g LEFT JOIN m ON m.cell_id = g.cell_id AND m.m = g.m),
s AS (SELECT a.cell_id, CAST(sum(sign(b.n - a.n)) AS BIGINT) AS s FROM x a JOIN x b ON a.cell_id = b.cell_id AND a.m < b.m GROUP BY a.cell_id),
t AS (SELECT cell_id, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM (SELECT cell_id, n, count(*) AS c FROM x GROUP BY cell_id, n) GROUP BY cell_id),
w AS (SELECT cell_id, count(*) AS k, sum(n) FILTER (m > mx - 6) / 6 AS recent, sum(n) FILTER (m <= mx - 6) / (count(*) - 6) AS hist, count(*) FILTER (n > 0) AS busy
  FROM x, (SELECT max(m) AS mx FROM m) GROUP BY cell_id),
z AS (SELECT *, (k * (k - 1) * (2 * k + 5) - ties) / 18 AS var, s / (k * (k - 1) / 2) AS tau FROM s JOIN t USING (cell_id) JOIN w USING (cell_id)),
p AS (SELECT *, {normal_p_sql('(CASE WHEN var > 0 THEN (s - sign(s)) / sqrt(var) ELSE 0.0 END)')} AS p FROM z)
SELECT cell_id, CASE WHEN hist = 0 AND recent > 0 THEN 'new' WHEN p <= 0.05 AND tau > 0 THEN 'intensifying' WHEN p <= 0.05 AND tau < 0 THEN 'cooling'
  WHEN busy * 2 >= k THEN 'persistent' END AS category, round(tau, 6) AS tau, round(p, 6) AS p, round(recent, 4) AS recent_monthly, round(hist, 4) AS hist_monthly, total_cases
FROM p JOIN cells USING (cell_id)"""


@query("emerging_cells", "inc", EMERGING_SQL)
def emerging_cells(spark, d):
    out = series.emerging_cells(tables.order_incidents(spark, d))
    return out.select(
        "cell_id", "category", F.round("tau", 6).alias("tau"), F.round("p", 6).alias("p"),
        F.round("recent_monthly", 4).alias("recent_monthly"), F.round("hist_monthly", 4).alias("hist_monthly"), "total_cases",
    )


@query(
    "emerging_actionable",
    "inc",
    f"SELECT * FROM ({EMERGING_SQL}) WHERE category IN ('new', 'intensifying') ORDER BY category <> 'new', recent_monthly DESC, cell_id LIMIT 12",
)
def emerging_actionable(spark, d):
    """New before intensifying cells, hottest first: the twelve to look at."""
    cells = emerging_cells(spark, d).where(F.col("category").isin("new", "intensifying"))
    return cells.orderBy((F.col("category") != "new"), F.desc("recent_monthly"), "cell_id").limit(12)
