"""Panel, feature and score-metric queries."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from hotgrid import settings as S
from hotgrid.operators import grid, metrics, model, panel
from hotgrid.operators.scale import percent_rank_avg
from hotgrid.plans.registry import cell_km, query, view
from hotgrid.session import cut_lineage
from hotgrid.sources import store, tables

TRAIN_END, VAL_END = "2024-01-20", "2024-01-25"
SHIFT_SQL = "CASE WHEN hour(ts) BETWEEN 6 AND 13 THEN 0 WHEN hour(ts) BETWEEN 14 AND 21 THEN 1 ELSE 2 END"

view("act_evt", "SELECT * FROM evt WHERE cell_id IN (SELECT cell_id FROM evt GROUP BY cell_id HAVING count(*) >= 5)")
view(
    "evt_panel",
    f"""
SELECT cell_id, date, shift, coalesce(n, 0) AS n_crimes, CAST(coalesce(n, 0) > 0 AS INTEGER) AS has_crime
FROM (SELECT DISTINCT cell_id FROM act_evt)
CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM act_evt), (SELECT max(CAST(ts AS DATE)) FROM act_evt), INTERVAL 1 DAY)) AS DATE) AS date)
CROSS JOIN (SELECT unnest([0, 1, 2]) AS shift)
LEFT JOIN (SELECT cell_id, CAST(ts AS DATE) AS date, {SHIFT_SQL} AS shift, count(*) AS n FROM act_evt GROUP BY ALL) USING (cell_id, date, shift)""",
)
_AGE = "date_diff('day', h.date, p.date)"
_NEAR = [(r, w) for r in S.NEAR_RADII_KM for w in S.NEAR_WINDOWS_DAYS]
view(
    "evt_near",
    f"""
WITH cells AS (SELECT DISTINCT cell_id FROM act_evt),
edges AS (SELECT a.cell_id, b.cell_id AS nbr_id, {cell_km('a.cell_id', 'b.cell_id')} AS km FROM cells a, cells b WHERE {cell_km('a.cell_id', 'b.cell_id')} <= 5),
hits AS (SELECT e.cell_id, km, date, n FROM edges e JOIN (SELECT cell_id AS nbr_id, CAST(ts AS DATE) AS date, count(*) AS n FROM act_evt GROUP BY ALL) USING (nbr_id))
SELECT p.cell_id, p.date, {', '.join(f'CAST(coalesce(sum(n) FILTER (km <= {r} AND {_AGE} BETWEEN 1 AND {w}), 0) AS BIGINT) AS "{panel.near_name(r, w)}"' for r, w in _NEAR)}
FROM (SELECT DISTINCT cell_id, date FROM evt_panel) p LEFT JOIN hits h ON h.cell_id = p.cell_id AND h.date < p.date
GROUP BY p.cell_id, p.date""",
)


def _history_sql(name: str, cutoff: str) -> str:
    return f"""
SELECT '{name}' AS split, cell_id, count(*) AS hist_total, avg(CASE WHEN severity_id = 1 THEN 1.0::DOUBLE ELSE 0 END) AS hist_heinous_pct,
  avg(CASE WHEN category_id = 1 THEN 1.0::DOUBLE ELSE 0 END) AS hist_violent_pct, avg(CASE WHEN category_id IN (2, 3) THEN 1.0::DOUBLE ELSE 0 END) AS hist_property_pct,
  count(DISTINCT category_id) AS n_crime_types, any_value(entropy) AS crime_entropy
FROM act_evt JOIN (
  SELECT cell_id, sum(-p * log2(greatest(p, 1e-10))) AS entropy FROM (
    SELECT cell_id, count(*) / sum(count(*)) OVER (PARTITION BY cell_id) AS p FROM act_evt WHERE ts < '{cutoff}' GROUP BY cell_id, category_id) GROUP BY cell_id) USING (cell_id)
WHERE ts < '{cutoff}' GROUP BY cell_id"""


# each history ends where its split begins; in reference mode training rows see their own window
STRICT_ENDS = {"train": "0001-01-01", "val": "2024-01-20", "test": "2024-01-25"}
REFERENCE_ENDS = {"train": "2024-01-20", "val": "2024-01-25", "test": "2024-01-25"}
view("evt_history", " UNION ALL ".join(_history_sql(n, c) for n, c in STRICT_ENDS.items()))
view("evt_history_ref", " UNION ALL ".join(_history_sql(n, c) for n, c in REFERENCE_ENDS.items()))
view(
    "evt_staff",
    """
SELECT cell_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_officers FROM (SELECT station_id, arg_min(cell_id, (ts, incident_id)) AS cell_id FROM act_evt GROUP BY station_id)
LEFT JOIN (SELECT CAST(s_nationkey AS BIGINT) AS station_id, count(*) AS n FROM supplier GROUP BY 1) USING (station_id) GROUP BY cell_id""",
)
PRIME = 10_007
MIX = f"((cell_id * 7919 + date_diff('day', DATE '1970-01-01', date) * 5003 + shift * 3001 + 42) % {PRIME})"
view(
    "evt_sample",
    f"SELECT * FROM evt_panel WHERE has_crime = 1 OR ({MIX} * ({MIX} + 17)) % {PRIME} < {int(S.NEGATIVE_SAMPLE_RATE * PRIME)}",
)
_TURN = "(2 * 3.141592653589793::DOUBLE)"
_TEMPORAL = f"""CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year,
CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(shift = 2 AS INTEGER) AS is_night_shift,
CAST(shift = 0 AS INTEGER) AS is_morning_shift, shift * 8 + 4 AS hour_proxy,
CAST(sin({_TURN} * ((isodow(date) - 1) / 7)) AS FLOAT) AS dow_sin, CAST(cos({_TURN} * ((isodow(date) - 1) / 7)) AS FLOAT) AS dow_cos,
CAST(sin({_TURN} * ((month(date) - 1) / 12)) AS FLOAT) AS month_sin, CAST(cos({_TURN} * ((month(date) - 1) / 12)) AS FLOAT) AS month_cos,
CAST(sin({_TURN} * ((shift * 8 + 4) / 24)) AS FLOAT) AS hour_sin, CAST(cos({_TURN} * ((shift * 8 + 4) / 24)) AS FLOAT) AS hour_cos"""
view(
    "evt_matrix",
    f"""
SELECT cell_id, date, shift, n_crimes, has_crime, {_TEMPORAL}, split, coalesce(hist_total, 0) AS hist_total, coalesce(hist_heinous_pct, 0) AS hist_heinous_pct,
  coalesce(hist_violent_pct, 0) AS hist_violent_pct, coalesce(hist_property_pct, 0) AS hist_property_pct, coalesce(n_crime_types, 0) AS n_crime_types,
  coalesce(crime_entropy, 0) AS crime_entropy, coalesce(n_officers, 0) AS n_officers, {', '.join(f'"{panel.near_name(r, w)}"' for r, w in _NEAR)}
FROM (SELECT *, CASE WHEN date > DATE '{VAL_END}' THEN 'test' WHEN date > DATE '{TRAIN_END}' THEN 'val' ELSE 'train' END AS split FROM evt_panel)
LEFT JOIN evt_history USING (split, cell_id) LEFT JOIN evt_staff USING (cell_id) JOIN evt_near USING (cell_id, date)""",
)
EVT = "evt act_evt evt_panel"
MATRIX = EVT + " evt_near evt_history evt_staff evt_matrix"


def _active_events(spark, d):
    evt = tables.event_incidents(spark, d)
    return evt.join(grid.active_cells(evt).select("cell_id"), "cell_id", "left_semi")


@query("panel", EVT, "SELECT * FROM evt_panel")
def space_time_panel(spark, d):
    return panel.panel(panel.active_days(tables.event_incidents(spark, d))[0])


@query("panel_sampled", EVT + " evt_sample", "SELECT * FROM evt_sample")
def panel_sampled(spark, d):
    return panel.sample_negatives(space_time_panel(spark, d))


@query("near_repeat", EVT + " evt_near", "SELECT * FROM evt_near")
def near_repeat(spark, d):
    return panel.near_repeat_days(*panel.active_days(tables.event_incidents(spark, d))).drop("n0", "n1", "n2")


_ROUND6 = ("hist_heinous_pct", "hist_violent_pct", "hist_property_pct", "crime_entropy")
_ROUND6_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in _ROUND6)


def _rounded(df):
    for c in _ROUND6:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query(
    "cell_history",
    "evt act_evt evt_history",
    f"SELECT split, cell_id, hist_total, n_crime_types, {_ROUND6_SQL} FROM evt_history",
)
def cell_history(spark, d):
    return _rounded(panel.history_profile(_active_events(spark, d), panel.history_cutoffs(TRAIN_END, VAL_END)))


@query(
    "cell_history_reference",
    "evt act_evt evt_history_ref",
    f"SELECT split, cell_id, hist_total, n_crime_types, {_ROUND6_SQL} FROM evt_history_ref",
)
def cell_history_reference(spark, d):
    return _rounded(panel.history_profile(_active_events(spark, d), panel.history_cutoffs(TRAIN_END, VAL_END, reference_mode=True)))


@query("staff_per_cell", "evt act_evt evt_staff", "SELECT * FROM evt_staff")
def staff_per_cell(spark, d):
    return panel.staff_per_cell(_active_events(spark, d), tables.staff(spark, d))


def matrix(spark, d):
    return panel.feature_matrix(tables.event_incidents(spark, d), tables.staff(spark, d), TRAIN_END, VAL_END)


@query("feature_matrix", MATRIX, f"SELECT * REPLACE ({_ROUND6_SQL}) FROM evt_matrix")
def feature_matrix(spark, d):
    return _rounded(matrix(spark, d))


view(
    "decayed",
    """
SELECT cell_id, sum(exp(-0.6931471805599453 / 14 * date_diff('day', CAST(ts AS DATE), (SELECT max(CAST(ts AS DATE)) FROM inc)))) AS fallback_risk FROM inc GROUP BY cell_id""",
)


@query(
    "decayed_risk",
    "inc decayed",
    """SELECT cell_id, round(fallback_risk, 9) AS fallback_risk, round((rank() OVER (ORDER BY round(fallback_risk, 12))
 + (count(*) OVER (PARTITION BY round(fallback_risk, 12)) - 1) / 2) / count(*) OVER (), 9) AS fallback_risk_rank FROM decayed""",
)
def decayed_risk(spark, d):
    risk = panel.decayed_risk(tables.order_incidents(spark, d)).withColumn("v", F.round("fallback_risk", 12))
    ranked = percent_rank_avg(risk, "v", "fallback_risk_rank")
    return ranked.select(
        "cell_id", F.round("fallback_risk", 9).alias("fallback_risk"), F.round("fallback_risk_rank", 9).alias("fallback_risk_rank")
    )


# --- scores with fixed coefficients ---------------------------------------------
COEF = {
    "nr_0.5km_7d": 0.05,
    "nr_2.0km_14d": 0.01,
    "nr_5.0km_30d": 0.002,
    "hist_total": 0.01,
    "crime_entropy": 0.3,
    "hist_heinous_pct": 0.5,
    "is_night_shift": -0.4,
    "is_weekend": 0.1,
}
INTERCEPT = -3.0
_MARGIN = " + ".join(f'{v}::DOUBLE * "{k}"' for k, v in COEF.items())
view("evt_scored", f"SELECT *, 1 / (1 + exp(-({INTERCEPT} + {_MARGIN}))) AS risk_score FROM evt_matrix")
SCORED = MATRIX + " evt_scored"


def scored_matrix(spark, d):
    return model.linear_score(matrix(spark, d), COEF, INTERCEPT)


@query(
    "risk_map",
    SCORED,
    "SELECT cell_id, round(avg(risk_score), 9) AS mean_risk, round(max(risk_score), 9) AS max_risk FROM evt_scored GROUP BY cell_id",
)
def risk_map(spark, d):
    out = panel.risk_map(scored_matrix(spark, d))
    return out.select("cell_id", F.round("mean_risk", 9).alias("mean_risk"), F.round("max_risk", 9).alias("max_risk"))


@query(
    "score_rank",
    SCORED,
    """SELECT cell_id, date, shift, round((rank() OVER (ORDER BY round(risk_score, 12)) + (count(*) OVER (PARTITION BY round(risk_score, 12)) - 1) / 2) / count(*) OVER (), 9) AS risk_rank
FROM evt_scored""",
)
def score_rank(spark, d):
    scored = scored_matrix(spark, d).select("cell_id", "date", "shift", F.round("risk_score", 12).alias("v"))
    return percent_rank_avg(scored, "v", "risk_rank").select("cell_id", "date", "shift", F.round("risk_rank", 9).alias("risk_rank"))


view(
    "test_cells",
    "SELECT cell_id, round(avg(risk_score), 12) AS mean_risk, sum(n_crimes) AS crimes FROM evt_scored WHERE split = 'test' GROUP BY cell_id",
)
view(
    "pai",
    """
SELECT pct AS area_pct, round(hit / pct, 2) AS pai, round(hit, 2) AS hit_rate, best FROM (
  SELECT pct, sum(crimes) FILTER (rn <= greatest(1, floor(n * pct / 100))) / sum(crimes) * 100 AS hit,
    sum(crimes) FILTER (bn <= greatest(1, floor(n * pct / 100))) / sum(crimes) * 100 AS best
  FROM (SELECT *, row_number() OVER (ORDER BY mean_risk DESC, cell_id) AS rn, row_number() OVER (ORDER BY crimes DESC, cell_id) AS bn, count(*) OVER () AS n FROM test_cells),
       (SELECT unnest([1, 2, 5, 10, 20]) AS pct) GROUP BY pct)""",
)


@query("pai", SCORED + " test_cells pai", "SELECT area_pct, pai, hit_rate FROM pai")
def pai(spark, d):
    return metrics.accuracy_index(scored_matrix(spark, d)).drop("hit_pct")


@query("pei", SCORED + " test_cells pai", "SELECT area_pct, round(pai / (best / area_pct), 4) AS pei FROM pai")
def pei(spark, d):
    return metrics.efficiency_index(scored_matrix(spark, d))


@query(
    "priority_cells",
    SCORED,
    """WITH m AS (SELECT cell_id, round(avg(risk_score), 12) AS mean_risk FROM evt_scored GROUP BY cell_id)
SELECT cell_id, row_number() OVER (ORDER BY mean_risk DESC, cell_id) AS position FROM m QUALIFY position <= ceil((SELECT count(*) FROM m) * 5.0 / 100)""",
)
def priority_cells(spark, d):
    cells = panel.risk_map(scored_matrix(spark, d)).withColumn("mean_risk", F.round("mean_risk", 12))
    return metrics.top_share(cells, "mean_risk").select("cell_id", "position")


_RANKING_SQL = """SELECT count(*) AS n, round(avg(y), 9) AS pos_rate, round(avg(pow(p - y, 2)), 9) AS brier,
round((sum(ar) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 9) AS auc,
round(sum(CAST(y AS DOUBLE) * tp / n_at) / sum(y), 9) AS avg_precision
FROM (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS ar,
  sum(y) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS tp, count(*) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS n_at FROM {source})"""
view(
    "scored",
    """SELECT l.doc_id AS id, quality AS y, (n_chars % 100) / 100 AS p,
CASE l.doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM labels l JOIN documents USING (doc_id)""",
)


def _rank_cols(df):
    return df.select("n", *[F.round(c, 9).alias(c) for c in ("pos_rate", "brier", "auc", "avg_precision")])


@query("ranking_metrics", "scored", _RANKING_SQL.format(source="scored"))
def ranking_metrics(spark, d):
    return _rank_cols(metrics.ranking_metrics(tables.scored(spark, d)))


@query(
    "risk_ranking_metrics",
    SCORED,
    _RANKING_SQL.format(source="(SELECT has_crime AS y, round(risk_score, 12) AS p FROM evt_scored WHERE split = 'test')"),
)
def risk_ranking_metrics(spark, d):
    scored = scored_matrix(spark, d).where(F.col("split") == "test")
    return _rank_cols(metrics.ranking_metrics(scored.withColumn("p", F.round("risk_score", 12)), "has_crime", "p"))


_CURVE = """SELECT CAST(ntile(10) OVER (ORDER BY p, id) AS BIGINT) AS bin, p, y FROM scored"""


@query(
    "reliability_curve",
    "scored",
    f"SELECT bin, round(avg(p), 9) AS conf, round(avg(y), 9) AS acc, round(count(*) / (SELECT count(*) FROM scored), 9) AS frac FROM ({_CURVE}) GROUP BY bin",
)
def reliability_curve(spark, d):
    curve = metrics.reliability_curve(tables.scored(spark, d))
    return curve.select("bin", *[F.round(c, 9).alias(c) for c in ("conf", "acc", "frac")])


@query(
    "calibration_error",
    "scored",
    f"SELECT round(sum(n / t * abs(acc - conf)), 9) AS ece FROM (SELECT bin, avg(p) AS conf, avg(y) AS acc, count(*) AS n, (SELECT count(*) FROM scored) AS t FROM ({_CURVE}) GROUP BY bin)",
)
def calibration_error(spark, d):
    curve = metrics.reliability_curve(tables.scored(spark, d))
    return curve.agg(F.sum(F.col("frac") * F.abs(F.col("acc") - F.col("conf"))).alias("ece")).select(F.round("ece", 9).alias("ece"))


_COEF_ROWS = ", ".join(f"('{k}')" for k in COEF)
view(
    "contrib",
    "SELECT cell_id, date, shift, has_crime, round(risk_score, 12) AS rs, risk_score, unnest(["
    + ", ".join(f"'{k}'" for k in COEF)
    + "]) AS feature, unnest(["
    + ", ".join(f'{v}::DOUBLE * ("{k}" - (SELECT avg("{k}") FROM evt_scored))' for k, v in COEF.items())
    + "]) AS contribution FROM evt_scored",
)


def _title_sql(col: str) -> str:
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.FEATURE_TITLES.items())
    pat = r"^nr_([\d.]+)km_(\d+)d$"
    return (
        f"CASE {col} {known} ELSE CASE WHEN regexp_matches({col}, '{pat}') THEN 'Crimes within ' || regexp_extract({col}, '{pat}', 1)"
        f" || ' km, last ' || regexp_extract({col}, '{pat}', 2) || ' days' ELSE {col} END END"
    )


@query(
    "attribution",
    SCORED + " contrib",
    "SELECT cell_id, date, shift, feature, round(contribution, 9) AS contribution FROM contrib",
)
def attribution(spark, d):
    out = model.attributions(scored_matrix(spark, d), COEF, ["cell_id", "date", "shift"])
    return out.withColumn("contribution", F.round("contribution", 9))


@query(
    "global_attribution",
    SCORED + " contrib",
    f"SELECT feature, {_title_sql('feature')} AS description, round(avg(abs(contribution)), 6) AS mean_abs FROM contrib GROUP BY feature ORDER BY mean_abs DESC LIMIT 20",
)
def global_attribution(spark, d):
    out = model.global_attribution(scored_matrix(spark, d), COEF)
    return out.select("feature", model.feature_title(F.col("feature")).alias("description"), F.round("mean_abs", 6).alias("mean_abs"))


@query(
    "explanations",
    SCORED + " contrib",
    f"""WITH best AS (SELECT DISTINCT cell_id, date, shift, rs FROM contrib ORDER BY rs DESC, cell_id, date, shift LIMIT 50),
r AS (SELECT c.*, round(contribution, 9) AS v, row_number() OVER (PARTITION BY cell_id, date, shift ORDER BY round(contribution, 9) DESC, feature) AS up,
  row_number() OVER (PARTITION BY cell_id, date, shift ORDER BY round(contribution, 9), feature) AS down FROM contrib c SEMI JOIN best USING (cell_id, date, shift)),
t AS (SELECT cell_id, date, shift, risk_score, has_crime, string_agg({_title_sql('feature')}, ', ' ORDER BY up) FILTER (v > 0 AND up <= 3) AS raising,
  string_agg({_title_sql('feature')}, ', ' ORDER BY down) FILTER (v < 0 AND down <= 2) AS lowering FROM r GROUP BY ALL)
SELECT cell_id, date, shift, has_crime, printf('Risk score: %.3f. ', risk_score) || coalesce('Risk elevated due to: ' || raising, 'No strong risk drivers') || coalesce('. Mitigating: ' || lowering, '') AS explanation FROM t""",
)
def explanations(spark, d):
    return model.explain_top(scored_matrix(spark, d), COEF, ["cell_id", "date", "shift"]).drop("risk_score")


# --- trained model (no SQL form) --------------------------------------------------
def trained(spark, d, kind="gbt", max_iter=500):
    """Model, features and matrix, built once for the state of the input files and these parameters."""

    def build(folder):
        matrix(spark, d).write.parquet(f"{folder}/matrix")
        rows = spark.read.parquet(f"{folder}/matrix")
        fit = model.train_risk_model(rows, model.feature_columns(rows), kind, max_iter)
        fit.write().save(f"{folder}/model")
        model.score(fit, rows).write.parquet(f"{folder}/scored")

    folder = store.stored(spark, "risk_model", {"kind": kind, "max_iter": max_iter}, [tables.table(spark, d, "events")], build)
    scored = spark.read.parquet(f"{folder}/scored")
    return PipelineModel.load(f"{folder}/model"), model.feature_columns(spark.read.parquet(f"{folder}/matrix")), scored


@query("risk_model_scores")
def risk_model_scores(spark, d):
    return trained(spark, d)[2].select("cell_id", "date", "shift", "split", "has_crime", "n_crimes", "risk_score")


@query("model_global_attribution")
def model_global_attribution(spark, d):
    """What the fitted trees look at, over all test rows."""
    fit, features, rows = trained(spark, d)
    out = model.tree_global_attribution(rows.where(F.col("split") == "test"), model.boosted_trees(fit, spark), features)
    return out.select("feature", model.feature_title(F.col("feature")).alias("description"), F.round("mean_abs", 6).alias("mean_abs"))


@query("model_explanations")
def model_explanations(spark, d):
    """Sentences for the highest scores of the fitted trees."""
    fit, features, rows = trained(spark, d)
    test = rows.where(F.col("split") == "test")
    return model.explain_top_of_trees(test, model.boosted_trees(fit, spark), features, ["cell_id", "date", "shift"])


@query("risk_model_metrics")
def risk_model_metrics(spark, d):
    test = risk_model_scores(spark, d).where(F.col("split") == "test")
    return metrics.ranking_metrics(test, "has_crime", "risk_score")


@query("feature_importance")
def feature_importance(spark, d):
    fit, features, _ = trained(spark, d)
    return spark.createDataFrame(model.feature_importance(fit, features), "feature string, importance double")


@query("calibration_report")
def calibration_report(spark, d):
    return model.calibration_report(model.isotonic_calibration(risk_model_scores(spark, d)))
