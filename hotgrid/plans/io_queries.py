"""Source, sink, polygon and spree queries."""

from pyspark.sql import functions as F

from hotgrid.functions import labels
from hotgrid.operators import hotspots, panel, places
from hotgrid.plans import panel_queries as pq
from hotgrid.plans import spatial_queries as sq
from hotgrid.plans.registry import HAVERSINE, cell_lat, cell_lon, query, view
from hotgrid.plans.graph_queries import cc_sql
from hotgrid.session import scratch_folder
from hotgrid.sources import readers, sinks, tables

# Text files with flaws: every 97th date and every 89th latitude is unreadable.
view(
    "flawed",
    """SELECT incident_id, station_id, category_id, severity_id, status_id, CASE WHEN incident_id % 97 = 0 THEN NULL ELSE ts END AS ts,
CASE WHEN incident_id % 89 = 0 THEN NULL ELSE latitude END AS latitude, longitude FROM inc""",
)


def flawed_csv(spark, d):
    """Incidents written as CSV with unreadable values, and the folder they went to."""
    inc = tables.order_incidents(spark, d)
    folder = scratch_folder(spark, "csv")
    text = inc.select(
        "incident_id", "station_id", "category_id", "severity_id", "status_id",
        F.when(F.col("incident_id") % 97 == 0, "31/02/2020 late").otherwise(F.col("ts").cast("string")).alias("ts"),
        F.when(F.col("incident_id") % 89 == 0, "north").otherwise(F.col("latitude").cast("string")).alias("latitude"),
        "longitude",
    )
    sinks.write_csv(text, f"{folder}/incidents.csv")
    return folder


@query("csv_incidents", "inc flawed", "SELECT * FROM flawed")
def csv_incidents(spark, d):
    return readers.read_typed_csv(spark, f"{flawed_csv(spark, d)}/incidents.csv", readers.INCIDENT).select(
        "incident_id", "station_id", "category_id", "severity_id", "status_id", "ts", "latitude", "longitude"
    )


@query(
    "csv_enriched",
    "inc",
    """SELECT region_name, category_name, severity_name, count(*) AS n, count(DISTINCT station_id) AS stations FROM inc GROUP BY ALL""",
)
def csv_enriched(spark, d):
    """The whole catalogue as CSV files: fact, units, regions, categories, severities; read back and star-joined."""
    folder = flawed_csv(spark, d)
    inc = tables.order_incidents(spark, d)
    units = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("unit_id"), F.col("c_nationkey").alias("region_id"))
    regions = tables.table(spark, d, "nation").select(F.col("n_nationkey").alias("region_id"), F.col("n_name").alias("region_name"))
    sinks.write_csv(units, f"{folder}/units.csv")
    sinks.write_csv(regions, f"{folder}/regions.csv")
    sinks.write_csv(inc.select("category_id", "category_name").distinct(), f"{folder}/categories.csv")
    sinks.write_csv(
        inc.select("severity_id", F.col("severity_name").alias("severity_label")).distinct(), f"{folder}/severities.csv"
    )
    names = ("incidents", "units", "regions", "categories", "severities")
    t = readers.load_catalogue(spark, folder, {n: readers.CATALOGUE[n] for n in names})
    rows = readers.enrich(t["incidents"], t["units"], t["regions"], t["categories"], t["severities"])
    return rows.groupBy("region_name", "category_name", "severity_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("station_id").alias("stations")
    )


@query(
    "csv_satellites",
    "",
    """SELECT 'arrests' AS name, count(*) AS n, count(DISTINCT l_partkey) AS entities, count(*) FILTER (l_linenumber % 5 <> 0) AS dated FROM lineitem
UNION ALL SELECT 'bridge', count(*), count(DISTINCT l_partkey), 0 FROM lineitem
UNION ALL SELECT 'chargesheets', count(DISTINCT l_orderkey), 0, 0 FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1
UNION ALL SELECT 'complainants', count(*), count(DISTINCT c_mktsegment), 0 FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'sections', count(*), count(DISTINCT p_brand || p_type), 0 FROM lineitem JOIN part ON p_partkey = l_partkey
UNION ALL SELECT 'staff', count(*), count(DISTINCT s_nationkey), 0 FROM supplier
UNION ALL SELECT 'subcategories', count(*), count(*), 0 FROM (SELECT DISTINCT substr(o_orderpriority, 1, 1), o_custkey % 6 FROM orders)
UNION ALL SELECT 'victims', count(*), count(DISTINCT l_suppkey), 0 FROM lineitem""",
)
def csv_satellites(spark, d):
    """Bridge and satellite tables through CSV: rows, distinct entities, readable dates."""
    folder = scratch_folder(spark, "sat")
    items, part = tables.table(spark, d, "lineitem"), tables.table(spark, d, "part")
    day = F.when(F.col("l_linenumber") % 5 == 0, "unknown").otherwise(F.col("l_shipdate").cast("string"))
    case, entity = F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("entity_id")
    inc = tables.order_incidents(spark, d)
    owners = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("station_id"), "c_mktsegment")
    files = {
        "bridge": (items.select(case, entity), "entity_id", None),
        "arrests": (items.select(case, entity, day.alias("arrest_date")), "entity_id", "arrest_date"),
        "victims": (items.select(case, F.col("l_suppkey").alias("victim_id")), "victim_id", None),
        "sections": (
            items.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
                case, F.col("p_brand").alias("act"), F.col("p_type").alias("section")
            ),
            "act_section",
            None,
        ),
        "complainants": (
            inc.join(owners, "station_id").select(F.col("incident_id").alias("case_id"), F.col("c_mktsegment").alias("occupation")),
            "occupation",
            None,
        ),
        "chargesheets": (tables.charged_cases(spark, d).distinct(), None, None),
        "staff": (tables.staff(spark, d), "unit_id", None),
        "subcategories": (inc.select("subtype_id").distinct(), "subtype_id", None),
    }
    for name, (df, _, _) in files.items():
        sinks.write_csv(df, f"{folder}/{name}.csv")
    read = readers.load_catalogue(spark, folder, {n: readers.CATALOGUE[n] for n in files})
    read["sections"] = read["sections"].withColumn("act_section", F.concat("act", "section"))
    out = None
    zero = F.lit(0).cast("bigint")
    for name, (_, key, date) in files.items():
        row = read[name].agg(
            F.lit(name).alias("name"),
            F.count(F.lit(1)).alias("n"),
            (F.count_distinct(key) if key else zero).alias("entities"),
            (F.count(date) if date else zero).alias("dated"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("catalogue_sql", "inc", "SELECT category_id, count(*) AS n, max(ts) AS latest FROM inc WHERE incident_id % 97 <> 0 GROUP BY category_id")
def catalogue_sql(spark, d):
    """Tables loaded by name are plain SQL views."""
    readers.load_catalogue(spark, flawed_csv(spark, d), {"incidents": readers.INCIDENT})
    return spark.sql("SELECT category_id, count(*) AS n, max(ts) AS latest FROM incidents WHERE ts IS NOT NULL GROUP BY category_id")


@query("matrix_parquet", pq.MATRIX, "SELECT split, count(*) AS n, CAST(sum(n_crimes) AS BIGINT) AS crimes, CAST(sum(has_crime) AS BIGINT) AS positives FROM evt_matrix GROUP BY split")
def matrix_parquet(spark, d):
    """Feature matrix written by split under its parameters and read back."""
    target = sinks.write_matrix(
        pq.matrix(spark, d), scratch_folder(spark, "matrix"), train_end=pq.TRAIN_END, val_end=pq.VAL_END, rate=0.1
    )
    rows = sinks.read_matrix(spark, target)
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_crimes").alias("crimes"), F.sum("has_crime").alias("positives")
    )


@query("risk_map_json", pq.SCORED, "SELECT cell_id, round(avg(risk_score), 6) AS mean_risk FROM evt_scored GROUP BY cell_id")
def risk_map_json(spark, d):
    path = scratch_folder(spark, "risk")
    sinks.write_json_records(sinks.stamped(panel.risk_map(pq.scored_matrix(spark, d))), path)
    back = spark.read.schema("cell_id bigint, mean_risk double, generated timestamp").json(path)
    return back.where(F.col("generated").isNotNull()).select("cell_id", F.round("mean_risk", 6).alias("mean_risk"))


@query("summary_report_json", "inc summary", "SELECT region_name, total_cases, yoy_change_pct, top_type FROM summary")
def summary_report_json(spark, d):
    """A nested one-document report, parsed again. Regions are a code list, so the list stays short."""
    from hotgrid.operators import trends

    rows = trends.region_summary(tables.order_incidents(spark, d))
    path = scratch_folder(spark, "report")
    sinks.write_report(rows.agg(F.collect_list(F.struct(*rows.columns)).alias("regions")), path)
    schema = "struct<regions: array<struct<region_name: string, total_cases: bigint, yoy_change_pct: double, top_type: string>>>"
    parsed = spark.read.text(path).select(F.from_json("value", schema).alias("r"))
    return parsed.select(F.explode("r.regions").alias("x")).select("x.*")


@query(
    "event_payload",
    "",
    """SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(*) AS n FROM events GROUP BY event_type""",
)
def event_payload(spark, d):
    events = tables.table(spark, d, "events")
    k = F.from_json("props", "k bigint")["k"]
    return events.groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count(F.lit(1)).alias("n"))


_FEATURE_SQL = f"""SELECT layer, cell_id, case_count, round({cell_lon('cell_id')}, 5) AS lon, round({cell_lat('cell_id')}, 5) AS lat, round(gi_zscore, 4) AS gi_zscore, significance
FROM gi_layers"""


@query("hotspots_geojson", "inc active layers gi_layers", _FEATURE_SQL)
def hotspots_geojson(spark, d):
    """Gi* layers written as GeoJSON features per layer folder, read back and opened up."""
    from hotgrid.operators import grid

    cells = hotspots.gi_star(hotspots.layer_counts(tables.order_incidents(spark, d)), ["layer"])
    features = sinks.point_features(grid.with_position(cells).withColumn("layer", labels.safe_label(F.col("layer"))), drop=["layer"])
    path = scratch_folder(spark, "geojson")
    sinks.write_features(features, path)
    schema = (
        "type string, geometry struct<type: string, coordinates: array<double>>, "
        "properties struct<cell_id: bigint, case_count: bigint, gi_zscore: double, gi_pvalue: double, significance: string>"
    )
    f = spark.read.text(path).select("layer", F.from_json("value", schema).alias("f"))
    return f.select(
        F.translate("layer", "_", " ").alias("layer"), "f.properties.cell_id", "f.properties.case_count",
        F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"),
        "f.properties.gi_zscore", "f.properties.significance",
    )


@query(
    "significant_only",
    "inc active layers gi_layers",
    "SELECT layer, cell_id, significance, analysed FROM (SELECT *, count(*) OVER (PARTITION BY layer) AS analysed FROM gi_layers) WHERE significance <> 'not_sig'",
)
def significant_only(spark, d):
    cells = hotspots.gi_star(hotspots.layer_counts(tables.order_incidents(spark, d)), ["layer"])
    kept = sinks.significant_only(cells)
    return sinks.significant_only(kept).select("layer", "cell_id", "significance", "analysed")


# --- polygons --------------------------------------------------------------------------
# Three territories: a convex one, a concave one, and one with a hole; rings of (lon, lat).
TERRITORY = {
    "west": [[(74.0, 11.9), (75.2, 11.9), (75.5, 13.2), (74.3, 13.6)]],
    "hook": [[(75.0, 13.4), (76.6, 13.4), (76.6, 15.6), (76.2, 15.6), (76.2, 14.2), (75.6, 14.2), (75.6, 15.0), (75.0, 15.0)]],
    "ring": [
        [(76.4, 15.7), (78.6, 15.7), (78.6, 18.4), (76.4, 18.4)],
        [(76.9, 16.3), (77.5, 16.3), (77.5, 17.1), (76.9, 17.1)],
    ],
}


def _edge_values() -> str:
    rows = []
    for poly, rings in TERRITORY.items():
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                rows.append(f"('{poly}', {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)")
    return ", ".join(rows)


_T = "least(greatest(((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)), 0), 1)"


@query(
    "clipped_incidents",
    "inc",
    f"""WITH e(poly, x1, y1, x2, y2) AS (VALUES {_edge_values()}),
s AS (SELECT DISTINCT longitude AS lon, latitude AS lat FROM inc),
t AS (SELECT lon, lat, poly, count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) AS n,
  bool_or(pow(lon - (x1 + {_T} * (x2 - x1)), 2) + pow(lat - (y1 + {_T} * (y2 - y1)), 2) <= 0.01 * 0.01) AS close FROM s, e GROUP BY ALL),
i AS (SELECT DISTINCT lon, lat FROM t WHERE n % 2 = 1 OR close)
SELECT region_name, count(*) AS n, count(DISTINCT cell_id) AS cells FROM inc JOIN i ON lon = longitude AND lat = latitude GROUP BY region_name""",
)
def clipped_incidents(spark, d):
    inc = tables.order_incidents(spark, d).withColumnRenamed("longitude", "lon").withColumnRenamed("latitude", "lat")
    kept = places.clip_points(inc, places.polygons(spark, TERRITORY))
    return kept.groupBy("region_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cell_id").alias("cells"))


@query(
    "region_centroids",
    "inc",
    """WITH b AS (SELECT region_name, min(lon_e6) AS xl, max(lon_e6) AS xh, min(lat_e6) AS yl, max(lat_e6) AS yh, min(lon_e6 + lat_e6) AS sl, max(lon_e6 + lat_e6) AS sh,
  min(lon_e6 - lat_e6) AS dl, max(lon_e6 - lat_e6) AS dh FROM inc GROUP BY region_name),
v AS (SELECT region_name, unnest(range(8)) AS seq, unnest([sl - yl, dh + yl, xh, xh, sh - yh, dl + yh, xl, xl]) / 1000000 AS x, unnest([yl, yl, xh - dh, sh - xh, yh, yh, xl - dl, sl - xl]) / 1000000 AS y FROM b),
e AS (SELECT a.region_name, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.region_name = b.region_name AND b.seq = (a.seq + 1) % 8)
SELECT region_name, round(sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 5) AS lon, round(sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 5) AS lat
FROM e GROUP BY region_name""",
)
def region_centroids(spark, d):
    """Centroid of each region's outline, the outline derived from its incidents."""
    out = places.centroids(places.ring_edges(places.outlines(tables.order_incidents(spark, d))))
    return out.select(F.col("poly_id").alias("region_name"), "lon", "lat")


_NAMES = "CASE WHEN n_nationkey < 8 THEN lower(n_name) WHEN n_nationkey < 14 THEN n_name || ' RURAL' WHEN n_nationkey < 18 THEN 'OLD ' || n_name ELSE substr(n_name, 1, 8) END"


@query(
    "name_crosswalk",
    "inc",
    f"""WITH k AS (SELECT DISTINCT region_name AS known FROM inc), n AS (SELECT DISTINCT {_NAMES} AS name FROM nation),
x AS (SELECT 'OLD ' || n_name AS name, n_name AS known FROM nation WHERE n_nationkey IN (14, 15)),
m AS (SELECT name, known, 1 AS method FROM n JOIN x USING (name) SEMI JOIN k USING (known)
  UNION ALL SELECT name, known, 2 FROM n, k WHERE upper(name) = upper(known)
  UNION ALL SELECT name, known, 3 FROM n, k WHERE starts_with(upper(known), upper(name)) OR starts_with(upper(name), upper(known)))
SELECT n.name, b.known, b.method FROM n LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY name ORDER BY method, known) = 1) b USING (name)""",
)
def name_crosswalk(spark, d):
    nation = tables.table(spark, d, "nation")
    key, name = F.col("n_nationkey"), F.col("n_name")
    spelled = (
        F.when(key < 8, F.lower(name)).when(key < 14, F.concat(name, F.lit(" RURAL"))).when(key < 18, F.concat(F.lit("OLD "), name))
        .otherwise(F.substring(name, 1, 8))
    )
    explicit = nation.where(key.isin(14, 15)).select(
        F.concat(F.lit("OLD "), name).alias("name"), name.alias("known"), F.lit(0).alias("place")
    )
    known = tables.order_incidents(spark, d).select(F.col("region_name").alias("known")).distinct()
    return places.match_names(nation.select(spelled.alias("name")), known, explicit)


# --- sprees ------------------------------------------------------------------------------
_GY, _GX = "((lat_e6 - 11000000) // 1000)", "((lon_e6 - 73000000) // 1000)"
view(
    "spots",
    f"""SELECT subtype_id, {_GY} AS gy, {_GX} AS gx, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day, count(*) AS n,
((subtype_id * 65536 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))) * 16384 + {_GY}) * 16384 + {_GX} AS node FROM inc GROUP BY ALL""",
)
_SPOT = lambda a: (f"((11000000 + {a}.gy * 1000) / 1000000)", f"((73000000 + {a}.gx * 1000) / 1000000)")
view(
    "spot_links",
    f"""SELECT a.node AS src, b.node AS dst FROM spots a JOIN spots b ON a.subtype_id = b.subtype_id AND a.node < b.node AND abs(a.day - b.day) <= 7
AND {HAVERSINE.format(lat1=_SPOT('a')[0], lon1=_SPOT('a')[1], lat2=_SPOT('b')[0], lon2=_SPOT('b')[1])} <= 1.0""",
)


@query(
    "sprees",
    "inc spots spot_links",
    "WITH "
    + cc_sql("cc", "spot_links")
    + """, p AS (SELECT coalesce(component, node) AS spree_id, s.* FROM spots s LEFT JOIN cc USING (node))
SELECT spree_id, subtype_id, CAST(sum(n) AS BIGINT) AS n_cases, DATE '1970-01-01' + CAST(min(day) AS INTEGER) AS start_date, DATE '1970-01-01' + CAST(max(day) AS INTEGER) AS end_date, max(day) - min(day) AS span_days,
round(sum((11000000 + gy * 1000) / 1000000 * n) / sum(n), 6) AS center_lat, round(sum((73000000 + gx * 1000) / 1000000 * n) / sum(n), 6) AS center_lon FROM p GROUP BY spree_id, subtype_id HAVING sum(n) >= 2""",
    recursive=True,
)
def sprees(spark, d):
    found, _ = places.sprees(tables.order_incidents(spark, d), min_cases=2)
    return found.withColumn("center_lat", F.round("center_lat", 6)).withColumn("center_lon", F.round("center_lon", 6))


@query(
    "spree_points",
    "inc spots spot_links",
    "WITH "
    + cc_sql("cc", "spot_links")
    + """, p AS (SELECT coalesce(component, node) AS spree_id, s.*, sum(n) OVER (PARTITION BY coalesce(component, node)) AS t FROM spots s LEFT JOIN cc USING (node))
SELECT spree_id, round((11000000 + gy * 1000) / 1000000, 6) AS lat, round((73000000 + gx * 1000) / 1000000, 6) AS lon, DATE '1970-01-01' + CAST(day AS INTEGER) AS date, n FROM p WHERE t >= 3""",
    recursive=True,
)
def spree_points(spark, d):
    _, members = places.sprees(tables.order_incidents(spark, d))
    return members.withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))
