"""Named queries over the given tables, each with the SQL that must give the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Shared SQL views in dependency order.
VIEWS: dict[str, str] = {}


def view(name: str, body: str) -> None:
    VIEWS[name] = body.strip()


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the named views (space separated, dependencies listed first)."""
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in names.split()]
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = body[5:]
        return head + ",\n".join(parts) + ",\n" + body
    return head + ",\n".join(parts) + "\n" + body


def query(name: str, views: str = "", sql: str | None = None, recursive: bool = False):
    """Register a query; ``sql`` is its oracle, omitted where SQL cannot express it."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql, recursive) if views else sql.strip()
        return fn

    return wrap


view(
    "inc",
    """
SELECT *, lat_e6 / 1000000 AS latitude, lon_e6 / 1000000 AS longitude,
       ((lat_e6 - 11500000) * 111 + 500000) // 1000000 * 493
         + ((lon_e6 - 74000000) * 107 + 500000) // 1000000 AS cell_id
FROM (
  SELECT o_orderkey AS incident_id, o_orderdate AS ts, o_custkey AS station_id,
         c_nationkey AS region_id, n_name AS region_name,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS category_id,
         o_orderpriority AS category_name,
         CAST(substr(o_orderpriority, 1, 1) AS BIGINT) * 10 + o_custkey % 6 AS subtype_id,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS severity_id,
         CASE o_orderstatus WHEN 'F' THEN 'severe' WHEN 'O' THEN 'standard' ELSE 'minor' END AS severity_name,
         CASE o_orderstatus WHEN 'F' THEN 3 ELSE 1 END AS status_id,
         12000000 + 250000 * CAST(c_nationkey AS BIGINT) + 18000 * (o_custkey % 4) + 3000 * (o_orderkey % 7) AS lat_e6,
         74200000 + 170000 * CAST(c_nationkey AS BIGINT) + 18000 * (o_custkey % 3) + 4000 * (o_orderkey % 5) AS lon_e6
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
)""",
)
view(
    "evt",
    """
SELECT *, lat_e6 / 1000000 AS latitude, lon_e6 / 1000000 AS longitude,
       ((lat_e6 - 11500000) * 111 + 500000) // 1000000 * 493
         + ((lon_e6 - 74000000) * 107 + 500000) // 1000000 AS cell_id
FROM (
  SELECT event_id AS incident_id, ts, user_id AS station_id, user_id % 25 AS region_id,
         'ZONE_' || CAST(user_id % 25 AS VARCHAR) AS region_name,
         CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS category_id,
         event_type AS category_name,
         CASE WHEN value < 20 THEN 1 WHEN value < 54 THEN 2 ELSE 3 END AS severity_id,
         12000000 + 250000 * (user_id % 25) + 9000 * (user_id // 25 % 3) + 3000 * (event_id % 4) AS lat_e6,
         74200000 + 170000 * (user_id % 25) + 9000 * (user_id // 75 % 2) AS lon_e6
  FROM events
)""",
)
view("ce", "SELECT l_orderkey AS case_id, l_partkey AS entity_id FROM lineitem")
view("active", "SELECT cell_id, count(*) AS total_cases FROM inc GROUP BY cell_id HAVING count(*) >= 5")
view(
    "layers",
    """
SELECT layer, cell_id, count(*) AS case_count
FROM (SELECT unnest(['overall', category_name]) AS layer, cell_id FROM inc)
WHERE cell_id IN (SELECT cell_id FROM active) GROUP BY layer, cell_id""",
)
view(
    "region_layers",
    """
SELECT * FROM (
  SELECT layer, region_name, cell_id, count(*) AS case_count,
         count(*) OVER (PARTITION BY layer, region_name) AS n_cells
  FROM (SELECT unnest(['overall', category_name]) AS layer, region_name, cell_id FROM inc)
  WHERE cell_id IN (SELECT cell_id FROM active) GROUP BY layer, region_name, cell_id)
WHERE n_cells >= 15""",
)

HAVERSINE = (
    "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2)"
    " + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"
)


def cell_lat(c: str) -> str:
    return f"(11.5::DOUBLE + ({c} // 493) / 111.0::DOUBLE)"


def cell_lon(c: str) -> str:
    return f"(74.0::DOUBLE + ({c} % 493) / 107.0::DOUBLE)"


def cell_km(a: str, b: str) -> str:
    return HAVERSINE.format(lat1=cell_lat(a), lon1=cell_lon(a), lat2=cell_lat(b), lon2=cell_lon(b))


def significance_sql(z: str) -> str:
    return (
        f"CASE WHEN {z} > 2.576 THEN 'hot_99' WHEN {z} < -2.576 THEN 'cold_99' WHEN {z} > 1.96 THEN 'hot_95' "
        f"WHEN {z} < -1.96 THEN 'cold_95' WHEN {z} > 1.645 THEN 'hot_90' WHEN {z} < -1.645 THEN 'cold_90' ELSE 'not_sig' END"
    )


def normal_p_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + 0.3275911::DOUBLE * {x}))"
    return (
        f"(((((1.061405429::DOUBLE * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592)"
        f" * {t} * exp(-{x} * {x}))"
    )
