"""Typed CSV scans: declared string columns, then coercion where bad values become null."""

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# column -> Spark type; everything is read as text first so that a bad value costs a cell, not a row
INCIDENT = {
    "incident_id": "bigint", "station_id": "bigint", "severity_id": "int", "category_id": "int", "subtype_id": "bigint",
    "status_id": "int", "ts": "timestamp_ntz", "ts_to": "timestamp_ntz", "reported_ts": "timestamp_ntz",
    "registered_ts": "timestamp_ntz", "latitude": "double", "longitude": "double",
}
BRIDGE = {"case_id": "bigint", "entity_id": "bigint", "age": "int", "gender_id": "int"}
VICTIM = {"case_id": "string", "victim_id": "string"}
ARREST = {"case_id": "bigint", "entity_id": "bigint", "arrest_date": "timestamp_ntz"}
CHARGESHEET = {"case_id": "bigint", "charged_on": "timestamp_ntz"}
SECTION = {"case_id": "string", "act": "string", "section": "string"}
COMPLAINANT = {"case_id": "bigint", "occupation": "string"}
STAFF = {"staff_id": "bigint", "unit_id": "bigint"}
CATEGORY = {"category_id": "int", "category_name": "string"}
SUBCATEGORY = {"subtype_id": "bigint", "subtype_name": "string"}
SEVERITY = {"severity_id": "int", "severity_label": "string"}
UNIT = {"unit_id": "bigint", "region_id": "int"}
REGION = {"region_id": "int", "region_name": "string"}

CATALOGUE = {
    "incidents": INCIDENT, "bridge": BRIDGE, "victims": VICTIM, "arrests": ARREST, "chargesheets": CHARGESHEET,
    "sections": SECTION, "complainants": COMPLAINANT, "staff": STAFF, "categories": CATEGORY,
    "subcategories": SUBCATEGORY, "severities": SEVERITY, "units": UNIT, "regions": REGION,
}


def read_typed_csv(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """CSV with a header; the columns named there must include ``columns``, others are not read."""
    header = spark.read.option("header", True).option("inferSchema", False).csv(path)
    present = [c for c in columns if c in header.columns]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header.columns])
    raw = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return raw.select(*[F.expr(f"try_cast(`{c}` AS {columns[c]})").alias(c) for c in present])


def load_catalogue(spark: SparkSession, folder: str, names: Mapping[str, Mapping[str, str]] = CATALOGUE) -> dict[str, DataFrame]:
    """All tables ``<folder>/<name>.csv`` as typed frames, each registered as a temporary view."""
    out = {}
    for name, columns in names.items():
        out[name] = read_typed_csv(spark, f"{folder}/{name}.csv", columns)
        out[name].createOrReplaceTempView(name)
    return out


def enrich(incidents: DataFrame, units: DataFrame, regions: DataFrame, categories: DataFrame, severities: DataFrame) -> DataFrame:
    """Star join of incidents with their lookups; the optimizer broadcasts those that are small."""
    out = incidents.join(units.withColumnRenamed("unit_id", "station_id"), "station_id", "left")
    out = out.join(regions, "region_id", "left").join(categories, "category_id", "left")
    return out.join(severities, "severity_id", "left").withColumnRenamed("severity_label", "severity_name")
