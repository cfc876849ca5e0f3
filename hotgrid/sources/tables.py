"""Incident, bridge and lookup views derived from the star-schema tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotgrid.functions import spatial


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _placed(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("latitude", F.col("lat_e6") / 1_000_000)
        .withColumn("longitude", F.col("lon_e6") / 1_000_000)
        .withColumn("cell_id", spatial.cell_of_e6(F.col("lat_e6"), F.col("lon_e6")))
    )


def order_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """One incident per order; the station is the customer, the region its nation."""
    orders = table(spark, folder, "orders")
    stations = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    regions = table(spark, folder, "nation").select("n_nationkey", "n_name")
    cat = F.substring("o_orderpriority", 1, 1).cast("int")
    status = F.col("o_orderstatus")
    nation = F.col("c_nationkey").cast("bigint")
    joined = orders.join(stations, F.col("o_custkey") == F.col("c_custkey"), "left").join(
        regions, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    return _placed(
        joined.select(
            F.col("o_orderkey").alias("incident_id"),
            F.col("o_orderdate").alias("ts"),
            F.col("o_custkey").alias("station_id"),
            F.col("c_nationkey").alias("region_id"),
            F.col("n_name").alias("region_name"),
            cat.alias("category_id"),
            F.col("o_orderpriority").alias("category_name"),
            (cat * 10 + F.col("o_custkey") % 6).cast("bigint").alias("subtype_id"),
            F.when(status == "F", 1).when(status == "O", 2).otherwise(3).alias("severity_id"),
            F.when(status == "F", "severe").when(status == "O", "standard").otherwise("minor").alias("severity_name"),
            F.when(status == "F", 3).otherwise(1).alias("status_id"),
            (
                F.lit(12_000_000) + 250_000 * nation + 18_000 * (F.col("o_custkey") % 4) + 3_000 * (F.col("o_orderkey") % 7)
            ).alias("lat_e6"),
            (
                F.lit(74_200_000) + 170_000 * nation + 18_000 * (F.col("o_custkey") % 3) + 4_000 * (F.col("o_orderkey") % 5)
            ).alias("lon_e6"),
        )
    )


def event_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """One incident per event, with real times of day."""
    return from_events(table(spark, folder, "events"))


def from_events(events: DataFrame) -> DataFrame:
    user, eid = F.col("user_id"), F.col("event_id")
    kinds = ["click", "error", "purchase", "signup", "view"]
    cat = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("event_type")).cast("int")
    return _placed(
        events.select(
            eid.alias("incident_id"),
            "ts",
            user.alias("station_id"),
            (user % 25).alias("region_id"),
            F.concat(F.lit("ZONE_"), (user % 25).cast("string")).alias("region_name"),
            cat.alias("category_id"),
            F.col("event_type").alias("category_name"),
            F.when(F.col("value") < 20, 1).when(F.col("value") < 54, 2).otherwise(3).alias("severity_id"),
            (
                F.lit(12_000_000)
                + 250_000 * (user % 25)
                + 9_000 * (F.floor(user / 25) % 3)
                + 3_000 * (eid % 4)
            ).cast("bigint").alias("lat_e6"),
            (F.lit(74_200_000) + 170_000 * (user % 25) + 9_000 * (F.floor(user / 75) % 2)).cast("bigint").alias("lon_e6"),
        )
    )


def case_entity(spark: SparkSession, folder: str) -> DataFrame:
    """Bridge between cases (orders) and entities (parts)."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("entity_id")
    )


def charged_cases(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .where((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1))
        .select(F.col("l_orderkey").alias("case_id"))
    )


def staff(spark: SparkSession, folder: str) -> DataFrame:
    """One row per staff member; the unit is a station number."""
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("staff_id"), F.col("s_nationkey").cast("bigint").alias("unit_id")
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled scores with ties: quality label and a score from the text length."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    return (
        table(spark, folder, "labels")
        .select("doc_id", F.col("quality").alias("y"))
        .join(docs, "doc_id")
        .select(
            F.col("doc_id").alias("id"),
            "y",
            ((F.col("n_chars") % 100) / 100).alias("p"),
            F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "val").otherwise("test").alias("split"),
        )
    )
