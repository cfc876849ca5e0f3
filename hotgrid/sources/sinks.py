"""File sinks. All write in parallel, one part per task; layers and scopes become partition folders."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_records(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """One JSON object per row and line."""
    df.write.mode("overwrite").partitionBy(*by).json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(row: DataFrame, path: str) -> None:
    """A nested one-row report as one JSON document."""
    row.select(F.to_json(F.struct(*[F.col(c) for c in row.columns])).alias("value")).write.mode("overwrite").text(path)


def write_features(features: DataFrame, path: str, by: Sequence[str] = ("layer",)) -> None:
    """GeoJSON features, one per line, in a folder per layer (feature text in column ``feature``)."""
    features.select(*by, F.col("feature").alias("value")).write.mode("overwrite").partitionBy(*by).text(path)


def write_matrix(matrix: DataFrame, path: str, **params) -> str:
    """Feature matrix as parquet partitioned by split; the folder name carries every parameter, so another
    filter or cutoff can never be served a stale copy."""
    key = "/".join(f"{k}={v}" for k, v in sorted(params.items()))
    target = f"{path}/{key}" if key else path
    matrix.write.mode("overwrite").partitionBy("split").parquet(target)
    return target


def read_matrix(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)


def stamped(df: DataFrame) -> DataFrame:
    """Add the time the export was made."""
    return df.withColumn("generated", F.current_timestamp())


def clean_number(c: Column, digits: int | None = None) -> Column:
    """NaN becomes null; optionally rounded."""
    out = F.when(~F.isnan(c), c)
    return F.round(out, digits) if digits is not None else out


def point_features(
    cells: DataFrame,
    lat: str = "cell_lat",
    lon: str = "cell_lon",
    drop: Sequence[str] = (),
    coord_digits: int | None = 5,
    property_digits: int | None = 4,
) -> DataFrame:
    """Add ``feature``: a GeoJSON point with every other column as property; compact, NaN as null."""
    props = [
        clean_number(F.col(c), property_digits).alias(c) if t in ("double", "float") else F.col(c)
        for c, t in cells.dtypes
        if c not in (lat, lon, *drop)
    ]
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.lit("Point").alias("type"),
            F.array(clean_number(F.col(lon), coord_digits), clean_number(F.col(lat), coord_digits)).alias("coordinates"),
        ).alias("geometry"),
        F.struct(*props).alias("properties"),
    )
    return cells.withColumn("feature", F.to_json(feature, {"ignoreNullFields": "false"}))


def significant_only(cells: DataFrame, by: Sequence[str] = ("layer",)) -> DataFrame:
    """Cells with a significant label, plus ``analysed``: cells of the layer before the cut.

    A table that already carries ``analysed`` keeps it, so the cut can be repeated.
    """
    if "analysed" not in cells.columns:
        sizes = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("analysed"))
        cells = cells.join(sizes, list(by))
    return cells.where(F.col("significance") != "not_sig")
