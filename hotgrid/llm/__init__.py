"""Operators for training-data pipelines, and their queries. Nothing else in the library imports this package."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from hotgrid.llm.catalogue import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from hotgrid.llm.catalogue import ORACLES

    return dict(ORACLES)
