"""All queries of the core and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintmill.plans import constructs, data_problems, generated, tables


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return tables.flagship(spark, d)


def queries() -> dict:
    return {**tables.QUERIES, **constructs.QUERIES, **generated.QUERIES, **data_problems.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**tables.ORACLES, **constructs.ORACLES, **generated.ORACLES, **data_problems.ORACLES}
