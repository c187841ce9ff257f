"""Linting of scripts as they arrive.  A script is judged alone, so no state and no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lintmill.operators.lint import lint
from lintmill.rules.engine import Options


def read_stream(spark: SparkSession, directory: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Scripts from Parquet files that arrive in a directory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


def lint_stream(scripts: DataFrame, options: Options = Options()) -> DataFrame:
    """Diagnostics of a stream of scripts; append mode."""
    return lint(scripts, options)


def write_stream(diagnostics: DataFrame, directory: str, checkpoint: str):
    """Append diagnostics as Parquet; exactly once through the checkpoint."""
    return diagnostics.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", directory)
