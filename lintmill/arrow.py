"""Arrow-batched map over rows: Python functions see lists of column values, never rows one by one through pickling."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


SMALL_BYTES = 16 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input over all cores.

    A small table often lies in one file of one row group, which one task would read and analyse
    alone.  Only inputs estimated below SMALL_BYTES are shuffled; larger ones have enough splits.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = spark.sparkContext.defaultParallelism
    return df.repartition(n) if size < SMALL_BYTES and n > 1 else df


def map_lists(
    df: DataFrame,
    columns: list[str],
    function: Callable[..., Iterable[tuple]],
    schema: str | StructType,
    once: Callable[[], object] | None = None,
) -> DataFrame:
    """``function(*lists)`` gets the given columns of one Arrow batch and yields output rows.

    ``once()`` runs once per task; its result, if there is such a function, is passed first.
    Nothing but a small input is shuffled and no more than one batch of input and output is held.
    """
    struct = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    out_schema = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = once() if once is not None else None
        for batch in batches:
            lists = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            rows = function(state, *lists) if once is not None else function(*lists)
            cols: list[list] = [[] for _ in out_schema]
            n = 0
            for row in rows:
                for c, v in zip(cols, row):
                    c.append(v)
                n += 1
                if n == 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out_schema)], schema=out_schema)
                    cols, n = [[] for _ in out_schema], 0
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out_schema)], schema=out_schema)

    return spread(df.select(*columns)).mapInArrow(run, struct)
