"""What the operators share: batches of rows inside tasks, and the tables that cut lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexilake.session import durable, release, ship_package

__all__ = ["durable", "keep_rows", "map_rows", "release", "slices", "table"]

SLICE_BYTES = 1_000_000
SLICE_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of bounded bytes, so that a run of very long texts stays small in memory."""
    for batch in batches:
        rows = batch.num_rows
        step = SLICE_ROWS
        if text is not None and rows:
            mean = max(1, batch.column(batch.schema.get_field_index(text)).nbytes // rows)
            step = max(1, min(SLICE_ROWS, SLICE_BYTES // mean))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str,
             text: str | None = None) -> DataFrame:
    """Apply a function of a batch of rows to every batch; ``make`` builds it once in each task.

    The function returns columns by name; ``schema`` is their DDL.  A narrow step: no shuffle.
    """
    ship_package(df.sparkSession)
    out = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for piece in slices(batches, text):
            columns = fn(piece)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], object]], text: str) -> DataFrame:
    """The rows, with all their columns, for which a function of a batch gives true; a narrow step."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for piece in slices(batches, text):
            yield piece.filter(pa.array(fn(piece), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
