"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_column: Column, folds: int) -> Column:
    """Deterministic fold of an id: CRC-32 of its decimal text modulo ``folds`` (null for a null id)."""
    return F.crc32(id_column.cast("string").cast("binary")) % folds


def map_columns(df: DataFrame, fn: Callable[..., dict[str, list]], schema: str) -> DataFrame:
    """Apply ``fn(*columns as lists) -> {column: list}`` to Arrow batches of ``df``, cut to at most 256 rows at a time.

    Slicing bounds the Python objects alive at once however many rows Spark puts into a batch.
    """
    spark_schema = _parse_datatype_string(schema)
    assert isinstance(spark_schema, StructType)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = fn(*[part.column(i).to_pylist() for i in range(part.num_columns)])
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for f in arrow for v in [made[f.name]]], schema=arrow)

    return df.mapInArrow(run, spark_schema)


def keep_rows(df: DataFrame, decide: Callable[[list], list[bool]], column: str = "text") -> DataFrame:
    """The rows of ``df``, columns unchanged, for which ``decide(values of the column)`` says so; no shuffle."""
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part.filter(pa.array(decide(part.column(place).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def int_lists(parts: list) -> pa.Array:
    """A list<int32> array from ``array('i')`` values, without a Python object per number."""
    import numpy as np

    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate([np.frombuffer(p, np.int32) for p in parts if len(p)] or [np.zeros(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
