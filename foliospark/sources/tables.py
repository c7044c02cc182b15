"""Table reader with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet table; with a schema, columns are selected and cast to it by name."""
    df = spark.read.parquet(path)
    if schema is None:
        return df
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
