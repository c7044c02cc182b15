"""Writers of tables, reports and extracted text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.scratch import shared_dir


def write_reports(spark: SparkSession, lines: DataFrame, path: str | None = None, buckets: int = 64) -> str:
    """Report lines in order of document, page and part, in folders by a hash of the document, which stays a column.

    Rows are placed by document and page range, so a long report spreads over several files.
    """
    path = path or shared_dir(spark, "reports")
    placed = lines.select("doc_id", "page_no", "part", "line").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    placed.repartitionByRange("bucket", "doc_id", "page_no").sortWithinPartitions("bucket", "doc_id", "page_no", "part", "line").write.mode("append").partitionBy("bucket").parquet(path)
    return path


def write_tables(spark: SparkSession, cells: DataFrame, path: str | None = None, buckets: int = 64) -> str:
    """Typed cells as Parquet in order of table and row, in folders by a hash of the document, which stays a column."""
    path = path or shared_dir(spark, "tables")
    placed = cells.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    ordered = placed.repartitionByRange("bucket", "doc_id", "page_no", "table_no").sortWithinPartitions("bucket", "doc_id", "page_no", "table_no", "row_no", "col_no")
    ordered.write.mode("append").partitionBy("bucket").parquet(path)
    return path


def extracted_text(pages: DataFrame) -> DataFrame:
    """Pieces of each document's text file: concatenated by page they give the file."""
    gap = F.when(F.col("page_no") > 1, "\n\n").otherwise("")
    piece = F.concat(gap, F.lit("--- Page "), F.col("page_no").cast("string"), F.lit(" ---\n"), F.col("text"))
    return pages.select("doc_id", "page_no", piece.alias("piece"))
