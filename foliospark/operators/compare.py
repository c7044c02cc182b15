"""Page-by-page comparison of two versions of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters at which words are split, and line ends.
WORD_GAP = r"[\s\x0b\x0c\x1c-\x1f\x85   -     　]+"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def page_pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages of both versions by number; a missing page reads as ''."""
    a = before.select("doc_id", "page_no", F.col("text").alias("a"))
    b = after.select("doc_id", "page_no", F.col("text").alias("b"))
    j = a.join(b, ["doc_id", "page_no"], "full_outer")
    return j.select("doc_id", "page_no", F.coalesce("a", F.lit("")).alias("text_before"), F.coalesce("b", F.lit("")).alias("text_after"),
                    F.col("a").isNotNull().cast("long").alias("in_before"), F.col("b").isNotNull().cast("long").alias("in_after"))


def words_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, WORD_GAP), lambda w: w != ""))


def changed_pages(pairs: DataFrame) -> DataFrame:
    """Differing pages with the numbers of distinct words added and removed."""
    d = pairs.filter(F.col("text_before") != F.col("text_after"))
    a, b = words_of(F.col("text_before")), words_of(F.col("text_after"))
    return d.select("doc_id", "page_no", F.array_except(b, a).alias("words_added"), F.array_except(a, b).alias("words_removed"))


def diff_summary(pairs: DataFrame) -> DataFrame:
    """One row per pair: page difference, changed pages and changed words.

    The page numbers themselves stay rows (:func:`changed_pages`), so no pair is gathered.
    """
    a, b = words_of(F.col("text_before")), words_of(F.col("text_after"))
    words = F.when(F.col("text_before") != F.col("text_after"), F.size(F.array_except(b, a)) + F.size(F.array_except(a, b))).otherwise(0)
    changed = (F.col("text_before") != F.col("text_after")).cast("long")
    return pairs.groupBy("doc_id").agg(
        (F.sum("in_after") - F.sum("in_before")).alias("pages_diff"), F.sum(changed).alias("pages_with_changes"),
        F.sum(words).alias("text_changes_count"), (F.sum(changed) == 0).alias("identical"))


def line_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines only in one version, per page; equal lines cancel one for one (multiset difference)."""
    def lines(df):
        return df.select("doc_id", "page_no", F.explode(F.split("text", LINE_END)).alias("line"))

    a, b = lines(before), lines(after)
    # Signed counts need one shuffle on the line, instead of two except-all passes.
    signed = a.withColumn("d", F.lit(-1)).unionByName(b.withColumn("d", F.lit(1)))
    net = signed.groupBy("doc_id", "page_no", "line").agg(F.sum("d").alias("net")).filter(F.col("net") != 0)
    return net.select("doc_id", "page_no", "line", F.when(F.col("net") > 0, "added").otherwise("removed").alias("change"),
                      F.abs("net").alias("n"))


def report_lines(pairs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Comparison report as ordered lines: (doc_id, page_no, part, line)."""
    head = pairs.groupBy("doc_id").agg(F.sum("in_before").alias("a"), F.sum("in_after").alias("b"))
    rule = F.lit("=" * 50)
    head = head.select("doc_id", F.lit(0).cast("long").alias("page_no"), F.posexplode(F.array(
        F.lit("PDF Comparison Report"), rule, F.concat(F.lit("Pages in File 1: "), F.col("a").cast("string")),
        F.concat(F.lit("Pages in File 2: "), F.col("b").cast("string")), rule)).alias("part", "line"))
    titles = pairs.select("doc_id", "page_no", F.lit(0).alias("part"), F.concat(F.lit("--- Page "), F.col("page_no").cast("string"), F.lit(" ---")).alias("line"))
    same = pairs.filter(F.col("text_before") == F.col("text_after")).select("doc_id", "page_no", F.lit(1).alias("part"), F.lit("No text differences found.").alias("line"))
    mark = F.when(F.col("change") == "added", "+").otherwise("-")
    diff = line_diff(before, after).select("doc_id", "page_no", F.when(F.col("change") == "added", 2).otherwise(1).alias("part"), F.concat(mark, F.col("line")).alias("line"))
    return head.unionByName(titles).unionByName(same).unionByName(diff)
