"""Page-set algebra: merge, organise, delete, number, rotate, crop, links and bookmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))


def merge_offsets(files: DataFrame) -> DataFrame:
    """First output page of each file of a job; ``files`` has one row per file (job, ord, n)."""
    before = Window.partitionBy("job").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    size = Window.partitionBy("job")
    return (files.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .withColumn("files", F.count(F.lit(1)).over(size)).filter(F.col("files") >= 2))


def merge_pages(pages: DataFrame, offsets: DataFrame) -> DataFrame:
    """Pages of all files of a job under their output page numbers."""
    return pages.join(offsets.select("doc_id", "job", "offset"), "doc_id").withColumn("out_page", F.col("offset") + F.col("page_no"))


def page_labels(pages: DataFrame, template: str, start: int = 1) -> DataFrame:
    """Label per page. Pages are numbered from 1, so only the total needs an aggregate."""
    n = (F.lit(start) + F.col("page_no") - 1).cast("string")
    label = F.replace(F.replace(F.lit(template), F.lit("{n}"), n), F.lit("{total}"), F.col("total").cast("string"))
    return pages.join(page_counts(pages), "doc_id").withColumn("label", label)


def selected_pages(jobs: DataFrame, numbers: Column) -> DataFrame:
    """One row per chosen page, with its place in the selection."""
    return jobs.select("doc_id", F.posexplode(numbers).alias("pos", "page_no"))


def rotate_pages(pages: DataFrame, selection: DataFrame, angle: int) -> DataFrame:
    if angle not in (90, 180, 270):
        raise ValueError("angle must be 90, 180 or 270")
    chosen = selection.select("doc_id", "page_no", F.lit(True).alias("_in"))
    turned = F.when(F.col("_in"), F.pmod(F.col("rotation") + angle, F.lit(360))).otherwise(F.col("rotation"))
    return pages.join(chosen, ["doc_id", "page_no"], "left").withColumn("rotation", turned).drop("_in")


def crop_box(pages: DataFrame, left: Column, top: Column, right: Column, bottom: Column) -> DataFrame:
    """Crop box from the page box minus margins; an empty box makes its job invalid."""
    w, h = F.coalesce("width", F.lit(612.0)), F.coalesce("height", F.lit(792.0))
    boxed = pages.select("doc_id", "page_no", left.cast("double").alias("x0"), bottom.cast("double").alias("y0"),
                         (w - right).alias("x1"), (h - top).alias("y1"))
    bad = boxed.withColumn("bad", (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")))
    jobs = bad.groupBy("doc_id").agg((~F.bool_or("bad")).alias("valid"))
    return bad.drop("bad").join(jobs, "doc_id")


def organize_pages(pages: DataFrame, selection: DataFrame) -> DataFrame:
    """Pages in the requested order, repeats included; a job naming a missing page is left out."""
    totals = page_counts(pages)
    ranged = selection.join(totals, "doc_id")
    outside = ranged.filter((F.col("page_no") < 1) | (F.col("page_no") > F.col("total"))).select("doc_id").distinct()
    good = selection.join(outside, "doc_id", "left_anti")
    first = good.groupBy("doc_id", "page_no").agg(F.min("pos").alias("first_pos"))
    return (good.join(first, ["doc_id", "page_no"]).join(pages, ["doc_id", "page_no"])
            .withColumn("is_first_copy", F.col("pos") == F.col("first_pos")).withColumn("out_page", F.col("pos") + 1))


def delete_pages(pages: DataFrame, deleted: DataFrame) -> DataFrame:
    """Pages not deleted; a document left without pages yields no rows, which is the error case."""
    return pages.join(deleted.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_anti")


def kept_links(links: DataFrame, page_map: DataFrame) -> DataFrame:
    """Links of kept pages; one whose target page was dropped loses its destination."""
    source = page_map.select("doc_id", F.col("page_no").alias("src_page"), F.col("out_page").alias("src_out"))
    target = page_map.select("doc_id", F.col("page_no").alias("dest_page"), F.col("out_page").alias("dest_out"))
    return links.join(source, ["doc_id", "src_page"]).join(target, ["doc_id", "dest_page"], "left")


def bookmark_remap(bookmarks: DataFrame, page_map: DataFrame) -> DataFrame:
    """Bookmarks kept with their page, or with any child's; then the first kept child's page is used.

    Needs doc_id, id, parent_id (null or -1 for a root) and dest_page; ids number an outline in reading order, parents before
    their children. There the first kept child's page, taken down to the leaves, is the page of the first kept bookmark below,
    and all that follows a bookmark lies below it until one hangs from an earlier parent. So runs that end at a kept bookmark
    and the smallest parent between a bookmark and that end decide: two windows, whatever the depth.
    """
    target = page_map.select("doc_id", F.col("page_no").alias("dest_page"), F.col("out_page").alias("dest"))
    tree = bookmarks.join(target, ["doc_id", "dest_page"], "left")
    onward = Window.partitionBy("doc_id").orderBy(F.desc("id"))
    runs = tree.withColumn("_run", F.count("dest").over(onward))
    back = Window.partitionBy("doc_id", "_run").orderBy(F.desc("id"))
    ends = runs.withColumns({"_end": F.first("dest").over(back),
                             "_least": F.min(F.coalesce("parent_id", F.lit(-1))).over(back.rowsBetween(Window.unboundedPreceding, -1))})
    below = F.col("dest").isNotNull() | (F.col("_least") >= F.col("id"))
    return ends.where(F.col("_end").isNotNull() & below).withColumn("dest", F.col("_end")).drop("_run", "_end", "_least")


def chunk_plan(pages: DataFrame, size: int = 50) -> DataFrame:
    """Chunks of a document; with one or two chunks it is not split."""
    c = pages.groupBy("doc_id", F.floor((F.col("page_no") - 1) / size).alias("chunk")).agg(
        F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"))
    n = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    return c.join(n, "doc_id").withColumn("parallel", F.col("chunks") > 2)
