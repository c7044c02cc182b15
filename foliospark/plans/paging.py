"""Catalogue: page specifications and page-set algebra over ``conversations`` as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import pagespec
from foliospark.operators import pages
from foliospark.plans.fixtures import ctes, view
from foliospark.plans.registry import query

# One specification per document, by doc_id % 6; the oracle states the outcome of each per page count.
_SPEC = "CASE doc_id % 6 WHEN 0 THEN 'all' WHEN 1 THEN '1-3,2' WHEN 2 THEN '4,x,2-99' WHEN 3 THEN '3-1, 2' WHEN 4 THEN '7,1-2' ELSE '0,2-' END"
_DOCS = f"docs AS (SELECT doc_id, count(*) AS total, {_SPEC} AS spec FROM page_text GROUP BY doc_id)"
_BASE = ctes("page_text", more=_DOCS)


def _docs(spark, d):
    return pages.page_counts(view(spark, d, "page_text")).withColumn("spec", F.expr(_SPEC))


def _joined(arr):
    return F.array_join(F.transform(arr, lambda p: p.cast("string")), ",")


@query("page_ranges", _BASE + """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN array_to_string(list_transform(range(1, total + 1), lambda p : p || '-' || p), ',')
 WHEN 1 THEN concat_ws(',', CASE WHEN total >= 3 THEN '1-3' END, CASE WHEN total >= 2 THEN '2-2' END) WHEN 2 THEN concat_ws(',', CASE WHEN total >= 4 THEN '4-4' END)
 WHEN 3 THEN concat_ws(',', CASE WHEN total >= 2 THEN '2-2' END) WHEN 4 THEN concat_ws(',', CASE WHEN total >= 7 THEN '7-7' END, CASE WHEN total >= 2 THEN '1-2' END) ELSE '' END AS ranges FROM docs""")
def _(spark, d):
    r = F.transform(pagespec.page_ranges(F.col("spec"), F.col("total")), lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))
    return _docs(spark, d).select("doc_id", F.array_join(r, ",").alias("ranges"))


_RNG = "array_to_string(range({}, {}), ',')"


@query("page_list", _BASE + f"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN {_RNG.format(1, 'total + 1')} WHEN 1 THEN {_RNG.format(1, 'least(total, 3) + 1')}
 WHEN 2 THEN concat_ws(',', CASE WHEN total >= 4 THEN '4' END, CASE WHEN total >= 2 THEN array_to_string(list_filter(range(2, total + 1), lambda p : p <> 4), ',') END)
 WHEN 3 THEN concat_ws(',', CASE WHEN total >= 2 THEN '2' END) WHEN 4 THEN concat_ws(',', CASE WHEN total >= 7 THEN '7' END, {_RNG.format(1, 'least(total, 2) + 1')}) ELSE '' END AS pages FROM docs""")
def _(spark, d):
    return _docs(spark, d).select("doc_id", _joined(pagespec.page_list(F.col("spec"), F.col("total"))).alias("pages"))


@query("page_set", _BASE + f"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN {_RNG.format(1, 'total + 1')} WHEN 1 THEN {_RNG.format(1, 'least(total, 3) + 1')}
 WHEN 2 THEN CASE WHEN total >= 2 THEN {_RNG.format(2, 'total + 1')} ELSE '' END WHEN 3 THEN CASE WHEN total >= 2 THEN '2' ELSE '' END
 WHEN 4 THEN concat_ws(',', {_RNG.format(1, 'least(total, 2) + 1')}, CASE WHEN total >= 7 THEN '7' END) ELSE '' END AS pages, doc_id % 6 = 5 OR (doc_id % 6 IN (2, 3) AND total < 2) AS failed FROM docs""")
def _(spark, d):
    s = _docs(spark, d).withColumn("s", pagespec.page_set(F.col("spec"), F.col("total")))
    return s.select("doc_id", _joined(F.col("s")).alias("pages"), (F.size("s") == 0).alias("failed"))


@query("page_crop_list", _BASE + f"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN {_RNG.format(1, 'total + 1')} WHEN 1 THEN concat_ws(',', {_RNG.format(1, 'least(total, 3) + 1')}, CASE WHEN total >= 2 THEN '2' END)
 WHEN 3 THEN CASE WHEN total >= 2 THEN '2' ELSE '' END WHEN 4 THEN concat_ws(',', CASE WHEN total >= 7 THEN '7' END, {_RNG.format(1, 'least(total, 2) + 1')}) END AS pages FROM docs""")
def _(spark, d):
    return _docs(spark, d).select("doc_id", _joined(pagespec.page_crop_list(F.col("spec"), F.col("total"))).alias("pages"))


@query("validate_ranges", _BASE + """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN total < 3 THEN 'Page 3 exceeds document length (' || total || ' pages)' END
 WHEN 2 THEN 'Invalid page range format. Use format like ''1-3,5,7-10''' WHEN 3 THEN 'Invalid range: 3-1' WHEN 4 THEN CASE WHEN total < 7 THEN 'Page 7 exceeds document length (' || total || ' pages)' END
 ELSE 'Page numbers must be positive' END AS message FROM docs""")
def _(spark, d):
    return _docs(spark, d).select("doc_id", pagespec.validate_ranges(F.col("spec"), F.col("total")).alias("message"))


_SELECTED = """, sel AS (SELECT p.doc_id, p.page_no FROM page_text p JOIN docs d USING (doc_id) WHERE d.doc_id % 6 = 0 OR (d.doc_id % 6 = 1 AND page_no <= 3)
 OR (d.doc_id % 6 = 2 AND page_no >= 2) OR (d.doc_id % 6 = 3 AND page_no = 2) OR (d.doc_id % 6 = 4 AND (page_no <= 2 OR page_no = 7)))"""
_SEL = ctes("page_text", more=_DOCS + _SELECTED)


def _selection(spark, d):
    return pages.selected_pages(_docs(spark, d), pagespec.page_set(F.col("spec"), F.col("total")))


@query("rotate_pages", _SEL + """SELECT p.doc_id, p.page_no, CASE WHEN s.page_no IS NOT NULL THEN ((p.page_no % 4) * 90 + 270) % 360 ELSE (p.page_no % 4) * 90 END AS rotation FROM page_text p LEFT JOIN sel s ON p.doc_id = s.doc_id AND p.page_no = s.page_no""")
def _(spark, d):
    p = view(spark, d, "page_text").select("doc_id", "page_no", ((F.col("page_no") % 4) * 90).alias("rotation"))
    return pages.rotate_pages(p, _selection(spark, d), 270)


@query("crop_box", ctes("page_text") + """SELECT doc_id, page_no, 10.0::DOUBLE AS x0, 20.0::DOUBLE AS y0, (612 - doc_id % 7 * 100)::DOUBLE AS x1, 762.0::DOUBLE AS y1, (612 - doc_id % 7 * 100) > 10 AS valid FROM page_text""")
def _(spark, d):
    p = view(spark, d, "page_text").withColumn("width", F.lit(None).cast("double")).withColumn("height", F.lit(792.0))
    return pages.crop_box(p, F.lit(10), F.lit(30), (F.col("doc_id") % 7) * 100, F.lit(20))


@query("fk_pages", _SEL + "SELECT p.doc_id, p.page_no, p.text FROM page_text p JOIN sel USING (doc_id, page_no)")
def _(spark, d):
    return view(spark, d, "page_text").join(_selection(spark, d).select("doc_id", "page_no"), ["doc_id", "page_no"]).select("doc_id", "page_no", "text")


_ORDER = "CASE doc_id % 4 WHEN 0 THEN array(2, 1, 2) WHEN 1 THEN array(1) WHEN 2 THEN array(3, 3, 1) ELSE array(9, 1) END"


@query("organize_pages", ctes("page_text", more="""o AS (SELECT doc_id, unnest(CASE doc_id % 4 WHEN 0 THEN [2, 1, 2] WHEN 1 THEN [1] WHEN 2 THEN [3, 3, 1] ELSE [9, 1] END) AS page_no,
 unnest(range(CASE doc_id % 4 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END)) AS pos FROM (SELECT DISTINCT doc_id FROM page_text)), t AS (SELECT doc_id, count(*) AS total FROM page_text GROUP BY doc_id),
 bad AS (SELECT DISTINCT doc_id FROM o JOIN t USING (doc_id) WHERE page_no > total)""") + """SELECT o.doc_id, o.pos + 1 AS out_page, o.page_no, p.text, o.pos = min(o.pos) OVER (PARTITION BY o.doc_id, o.page_no) AS is_first_copy
 FROM o JOIN page_text p ON o.doc_id = p.doc_id AND o.page_no = p.page_no WHERE o.doc_id NOT IN (FROM bad)""")
def _(spark, d):
    p = view(spark, d, "page_text")
    sel = pages.selected_pages(pages.page_counts(p), F.expr(_ORDER)).withColumn("page_no", F.col("page_no").cast("long"))
    return pages.organize_pages(p, sel).select("doc_id", F.col("out_page").cast("long").alias("out_page"), "page_no", "text", "is_first_copy")


@query("delete_pages", ctes("page_text") + "SELECT doc_id, page_no, text FROM page_text WHERE NOT (page_no % 3 = 1 OR doc_id % 10 = 0)")
def _(spark, d):
    p = view(spark, d, "page_text")
    gone = p.filter((F.col("page_no") % 3 == 1) | (F.col("doc_id") % 10 == 0))
    return pages.delete_pages(p, gone).select("doc_id", "page_no", "text")


_FILES = "files AS (SELECT doc_id, doc_id // 3 AS job, doc_id % 3 AS ord, count(*) AS n FROM page_text GROUP BY doc_id), offs AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY job ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, count(*) OVER (PARTITION BY job) AS fs FROM files)"


def _offsets(spark, d):
    f = pages.page_counts(view(spark, d, "page_text")).select("doc_id", F.floor(F.col("doc_id") / 3).alias("job"), (F.col("doc_id") % 3).alias("ord"), F.col("total").alias("n"))
    return pages.merge_offsets(f)


@query("merge_offsets", ctes("page_text", more=_FILES) + "SELECT job, doc_id, n, off AS offset, fs AS files FROM offs WHERE fs >= 2")
def _(spark, d):
    return _offsets(spark, d).select("job", "doc_id", "n", "offset", "files")


@query("merge_pages", ctes("page_text", more=_FILES) + "SELECT o.job, o.off + p.page_no AS out_page, p.doc_id, p.page_no, p.text FROM offs o JOIN page_text p USING (doc_id) WHERE fs >= 2")
def _(spark, d):
    return pages.merge_pages(view(spark, d, "page_text"), _offsets(spark, d)).select("job", "out_page", "doc_id", "page_no", "text")


@query("page_numbers", ctes("page_text") + "SELECT doc_id, page_no, 'Page ' || (page_no + 4) || ' of ' || count(*) OVER (PARTITION BY doc_id) AS label FROM page_text")
def _(spark, d):
    return pages.page_labels(view(spark, d, "page_text"), "Page {n} of {total}", 5).select("doc_id", "page_no", "label")


def _page_map(spark, d):
    return view(spark, d, "page_text").filter("page_no % 3 <> 0").select("doc_id", "page_no", (F.col("page_no") - F.floor(F.col("page_no") / 3)).alias("out_page"))


_MAP = "pmap AS (SELECT doc_id, page_no, page_no - page_no // 3 AS out_page FROM page_text WHERE page_no % 3 <> 0)"


@query("kept_links", ctes("page_text", more=_MAP) + """SELECT l.doc_id, s.out_page AS src_out, l.dest_page, t.out_page AS dest_out FROM (SELECT doc_id, page_no AS src_page, (page_no * 2) % 9 + 1 AS dest_page FROM page_text) l
 JOIN pmap s ON l.doc_id = s.doc_id AND l.src_page = s.page_no LEFT JOIN pmap t ON l.doc_id = t.doc_id AND l.dest_page = t.page_no""")
def _(spark, d):
    links = view(spark, d, "page_text").select("doc_id", F.col("page_no").alias("src_page"), ((F.col("page_no") * 2) % 9 + 1).alias("dest_page"))
    return pages.kept_links(links, _page_map(spark, d)).select("doc_id", "src_out", "dest_page", "dest_out")


# Bookmarks of a document, one per line: in blocks of 32 an even place hangs below the even place before it and an odd one
# below its neighbour, so a block is 17 levels deep and even places have an odd sibling before them. Every fifth page is kept.
_TREE = """b AS (SELECT doc_id, CAST(line_no AS BIGINT) AS id, CAST(line_no % 32 AS BIGINT) AS p FROM line_text), t AS (SELECT doc_id, id, CASE WHEN p = 0 THEN -1 WHEN p % 2 = 1 THEN id - 1 ELSE id - 2 END AS parent_id,
 CASE WHEN id % 5 = 0 THEN id // 5 END AS own FROM b), up AS (SELECT doc_id, id AS node, parent_id, own AS dest, CAST([] AS BIGINT[]) AS way FROM t WHERE own IS NOT NULL
 UNION ALL SELECT u.doc_id, t.id, t.parent_id, u.dest, list_prepend(u.node, u.way) FROM up u JOIN t ON t.doc_id = u.doc_id AND t.id = u.parent_id)"""


@query("bookmark_remap", ctes("line_text", more=_TREE).replace("WITH", "WITH RECURSIVE", 1) + "SELECT doc_id, node AS id, any_value(parent_id) AS parent_id, arg_min(dest, way) AS dest FROM up GROUP BY doc_id, node")
def _(spark, d):
    lines = view(spark, d, "line_text").select("doc_id", F.col("line_no").cast("long").alias("id"), (F.col("line_no") % 32).cast("long").alias("p"))
    parent = F.when(F.col("p") == 0, -1).when(F.col("p") % 2 == 1, F.col("id") - 1).otherwise(F.col("id") - 2)
    b = lines.select("doc_id", "id", parent.alias("parent_id"), F.col("id").alias("dest_page"))
    kept = lines.where("id % 5 = 0").select("doc_id", F.col("id").alias("page_no"), F.floor(F.col("id") / 5).alias("out_page"))
    return pages.bookmark_remap(b, kept).select("doc_id", "id", "parent_id", "dest")


@query("chunk_plan", ctes("words") + "SELECT doc_id, (page_no - 1) // 5 AS chunk, min(page_no) AS first_page, max(page_no) AS last_page, count(*) OVER (PARTITION BY doc_id) AS chunks, count(*) OVER (PARTITION BY doc_id) > 2 AS parallel FROM (SELECT DISTINCT doc_id, page_no FROM words) GROUP BY doc_id, (page_no - 1) // 5")
def _(spark, d):
    return pages.chunk_plan(view(spark, d, "words").select("doc_id", "page_no").distinct(), 5)
