"""Catalogue: comparison, search, redaction, candidates, forms, catalogue filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliospark.operators import candidates, catalogue, compare, forms, redact
from foliospark.plans.fixtures import ctes, table, view
from foliospark.plans.registry import query


def _versions(spark, d):
    p = view(spark, d, "page_text").select("doc_id", "page_no", "text")
    changed = F.when(F.col("page_no") % 3 == 0, F.replace("text", F.lit("e"), F.lit("E"))).otherwise(F.col("text"))
    return p, p.filter(F.col("page_no") % 7 != 0).withColumn("text", changed)


def _pairs(spark, d):
    return compare.page_pairs(*_versions(spark, d))


_V = ctes("page_text", more="""pairs AS (SELECT doc_id, page_no, text AS a, CASE WHEN page_no % 7 = 0 THEN '' WHEN page_no % 3 = 0 THEN replace(text, 'e', 'E') ELSE text END AS b, 1 AS ia, CASE WHEN page_no % 7 = 0 THEN 0 ELSE 1 END AS ib FROM page_text),
 w AS (SELECT doc_id, page_no, ia, ib, a <> b AS diff, list_distinct(list_filter(string_split_regex(a, '\\s+'), lambda x : x <> '')) AS wa, list_distinct(list_filter(string_split_regex(b, '\\s+'), lambda x : x <> '')) AS wb FROM pairs),
 c AS (SELECT doc_id, page_no, ia, ib, diff, list_filter(wb, lambda x : NOT list_contains(wa, x)) AS added, list_filter(wa, lambda x : NOT list_contains(wb, x)) AS removed FROM w)""")


@query("page_pair", _V + "SELECT doc_id, page_no, a AS text_before, b AS text_after FROM pairs")
def _(spark, d):
    return _pairs(spark, d).select("doc_id", "page_no", "text_before", "text_after")


@query("diff_summary", _V + """SELECT doc_id, CAST(sum(ib) - sum(ia) AS BIGINT) AS pages_diff, count(*) FILTER (diff) AS pages_with_changes, CAST(sum(CASE WHEN diff THEN len(added) + len(removed) ELSE 0 END) AS BIGINT) AS text_changes_count,
 NOT bool_or(diff) AS identical FROM c GROUP BY doc_id""")
def _(spark, d):
    return compare.diff_summary(_pairs(spark, d))


@query("changed_pages", _V + "SELECT doc_id, page_no, CAST(len(added) AS INT) AS added, CAST(len(removed) AS INT) AS removed FROM c WHERE diff")
def _(spark, d):
    c = compare.changed_pages(_pairs(spark, d))
    return c.select("doc_id", "page_no", F.size("words_added").alias("added"), F.size("words_removed").alias("removed"))


@query("word_diff", _V + "SELECT doc_id, page_no, 'added' AS change, unnest(added) AS word FROM c WHERE diff UNION ALL SELECT doc_id, page_no, 'removed', unnest(removed) FROM c WHERE diff")
def _(spark, d):
    c = compare.changed_pages(_pairs(spark, d))
    side = lambda col, name: c.select("doc_id", "page_no", F.lit(name).alias("change"), F.explode(col).alias("word"))
    return side("words_added", "added").unionByName(side("words_removed", "removed"))


_LINES = """la AS (SELECT doc_id, page_no, unnest(string_split(a, chr(10))) AS line FROM pairs WHERE ia = 1), lb AS (SELECT doc_id, page_no, unnest(string_split(b, chr(10))) AS line FROM pairs WHERE ib = 1)"""
_LD = "SELECT doc_id, page_no, line, 'removed' AS change, count(*) AS n FROM (FROM la EXCEPT ALL FROM lb) GROUP BY ALL UNION ALL SELECT doc_id, page_no, line, 'added', count(*) FROM (FROM lb EXCEPT ALL FROM la) GROUP BY ALL"


@query("line_diff", _V.rstrip() + ", " + _LINES + " " + _LD)
def _(spark, d):
    return compare.line_diff(*_versions(spark, d))


@query("report_sink", _V.rstrip() + ", " + _LINES + f""", ld AS ({_LD}), h AS (SELECT doc_id, sum(ia) AS na, sum(ib) AS nb FROM pairs GROUP BY doc_id), l AS (
 SELECT doc_id, 0 AS page_no, unnest([0, 1, 2, 3, 4]) AS part, unnest(['PDF Comparison Report', repeat('=', 50), 'Pages in File 1: ' || na, 'Pages in File 2: ' || nb, repeat('=', 50)]) AS line FROM h UNION ALL SELECT doc_id, page_no, 0, '--- Page ' || page_no || ' ---' FROM pairs
 UNION ALL SELECT doc_id, page_no, 1, 'No text differences found.' FROM pairs WHERE a = b UNION ALL SELECT doc_id, page_no, CASE change WHEN 'added' THEN 2 ELSE 1 END, CASE change WHEN 'added' THEN '+' ELSE '-' END || line FROM ld)
 SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, part, line) AS place, line, 1 AS folders FROM l""")
def _(spark, d):
    """Each report as it lies in its files: lines in the order of file and row, and the number of folders that hold it."""
    from foliospark.sources.sinks import write_reports
    before, after = _versions(spark, d)
    path = write_reports(spark, compare.report_lines(compare.page_pairs(before, after), before, after))
    rows = spark.read.parquet(path).select("doc_id", "page_no", "line", "bucket", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    report = Window.partitionBy("doc_id")
    return rows.select("doc_id", "page_no", F.row_number().over(report.orderBy("file", "row")).cast("long").alias("place"), "line",
                       (F.max("bucket").over(report) - F.min("bucket").over(report) + 1).alias("folders"))


@query("find_text", """SELECT doc_id, 1::BIGINT AS page_no, unnest(range(n)) AS match_no FROM (SELECT doc_id, len(regexp_extract_all(text, '(?i)tion')) AS n FROM documents)""")
def _(spark, d):
    p = table(spark, d, "documents").withColumn("page_no", F.lit(1).cast("long"))
    return redact.find_text(p, "TION").select("doc_id", "page_no", "match_no")


@query("find_text_offsets", """SELECT doc_id, page_no, i - 1 AS match_no, CAST(list_sum(list_transform(parts[:i], lambda p: len(p))) + 3 * (i - 1) AS BIGINT) AS start FROM (SELECT doc_id, page_no, parts, unnest(range(1, len(parts))) AS i FROM (
 SELECT conv_id AS doc_id, turn + 1 AS page_no, string_split(lower(text), 'the') AS parts FROM conversations))""")
def _(spark, d):
    f = redact.find_text(view(spark, d, "page_text"), "the")
    return f.select("doc_id", "page_no", F.col("match_no").cast("long").alias("match_no"), F.col("start").cast("long").alias("start"))


@query("match_count", ctes("page_text") + "SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '(?i)the'))) AS BIGINT) AS total_matches, count(*) FILTER (regexp_matches(text, '(?i)the')) AS pages_with_matches FROM page_text GROUP BY doc_id")
def _(spark, d):
    return redact.match_counts(view(spark, d, "page_text"), "the")


@query("replace_text", ctes("page_text") + """SELECT doc_id, page_no, CAST(len(regexp_extract_all(text, '(?i)the')) + CASE WHEN page_no = 2 THEN len(regexp_extract_all(regexp_replace(text, 'the', 'THE$', 'gi'), '(?i)on')) ELSE 0 END AS INT) AS replaced,
 CASE WHEN page_no = 2 THEN regexp_replace(regexp_replace(text, 'the', 'THE$', 'gi'), 'on', '1', 'gi') ELSE regexp_replace(text, 'the', 'THE$', 'gi') END AS text FROM page_text""")
def _(spark, d):
    return redact.replace_text(view(spark, d, "page_text"), [("the", "THE$", None), ("on", "1", 2)]).select("doc_id", "page_no", "replaced", "text")


@query("redact_terms", "SELECT doc_id, regexp_replace(regexp_replace(text, 'tion', repeat('█', 4), 'gi'), 'der', repeat('█', 3), 'gi') AS text FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", redact.redact_terms(F.col("text"), ["tion", " der ", ""]).alias("text"))


_RE2 = {"email": r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+", "phone": r"[0-9]{3}[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        "credit_card": r"[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}"}


@query("redact_patterns", ctes("line_text") + "SELECT doc_id, line_no, CASE WHEN " + " OR ".join(f"regexp_matches(text, '{p}')" for p in _RE2.values()) + " THEN repeat('█', length(text)) ELSE text END AS text FROM line_text")
def _(spark, d):
    return view(spark, d, "line_text").select("doc_id", "line_no", redact.redact_spans(F.col("text"), list(redact.PATTERNS.values())).alias("text"))


@query("redaction_report", "SELECT lang, source, count(*) AS documents, " + ", ".join(
    f"CAST(sum({k}) AS BIGINT) AS {k}_lines, count(*) FILTER ({k} > 0) AS {k}_documents" for k in _RE2) + " FROM (SELECT lang, source, " + ", ".join(
    f"len(list_filter(string_split(text, chr(10)), lambda s : regexp_matches(s, '{p}'))) AS {k}" for k, p in _RE2.items()) + " FROM documents) GROUP BY lang, source")
def redaction(spark, d):
    return redact.redaction_report(table(spark, d, "documents"))


@query("area_redact", ctes("words") + """SELECT doc_id, page_no, line_no, word_no, CASE WHEN x0 < 200 AND x1 > 100 AND y0 < 150 + doc_id % 50 AND y1 > 80 AND page_no = doc_id % 3 + 1 THEN repeat('█', length(text)) ELSE text END AS text FROM words""")
def _(spark, d):
    areas = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3 + 1).alias("page_no"), F.lit(100).alias("x0"), F.lit(80).alias("y0"), F.lit(200).alias("x1"), (F.lit(150) + F.col("doc_id") % 50).alias("y1"))
    return redact.area_redact(view(spark, d, "words"), areas).select("doc_id", "page_no", "line_no", "word_no", "text")


def _cands(spark, d):
    li = table(spark, d, "lineitem")
    c = li.select(F.col("l_orderkey").alias("job"), F.floor("l_extendedprice").alias("size"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("ord"),
                  F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("method"), (F.lit(330) - F.col("l_linenumber") * 30).alias("dpi"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.floor(F.col("o_totalprice") / 10).alias("original_size")), c


_CAND = ctes(more="""jobs AS (SELECT o_orderkey AS job, CAST(floor(o_totalprice / 10) AS BIGINT) AS original_size FROM orders),
 c AS (SELECT l_orderkey AS job, CAST(floor(l_extendedprice) AS BIGINT) AS size, l_linenumber * 100000 + l_partkey AS ord, 'm' || l_linenumber AS method, 330 - l_linenumber * 30 AS dpi FROM lineitem),
 b AS (SELECT job, min(size) AS size, arg_min(method, (size, ord)) AS method FROM c GROUP BY job)""")


@query("best_candidate", _CAND + """SELECT job, original_size, compressed_size, method, original_size - compressed_size AS saved_bytes, round_even((1 - compressed_size / original_size) * 100, 1) AS compression_ratio FROM (
 SELECT j.job, original_size, CASE WHEN b.size < original_size THEN b.size ELSE original_size END AS compressed_size, CASE WHEN b.size < original_size THEN b.method ELSE 'original' END AS method FROM jobs j LEFT JOIN b USING (job))""")
def _(spark, d):
    return candidates.best_candidate(*_cands(spark, d))


@query("target_size", _CAND + """SELECT j.job, original_size, original_size <= 20000 OR h.dpi IS NOT NULL AS target_reached, CASE WHEN original_size <= 20000 THEN 300 WHEN h.dpi IS NOT NULL THEN h.dpi WHEN s.dpi IS NOT NULL THEN s.dpi ELSE 30 END AS final_dpi,
 CASE WHEN original_size <= 20000 THEN original_size WHEN h.dpi IS NOT NULL THEN h.size ELSE s.size END AS compressed_size FROM jobs j
 LEFT JOIN (SELECT job, max(dpi) AS dpi, arg_max(size, (dpi, size)) AS size FROM c WHERE size <= 20000 GROUP BY job) h USING (job) LEFT JOIN (SELECT job, min(size) AS size, arg_min(dpi, (size, -dpi)) AS dpi FROM c GROUP BY job) s USING (job)""")
def _(spark, d):
    return candidates.target_size(*_cands(spark, d), 20000)


@query("compression_stats", _CAND + """SELECT method, count(*) AS jobs, CAST(sum(original_size - compressed_size) AS BIGINT) AS saved_bytes FROM (SELECT original_size, CASE WHEN b.size < original_size THEN b.size ELSE original_size END AS compressed_size,
 CASE WHEN b.size < original_size THEN b.method ELSE 'original' END AS method FROM jobs j LEFT JOIN b USING (job)) GROUP BY method""")
def _(spark, d):
    return candidates.best_candidate(*_cands(spark, d)).groupBy("method").agg(F.count(F.lit(1)).alias("jobs"), F.sum("saved_bytes").alias("saved_bytes"))


# Each event is a form field of its user's document.
def _fields(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "checkbox").when(F.col("event_type") == "view", "dropdown").otherwise("text")
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("field_id"), F.concat(F.lit("f"), (F.col("event_id") % 40).cast("string")).alias("name"), kind.alias("field_type"),
                    F.lit("old").alias("value"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("default_value"), (F.col("event_id") % 5 == 0).alias("read_only"),
                    (F.col("event_id") % 3 == 0).alias("required"), F.when(F.col("event_type") == "view", F.array(F.lit("a"))).alias("options"))


def _values(spark, d):
    o = table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 150).alias("doc_id"), F.concat(F.lit("f"), (F.col("o_orderkey") % 60).cast("string")).alias("name"),
                    F.when(F.col("o_orderstatus") == "O", "YES").otherwise(F.col("o_orderstatus")).alias("new_value"), F.col("o_orderkey").alias("ord"))


_FORM = ctes(more="""f AS (SELECT user_id AS doc_id, event_id AS field_id, 'f' || (event_id % 40) AS name, CASE event_type WHEN 'click' THEN 'checkbox' WHEN 'view' THEN 'dropdown' ELSE 'text' END AS field_type, event_type,
 CASE WHEN event_id % 2 = 0 THEN event_type END AS default_value, event_id % 5 = 0 AS read_only, event_id % 3 = 0 AS required FROM events),
 v AS (SELECT o_custkey % 150 AS doc_id, 'f' || (o_orderkey % 60) AS name, arg_max(CASE o_orderstatus WHEN 'O' THEN 'YES' ELSE o_orderstatus END, o_orderkey) AS nv FROM orders GROUP BY ALL)""")


@query("fill_form", _FORM + """SELECT f.doc_id, field_id, nv IS NOT NULL AND NOT read_only AS filled, CASE WHEN nv IS NOT NULL AND NOT read_only THEN CASE WHEN field_type = 'checkbox' THEN CAST(lower(nv) IN ('true','yes','on','1') AS VARCHAR) ELSE nv END ELSE 'old' END AS value
 FROM f LEFT JOIN v ON f.doc_id = v.doc_id AND f.name = v.name""")
def _(spark, d):
    return forms.fill_form(_fields(spark, d), _values(spark, d)).select("doc_id", "field_id", "filled", "value")


@query("filled_count", _FORM + "SELECT f.doc_id, count(*) FILTER (nv IS NOT NULL AND NOT read_only) AS filled_count FROM f LEFT JOIN v ON f.doc_id = v.doc_id AND f.name = v.name GROUP BY f.doc_id")
def _(spark, d):
    return forms.filled_count(forms.fill_form(_fields(spark, d), _values(spark, d)))


@query("form_coerce", "SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') = '1' AS VARCHAR) ELSE json_extract_string(props, '$.k') END AS value FROM events")
def _(spark, d):
    kind = F.when(F.col("event_type") == "click", "checkbox").otherwise("text")
    return table(spark, d, "events").select("event_id", forms.coerce(kind, F.get_json_object("props", "$.k")).alias("value"))


@query("reset_form", _FORM + "SELECT doc_id, field_id, coalesce(default_value, '') AS value FROM f")
def _(spark, d):
    return forms.reset_form(_fields(spark, d)).select("doc_id", "field_id", "value")


@query("form_summary", _FORM + "SELECT doc_id, count(*) AS field_count, true AS has_form, count(*) FILTER (required) AS required_fields, count(*) FILTER (read_only) AS read_only_fields, count(*) FILTER (event_type = 'view') AS choice_fields FROM f GROUP BY doc_id")
def _(spark, d):
    return forms.form_summary(_fields(spark, d))


@query("edit_ops_parse", """SELECT event_id AS request_id, n AS op_no, CASE n WHEN 0 THEN 'text' WHEN 1 THEN 'line' ELSE 'highlight' END AS type, CASE WHEN n = 0 THEN k BETWEEN 6 AND 144 WHEN n = 1 THEN event_type <> 'error' ELSE true END AS valid,
 CASE n WHEN 2 THEN 0.5 ELSE 1.0 END AS opacity FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, unnest([0, 1, 2]) AS n FROM events)""")
def _(spark, d):
    k = F.get_json_object("props", "$.k")
    x2 = F.when(F.col("event_type") == "error", "").otherwise(',"x2":9.5')
    ops = F.concat(F.lit('[{"type":"text","text":"a","page":1,"x":1,"y":2,"font_size":'), k, F.lit('},{"type":"line","page":2,"x1":0,"y1":0,"y2":4'), x2,
                   F.lit('},{"type":"highlight","page":1,"x":1,"y":1,"width":5,"height":5}]'))
    r = table(spark, d, "events").select(F.col("event_id").alias("request_id"), ops.alias("operations"))
    return forms.edit_operations(r).select("request_id", "op_no", "type", "valid", "opacity")


def _posts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"), F.col("p_brand").alias("description"), F.col("p_type").alias("category"),
                                          F.split("p_name", " ").alias("keywords"), F.col("p_type").alias("keywords_text"), (F.col("p_size") > 40).alias("featured"))


@query("blog_filter", "SELECT p_partkey AS pos, p_name AS title FROM part WHERE lower(p_type) = 'economy' AND (contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red'))")
def _(spark, d):
    return catalogue.post_filter(_posts(spark, d), "Economy", "RED").select("pos", "title")


@query("featured", "SELECT p_partkey AS pos, p_name AS title FROM part WHERE p_size > 40")
def _(spark, d):
    return _posts(spark, d).filter("featured").select("pos", "title")


@query("popular", "SELECT p_partkey AS pos, p_name AS title FROM part WHERE p_size > 40 AND p_type = 'SMALL' ORDER BY p_partkey")
def _(spark, d):
    return _posts(spark, d).filter("featured AND category = 'SMALL'").orderBy("pos").select("pos", "title")


@query("ranked_search", """SELECT p_partkey AS pos, p_name AS title, CASE WHEN starts_with(lower(p_name), 'red') THEN 3 WHEN contains(lower(p_name), 'red') THEN 2 ELSE 1 END +
 CASE WHEN starts_with(lower(p_name), 'brand#1') THEN 3 WHEN contains(lower(p_name), 'brand#1') THEN 2 ELSE 1 END AS score FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'red') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1')""")
def _(spark, d):
    return catalogue.ranked_search(_posts(spark, d), "red Brand#1").select("pos", "title", "score")


@query("categories", "SELECT p_type AS category, min(p_partkey) AS first_pos FROM part GROUP BY p_type")
def _(spark, d):
    return catalogue.categories(_posts(spark, d))
