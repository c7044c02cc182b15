"""Catalogue: sources, sinks and streams over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import archives, layout, retention
from foliospark.plans.fixtures import NOW, VIEWS, ctes, now, table, view
from foliospark.plans import operations, screening  # noqa: F401  (their SQL is reused below)
from foliospark.plans.registry import ORACLES, query
from foliospark.sources import scans, sinks
from foliospark.sources.scratch import shared_dir
from foliospark.streaming import jobs as streams

TS = f"TIMESTAMP '{NOW}'"


def event_stream(spark, sf_dir, exprs):
    """The event table as a file stream, under the expressions of a view."""
    schema = table(spark, sf_dir, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    return s.selectExpr(*exprs)


@query("file_inventory")
def _(spark, d):
    """The tables of the folder, in both modes; no SQL, since a query doesn't know its folder there."""
    name = F.regexp_extract("path", "([^/]*)$", 1).alias("name")
    below = scans.file_inventory(spark, d, "*.parquet").select(name, "length", "modificationTime")
    own = scans.file_inventory(spark, d, "*.parquet", recursive=False, links=True).select(name, F.lit(True).alias("top"))
    return below.join(own, "name", "left").withColumn("top", F.coalesce("top", F.lit(False)))


@query("json_log_scan", """SELECT event_type AS level, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS duration_ms, count(*) FILTER (event_type = 'error') AS with_exception FROM events GROUP BY event_type""")
def _(spark, d):
    log = table(spark, d, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("level"), F.lit("app").alias("logger"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"),
                                           F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", "Traceback").alias("exception"))
    path = shared_dir(spark, "logs")
    log.write.json(path)
    s = scans.json_log_scan(spark, path)
    return s.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("duration_ms").cast("decimal(18,4)")).cast("double").alias("duration_ms"), F.count("exception").alias("with_exception"))


@query("progress_events", ctes("status_log") + "SELECT status, count(*) AS n, CAST(sum(progress) AS BIGINT) AS progress FROM status_log GROUP BY status")
def _(spark, d):
    path = shared_dir(spark, "progress")
    view(spark, d, "status_log").select(F.col("task_id").cast("string").alias("task_id"), "progress", "status", F.col("ts").alias("timestamp")).write.json(path)
    return scans.progress_events(spark, path).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("progress").alias("progress"))


@query("progress_stream", ctes("status_log") + "SELECT CAST(task_id AS VARCHAR) AS task_id, status, count(*) AS n, CAST(sum(progress) AS BIGINT) AS progress FROM status_log GROUP BY ALL")
def _(spark, d):
    """Progress messages as a live source: what is published to the folder is read as a stream and drained."""
    path = shared_dir(spark, "progress")
    view(spark, d, "status_log").select(F.col("task_id").cast("string").alias("task_id"), "progress", "status", F.col("ts").alias("timestamp")).write.json(path)
    t = streams.run_to_table(spark, scans.progress_events(spark, path, stream=True), "progress-stream")
    return t.groupBy("task_id", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("progress").alias("progress"))


@query("object_store_io", "SELECT o_orderkey, o_totalprice, true AS stored, false AS after_delete FROM orders")
def _(spark, d):
    """Put and get a table; of a second object, whether it is there before and after it is deleted."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    spare = shared_dir(spark, "object")
    scans.store_roundtrip(spark, rows, spare)
    stored = scans.object_exists(spark, spare) and scans.delete_object(spark, spare)
    return scans.store_roundtrip(spark, rows, shared_dir(spark, "object")).withColumns({"stored": F.lit(stored), "after_delete": F.lit(scans.object_exists(spark, spare))})


def _hocr_pages(spark, d):
    """Word grids rendered as hOCR, one text per page."""
    w = view(spark, d, "words")
    bbox = lambda *c: F.concat_ws(" ", F.lit("bbox"), *[F.col(x).cast("int").cast("string") for x in c])
    word = F.concat(F.lit("<span class='ocrx_word' title='"), bbox("x0", "y0", "x1", "y1"), F.lit("; x_wconf "), F.col("conf").cast("int").cast("string"), F.lit("; x_fsize "),
                    F.col("fsize").cast("int").cast("string"), F.lit("'>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</span>"))
    line = w.groupBy("doc_id", "page_no", "par", "line_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
                                                                F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", word.alias("h")))), lambda v: v["h"]), "\n").alias("h"))
    span = F.concat(F.lit("<span class='ocr_line' title='"), bbox("x0", "y0", "x1", "y1"), F.lit("; baseline 0 -3'>"), "h", F.lit("</span>"))
    par = line.groupBy("doc_id", "page_no", "par").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", span.alias("h")))), lambda v: v["h"]), "\n").alias("h"))
    p = F.concat(F.lit("<p class='ocr_par'>"), "h", F.lit("</p>"))
    page = par.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("par", p.alias("h")))), lambda v: v["h"]), "\n").alias("h"))
    return page.select("doc_id", "page_no", F.concat(F.lit("<div class='ocr_carea' id='b'>"), "h", F.lit("</div>")).alias("hocr"))


_NOISE = "NOT (conf < 25 AND length(text) <= 2 AND NOT regexp_matches(text, '^[0-9]+$'))"


@query("hocr_scan", ctes("words") + f"SELECT doc_id, page_no, par % 8 + 1 AS par, min(line_no) % 5 + 1 AS line_in_par, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(y1) - 3 AS base, count(*) AS n_words FROM words WHERE {_NOISE} GROUP BY doc_id, page_no, par, line_no")
def _(spark, d):
    lines = scans.hocr_lines(scans.hocr_scan(_hocr_pages(spark, d)))
    return lines.select("doc_id", "page_no", F.col("par").cast("long").alias("par"), F.col("line_in_par").cast("long").alias("line_in_par"), "x0", "y0", "x1", "y1", "base", "n_words")


@query("ocr_tsv_lines", ctes("words") + """SELECT doc_id, page_no, line_no, string_agg(text, ' ' ORDER BY x0, word_no) AS text, round(min(x0) * 0.36, 6) AS x, round((max(x1) - min(x0)) * 0.36, 6) AS width, round(greatest(8, least(avg(y1 - y0) * 0.36 * 0.75, 24)), 6) AS font_size FROM words WHERE conf > 30 GROUP BY ALL""")
def _(spark, d):
    w = view(spark, d, "words").select("doc_id", "page_no", F.lit(1).alias("block"), "line_no", "word_no", "text", "conf", F.col("x0").alias("left"), F.col("y0").alias("top"),
                                       (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))
    return layout.ocr_tsv_lines(w, 200.0).select("doc_id", "page_no", "line_no", "text", *[F.round(c, 6).alias(c) for c in ("x", "width", "font_size")])


@query("extracted_text_sink", ctes("page_text") + "SELECT doc_id, page_no, CASE WHEN page_no > 1 THEN chr(10) || chr(10) ELSE '' END || '--- Page ' || page_no || ' ---' || chr(10) || text AS piece FROM page_text")
def _(spark, d):
    return sinks.extracted_text(view(spark, d, "page_text"))


@query("zip_names", ctes("stored_names").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """, e AS (SELECT job, file_no AS pos, arcname, regexp_replace(arcname, '[.]pdf$', '') AS stem, row_number() OVER (PARTITION BY job ORDER BY file_no) AS k FROM stored_names),
 r AS (SELECT job, pos, arcname, k, arcname AS name, [arcname] AS used FROM e WHERE k = 1 UNION ALL SELECT job, pos, arcname, k, name, list_append(used, name) FROM (SELECT e.*, r.used, CASE WHEN list_contains(r.used, e.arcname)
   THEN list_filter(list_transform(range(2, len(r.used) + 3), lambda n: e.stem || '_' || n || '.pdf'), lambda c: NOT list_contains(r.used, c))[1] ELSE e.arcname END AS name FROM r JOIN e ON e.job = r.job AND e.k = r.k + 1))
 SELECT job, pos, arcname, name FROM r""")
def _(spark, d):
    e = view(spark, d, "stored_names").select("job", F.col("file_no").alias("pos"), "arcname")
    return archives.zip_names(e)


@query("zip_names_simple", "SELECT o_custkey AS job, o_orderkey AS pos, CASE n WHEN 1 THEN 'doc.pdf' ELSE 'doc_' || n || '.pdf' END AS name FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)")
def _(spark, d):
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("pos"), F.lit("doc.pdf").alias("arcname"))
    return archives.zip_names(e, 1000).select("job", "pos", "name")


@query("usage_stream", ctes("usage_log") + """SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS files_processed, CAST(sum(file_size) AS BIGINT) AS bytes_processed, count(*) FILTER (starts_with(tool_type, 'pdf')) AS pdf_operations,
 count(*) FILTER (starts_with(tool_type, 'image')) AS image_operations, count(*) FILTER (starts_with(tool_type, 'document')) AS document_operations FROM usage_log GROUP BY ALL""")
def _(spark, d):
    s = streams.usage_stream(event_stream(spark, d, VIEWS["usage_log"][1]).withColumn("ts", F.col("ts").cast("timestamp")))
    return streams.run_updates(spark, s, ["user_id", "day"], "usage-stream")


@query("audit_stream", ctes("audit") + "SELECT CAST(created_at AS DATE) AS day, event_type, count(*) AS n FROM audit GROUP BY ALL")
def _(spark, d):
    t = streams.run_to_table(spark, streams.audit_stream(event_stream(spark, d, VIEWS["audit"][1])), "audit-stream", "day")
    return t.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("download_counter", "SELECT user_id AS file_id, count(*) AS download_count FROM events WHERE event_type <> 'error' GROUP BY user_id")
def _(spark, d):
    s = event_stream(spark, d, ["user_id AS file_id", "CASE WHEN event_type = 'error' THEN 'HEAD' ELSE 'GET' END AS method"])
    return streams.run_updates(spark, streams.download_counter(s), ["file_id"], "download-stream")


@query("fixed_limiter", ctes("requests") + """SELECT *, CASE WHEN in_second > 10 THEN 'burst' WHEN in_minute > 60 THEN 'minute' WHEN in_hour > 1000 THEN 'hour' END AS limit_type FROM (SELECT seq, client, count(*) OVER (PARTITION BY client, sec ORDER BY seq) AS in_second, count(*) OVER (PARTITION BY client, sec // 60 ORDER BY sec, seq) AS in_minute,
 count(*) OVER (PARTITION BY client, sec // 3600 ORDER BY sec, seq) AS in_hour FROM requests)""")
def _(spark, d):
    streams.use_state_store(spark)
    r = event_stream(spark, d, VIEWS["requests"][1]).select("client", "sec", "seq")
    return streams.run_to_table(spark, streams.fixed_limiter(r), "fixed-limiter").select("seq", "client", "in_second", "in_minute", "in_hour", "limit_type")


@query("sliding_limiter_stream", ORACLES["sliding_limiter"])
def _(spark, d):
    streams.use_state_store(spark)
    r = event_stream(spark, d, VIEWS["requests"][1]).select("client", F.col("sec").cast("double").alias("t"), "seq")
    return streams.run_to_table(spark, streams.sliding_limiter(r), "sliding-limiter").select("seq", "client", "allowed", "limit_type", "retry_after")


@query("endpoint_limiter_stream", ORACLES["endpoint_limiter"])
def _(spark, d):
    streams.use_state_store(spark)
    r = event_stream(spark, d, VIEWS["requests"][1]).select("client", "path", F.col("sec").cast("double").alias("t"), "seq")
    return streams.run_to_table(spark, streams.endpoint_limiter(r), "endpoint-limiter").select("seq", "client", "allowed", "limit_type", "retry_after")


@query("latest_progress", ctes("status_log") + """SELECT task_id, seq, status FROM (SELECT *, lag(status) OVER (PARTITION BY task_id ORDER BY ts, seq) AS p FROM status_log) WHERE p IS NULL OR p <> status""")
def _(spark, d):
    streams.use_state_store(spark)
    s = event_stream(spark, d, VIEWS["status_log"][1]).select("task_id", "seq", "ts", "status")
    return streams.run_to_table(spark, streams.latest_progress(s), "progress-stream").filter("seq >= 0").select("task_id", "seq", "status")


@query("stalled_tasks", ctes("status_log", more="f AS (SELECT task_id, min(ts) AS f FROM status_log GROUP BY task_id)") + "SELECT task_id, date_trunc('milliseconds', f) + INTERVAL 10 MINUTE AS failed_at FROM f WHERE NOT EXISTS (SELECT 1 FROM status_log s WHERE s.task_id = f.task_id AND s.status IN ('completed', 'failed', 'cancelled') AND date_trunc('milliseconds', s.ts) <= date_trunc('milliseconds', f) + INTERVAL 10 MINUTE)")
def _(spark, d):
    streams.use_state_store(spark)
    s = event_stream(spark, d, VIEWS["status_log"][1]).select("task_id", "seq", "ts", "status")
    return streams.run_to_table(spark, streams.latest_progress(s), "stalled-stream").filter("seq = -1").select("task_id", F.col("ts").cast("timestamp_ntz").alias("failed_at"))


@query("expiry_timer", """WITH f AS (SELECT user_id AS task_id, date_trunc('milliseconds', min(ts)) AS f FROM events WHERE event_type <> 'error' GROUP BY user_id)
 SELECT task_id, 'expiry' AS what, f + INTERVAL 120 SECOND AS ts FROM f UNION ALL SELECT task_id, 'purge', f + INTERVAL 121 SECOND FROM f""")
def _(spark, d):
    streams.use_state_store(spark)
    s = event_stream(spark, d, ["user_id AS task_id", "event_id AS seq", "ts", "ts + INTERVAL 1 HOUR AS expires_at", "CASE WHEN event_type = 'error' THEN 'HEAD' ELSE 'GET' END AS method"])
    return streams.run_to_table(spark, streams.expiry_timer(s), "expiry-stream").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("subscription_stream", f"SELECT sub_id, status, tier, plan, applied FROM ({ORACLES['subscription_fold']})")
def _(spark, d):
    streams.use_state_store(spark)
    k = "CAST(get_json_object(props, '$.k') AS BIGINT) % 4"
    s = event_stream(spark, d, ["user_id AS sub_id", "ts", "event_id AS seq", "CASE event_type WHEN 'purchase' THEN 'checkout' WHEN 'signup' THEN 'updated' WHEN 'error' THEN 'payment_failed' WHEN 'view' THEN 'deleted' END AS kind",
                                f"CASE {k} WHEN 0 THEN 'active' WHEN 1 THEN 'past_due' WHEN 2 THEN 'unpaid' ELSE 'trialing' END AS provider_status", "CASE WHEN value > 10 THEN 'pro' ELSE 'business' END AS plan"])
    rows = streams.run_to_table(spark, streams.subscription_fold(s.filter("kind IS NOT NULL")), "subscription-stream")
    return rows.groupBy("sub_id").agg(*[F.max_by(c, "applied").alias(c) for c in ("status", "tier", "plan")], F.max("applied").alias("applied"))


# The logs lie in another year than the clock: they are moved so that the limits of both sweeps fall into them.
_MOVED = "INTERVAL {} DAY"
_GONE = f"""gone AS (SELECT task_id FROM outputs WHERE expires_at < {TS} UNION SELECT task_id FROM tasks WHERE status = 'completed' AND completed_at < {TS} - INTERVAL 7 MINUTE
 UNION SELECT task_id FROM tasks WHERE created_at < {TS} - INTERVAL 24 HOUR AND task_id NOT IN (SELECT task_id FROM outputs))"""


def _left(item: str, source: str, extra: str = "") -> str:
    return f"SELECT '{item}' AS item, count(*) AS n FROM {source} WHERE task_id NOT IN (SELECT task_id FROM gone){extra}"


@query("retention_sweep", ctes("tasks", "outputs", "inputs", more=_GONE) + " UNION ALL ".join([
    _left("tasks", "tasks"), _left("inputs", "inputs"), _left("outputs", "outputs"), _left("uploads", "inputs", f" AND NOT created_at < {TS} - INTERVAL 1 HOUR"),
    _left("results", "outputs", f" AND (line_no = 1 OR NOT expires_at - INTERVAL 2 MINUTE < {TS} - INTERVAL 60 MINUTE)"),
    f"SELECT 'usage', count(*) FROM events WHERE NOT ts - {_MOVED.format(8504)} < {TS} - INTERVAL 90 DAY",
    f"SELECT 'audit', count(*) FROM events WHERE NOT ts - {_MOVED.format(8779)} < {TS} - INTERVAL 365 DAY"]))
def _(spark, d):
    tasks, outputs, inputs, events = (view(spark, d, v) for v in ("tasks", "outputs", "inputs", "events"))
    results = outputs.select("task_id", (F.col("expires_at") - F.expr("INTERVAL 2 MINUTE")).alias("modified"), (F.col("line_no") == 1).alias("is_link"))
    moved = {name: events.select((F.col("ts") - F.expr(_MOVED.format(days))).alias("created_at")) for name, days in (("usage", 8504), ("audit", 8779))}
    tables = {"tasks": tasks, "inputs": inputs, "outputs": outputs, "uploads": inputs.select("task_id", F.col("created_at").alias("modified")), "results": results, **moved}
    return retention.counts(retention.sweep(tables, now()))
