"""Catalogue: tasks, retention, quotas, routing, subscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import jobs, retention
from foliospark.plans.fixtures import NOW, ctes, now, table, view
from foliospark.plans.registry import query

TS = f"TIMESTAMP '{NOW}'"
ECLOCK = "TIMESTAMP_NTZ '2024-01-31 00:00:00'"
DCLOCK = "TIMESTAMP '2024-01-31 00:00:00'"


@query("scan_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query("audit_filter", ctes("audit") + "SELECT id, event_type, client_ip, created_at FROM audit WHERE event_type = 'download' AND client_ip = md5('7')")
def _(spark, d):
    a = view(spark, d, "audit")
    client = spark.sql("SELECT md5('7') AS h").first()["h"]
    return jobs.audit_filter(a, client, "download").select("id", "event_type", "client_ip", "created_at")


@query("task_filter", ctes("tasks") + "SELECT task_id, status, tool_type, created_at, completed_at FROM tasks WHERE status = 'completed' AND tool_type = 'pdf_ocr'")
def _(spark, d):
    return jobs.task_filter(view(spark, d, "tasks"), "completed", "pdf_ocr")


@query("audit_page", ctes("audit") + "SELECT id, event_type, created_at FROM audit ORDER BY created_at DESC, id LIMIT 100 OFFSET 200")
def _(spark, d):
    return jobs.page_of(view(spark, d, "audit"), "created_at", "id", 100, 200).select("id", "event_type", "created_at")


@query("task_page", ctes("tasks") + "SELECT task_id, status, tool_type, created_at, completed_at FROM tasks WHERE status = 'queued' ORDER BY created_at DESC, task_id LIMIT 20 OFFSET 40")
def _(spark, d):
    return jobs.page_of(jobs.task_filter(view(spark, d, "tasks"), "queued"), "created_at", "task_id", 20, 40, 100)


@query("expired_outputs", ctes("outputs") + f"SELECT count(*) AS expired FROM outputs WHERE expires_at < {TS}")
def _(spark, d):
    out = view(spark, d, "outputs")
    return out.filter(retention.is_expired(F.col("expires_at"), now())).agg(F.count(F.lit(1)).alias("expired"))


@query("downloadable", ctes("outputs") + f"SELECT file_id, file_path, expires_at FROM outputs WHERE expires_at + INTERVAL 15 SECOND >= {TS} "
       r"AND regexp_matches(file_id, '^[a-zA-Z0-9_]+$') AND regexp_matches(lower(regexp_extract(file_path, '([^/]*)$', 1)), '^[a-f0-9]+_[0-9]+\.[0-9a-z_]+$')")
def _(spark, d):
    out = view(spark, d, "outputs")
    name = F.regexp_extract("file_path", r"([^/]*)$", 1)
    ok = retention.is_downloadable(F.col("file_id"), name, F.col("expires_at"), now())
    return out.filter(ok).select("file_id", "file_path", "expires_at")


@query("completed_before", ctes("tasks") + f"SELECT task_id, completed_at FROM tasks WHERE status = 'completed' AND completed_at < {TS} - INTERVAL 7 MINUTE")
def _(spark, d):
    return retention.completed_before(view(spark, d, "tasks"), now()).select("task_id", "completed_at")


@query("aged_rows", ctes("inputs", "outputs", "tasks", "audit") + f"""
SELECT 'usage_stats' AS item, count(*) AS n FROM tasks WHERE created_at < {TS} - INTERVAL 90 DAY UNION ALL
SELECT 'audit_logs', count(*) FROM tasks WHERE created_at < {TS} - INTERVAL 365 DAY UNION ALL
SELECT 'upload_files', count(*) FROM inputs WHERE created_at < {TS} - INTERVAL 1 HOUR UNION ALL
SELECT 'processed_files', count(*) FROM outputs WHERE expires_at < {TS} - INTERVAL 60 MINUTE""")
def _(spark, d):
    tasks, t = view(spark, d, "tasks"), now()
    return retention.counts({
        "usage_stats": retention.aged(tasks, "created_at", t, "DAY", retention.USAGE_DAYS),
        "audit_logs": retention.aged(tasks, "created_at", t, "DAY", retention.AUDIT_DAYS),
        "upload_files": retention.aged(view(spark, d, "inputs"), "created_at", t, "HOUR", retention.UPLOAD_HOURS),
        "processed_files": retention.aged(view(spark, d, "outputs"), "expires_at", t, "MINUTE", retention.processed_age_minutes()),
    })


@query("retention_survivors", ctes("outputs") + f"SELECT file_id, task_id, expires_at FROM outputs WHERE NOT (expires_at < {TS})")
def _(spark, d):
    out = view(spark, d, "outputs")
    return retention.survivors(out, F.col("expires_at") < now()).select("file_id", "task_id", "expires_at")


_PURGE = """SELECT 'tasks_deleted' AS item, {t} AS n UNION ALL SELECT 'input_files_deleted', {i} UNION ALL
SELECT 'output_files_deleted', {o} UNION ALL SELECT 'audit_logs_deleted', (SELECT count(*) FROM audit {w})"""


@query("purge_client", ctes("audit") + _PURGE.format(t=0, i=0, o=0, w="WHERE client_ip = md5('11')"))
def _(spark, d):
    client = spark.sql("SELECT md5('11') AS h").first()["h"]
    return retention.purge_client(view(spark, d, "audit"), view(spark, d, "tasks"), view(spark, d, "inputs"),
                                  view(spark, d, "outputs"), client)


@query("purge_everything", ctes("audit", "tasks", "inputs", "outputs") + _PURGE.format(
    t="(SELECT count(*) FROM tasks)", i="(SELECT count(*) FROM inputs)", o="(SELECT count(*) FROM outputs)", w=""))
def _(spark, d):
    return retention.purge_client(view(spark, d, "audit"), view(spark, d, "tasks"), view(spark, d, "inputs"), view(spark, d, "outputs"))


@query("subscription_active", ctes() + f"""SELECT o_orderkey AS sub_id,
 coalesce(CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'past_due' ELSE 'active' END = 'active', false)
 AND (o_orderstatus = 'P' OR o_orderdate >= {TS}) AS active FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "past_due").otherwise("active")
    end = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return o.select(F.col("o_orderkey").alias("sub_id"), jobs.subscription_active(status, end, now()).alias("active"))


@query("cancellable", ctes("tasks") + """SELECT task_id, status IN ('pending', 'queued') AS ok,
 CASE WHEN status IN ('pending', 'queued') THEN 'cancelled' ELSE status END AS new_status,
 CASE WHEN status IN ('pending', 'queued') THEN 'Task cancelled by user' ELSE 'Cannot cancel task in ''' || status ||
 ''' status. Only pending/queued tasks can be cancelled.' END AS message FROM tasks""")
def _(spark, d):
    ok, status, message = jobs.cancel_result(F.col("status"))
    return view(spark, d, "tasks").select("task_id", ok.alias("ok"), status.alias("new_status"), message.alias("message"))


@query("needs_async", ctes("inputs") + "SELECT task_id, CAST(sum(file_size) AS BIGINT) AS total_size, sum(file_size) > 5242880 AS use_async FROM inputs GROUP BY task_id")
def _(spark, d):
    return jobs.needs_async(view(spark, d, "inputs"))


@query("task_outputs", ctes("tasks", "outputs") + """SELECT t.task_id, t.status, t.tool_type, o.file_id,
 CASE WHEN t.status IN ('pending','processing','completed','failed') THEN t.status ELSE 'pending' END AS shown_status,
 CASE WHEN t.status = 'completed' AND o.file_id IS NOT NULL THEN '/api/v1/download/' || o.file_id END AS download_url,
 CASE WHEN t.status = 'completed' THEN o.file_size END AS file_size,
 CASE WHEN t.status = 'completed' THEN 100 ELSE 0 END AS progress,
 CASE WHEN t.status = 'failed' THEN coalesce(t.error_message, 'Unknown error') END AS error
 FROM tasks t LEFT JOIN outputs o ON t.task_id = o.task_id""")
def _(spark, d):
    return jobs.status_rows(view(spark, d, "tasks"), view(spark, d, "outputs"))


@query("orphan_tasks", ctes("tasks", "outputs") + f"SELECT t.task_id, t.created_at FROM tasks t LEFT JOIN outputs o ON t.task_id = o.task_id WHERE o.task_id IS NULL AND t.created_at < {TS} - INTERVAL 24 HOUR")
def _(spark, d):
    return retention.orphan_tasks(view(spark, d, "tasks"), view(spark, d, "outputs"), now()).select("task_id", "created_at")


_EXPIRED = f"expired AS (SELECT DISTINCT task_id FROM outputs WHERE expires_at < {TS})"


@query("purge_cascade", ctes("tasks", "inputs", "outputs", more=_EXPIRED) + """
SELECT task_id, 'task' AS kind, CAST(task_id AS VARCHAR) AS item FROM tasks WHERE task_id IN (FROM expired) UNION ALL
SELECT task_id, 'input', stored_name FROM inputs WHERE task_id IN (FROM expired) UNION ALL
SELECT task_id, 'input', stored_name FROM (SELECT DISTINCT e.task_id, stored_name FROM inputs i JOIN expired e ON regexp_extract(i.stored_name, '^(.*?)_', 1) = CAST(e.task_id AS VARCHAR)
 WHERE NOT EXISTS (SELECT 1 FROM inputs o WHERE o.task_id = e.task_id AND o.stored_name = i.stored_name)) UNION ALL
SELECT task_id, 'output', file_id FROM outputs WHERE task_id IN (FROM expired)""")
def _(spark, d):
    out = view(spark, d, "outputs")
    return retention.purge_cascade(view(spark, d, "tasks"), view(spark, d, "inputs"), out,
                                   retention.expired_task_ids(out, now()))


@query("input_path_union", ctes("inputs") + "SELECT DISTINCT CAST(task_id AS VARCHAR) AS task_id, stored_name FROM inputs")
def _(spark, d):
    rows = view(spark, d, "inputs")
    return retention.input_paths(rows, rows.select("stored_name"))


@query("purge_union", ctes("tasks", "inputs", "outputs", more=_EXPIRED) + """
SELECT 'input' AS kind, count(*) AS n FROM inputs WHERE task_id IN (FROM expired) UNION ALL
SELECT 'output', count(*) FROM outputs WHERE task_id IN (FROM expired) UNION ALL
SELECT 'task', count(*) FROM tasks WHERE task_id IN (FROM expired)""")
def _(spark, d):
    out = view(spark, d, "outputs")
    gone = retention.purge_cascade(view(spark, d, "tasks"), view(spark, d, "inputs"), out,
                                   retention.expired_task_ids(out, now()))
    return gone.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("cleanup_report", ctes("tasks", "inputs", "outputs", "audit") + f"""SELECT
 (SELECT count(*) FROM outputs WHERE expires_at < {TS}) AS expired_files,
 (SELECT count(*) FROM tasks t WHERE created_at < {TS} - INTERVAL 24 HOUR AND NOT EXISTS (SELECT 1 FROM outputs o WHERE o.task_id = t.task_id)) AS orphaned_tasks,
 (SELECT count(*) FROM tasks WHERE status = 'completed' AND completed_at < {TS} - INTERVAL 7 MINUTE) AS completed_tasks,
 (SELECT count(*) FROM inputs WHERE created_at < {TS} - INTERVAL 1 HOUR) AS upload_files,
 (SELECT count(*) FROM tasks WHERE created_at < {TS} - INTERVAL 90 DAY) AS usage_stats,
 (SELECT count(*) FROM audit WHERE created_at < {TS} - INTERVAL 365 DAY) AS audit_logs""")
def _(spark, d):
    tasks, inputs, outputs, t = view(spark, d, "tasks"), view(spark, d, "inputs"), view(spark, d, "outputs"), now()
    return retention.one_row_report({
        "expired_files": outputs.filter(retention.is_expired(F.col("expires_at"), t)),
        "orphaned_tasks": retention.orphan_tasks(tasks, outputs, t),
        "completed_tasks": retention.completed_before(tasks, t),
        "upload_files": retention.aged(inputs, "created_at", t, "HOUR", retention.UPLOAD_HOURS),
        "usage_stats": retention.aged(tasks, "created_at", t, "DAY", retention.USAGE_DAYS),
        "audit_logs": retention.aged(view(spark, d, "audit"), "created_at", t, "DAY", retention.AUDIT_DAYS),
    })


@query("grace_expiry", ctes("outputs") + f"SELECT file_id, least(expires_at, {TS} + to_seconds(greatest(0, line_no * 60 - 120))) AS new_expiry FROM outputs")
def _(spark, d):
    e = retention.grace_expiry(now(), F.col("expires_at"), F.col("line_no") * 60 - 120)
    return view(spark, d, "outputs").select("file_id", e.alias("new_expiry"))


@query("expires_at", ctes("tasks") + "SELECT task_id, created_at + INTERVAL 2 MINUTE AS expires_at FROM tasks")
def _(spark, d):
    return view(spark, d, "tasks").select("task_id", retention.expires_at(F.col("created_at")).alias("expires_at"))


_TIER_SQL = """limits(limit_tier, daily_file_limit, max_file_size, queue_priority) AS (VALUES
 ('anonymous', 3, 5242880, 'low'), ('free', 5, 10485760, 'normal'), ('pro', -1, 104857600, 'high'), ('business', -1, 524288000, 'critical')),
 people AS (SELECT c_custkey AS user_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'Free' WHEN 'MACHINERY' THEN 'pro' WHEN 'HOUSEHOLD' THEN 'business' WHEN 'FURNITURE' THEN 'gold' END AS tier FROM customer)"""


def _people(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.expr(
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'Free' WHEN 'MACHINERY' THEN 'pro' WHEN 'HOUSEHOLD' THEN 'business' WHEN 'FURNITURE' THEN 'gold' END").alias("tier"))


@query("tier_limits", ctes(more=_TIER_SQL) + """SELECT p.user_id, p.tier, l.daily_file_limit, l.max_file_size, l.queue_priority FROM people p
 JOIN limits l ON l.limit_tier = CASE WHEN lower(p.tier) IN ('free','pro','business') THEN lower(p.tier) ELSE 'anonymous' END""")
def _(spark, d):
    return jobs.with_tier_limits(_people(spark, d), jobs.tier_table(spark)).select(
        "user_id", "tier", "daily_file_limit", F.col("max_file_size").cast("int").alias("max_file_size"), "queue_priority")


@query("quota_check", ctes("usage_log", more=_TIER_SQL + """, used AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS files, max(file_size) AS biggest FROM usage_log GROUP BY ALL)""") + """
 SELECT u.user_id, u.day, u.files, u.biggest, CASE WHEN l.daily_file_limit <> -1 AND u.files >= l.daily_file_limit THEN 'Daily file limit exceeded'
 WHEN u.biggest > l.max_file_size THEN 'File size exceeds limit' ELSE 'ok' END AS decision FROM used u LEFT JOIN people p ON u.user_id = p.user_id
 JOIN limits l ON l.limit_tier = CASE WHEN lower(p.tier) IN ('free','pro','business') THEN lower(p.tier) ELSE 'anonymous' END""")
def _(spark, d):
    used = view(spark, d, "usage_log").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("files"), F.max("file_size").alias("biggest"))
    who = jobs.with_tier_limits(used.join(_people(spark, d), "user_id", "left"), jobs.tier_table(spark))
    return who.select("user_id", "day", "files", "biggest", jobs.quota_decision(
        F.col("files"), F.col("daily_file_limit"), F.col("biggest"), F.col("max_file_size")).alias("decision"))


@query("daily_usage", ctes("usage_log") + """SELECT user_id AS key, CAST(ts AS DATE) AS day, count(*) AS files_processed, CAST(sum(file_size) AS BIGINT) AS bytes_processed,
 count(*) FILTER (starts_with(tool_type, 'pdf')) AS pdf_operations, count(*) FILTER (starts_with(tool_type, 'image')) AS image_operations,
 count(*) FILTER (starts_with(tool_type, 'document')) AS document_operations FROM usage_log GROUP BY ALL""")
def _(spark, d):
    return jobs.daily_usage(view(spark, d, "usage_log").withColumnRenamed("user_id", "key"))


@query("anonymous_usage", ctes("usage_log") + """SELECT substr(sha256('10.0.0.' || CAST(user_id AS VARCHAR)), 1, 16) AS key, CAST(ts AS DATE) AS day, count(*) AS files_processed,
 CAST(sum(file_size) AS BIGINT) AS bytes_processed FROM usage_log GROUP BY ALL""")
def _(spark, d):
    key = F.substring(F.sha2(F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")), 256), 1, 16)
    return jobs.daily_usage(view(spark, d, "usage_log").withColumn("key", key), by_tool=False)


_QUEUE = """CASE WHEN tool_type IN ('pdf_merge','pdf_compress','pdf_ocr','pdf_to_word','pdf_compare') THEN 'pdf-heavy'
 WHEN tool_type IN ('pdf_split','pdf_rotate','pdf_watermark','pdf_page_numbers','pdf_protect','pdf_unlock') THEN 'pdf-light'
 WHEN starts_with(tool_type, 'image_') THEN 'image' WHEN starts_with(tool_type, 'document_') THEN 'document' ELSE 'default' END"""
_PRIO = "CASE tool_type WHEN 'pdf_split' THEN 8 WHEN 'pdf_merge' THEN 5 WHEN 'image_resize' THEN 5 WHEN 'pdf_ocr' THEN 1 WHEN 'document_convert' THEN 2 ELSE 5 END"


@query("queue_route", ctes("tasks") + f"SELECT {_QUEUE} AS queue, tool_type, count(*) AS n FROM tasks GROUP BY ALL")
def _(spark, d):
    return view(spark, d, "tasks").groupBy(jobs.queue_of(F.col("tool_type")).alias("queue"), "tool_type").agg(F.count(F.lit(1)).alias("n"))


@query("queue_order", ctes("tasks") + f"SELECT task_id, tool_type, {_PRIO} AS priority FROM tasks WHERE status = 'queued' ORDER BY priority DESC, created_at, task_id")
def _(spark, d):
    t = view(spark, d, "tasks").filter(F.col("status") == "queued").withColumn("priority", jobs.priority_of(F.col("tool_type")))
    return t.orderBy(F.desc("priority"), "created_at", "task_id").select("task_id", "tool_type", "priority")


@query("status_changes", ctes("status_log") + """SELECT task_id, seq, status, previous FROM (SELECT *, lag(status) OVER (PARTITION BY task_id ORDER BY ts, seq) AS previous FROM status_log)
 WHERE previous IS NULL OR previous <> status""")
def _(spark, d):
    return jobs.status_changes(view(spark, d, "status_log"), F.date_trunc("day", "ts")).select("task_id", "seq", "status", "previous")


@query("latest_status", ctes("status_log") + """SELECT task_id, arg_max(status, (ts, seq)) AS status, arg_max(progress, (ts, seq)) AS progress,
 arg_max(error_message, (ts, seq)) FILTER (error_message IS NOT NULL) AS error_message, max(ts) FILTER (status = 'completed') AS completed_at,
 count(*) AS messages FROM status_log GROUP BY task_id""")
def _(spark, d):
    return jobs.latest_status(view(spark, d, "status_log"))


@query("metadata_merge", ctes("status_log", more="""entries AS (SELECT task_id, ts, seq, 'progress' AS key, CAST(progress AS VARCHAR) AS value FROM status_log
 UNION ALL SELECT task_id, ts, seq, 'last_' || status, CAST(seq AS VARCHAR) FROM status_log)""") + "SELECT task_id, key, arg_max(value, (ts, seq)) AS value FROM entries GROUP BY ALL")
def _(spark, d):
    meta = F.create_map(F.lit("progress"), F.col("progress").cast("string"),
                        F.concat(F.lit("last_"), F.col("status")), F.col("seq").cast("string"))
    return jobs.merged_metadata(view(spark, d, "status_log").withColumn("metadata", meta), [])


_PROVIDER = "CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'past_due' WHEN 2 THEN 'unpaid' ELSE 'trialing' END"


def _webhooks(spark, d):
    k = F.get_json_object("props", "$.k").cast("long") % 4
    said = F.when(k == 0, "active").when(k == 1, "past_due").when(k == 2, "unpaid").otherwise("trialing")
    kind = (F.when(F.col("event_type") == "purchase", "checkout").when(F.col("event_type") == "signup", "updated")
            .when(F.col("event_type") == "error", "payment_failed").when(F.col("event_type") == "view", "deleted"))
    e = table(spark, d, "events").select(
        F.col("user_id").alias("sub_id"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), said.alias("provider_status"),
        F.when(F.col("value") > 10, "pro").otherwise("business").alias("plan"),
        F.when(k != 3, F.expr("ts + INTERVAL 30 DAY")).alias("period_end"))
    return e.filter(F.col("kind").isNotNull())


_HOOKS = f"""hooks AS (SELECT user_id AS sub_id, ts, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'checkout' WHEN 'signup' THEN 'updated' WHEN 'error' THEN 'payment_failed' ELSE 'deleted' END AS kind,
 {_PROVIDER} AS said, CASE WHEN value > 10 THEN 'pro' ELSE 'business' END AS plan,
 CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 <> 3 THEN ts + INTERVAL 30 DAY END AS period_end FROM events WHERE event_type <> 'click')"""


@query("stripe_status", ctes(more=_HOOKS) + """SELECT seq, said AS provider_status, CASE WHEN said = 'active' THEN 'active' WHEN said = 'past_due' THEN 'past_due'
 WHEN said IN ('canceled','unpaid') THEN 'cancelled' ELSE 'active' END AS status FROM hooks WHERE kind = 'updated'""")
def _(spark, d):
    return _webhooks(spark, d).filter(F.col("kind") == "updated").select(
        "seq", "provider_status", jobs.subscription_status(F.col("provider_status"), F.lit("active")).alias("status"))


@query("subscription_fold", ctes(more=_HOOKS + """, first_one AS (SELECT sub_id, min((ts, seq)) AS started FROM hooks WHERE kind = 'checkout' GROUP BY sub_id),
 known AS (SELECT h.*, CASE WHEN kind = 'checkout' THEN 'active' WHEN kind = 'deleted' THEN 'cancelled' WHEN kind = 'payment_failed' THEN 'past_due' WHEN said IN ('active','past_due') THEN said WHEN said = 'unpaid' THEN 'cancelled' END AS st,
 CASE WHEN kind = 'checkout' THEN plan WHEN kind = 'deleted' THEN 'free' END AS ti FROM hooks h JOIN first_one f ON h.sub_id = f.sub_id AND (h.ts, h.seq) >= f.started)""") + """
 SELECT sub_id, arg_max(st, (ts, seq)) FILTER (st IS NOT NULL) AS status, arg_max(ti, (ts, seq)) FILTER (ti IS NOT NULL) AS tier,
 arg_max(plan, (ts, seq)) FILTER (kind = 'checkout') AS plan, arg_max(period_end, (ts, seq)) FILTER (kind = 'updated' AND period_end IS NOT NULL) AS period_end,
 max(ts) FILTER (kind = 'deleted') AS cancelled_at, count(*) AS applied FROM known GROUP BY sub_id""")
def _(spark, d):
    return jobs.subscription_state(_webhooks(spark, d))


@query("rows_out", ctes("inputs") + "SELECT task_id, stored_name, file_size, upload_order FROM inputs")
def _(spark, d):
    from foliospark.sources.scratch import written
    return written(spark, view(spark, d, "inputs").select("task_id", "stored_name", "file_size", "upload_order"), "rows_out")
