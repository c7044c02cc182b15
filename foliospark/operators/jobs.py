"""Task listings, status, quotas, usage, routing and subscription state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.skew import bucketed_lag

# Limits per tier as (tier, files per day, largest file, queue priority, ads, batch, api).
TIER_LIMITS = [
    ("anonymous", 3, 5242880, "low", True, False, False),
    ("free", 5, 10485760, "normal", True, False, False),
    ("pro", -1, 104857600, "high", False, True, True),
    ("business", -1, 524288000, "critical", False, True, True),
]

# Queue of each PDF tool; image and document tools go to their own queues.
TOOL_QUEUES = {
    "pdf_merge": "pdf-heavy", "pdf_compress": "pdf-heavy", "pdf_ocr": "pdf-heavy",
    "pdf_to_word": "pdf-heavy", "pdf_compare": "pdf-heavy",
    "pdf_split": "pdf-light", "pdf_rotate": "pdf-light", "pdf_watermark": "pdf-light",
    "pdf_page_numbers": "pdf-light", "pdf_protect": "pdf-light", "pdf_unlock": "pdf-light",
}

# Queue priorities, higher first; any other tool has 5.
TOOL_PRIORITIES = {
    "pdf_split": 8, "pdf_rotate": 8, "pdf_unlock": 8,
    "pdf_page_numbers": 7, "pdf_watermark": 7, "pdf_protect": 7,
    "pdf_merge": 5, "image_compress": 5, "image_resize": 5,
    "pdf_compress": 3, "pdf_to_word": 3, "pdf_to_excel": 3,
    "pdf_ocr": 1, "pdf_compare": 2, "document_convert": 2,
}

ASYNC_THRESHOLD = 5242880
FINAL_STATUSES = ("completed", "failed", "cancelled")


def lookup(values: dict, key: Column, default) -> Column:
    """A small fixed map as a literal map, so that a lookup needs no join."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def audit_filter(audit: DataFrame, client_hash: str | None = None, event_type: str | None = None) -> DataFrame:
    if client_hash is not None:
        audit = audit.filter(F.col("client_ip") == client_hash)
    if event_type is not None:
        audit = audit.filter(F.col("event_type") == event_type)
    return audit


def task_filter(tasks: DataFrame, status: str | None = None, tool_type: str | None = None) -> DataFrame:
    if status is not None:
        tasks = tasks.filter(F.col("status") == status)
    if tool_type is not None:
        tasks = tasks.filter(F.col("tool_type") == tool_type)
    return tasks.select("task_id", "status", "tool_type", "created_at", "completed_at")


def page_of(df: DataFrame, newest: str, tie: str, limit: int, offset: int = 0, most: int = 1000) -> DataFrame:
    """One page of a listing, newest first; Spark plans it as a top-k, not a full sort."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be 1..{most} and offset not negative")
    return df.orderBy(F.col(newest).desc(), F.col(tie)).offset(offset).limit(limit)


def subscription_active(status: Column, period_end: Column, now: Column) -> Column:
    return F.coalesce(status == "active", F.lit(False)) & (period_end.isNull() | (period_end >= now))


def cancel_result(status: Column) -> tuple[Column, Column, Column]:
    """(may be cancelled, resulting status, message)."""
    ok = status.isin("pending", "queued")
    refused = F.concat(F.lit("Cannot cancel task in '"), status,
                       F.lit("' status. Only pending/queued tasks can be cancelled."))
    return (ok, F.when(ok, F.lit("cancelled")).otherwise(status),
            F.when(ok, F.lit("Task cancelled by user")).otherwise(refused))


def needs_async(inputs: DataFrame, forced: bool = False, enabled: bool = True,
                threshold: int = ASYNC_THRESHOLD) -> DataFrame:
    total = inputs.groupBy("task_id").agg(F.sum("file_size").alias("total_size"))
    return total.withColumn("use_async", F.lit(enabled) & (F.lit(forced) | (F.col("total_size") > threshold)))


def status_rows(tasks: DataFrame, outputs: DataFrame) -> DataFrame:
    """Tasks with their outputs; download fields only for completed ones, unknown status as pending."""
    done = F.col("status") == "completed"
    known = F.col("status").isin("pending", "processing", "completed", "failed")
    return tasks.join(outputs, "task_id", "left").select(
        "task_id", "status", "tool_type", "file_id",
        F.when(known, F.col("status")).otherwise("pending").alias("shown_status"),
        F.when(done & F.col("file_id").isNotNull(),
               F.concat(F.lit("/api/v1/download/"), F.col("file_id"))).alias("download_url"),
        F.when(done, F.col("file_size")).alias("file_size"),
        F.when(done, F.lit(100)).otherwise(0).alias("progress"),
        F.when(F.col("status") == "failed", F.coalesce("error_message", F.lit("Unknown error"))).alias("error"),
    )


def tier_table(spark: SparkSession) -> DataFrame:
    """Four fixed rows; a table of constants, so it may always be broadcast."""
    rows = ", ".join("('{}', {}, {}L, '{}', {}, {}, {})".format(*t) for t in TIER_LIMITS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(tier, daily_file_limit, max_file_size, "
                     "queue_priority, show_ads, batch_processing, api_access)")


def with_tier_limits(users: DataFrame, tiers: DataFrame, tier_col: str = "tier") -> DataFrame:
    """Users with the limits of their tier; an unknown tier gets the anonymous limits."""
    known = [t[0] for t in TIER_LIMITS]
    name = F.lower(F.coalesce(F.col(tier_col), F.lit("")))
    keyed = users.withColumn("limit_tier", F.when(name.isin(*known), name).otherwise("anonymous"))
    return keyed.join(F.broadcast(tiers.withColumnRenamed("tier", "limit_tier")), "limit_tier", "left")


def quota_decision(used: Column, limit: Column, size: Column, max_size: Column) -> Column:
    """Daily count is tested before the file size; -1 means no daily limit."""
    return (F.when((limit != -1) & (used >= limit), "Daily file limit exceeded")
            .when(size > max_size, "File size exceeds limit").otherwise("ok"))


def daily_usage(log: DataFrame, by_tool: bool = True) -> DataFrame:
    """Files and bytes per key and day, split by tool family when asked."""
    aggs = [F.count(F.lit(1)).alias("files_processed"), F.sum("file_size").alias("bytes_processed")]
    if by_tool:
        aggs += [F.count_if(F.col("tool_type").startswith(p)).alias(f"{p}_operations")
                 for p in ("pdf", "image", "document")]
    return log.groupBy("key", F.to_date("ts").alias("day")).agg(*aggs)


def queue_of(tool: Column) -> Column:
    fixed = lookup(TOOL_QUEUES, tool, None)
    return F.coalesce(fixed, F.when(tool.startswith("image_"), "image")
                      .when(tool.startswith("document_"), "document").otherwise("default"))


def priority_of(tool: Column) -> Column:
    return lookup(TOOL_PRIORITIES, tool, 5)


def status_changes(log: DataFrame, bucket: Column) -> DataFrame:
    """Status messages that differ from the last one seen for their task."""
    d = bucketed_lag(log, ["task_id"], ["ts", "seq"], bucket, "status", "previous")
    return d.filter(F.col("previous").isNull() | (F.col("previous") != F.col("status")))


def latest_status(log: DataFrame) -> DataFrame:
    """One row per task from partial aggregates: no sort and no window per task."""
    order = F.struct("ts", "seq")
    return log.groupBy("task_id").agg(
        F.max_by("status", order).alias("status"),
        F.max_by("progress", F.when(F.col("progress").isNotNull(), order)).alias("progress"),
        F.max_by("error_message", F.when(F.col("error_message").isNotNull(), order)).alias("error_message"),
        F.max(F.when(F.col("status") == "completed", F.col("ts"))).alias("completed_at"),
        F.count(F.lit(1)).alias("messages"),
    )


def merged_metadata(log: DataFrame, keys: list[str]) -> DataFrame:
    """Shallow merge of the metadata maps of a task: for each key the last value wins.

    Each key is reduced on its own (``max_by``), so no task's messages are ever collected.
    """
    entries = log.select("task_id", "ts", "seq", F.explode("metadata").alias("key", "value"))
    if keys:
        entries = entries.filter(F.col("key").isin(*keys))
    return entries.groupBy("task_id", "key").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))


def subscription_status(provider: Column, current: Column) -> Column:
    """Status named by the payment provider to the stored one; unknown names change nothing."""
    return (F.when(provider == "active", "active").when(provider == "past_due", "past_due")
            .when(provider.isin("canceled", "unpaid"), "cancelled").otherwise(current))


def subscription_state(events: DataFrame) -> DataFrame:
    """State of each subscription after all its events, in the order (ts, seq).

    Events before the first checkout are ignored. Every column is the last setting made after
    that point, hence a few ``max_by`` aggregates instead of an ordered fold.
    """
    order = F.struct("ts", "seq")
    start = events.filter(F.col("kind") == "checkout").groupBy("sub_id").agg(F.min(order).alias("started"))
    known = events.join(start, "sub_id").filter(order >= F.col("started"))
    kind, said = F.col("kind"), F.col("provider_status")
    status = (F.when(kind == "checkout", "active").when(kind == "deleted", "cancelled")
              .when(kind == "payment_failed", "past_due")
              .when(kind == "updated", subscription_status(said, F.lit(None).cast("string"))))
    tier = (F.when((kind == "checkout") & (F.col("plan") == "pro"), "pro").when(kind == "checkout", "business")
            .when(kind == "deleted", "free"))
    cut = known.withColumn("_status", status).withColumn("_tier", tier)
    last = lambda c, cond: F.max_by(c, F.when(cond, order))
    return cut.groupBy("sub_id").agg(
        last("_status", F.col("_status").isNotNull()).alias("status"),
        last("_tier", F.col("_tier").isNotNull()).alias("tier"),
        last("plan", kind == "checkout").alias("plan"),
        last("period_end", (kind == "updated") & F.col("period_end").isNotNull()).alias("period_end"),
        last("ts", kind == "deleted").alias("cancelled_at"),
        F.count(F.lit(1)).alias("applied"),
    )
