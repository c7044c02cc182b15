"""Expiry, retention sweeps, orphan detection and privacy purges as set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Retention settings.
FILE_EXPIRY_MINUTES = 2
UPLOAD_HOURS = 1
ORPHAN_HOURS = 24
USAGE_DAYS = 90
AUDIT_DAYS = 365
DOWNLOAD_LEEWAY_SECONDS = 15


def interval(unit: str, amount: int) -> Column:
    return F.expr(f"INTERVAL '{amount}' {unit}")


def grace_expiry(now: Column, expiry: Column, grace_seconds: Column) -> Column:
    """Expiry after a first download: never later than before, nor than now plus the grace."""
    grace = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                               F.greatest(F.lit(0), grace_seconds).cast("decimal(18,6)"))
    return F.least(expiry, now + grace)


def expires_at(created: Column, minutes: int = FILE_EXPIRY_MINUTES) -> Column:
    return created + interval("MINUTE", minutes)


def is_expired(expiry: Column, now: Column) -> Column:
    return F.coalesce(expiry < now, F.lit(False))


def is_downloadable(file_id: Column, file_name: Column, expiry: Column, now: Column) -> Column:
    """Still inside its expiry plus the leeway, with a well-formed id and stored name."""
    live = expiry + interval("SECOND", DOWNLOAD_LEEWAY_SECONDS) >= now
    return live & file_id.rlike(r"^[a-zA-Z0-9_]+$") & file_name.rlike(r"(?i)^[a-f0-9]+_[0-9]+\.\w+$")


def completed_before(tasks: DataFrame, now: Column, hours: int | None = None) -> DataFrame:
    """Completed tasks past their lifetime: expiry plus five minutes unless hours are given."""
    age = interval("MINUTE", FILE_EXPIRY_MINUTES + 5) if hours is None else interval("HOUR", hours)
    return tasks.filter((F.col("status") == "completed") & (F.col("completed_at") < now - age))


def aged(df: DataFrame, column: str, now: Column, unit: str, amount: int) -> DataFrame:
    return df.filter(F.col(column) < now - interval(unit, amount))


def processed_age_minutes(minutes: int = 60) -> int:
    """Stale-result age: never below twice the file expiry."""
    return max(minutes, FILE_EXPIRY_MINUTES * 2)


def survivors(df: DataFrame, removed: Column) -> DataFrame:
    """Rows a sweep leaves behind; an undecided condition keeps the row."""
    return df.filter(~F.coalesce(removed, F.lit(False)))


def orphan_tasks(tasks: DataFrame, outputs: DataFrame, now: Column, hours: int = ORPHAN_HOURS) -> DataFrame:
    """Old tasks with no output. The age filter is applied before the join."""
    return aged(tasks, "created_at", now, "HOUR", hours).join(outputs, "task_id", "left_anti")


def task_of_stored_name(stored_name: Column) -> Column:
    """The task id in front of an upload's stored name, for an equi join instead of a LIKE join."""
    return F.regexp_extract(stored_name, r"^(.*?)_", 1)


#: Rows of a table that one task takes of what is dealt by task id.
ROWS_PER_TASK = 1_000_000


def parts_for(rows: DataFrame) -> int:
    """Parts into which rows are dealt by task id: the session's number, or more where they are more."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_TASK))


def expired_task_ids(outputs: DataFrame, now: Column) -> DataFrame:
    """Ids dealt in parts that grow with the table: adaptive execution would merge parts that are small once compressed."""
    ids = outputs.filter(is_expired(F.col("expires_at"), now)).select("task_id")
    return ids.repartition(parts_for(outputs), "task_id").distinct()


def purge_cascade(tasks: DataFrame, inputs: DataFrame, outputs: DataFrame, expired: DataFrame, uploads: DataFrame | None = None) -> DataFrame:
    """Everything that belongs to the expired tasks, in one long result.

    An upload belongs to a task by its row, or by the task id in front of its stored name: ``uploads`` (stored_name) lists the
    folder; without it the stored names of all rows stand for it. Each row counts; a file known by its name alone counts once.
    ``expired`` may be as large as the task table, so nothing is broadcast: it comes dealt by task (``expired_task_ids``), the tables
    follow its parts, and a part's rows are streamed past its ids, so that neither the tables nor a busy task fill a sort.
    """
    def mine(df, ids=expired):
        return df.join(ids.select("task_id").hint("shuffle_hash"), "task_id", "left_semi")

    def part(df, kind, item):
        return df.select(F.col("task_id"), F.lit(kind).alias("kind"), F.col(item).cast("string").alias("item"))

    rows, named = inputs.select("task_id", "stored_name"), mine(named_uploads(inputs, uploads))
    # Only the rows of tasks with files found by name are held against these. The null-safe test leaves the rows' shuffle as it is, so it serves twice.
    known = mine(rows, named).toDF("of_task", "of_name").hint("shuffle_hash")
    found = named.distinct().join(known, F.col("stored_name").eqNullSafe(F.col("of_name")) & (F.col("task_id") == F.col("of_task")), "left_anti")
    return reduce(DataFrame.unionByName, [part(mine(tasks), "task", "task_id"), part(mine(rows), "input", "stored_name"),
                                          part(found, "input", "stored_name"), part(mine(outputs), "output", "file_id")])


def named_uploads(inputs: DataFrame, uploads: DataFrame | None) -> DataFrame:
    """``task_id, stored_name`` of uploads whose name begins with a task id; where the rows stand for the folder, with another than their row's."""
    prefix = task_of_stored_name(F.col("stored_name"))
    owner = prefix.try_cast(inputs.schema["task_id"].dataType)
    listed = inputs.where(~owner.eqNullSafe(F.col("task_id"))) if uploads is None else uploads
    return listed.where((prefix != "") & (owner.cast("string") == prefix)).select(owner.alias("task_id"), "stored_name")


def input_paths(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Upload paths known from rows together with those found by name prefix, each once."""
    by_row = rows.select(F.col("task_id").cast("string").alias("task_id"), "stored_name")
    by_name = names.select(task_of_stored_name(F.col("stored_name")).alias("task_id"), "stored_name")
    return by_row.unionByName(by_name).distinct()


def counts(named: dict[str, DataFrame]) -> DataFrame:
    """One row per name with its row count; each branch counts before anything is shuffled."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n")
             for name, df in named.items()]
    return reduce(DataFrame.unionByName, parts)


def one_row_report(named: dict[str, DataFrame]) -> DataFrame:
    """The counts as columns of a single row."""
    total = counts(named)
    return total.agg(*[F.max(F.when(F.col("item") == name, F.col("n"))).alias(name) for name in named])


def purge_client(audit: DataFrame, tasks: DataFrame, inputs: DataFrame, outputs: DataFrame,
                 client_hash: str | None = None) -> DataFrame:
    """Counts a privacy purge deletes: one client's audit rows, or everything."""
    if client_hash is None:
        return counts({"tasks_deleted": tasks, "input_files_deleted": inputs,
                       "output_files_deleted": outputs, "audit_logs_deleted": audit})
    none = tasks.filter(F.lit(False))
    return counts({"tasks_deleted": none, "input_files_deleted": none, "output_files_deleted": none,
                   "audit_logs_deleted": audit.filter(F.col("client_ip") == client_hash)})


def sweep(tables: dict[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """What remains of each table after one run of all seven sweeps; run it from a schedule, or per trigger of a stream.

    ``tables`` holds tasks, inputs, outputs (rows), uploads and results (files on disk: task_id, modified, and for results
    is_link), usage and audit. Three sweeps remove whole tasks: those with an expired output, those completed for longer
    than their lifetime, and old ones without any output; the rows and files of a removed task go with it. Then go
    uploads and results that outlived their time (links are left alone), old usage statistics and old audit rows. Each table is read once.
    """
    tasks, outputs = tables["tasks"], tables["outputs"]
    made = outputs.groupBy("task_id").agg(F.bool_or(is_expired(F.col("expires_at"), now)).alias("expired"))
    known = tasks.select("task_id", "status", "completed_at", "created_at").join(made, "task_id", "full_outer")
    lifetime = interval("MINUTE", FILE_EXPIRY_MINUTES + 5)
    done = (F.col("status") == "completed") & (F.col("completed_at") < now - lifetime)
    orphan = F.col("expired").isNull() & (F.col("created_at") < now - interval("HOUR", ORPHAN_HOURS))
    gone = known.where(F.coalesce(F.col("expired"), F.lit(False)) | F.coalesce(done, F.lit(False)) | F.coalesce(orphan, F.lit(False))).select("task_id")
    kept = {name: tables[name].join(gone, "task_id", "left_anti") for name in ("tasks", "inputs", "outputs", "uploads", "results")}
    stale = (F.col("modified") < now - interval("MINUTE", processed_age_minutes())) & ~F.col("is_link")
    kept["uploads"] = survivors(kept["uploads"], F.col("modified") < now - interval("HOUR", UPLOAD_HOURS))
    kept["results"] = survivors(kept["results"], stale)
    kept["usage"] = survivors(tables["usage"], F.col("created_at") < now - interval("DAY", USAGE_DAYS))
    kept["audit"] = survivors(tables["audit"], F.col("created_at") < now - interval("DAY", AUDIT_DAYS))
    return kept
