"""Continuous forms of the limits, usage, audit, progress, expiry and subscription operators.

Stateful processors keep a few values per key and take its rows in order, a span of time after the other. Timers use event time behind a watermark where the
service uses the wall clock, so that a replay gives the same rows as the live run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from foliospark.functions.screen import is_limited_path
from foliospark.operators.limits import ENDPOINT_LIMITS, Limits, SlidingState
from foliospark.sources.scratch import shared_dir
from foliospark.streaming.ordered import Aside, micros

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)


def run_to_table(spark: SparkSession, stream: DataFrame, purpose: str, partition_by: str | None = None) -> DataFrame:
    """Drain the available input into a Parquet table in the shared folder, then read it."""
    path, mark = shared_dir(spark, purpose), shared_dir(spark, f"{purpose}-state")
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", mark).outputMode("append")
    w = w.partitionBy(partition_by) if partition_by else w
    w.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_updates(spark: SparkSession, stream: DataFrame, keys: list[str], purpose: str) -> DataFrame:
    """Drain an updating aggregation; the last update of each key is its state."""
    path, mark = shared_dir(spark, purpose), shared_dir(spark, f"{purpose}-state")

    stream.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/batch_id={i}")).option(
        "checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])).parquet(path)
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return last.select(*keys, "v.*")


class SlidingLimiter(StatefulProcessor):
    """Accepted instants of a client within the last hour; only accepted requests are remembered."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle) -> None:
        self.accepted = handle.getListState("accepted", "t double")
        self.aside = Aside(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = SlidingState(self.limits)
        for (t,) in self.accepted.get():
            state.accept(t, 1)
        for pdf in self.aside.in_order(rows, "t", ["t", "seq"]):
            out = []
            for t, seq in zip(pdf["t"], pdf["seq"]):
                k, kind, retry = state.offer(float(t), 1)
                out.append((key[0], int(seq), float(t), bool(k), kind, retry))
            res = pd.DataFrame(out, columns=["client", "seq", "t", "allowed", "limit_type", "retry_after"])
            res["retry_after"] = res["retry_after"].astype("Int64")
            yield res
        self.accepted.put([(t,) for t, k in state.queues[2] for _ in range(k)])

    def close(self) -> None:
        pass


def sliding_limiter(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    schema = "client string, seq long, t double, allowed boolean, limit_type string, retry_after long"
    return requests.groupBy("client").transformWithStateInPandas(SlidingLimiter(limits), schema, "Append", "None")


def endpoint_limiter(requests: DataFrame, limits: Limits = ENDPOINT_LIMITS) -> DataFrame:
    """Sliding limits of each client on each limited path; ``client`` is then ``client|path``."""
    limited = requests.filter(is_limited_path(F.col("path")))
    return sliding_limiter(limited.select(F.concat_ws("|", "client", "path").alias("client"), "t", "seq"), limits)


class FixedLimiter(StatefulProcessor):
    """Counters of one hour of a client: its seconds, its minutes and itself.

    Seconds and minutes lie inside an hour, so hours need nothing from each other and a busy client is as many keys as
    it has hours. No counter is dropped, however late a request comes in.
    """

    WIDTHS = (1, 60, 3600)

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle) -> None:
        self.counts = handle.getListState("counts", "width long, bucket long, n long")
        self.aside = Aside(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {(w, b): n for w, b, n in self.counts.get()}
        for pdf in self.aside.in_order(rows, "sec", ["sec", "seq"]):
            seen = {}
            for w in self.WIDTHS:
                bucket = pdf["sec"] // w
                seen[w] = bucket.groupby(bucket).cumcount() + 1 + bucket.map(lambda b: known.get((w, b), 0))
                known.update({(w, int(b)): int(n) for b, n in seen[w].groupby(bucket).max().items()})
            kind = pd.Series([None] * len(pdf), dtype=object)
            for w, limit, name in ((3600, self.limits.hour, "hour"), (60, self.limits.minute, "minute"), (1, self.limits.burst, "burst")):
                kind = kind.mask(seen[w] > limit, name)
            yield pd.DataFrame({"client": key[0], "seq": pdf["seq"], "in_second": seen[1], "in_minute": seen[60], "in_hour": seen[3600], "limit_type": kind})
        self.counts.put([(w, b, n) for (w, b), n in known.items()])

    def close(self) -> None:
        pass


def fixed_limiter(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    schema = "client string, seq long, in_second long, in_minute long, in_hour long, limit_type string"
    hours = requests.withColumn("hour", F.floor(F.col("sec") / 3600))
    return hours.groupBy("client", "hour").transformWithStateInPandas(FixedLimiter(limits), schema, "Append", "None")


def usage_stream(log: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Files and bytes per user and day, kept up to date."""
    g = log.withWatermark("ts", lateness).groupBy("user_id", F.window("ts", "1 day"))
    a = g.agg(F.count(F.lit(1)).alias("files_processed"), F.sum("file_size").alias("bytes_processed"),
              *[F.count_if(F.col("tool_type").startswith(p)).alias(f"{p}_operations") for p in ("pdf", "image", "document")])
    return a.select("user_id", F.to_date("window.start").alias("day"), *a.columns[2:])


def audit_stream(events: DataFrame) -> DataFrame:
    """Audit rows with the date they are stored under."""
    return events.withColumn("day", F.to_date("created_at"))


def download_counter(requests: DataFrame) -> DataFrame:
    """Downloads per file: GET counts, HEAD does not."""
    return requests.filter(F.col("method") == "GET").groupBy("file_id").agg(F.count(F.lit(1)).alias("download_count"))


def _instants(ms: list[int]) -> np.ndarray:
    return np.array(ms, "datetime64[ms]").astype("datetime64[ns]")


class LatestProgress(StatefulProcessor):
    """Status changes of a task; without a final status ten minutes after its first message it failed."""

    def __init__(self, stall_seconds: int = 600):
        self.stall_ms = stall_seconds * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, done boolean, deadline long")
        self.aside = Aside(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Every request to the state store is answered over a socket and every frame is turned into a batch of its own:
        # a key asks once and yields frames with rows only.
        status, done, deadline = self.last.get() or (None, False, None)
        for pdf in self.aside.in_order(rows, "ts", ["ts", "seq"]):
            places, changes = [], pdf["status"].tolist()
            for at, (us, new) in enumerate(zip(micros(pdf["ts"]), changes)):
                if deadline is None:
                    deadline = us // 1000 + self.stall_ms
                    self.handle.registerTimer(deadline)
                if new != status:
                    places.append(at)
                in_time = us // 1000 <= deadline
                status, done = new, done or (in_time and new in ("completed", "failed", "cancelled"))
            if places:
                yield pd.DataFrame({"task_id": key[0], "seq": [int(s) for s in pdf["seq"].to_numpy()[places]], "ts": pdf["ts"].to_numpy()[places], "status": [changes[p] for p in places]})
        self.last.update((status, done, deadline))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, done, deadline = self.last.get()
        if not done:
            yield pd.DataFrame({"task_id": [key[0]], "seq": [-1], "ts": _instants([deadline]), "status": ["failed"]})

    def close(self) -> None:
        pass


def latest_progress(messages: DataFrame, lateness: str = "1 minute", stall_seconds: int = 600) -> DataFrame:
    schema = "task_id long, seq long, ts timestamp, status string"
    m = messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return m.groupBy("task_id").transformWithStateInPandas(LatestProgress(stall_seconds), schema, "Append", "EventTime", eventTimeColumnName="ts")


class ExpiryTimer(StatefulProcessor):
    """Expiry of a task's file after its first download, and the one purge that follows."""

    def __init__(self, grace_seconds: int = 120):
        self.grace_ms = max(0, grace_seconds) * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "expiry long, purged boolean")
        self.aside = Aside(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # The state is read once and written once: a request per row would be answered over a socket each.
        held = self.state.get()
        expiry, changed = held[0] if held else None, False
        for pdf in self.aside.in_order(rows, "ts", ["ts", "seq"]):
            out = []
            for us, given in zip(micros(pdf["ts"]), micros(pdf["expires_at"])):
                now, before = us // 1000, expiry
                if expiry is None:
                    self.handle.registerTimer(now + self.grace_ms + 1000)
                    expiry = given // 1000
                expiry = min(expiry, now + self.grace_ms)
                if expiry != before:
                    out.append(expiry)
            if out:
                changed = True
                yield pd.DataFrame({"task_id": key[0], "what": "expiry", "ts": _instants(out)})
        if changed:
            self.state.update((expiry, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.state.update((self.state.get()[0], True))
        yield pd.DataFrame({"task_id": [key[0]], "what": ["purge"], "ts": _instants([at])})

    def close(self) -> None:
        pass


def expiry_timer(downloads: DataFrame, grace_seconds: int = 120, lateness: str = "1 minute") -> DataFrame:
    d = downloads.filter(F.col("method") == "GET").withColumns({"ts": F.col("ts").cast("timestamp"), "expires_at": F.col("expires_at").cast("timestamp")})
    return d.withWatermark("ts", lateness).groupBy("task_id").transformWithStateInPandas(
        ExpiryTimer(grace_seconds), "task_id long, what string, ts timestamp", "Append", "EventTime", eventTimeColumnName="ts")


class SubscriptionFold(StatefulProcessor):
    """State of a subscription after each of its events; events before the first checkout are ignored."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", "status string, tier string, plan string, applied long")
        self.aside = Aside(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get() if self.state.exists() else None
        said = {"active": "active", "past_due": "past_due", "canceled": "cancelled", "unpaid": "cancelled"}
        for pdf in self.aside.in_order(rows, "ts", ["ts", "seq"]):
            out = []
            for seq, kind, word, plan in zip(pdf["seq"], pdf["kind"], pdf["provider_status"], pdf["plan"]):
                if now is None and kind != "checkout":
                    continue
                status, tier, held, n = now or (None, None, None, 0)
                if kind == "checkout":
                    status, tier, held = "active", "pro" if plan == "pro" else "business", plan
                elif kind == "updated":
                    status = said.get(word, status)
                elif kind == "deleted":
                    status, tier = "cancelled", "free"
                elif kind == "payment_failed":
                    status = "past_due"
                now = (status, tier, held, n + 1)
                out.append((key[0], int(seq), *now))
            yield pd.DataFrame(out, columns=["sub_id", "seq", "status", "tier", "plan", "applied"])
        if now is not None:
            self.state.update(now)

    def close(self) -> None:
        pass


def subscription_fold(events: DataFrame) -> DataFrame:
    schema = "sub_id long, seq long, status string, tier string, plan string, applied long"
    return events.groupBy("sub_id").transformWithStateInPandas(SubscriptionFold(), schema, "Append", "None")
