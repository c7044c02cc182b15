"""Request limits: aligned counters for all requests, and true sliding windows over accepted ones."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.skew import running_counts
from foliospark.sources.scratch import written


@dataclass(frozen=True)
class Limits:
    burst: int = 10
    minute: int = 60
    hour: int = 1000


ENDPOINT_LIMITS = Limits(minute=30, hour=500)


def fixed_window(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Decision per request from aligned second, minute and hour counters; rejected requests count too.

    ``requests`` has client, sec (whole seconds) and seq. The counters come from per-second counts,
    so a client with a large share of all requests is still spread over many tasks.
    """
    d = running_counts(requests, ["client"], "sec", "seq", {"in_second": 1, "in_minute": 60, "in_hour": 3600})
    kind = (F.when(F.col("in_second") > limits.burst, "burst").when(F.col("in_minute") > limits.minute, "minute")
            .when(F.col("in_hour") > limits.hour, "hour"))
    retry = (F.when(F.col("limit_type") == "burst", 1).when(F.col("limit_type") == "minute", 60 - F.col("sec") % 60)
             .when(F.col("limit_type") == "hour", 3600 - F.col("sec") % 3600))
    return d.withColumn("limit_type", kind).withColumn("retry_after", retry).withColumn("allowed", F.col("limit_type").isNull())


def quota_headers(count: Column, sec: Column, limit: int = 60, sliding: bool = False) -> tuple[Column, Column, Column]:
    """(limit, remaining, reset): reset is the next full minute, or a minute from now when sliding."""
    reset = sec + 60 if sliding else (F.floor(sec / 60) + 1) * 60
    return F.lit(limit), F.greatest(F.lit(0).cast("long"), limit - count), reset


class SlidingState:
    """Accepted instants of one client within the last hour, as (time, how many)."""

    def __init__(self, limits: Limits):
        self.windows = ((1.0, limits.burst, "burst"), (60.0, limits.minute, "minute"), (3600.0, limits.hour, "hour"))
        self.queues = [deque() for _ in self.windows]
        self.sums = [0, 0, 0]

    def accept(self, t: float, k: int) -> None:
        for i, q in enumerate(self.queues):
            q.append((t, k))
            self.sums[i] += k

    def expire(self, t: float) -> None:
        for i, (width, _, _) in enumerate(self.windows):
            q = self.queues[i]
            while q and q[0][0] <= t - width:
                self.sums[i] -= q.popleft()[1]

    def offer(self, t: float, n: int) -> tuple[int, str | None, int | None]:
        """n requests at one instant: how many are accepted, and why the next one is not."""
        self.expire(t)
        k = max(0, min(n, *[limit - have for (_, limit, _), have in zip(self.windows, self.sums)]))
        if k:
            self.accept(t, k)
        if k == n:
            return k, None, None
        for i, (width, limit, name) in enumerate(self.windows):
            if self.sums[i] >= limit:
                return k, name, 1 if name == "burst" else int(self.queues[i][0][0] + width - t) + 1
        return k, None, None


_FOLD_SCHEMA = "client string, t double, n long, k long, limit_type string, retry_after long"


def _fold(limits: Limits):
    """Walk sorted rows; only the state of the current client and span is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out = []
            for client, span, t, n, carried in pdf[["client", "span", "t", "n", "carried"]].itertuples(index=False):
                if (client, span) != current:
                    current, state = (client, span), SlidingState(limits)
                if carried:
                    state.accept(t, n)
                    continue
                out.append((client, t, n, *state.offer(t, n)))
            res = pd.DataFrame(out, columns=["client", "t", "n", "k", "limit_type", "retry_after"])
            res["retry_after"] = res["retry_after"].astype("Int64")
            yield res

    return run


def _folded(instants: DataFrame, carry: DataFrame | None, limits: Limits) -> DataFrame:
    rows = instants.select("client", "span", "t", "n", F.lit(False).alias("carried"))
    if carry is not None:
        rows = rows.unionByName(carry.select("client", "span", "t", "n", F.lit(True).alias("carried")))
    placed = rows.repartition("client", "span").sortWithinPartitions("client", "span", "t")
    return placed.mapInPandas(_fold(limits), _FOLD_SCHEMA).withColumn("chunk", F.floor(F.col("t") / HOUR))


HOUR = 3600
KEY = ["client", "chunk"]


def sliding_window(spark: SparkSession, requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Decision per request when only accepted requests are remembered, for true sliding windows.

    Each decision depends on earlier ones, so a client is sequential by nature. To keep a busy client
    from becoming one task, its time is cut into hours, and hours are first decided in parallel, each as
    if it were the first. An hour needs only what the hour before accepted, so the hours whose inheritance
    differs from what they were decided with are redone, and with them the hours that follow in a span that doubles with every
    round: one task walks a span with its real state. So there are as many rounds as the number of hours has
    binary digits, at most, and a client without limits hit is never walked again. A round writes what it
    redid, nothing else; the newest round of an hour counts. Rounds go through tables in the shared
    folder, so a lost executor does not replay earlier rounds.
    """
    instants = (requests.groupBy("client", F.col("t").cast("double").alias("t")).agg(F.count(F.lit(1)).alias("n"))
                .withColumn("chunk", F.floor(F.col("t") / HOUR)).select("client", "chunk", "t", "n"))
    instants = written(spark, instants, "limit-instants")

    def given(rows: DataFrame) -> DataFrame:
        """What an hour hands on: a hash of its acceptances, zero for none."""
        hashed = F.sum(F.when(F.col("k") > 0, F.xxhash64("t", "k").cast("decimal(20,0)")))
        return rows.groupBy(*KEY).agg(F.coalesce(hashed, F.lit(0)).cast("decimal(38,0)").alias("gives"))

    width, rounds = 1, 0
    decided = written(spark, _folded(instants.withColumn("span", F.col("chunk")), None, limits).withColumn("round", F.lit(0)), "limit-round")
    hours = written(spark, given(decided).withColumns({"takes": F.lit(0).cast("decimal(38,0)"), "round": F.lit(0)}), "limit-hours")
    while True:
        latest = hours.groupBy(*KEY).agg(F.max_by(F.struct("gives", "takes", "round"), "round").alias("v")).select(*KEY, "v.*")
        handed = latest.select("client", (F.col("chunk") + 1).alias("chunk"), F.col("gives").alias("due"))
        stale = latest.join(handed, KEY, "left").filter(F.coalesce("due", F.lit(0)) != F.col("takes")).select(*KEY)
        width, rounds = 2 * width, rounds + 1
        span = F.floor(F.col("chunk") / width)
        starts = written(spark, stale.withColumn("span", span).groupBy("client", "span").agg(F.min("chunk").alias("start")), "limit-stale")
        if starts.isEmpty():
            break
        redo = instants.withColumn("span", span).join(starts, ["client", "span"]).filter("chunk >= start")
        wanted = starts.withColumn("chunk", F.col("start") - 1).join(latest.select(*KEY, "round"), KEY).select(*KEY, "span", "round")
        carry = decided.filter("k > 0").join(wanted, [*KEY, "round"]).select("client", "span", "t", F.col("k").alias("n"))
        again = written(spark, _folded(redo, carry, limits).withColumn("round", F.lit(rounds)), "limit-round")
        gives = given(again)
        own = gives.select("client", (F.col("chunk") + 1).alias("chunk"), F.col("gives").alias("inside"))
        first = starts.select("client", F.col("start").alias("chunk"), F.lit(True).alias("first"))
        takes = F.coalesce(F.when(F.col("first"), F.col("due")).otherwise(F.col("inside")), F.lit(0)).cast("decimal(38,0)")
        gives = gives.join(own, KEY, "left").join(first, KEY, "left").join(handed, KEY, "left").select(*KEY, "gives", takes.alias("takes"), F.lit(rounds).alias("round"))
        hours = hours.unionByName(written(spark, gives, "limit-hours"))
        decided = decided.unionByName(again)
    decided = decided.join(latest.select(*KEY, "round"), [*KEY, "round"]).drop("round")
    order = F.row_number().over(_same_instant())
    d = requests.withColumn("t", F.col("t").cast("double")).withColumn("_rn", order).join(decided.drop("chunk", "n"), ["client", "t"])
    ok = F.col("_rn") <= F.col("k")
    return d.withColumn("allowed", ok).withColumns({"limit_type": F.when(~ok, F.col("limit_type")), "retry_after": F.when(~ok, F.col("retry_after"))}).drop("_rn", "k")


def _same_instant():
    from pyspark.sql import Window

    return Window.partitionBy("client", "t").orderBy("seq")
