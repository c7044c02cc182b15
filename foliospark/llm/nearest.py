"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised with its own codebook; a pair of centroids is a cell. A query visits
cells in the order of the summed scores of its halves, by a heap over the two sorted centroid lists, until the cells
hold enough entries, and the entries are then scored exactly.

Equal vectors are one entry with its smallest ids, which is all that can be among the nearest. Work is cut into
blocks of entries and queries by the sizes of cells, so a full cell or a popular one is many tasks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.sources.scratch import written

#: Bound of the sample that the codebooks are fitted on (rows with the smallest id hashes), and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 12
CENTROIDS = 64
#: Share of all entries that a query visits, and the least number of entries.
VISIT_SHARE, VISIT_LEAST = 0.5, 2000
#: Cells of a lane are scored together; blocks of a lane hold about so many entries and queries.
LANES, ENTRIES, QUERIES = 8, 4096, 2048


@dataclass(frozen=True)
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    @property
    def width(self) -> int:
        return self.first.shape[1] + self.second.shape[1]

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return nearest_centroid(vectors[:, :cut], self.first), nearest_centroid(vectors[:, cut:], self.second)


def nearest_centroid(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids ** 2).sum(1) / 2 - points @ centroids.T).argmin(1)


def quantiser(points: np.ndarray, count: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct sample points; an empty cluster keeps its centre."""
    distinct = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centroids = distinct[rng.permutation(len(distinct))[:count]].copy()
    for _ in range(rounds):
        codes = nearest_centroid(points, centroids)
        size = np.bincount(codes, minlength=len(centroids))
        for d in range(points.shape[1]):
            total = np.bincount(codes, points[:, d], len(centroids))
            centroids[:, d] = np.where(size > 0, total / np.maximum(size, 1), centroids[:, d])
    return centroids


def usable(vector: Column, width: int | None = None) -> Column:
    """Not null, no null or non-finite component, not all zero, and of the given width."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)
    return ok & (F.size(vector) == width) if width else ok


def fit(spark: SparkSession, rows: DataFrame, count: int, sample: int = SAMPLE) -> Codebooks | None:
    """Codebooks from a bounded sample of ``rows(vec_id, vector)``; widths other than the commonest take no part."""
    common = rows.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if common is None:
        return None
    some = rows.where(F.size("vector") == common["w"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow()
    x = np.array(some.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, common["w"])
    cut = (common["w"] + 1) // 2
    return Codebooks(quantiser(x[:, :cut], count, ROUNDS, 1), quantiser(x[:, cut:], count, ROUNDS, 2) if cut < common["w"] else np.zeros((1, 0)))


def visited_cells(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Cells by falling sum of half scores until they hold ``wanted`` entries (multi-sequence traversal with a heap)."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap = [(-(first[a[0]] + second[b[0]]), 0, 0)]
    found, held = [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]), int(b[j])
        if sizes[cell]:
            found.append(cell)
            held += int(sizes[cell])
        if j + 1 < len(b):
            heapq.heappush(heap, (-(first[a[i]] + second[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(first[a[i + 1]] + second[b[0]]), i + 1, 0))
    return found


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def search(vectors: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", visit_share: float = VISIT_SHARE, centroids: int = CENTROIDS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query`` the ``k`` found with the largest inner product.

    ``vectors`` has ``vec_id`` and the vector column; others are ignored. Rows with a null id, and vectors that are null, zero, of an
    uncommon width or hold null or non-finite components, take no part. Of rows that repeat an id the least vector counts; a
    query is never its own result. Ties go to the smaller id. All candidates are returned if there are fewer than ``k``.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))
    rows = written(spark, rows, "vectors")
    books = fit(spark, rows, centroids)
    result = "query_id long, rank int, vec_id long, score double"
    if books is None:
        return spark.createDataFrame([], result)
    width = books.width
    rows = rows.where(F.size("vector") == width)

    # Equal vectors become one entry, named by its smallest id, with the ids that can still be among the nearest k.
    few = Window.partitionBy("vector").orderBy("vec_id")
    entries = (rows.select("vec_id", "vector").withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
               .groupBy("vector").agg(F.min("vec_id").alias("entry"), F.sort_array(F.collect_list("vec_id")).alias("ids")))

    wide = len(books.second)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c1, c2 = books.codes(_matrix(batch.column("vector"), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c1 * wide + c2, pa.int32()), pa.array(c1 % LANES, pa.int32())], names=[*batch.schema.names, "cell", "lane"])

    entries = written(spark, entries.mapInArrow(encode, "vector array<double>, entry long, ids array<long>, cell int, lane int"), "vector-entries")
    sizes = np.zeros((len(books.first), wide), np.int64)
    for r in entries.groupBy("cell").count().collect():
        sizes[divmod(r["cell"], wide)] = r["count"]
    wanted = max(VISIT_LEAST, math.ceil(visit_share * sizes.sum()))

    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), "vector").join(entries.select("vector", "entry"), "vector").select("query_id", "entry")
    asked = written(spark, asked, "vector-queries")
    asking = entries.join(asked.select("entry").distinct(), "entry", "left_semi").select("entry", "vector")

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = books.first.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("vector"), width)
            one, two = q[:, :cut] @ books.first.T, q[:, cut:] @ books.second.T
            for i in range(len(q)):
                lanes: dict[int, list[int]] = {}
                for a, b in visited_cells(one[i], two[i], sizes, wanted):
                    lanes.setdefault(a % LANES, []).append(a * wide + b)
                line, n = batch.slice(i, 1), len(lanes)
                yield pa.RecordBatch.from_arrays([pa.array(line.column("entry").to_pylist() * n, pa.int64()), pa.array(line.column("vector").to_pylist() * n, pa.list_(pa.float64())),
                                                  pa.array(list(lanes), pa.int32()), pa.array(list(lanes.values()), pa.list_(pa.int32()))], names=["entry", "vector", "lane", "cells"])

    visits = written(spark, asking.mapInArrow(plan, "entry long, vector array<double>, lane int, cells array<int>"), "vector-visits")
    grid = visits.groupBy("lane").agg(F.count("*").alias("q")).join(entries.groupBy("lane").agg(F.count("*").alias("e")), "lane")
    grid = F.broadcast(grid.select("lane", F.ceil(F.col("e") / ENTRIES).cast("int").alias("parts"), F.ceil(F.col("q") / QUERIES).cast("int").alias("groups")))  # LANES rows
    left = (entries.join(grid, "lane").withColumn("part", F.pmod(F.xxhash64("entry"), "parts").cast("int"))
            .withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("lane", "part", "group", "entry", "vector", "cell"))
    right = (visits.join(grid, "lane").withColumn("group", F.pmod(F.xxhash64("entry"), "groups").cast("int"))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("lane", "part", "group", "entry", "vector", "cells"))

    def score(held: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if held.num_rows and asks.num_rows:
            ids, x, cell = held.column("entry").to_numpy(), _matrix(held.column("vector"), width), held.column("cell").to_numpy()
            q, names, cells = _matrix(asks.column("vector"), width), asks.column("entry").to_numpy(), asks.column("cells").to_pylist()
            for start in range(0, len(q), 64):
                some = q[start:start + 64]
                open_ = np.zeros((len(some), sizes.size), bool)
                for i, visited in enumerate(cells[start:start + 64]):
                    open_[i, visited] = True
                points = np.where(open_[:, cell], some @ x.T, -np.inf)
                edge = np.partition(points, -k - 1, axis=1)[:, -k - 1] if len(x) > k + 1 else np.full(len(some), -np.inf)
                for i in range(len(some)):
                    at = np.flatnonzero((points[i] >= edge[i] - 1e-9) & (points[i] > -np.inf))
                    exact = (x[at] * some[i]).sum(1)
                    best = np.lexsort((ids[at], -exact))[:k + 1]
                    out.append((np.full(len(best), names[start + i]), ids[at][best], exact[best]))
        if not out:
            return pa.table({"query": pa.array([], pa.int64()), "entry": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return pa.table({"query": np.concatenate([o[0] for o in out]), "entry": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

    scored = left.groupBy("lane", "part", "group").cogroup(right.groupBy("lane", "part", "group")).applyInArrow(score, "query long, entry long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    top = scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    found = F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda x: F.struct((-F.col("score")).alias("minus"), x.alias("vec_id")))))), 1, k + 1)
    lists = top.join(entries.select("entry", "ids"), "entry").groupBy("query").agg(found.alias("found"))
    mine = asked.join(lists.withColumnRenamed("query", "entry"), "entry")
    own = F.slice(F.filter("found", lambda s: s["vec_id"] != F.col("query_id")), 1, k)
    return (mine.select("query_id", F.posexplode(own).alias("at", "s"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("s.vec_id").alias("vec_id"), (-F.col("s.minus")).alias("score")))


def recall(found: pd.DataFrame, exact: pd.DataFrame) -> float:
    """Share of the exact pairs (query_id, vec_id) that were found."""
    want = set(zip(exact["query_id"], exact["vec_id"], strict=True))
    return len(want & set(zip(found["query_id"], found["vec_id"], strict=True))) / max(1, len(want))
