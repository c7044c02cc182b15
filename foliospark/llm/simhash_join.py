"""Near duplicates by SimHash fingerprints, with candidates from pigeonring chains.

**Fingerprints.** Bit ``k`` of a text's fingerprint is set if it is set in over half of the hashes of its word shingles, repeats included.

**Ring.** The 64 bits are cut into ``m = budget + 1`` segments that form a ring. If two fingerprints differ in at most ``budget`` bits, then
from some segment on every chain of ``l`` consecutive segments differs in at most ``l * budget / m`` bits (the strong form of the pigeonring
principle). So from that start the first segment is equal, the first two differ in at most one bit, and so on round the ring; the last chain
is the whole fingerprint, whose test is the full Hamming check.

**Buckets.** A distinct fingerprint goes to one bucket per start, named by the start and the value of its first segment; there are fewer than
2^16 such names. A bucket of more than ``full`` fingerprints is cut again by the second link of the chain: the second segment with each of its
bits left out in turn, since at most one differs. Buckets that are still full (groups of thousands of near copies) are cut into blocks: each
block is compared first, and then pairs of blocks of what is not in one component yet. A bucket gives away links that connect what is
connected, never all its pairs.

Equal fingerprints are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.graph import components
from foliospark.sources.scratch import written

#: Fingerprints of a bucket up to which all of it is compared in one task.
FULL = 4096
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15


def fingerprint(text: str | None, n: int = 4) -> int:
    """SimHash of the whole text: A-Z in lower case, words between ASCII white space, XXH64 with seed 42. Without words it is zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(n, len(words))
    total, ones = len(words) - width + 1, np.zeros(64, np.int64)
    starts, ends = starts[:total], ends[width - 1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, CHUNK):
        hashes = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[at:at + CHUNK].tolist(), ends[at:at + CHUNK].tolist(), strict=True)), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def segments(budget: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments of the ring."""
    edges = [64 * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def chains(budget: int) -> np.ndarray:
    """Bit masks by start and length of chain; the last is the whole fingerprint."""
    single = [((1 << bits) - 1) << at for at, bits in segments(budget)]
    m = len(single)
    return np.array([[sum(single[(i + k) % m] for k in range(length)) for length in range(1, m + 1)] for i in range(m)], np.uint64)


def _linked(one: np.ndarray, two: np.ndarray, start: np.ndarray, masks: np.ndarray, budget: int) -> np.ndarray:
    """Places whose pair keeps within the budget of each chain from its start, up to the full check."""
    left, apart = np.arange(len(one)), one ^ two
    m = masks.shape[1]
    for length in range(1, m + 1):
        left = left[np.bitwise_count(apart[left] & masks[start[left], length - 1]) <= length * budget // m]
    return left


def spanning_links(names: np.ndarray, start: np.ndarray, prints: np.ndarray, side: np.ndarray, label: np.ndarray, masks: np.ndarray, budget: int) -> np.ndarray:
    """Links (2 x n) among the rows of each bucket (equal neighbouring ``names``) that connect all that its links connect.

    Rows are held against those ``d`` places further for growing ``d``, in all buckets at once, unless they have one label already;
    with sides 0 and 1 only rows of different sides are compared, with side 2 all.
    """
    labels, out = np.unique(label, return_inverse=True)[1], []
    left, d = np.arange(len(names)), 0
    while True:
        d += 1
        left = left[left + d < len(names)]
        left = left[names[left] == names[left + d]]
        if not len(left):
            break
        ask = left[(labels[left] != labels[left + d]) & ((side[left] == 2) | (side[left] != side[left + d]))]
        new = ask[_linked(prints[ask], prints[ask + d], start[ask], masks, budget)]
        if not len(new):
            continue
        parent = {}

        def top(x: int, parent: dict = parent) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for i in new.tolist():
            a, b = top(int(labels[i])), top(int(labels[i + d]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, i + d))
        moved = {x: top(x) for x in parent}
        old = np.array(sorted(moved), np.int64)
        at = np.minimum(np.searchsorted(old, labels), len(old) - 1)
        labels = np.where(old[at] == labels, np.array([moved[x] for x in old.tolist()])[at], labels)
    if not out:
        return np.zeros((2, 0), np.int64)
    return prints.view(np.int64)[np.array(out).T]


def compared(rows: DataFrame, budget: int) -> DataFrame:
    """``a, b``: links of buckets ``(bucket, start, side, label, fp)`` of at most two blocks each. A task streams its sorted buckets."""
    masks = chains(budget)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "start", "fp", "side", "label")]
            if kept is not None:
                columns = [np.concatenate(x) for x in zip(kept, columns, strict=True)]
            if not len(columns[0]):
                continue
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            kept = [c[cut:] for c in columns]
            if cut:
                yield found([c[:cut] for c in columns])
        if kept is not None and len(kept[0]):
            yield found(kept)

    def found(columns: list[np.ndarray]) -> pa.RecordBatch:
        names, start, prints, side, label = columns
        links = spanning_links(names, start, prints.view(np.uint64), side, label, masks, budget)
        return pa.RecordBatch.from_pydict({"a": pa.array(links[0], pa.int64()), "b": pa.array(links[1], pa.int64())})

    return rows.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(run, "a long, b long")


def bucket_rows(prints: DataFrame, budget: int, full: int) -> tuple[DataFrame, DataFrame | None]:
    """(``bucket, start, fp`` with at most ``full`` rows a bucket, ``bucket, start, fp, own, blocks`` of those that are cut into blocks).

    For each start of a chain there is the bucket of its first segment; where that is full, one for each bit left out of the second.
    """
    spark = prints.sparkSession
    ring = segments(budget)

    def value(i: int):
        at, bits = ring[i % len(ring)]
        return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1))

    starts = F.array(*[F.struct(F.lit(i).alias("start"), value(i).alias("first"), value(i + 1).alias("second"), F.lit(ring[(i + 1) % len(ring)][1]).alias("bits")) for i in range(len(ring))])
    rows = prints.select("fp", F.inline(starts))
    crowded = written(spark, rows.groupBy("start", "first").count().where(F.col("count") > full).select("start", "first"), "simhash-full")
    if crowded.isEmpty():
        return rows.select(F.xxhash64("start", "first").alias("bucket"), "start", "fp"), None
    plain = rows.join(crowded, ["start", "first"], "left_anti").select(F.xxhash64("start", "first").alias("bucket"), "start", "fp")
    cut = rows.join(crowded, ["start", "first"]).select("fp", "start", "first", "second", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)).alias("bit"))
    rest = F.col("second").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))))
    cut = written(spark, cut.select(F.xxhash64("start", "first", "bit", rest).alias("bucket"), "start", "fp"), "simhash-cut")
    sizes = cut.groupBy("bucket").count().where("count > 1").select("bucket", F.ceil(F.col("count") / full).cast("int").alias("blocks"))
    cut = written(spark, cut.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int")), "simhash-blocks")
    blocks = cut.select(F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", "own")).alias("bucket"), "start", "fp")
    return plain.unionByName(blocks), cut.where("blocks > 1")


def links(prints: DataFrame, budget: int, full: int) -> DataFrame:
    """``a, b``: links between the distinct ``fp`` of ``prints`` that connect what is connected."""
    spark = prints.sparkSession
    rows, crowded = bucket_rows(prints, budget, full)
    found = written(spark, compared(rows.select("bucket", "start", F.lit(2).alias("side"), F.col("fp").alias("label"), "fp"), budget), "simhash-links")
    if crowded is None or crowded.isEmpty():
        return found
    names = named_components(found).select(F.col("node").alias("named"), "label")
    rows = crowded.join(names, F.xxhash64("fp") == F.col("named"), "left").select("bucket", "start", "fp", "own", "blocks", F.coalesce("label", F.xxhash64("fp")).alias("label"))
    rows = written(spark, rows, "simhash-labels")
    apart = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("bucket")
    rows = rows.join(apart, "bucket").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own != other")
    rows = rows.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "start", (F.col("own") > F.col("other")).cast("int").alias("side"), "label", "fp")
    return found.unionByName(written(spark, compared(rows, budget), "simhash-links"))


def named_components(found: DataFrame) -> DataFrame:
    """Components by names that are spread at random; on longs this hash is a bijection."""
    return components(found.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))


def simhash_facts(docs: DataFrame, n: int = 4) -> DataFrame:
    """``doc_id, fp`` for every row of ``docs(doc_id, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                prints = np.array([fingerprint(t, n) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, n: int = 4, budget: int = 4, full: int = FULL) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``.

    Fingerprints link when they differ in at most ``budget`` bits (below 63). ``component_id`` is the smallest doc_id reachable by links, the
    row's own included. A text with fewer than ``n`` words is one shingle; null, empty or blank texts have the fingerprint zero and are linked
    like any other. A row without an id takes part in links and gets the component of its fingerprint, null if no row of it has an id.
    Repeated rows are returned each; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    facts = written(spark, simhash_facts(docs, n), "simhash-facts")
    prints = written(spark, facts.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-prints")
    names = named_components(links(prints.select("fp"), budget, full))
    joined = written(spark, names.join(prints.withColumn("node", F.xxhash64("fp")), "node").select("fp", "first", "label"), "simhash-joined")
    least = joined.groupBy("label").agg(F.min("first").alias("least"))
    merged = joined.join(least, "label").select("fp", "least")
    own = prints.join(merged, "fp", "left").select("fp", F.least("first", "least").alias("component_id"))
    return facts.join(own, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
