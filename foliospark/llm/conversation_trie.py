"""Prefix tree of conversations by burst tries.

A node of the tree is a distinct sequence of first turns. Conversations enter as sequences of turn ids (digests of role and text), equal
sequences as one class. A container holds the rest of the classes below one place of the tree. A container of more than ``capacity`` turns
bursts: its place becomes a trie head, and its classes move to containers by their next turn id, several levels at a time. Heads are few,
at most one for ``capacity`` turns on each level. The remaining containers are dealt by hash to shards, sorted, and swept: neighbours in the
order share their longest common prefix, so a stack of the open path is all that a sweep needs besides the nodes of its container.

Members that end at a node are exactly one class, so the digest of their ids belongs to the class. Their ids are sorted by range over all
partitions, joined to pieces, and a task streams the pieces of a class; no list of members is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.sources.scratch import written

#: Turns that a container may hold, levels that burst at once, and ids of a piece of members.
CAPACITY, LEVELS, PIECE = 1 << 16, 4, 4096
TURNS = "array<struct<id:binary,chars:bigint>>"


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation in order, as digests and lengths of their texts; the texts stay behind."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.struct(F.col("turn").isNotNull().alias("placed"), "turn", role.alias("role"), digest.alias("id"), F.length(text).cast("long").alias("chars")).alias("row"))
    turns = F.transform(F.array_sort(F.collect_list("row")), lambda r: F.struct(r["id"].alias("id"), r["chars"].alias("chars"))).cast(TURNS)
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(sequences: DataFrame, hundred: int = 100, most: int = 6) -> DataFrame:
    """Sequences whose first ``h`` turns come from the conversation with the id rounded to ``hundred`` towards zero; ``h`` is the CRC-32 of the decimal id modulo ``most``."""
    base = F.col("conv_id") - F.col("conv_id") % hundred
    heads = sequences.where(F.col("conv_id") % hundred == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("opening"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    opening = F.coalesce("opening", F.array().cast(TURNS))
    turns = F.concat(F.slice(opening, F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    return sequences.withColumn("base", base).join(heads, "base", "left").select("conv_id", turns.alias("turns"))


def root() -> Column:
    return F.unhex(F.lit("00" * 16))


def place(parent: Column, turn: Column) -> Column:
    """Id of the node that a turn leads to."""
    return F.unhex(F.md5(F.concat(parent, turn)))


def member_digests(members: DataFrame) -> DataFrame:
    """``cls, n, first, ends`` of ``members(cls, conv_id)``: count, smallest id, and the digest of the ids in order, joined by commas."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"cls": pa.array([own], pa.binary()), "first": pa.array([ids[0]], pa.int64()), "n": pa.array([len(ids)], pa.int64()), "ids": [",".join(map(str, ids))]})

        for batch in batches:
            for cls, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (cls != own or len(ids) == PIECE):
                    yield piece()
                    ids = []
                own = cls
                ids.append(conv)
        if ids:
            yield piece()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, n, state = None, 0, 0, hashlib.sha256()
        for batch in batches:
            out: dict[str, list] = {"cls": [], "n": [], "first": [], "ends": []}
            for cls, at, count, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if cls != own:
                    if n:
                        for c, v in zip(out, (own, n, first, state.hexdigest()), strict=True):
                            out[c].append(v)
                    own, first, n, state = cls, at, 0, hashlib.sha256()
                state.update((b"," if n else b"") + ids.encode())
                n += count
            yield pa.RecordBatch.from_pydict(out, schema=schema)
        if n:
            yield pa.RecordBatch.from_pydict({"cls": [own], "n": [n], "first": [first], "ends": [state.hexdigest()]}, schema=schema)

    schema = pa.schema([("cls", pa.binary()), ("n", pa.int64()), ("first", pa.int64()), ("ends", pa.string())])
    cut = members.select("cls", "conv_id").repartitionByRange("cls", "conv_id").sortWithinPartitions("cls", "conv_id").mapInArrow(pieces, "cls binary, first long, n long, ids string")
    return cut.repartition("cls").sortWithinPartitions("cls", "first").mapInArrow(digests, "cls binary, n long, first long, ends string")


def burst(classes: DataFrame, capacity: int) -> DataFrame:
    """The classes with ``heads`` (ids of the trie heads on their way, from the root on) and ``container`` (null where a class ends at its last head)."""
    spark = classes.sparkSession
    size = F.size("turns")
    total = classes.agg(F.sum(size).alias("turns"), F.count("*").alias("classes")).first()
    if not total["classes"] > 1 or total["turns"] <= capacity:
        return classes.select("*", F.array().cast("array<binary>").alias("heads"), root().alias("container"))
    waiting = classes.withColumn("heads", F.array(root()))
    settled = None
    while True:
        depth = F.size("heads") - 1
        ahead = F.transform(F.slice("turns", depth + 1, F.lit(LEVELS)), lambda t: t["id"])
        ids = F.aggregate(ahead, F.slice("heads", -1, 1), lambda way, turn: F.concat(way, F.array(place(F.element_at(way, -1), turn))))
        waiting = written(spark, waiting.withColumn("ahead", F.slice(ids, 2, LEVELS)), "trie-waiting")
        steps = waiting.select("cls", (size - depth).alias("left"), F.posexplode("ahead").alias("step", "id")).withColumn("step", F.col("step") + 1)
        large = steps.groupBy("id").agg(F.sum(F.col("left") - F.col("step")).alias("turns"), F.count("*").alias("held")).where((F.col("turns") > capacity) & (F.col("held") > 1)).select("id")
        bursting = steps.join(large, "id").groupBy("cls").agg(F.max("step").alias("bursts"))
        moved = waiting.join(bursting, "cls", "left").withColumn("bursts", F.coalesce("bursts", F.lit(0)))
        moved = moved.withColumn("container", F.try_element_at("ahead", F.col("bursts") + 1)).withColumn("heads", F.concat("heads", F.slice("ahead", F.lit(1), F.col("bursts"))))
        moved = written(spark, moved, "trie-moved")
        goes_on = (F.col("bursts") == LEVELS) & (size > F.size("heads") - 1)
        done = moved.where(~goes_on).select(*classes.columns, "heads", "container")
        settled = done if settled is None else settled.unionByName(done)
        waiting = moved.where(goes_on).select(*classes.columns, "heads")
        if waiting.isEmpty():
            return settled


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SWEPT = pa.schema([("head", pa.binary()), ("top", pa.bool_()), *[(c, pa.string() if c == "ends_sha256" else pa.int64()) for c in NODE]])
EMPTY = hashlib.sha256(b"").hexdigest()


class Sweep:
    """Nodes of sorted containers. The first turn of each row leads to the container's own place."""

    def __init__(self) -> None:
        self.container: bytes | None = None
        self.rows: list[tuple] = []
        self.path: list[list] = []  # id, chars, members, smallest, children, leaves, saved, digest, rows of children

    def add(self, container: bytes, head: bytes | None, depth: int, ids: list[bytes], chars: list[int], n: int, first: int, ends: str) -> None:
        if container != self.container:
            self.close(0)
            self.container, self.head, self.depth = container, head, depth
        same = 0
        while same < min(len(self.path), len(ids)) and self.path[same][0] == ids[same]:
            same += 1
        self.close(same)
        for i in range(same, len(ids)):
            self.path.append([ids[i], chars[i], 0, None, 0, 0, 0, EMPTY, []])
        last = self.path[-1]
        last[2], last[3], last[7] = n, first, ends

    def close(self, upto: int) -> None:
        while len(self.path) > upto:
            _, chars, n, first, children, leaves, saved, ends, below = self.path.pop()
            leaves, saved = leaves or 1, saved + (n - 1) * chars
            self.rows += [(None, False, *row[:2], first, *row[2:]) for row in below]
            row = (first, self.depth + len(self.path), n, children, leaves, saved, ends)
            if not self.path:
                self.rows.append((self.head, True, *row[:2], None, *row[2:]))
                continue
            up = self.path[-1]
            up[2] += n
            up[3] = first if up[3] is None else min(up[3], first)
            up[4] += 1
            up[5] += leaves
            up[6] += saved
            up[8].append(row)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SWEPT)], schema=SWEPT)


def swept(settled: DataFrame) -> DataFrame:
    """Nodes of the containers; ``top`` marks a container's own place, ``head`` names the head above it."""
    depth = F.size("heads")
    whole = F.concat(F.array(F.struct(F.unhex(F.lit("")).alias("id"), F.lit(0).cast("long").alias("chars"))), "turns")
    rest = F.slice(whole, depth + 1, F.size("turns") + 1)
    rows = settled.where("container is not null").select("container", F.try_element_at("heads", F.lit(-1)).alias("head"), depth.alias("depth"), F.transform(rest, lambda t: t["id"]).alias("ids"),
                                                         F.transform(rest, lambda t: t["chars"]).alias("chars"), "n", "first", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for row in zip(*[c.to_pylist() for c in batch.slice(at, 1024).columns], strict=True):
                    sweep.add(*row)
                yield sweep.taken()
        sweep.close(0)
        yield sweep.taken()

    schema = "head binary, top boolean, " + ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODE)
    return rows.repartition("container").sortWithinPartitions("container", "ids").mapInArrow(run, schema)


def head_rows(settled: DataFrame, nodes: DataFrame) -> DataFrame:
    """The heads as nodes, with their id; what lies below is added up over their containers and the heads under them."""
    spark = settled.sparkSession
    steps = settled.select("n", "first", "turns", "heads", F.posexplode("heads").alias("depth", "id"))
    own = steps.groupBy("id").agg(F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"), F.max("depth").cast("long").alias("depth"),
                                  F.max(F.coalesce(F.try_element_at("turns", F.greatest("depth", F.lit(1)))["chars"] * (F.col("depth") > 0).cast("long"), F.lit(0))).alias("chars"),
                                  F.first(F.slice("heads", F.lit(1), F.col("depth") + 1)).alias("way"))
    own = written(spark, own, "trie-heads")
    tops = nodes.where("head is not null").groupBy(F.col("head").alias("id")).agg(F.count("*").alias("tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    kids = own.where("depth > 0").groupBy(F.element_at("way", -2).alias("id")).agg(F.count("*").alias("kids"))
    ends = settled.where("container is null").select(F.col("cls").alias("id"), "ends")
    own = own.join(tops, "id", "left").join(kids, "id", "left").join(ends, "id", "left")
    zero = F.lit(0).cast("long")
    own = written(spark, own.withColumns({"n_children": F.coalesce("tops", zero) + F.coalesce("kids", zero), "leaves": F.coalesce("leaves", zero),
                                          "saved": F.coalesce("saved", zero) + (F.col("n_convs") - 1) * F.col("chars")}), "trie-heads")
    below = own.select(F.explode("way").alias("id"), "leaves", "saved").groupBy("id").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = own.select(F.col("id").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    out = own.join(below, "id").withColumn("up", F.when(F.col("depth") > 0, F.element_at("way", -2))).join(above, "up", "left")
    return out.select("id", *NODE[:-1], F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))


def prefix_trie(sequences: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A row per node of the tree of ``sequences(conv_id, turns)``, ids being distinct.

    ``conv_id`` is the smallest member, ``parent_conv_id`` that of the parent (null at the root), ``n_convs`` counts members, ``n_children``
    children, ``n_leaves`` childless nodes of the subtree; ``saved_tokens`` sums (members - 1) times the characters of the last text over the
    subtree; ``ends_sha256`` is the digest of the ids that end at the node. No sequences give no rows; one without turns is a member of the
    root. A conversation is held whole, as digests, by one row.
    """
    spark = sequences.sparkSession
    cls = F.aggregate("turns", root(), lambda way, turn: place(way, turn["id"]))
    members = written(spark, sequences.select(cls.alias("cls"), "conv_id", "turns"), "trie-members")
    digests = member_digests(members)
    classes = written(spark, members.join(digests, (members["cls"] == digests["cls"]) & (members["conv_id"] == digests["first"])).select(digests["cls"], "turns", "n", "first", "ends"), "trie-classes")
    settled = burst(classes, capacity)
    nodes = written(spark, swept(settled), "trie-nodes")
    heads = written(spark, head_rows(settled, nodes), "trie-head-rows")
    above = heads.select(F.col("id").alias("head"), F.col("conv_id").alias("above"))
    inner = nodes.where("head is null").select(NODE)
    tops = nodes.where("head is not null").join(above, "head").withColumn("parent_conv_id", F.col("above")).select(NODE)
    return inner.unionByName(tops).unionByName(heads.select(NODE))


def conversation_trie(conversations: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The tree of the rebuilt conversations of ``conversations(conv_id, turn, role, text)``.

    Rows go by turn, null first, then by role and digest; null roles and texts are empty; repeated rows are turns of their own; rows without
    a conv_id take no part; other columns are ignored.
    """
    return prefix_trie(rebuilt(turn_sequences(conversations)), capacity)
