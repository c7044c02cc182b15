"""Chat formatting as prefix trees.

Conversations that share their first turns share a path from the root. Each distinct prefix is one node, named by a
128-bit hash that is accumulated along the conversation, so equal prefixes meet without comparing conversations.
Chains of nodes without a branch are one segment; depth-first order of segments is the order of their paths, and a
distributed running sum over that order gives each segment its place in the packed output. Shared text is emitted
once. A segment carries position ids (characters before it on its path), the intervals of its ancestors in the packed
output, which are what it may attend to besides itself, and its loss spans (assistant texts).

Everything is built-in column algebra. A conversation is the unit that is put together whole (a training sample is);
no step gathers a tree, a host of equal conversations or all prefixes of a conversation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.binding import let
from foliospark.sources.scratch import written

TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
#: Strings with a meaning in this or common chat templates; inside texts they are broken by the escape sign.
CONTROL = (TURN, SAYS, DONE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
           "<|system|>", "<|user|>", "<|assistant|>", "<unk>", "<pad>")
_LATER = "|".join(sorted({re.escape(c[1:]) for c in CONTROL}))


def escape(text: Column) -> Column:
    """Double the escape sign and put one behind the first character of each control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"([<\[])(?={_LATER})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turns_of(conversations: DataFrame) -> DataFrame:
    """One row per turn with its number, formatted text, the key of its prefix and the characters before it on the path."""
    rows = conversations.select(F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    body = escape(F.col("text"))
    return (rows.withColumn("n", F.row_number().over(order))
            .withColumn("head", head).withColumn("body", body)
            .withColumn("shown", F.concat("head", "body", F.lit(DONE)))
            .withColumn("size", F.length("shown").cast("long"))
            .withColumn("k1", F.bit_xor(F.xxhash64(F.lit(1), "n", "role", "text")).over(sofar))
            .withColumn("k2", F.bit_xor(F.xxhash64(F.lit(2), "n", "text", "role")).over(sofar))
            .withColumn("node", F.struct("k1", "k2", "n"))
            .withColumn("parent", F.lag("node").over(order))
            .withColumn("root", F.first("node").over(sofar))
            .withColumn("position", F.sum("size").over(sofar) - F.col("size"))
            .withColumn("last", F.lead("n").over(order).isNull())
            .withColumn("loss_start", F.when(F.col("role") == "assistant", F.length("head").cast("long")))
            .withColumn("loss_size", F.when(F.col("role") == "assistant", F.length("body").cast("long")))
            .drop("head", "body", "k1", "k2", "role", "text", "turn"))


def segmented(turns: DataFrame) -> DataFrame:
    """Add ``segment`` (key of the node that opens the chain the turn lies in) and ``branch`` (whether it opens it).

    A node opens a chain if it is a root or its parent has several children.
    """
    forks = (turns.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.min("node").alias("a"), F.max("node").alias("b"))
             .where("a != b").select(F.col("parent").alias("fork")))
    marked = turns.join(forks, turns["parent"] == forks["fork"], "left").withColumn("branch", F.col("parent").isNull() | F.col("fork").isNotNull()).drop("fork")
    sofar = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("segment", F.last(F.when(F.col("branch"), F.col("node")), ignorenulls=True).over(sofar))


def prefix_trees(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, members) for ``conversations(conv_id, turn, role, text)``.

    * segments: ``tree, segment, depth, start`` (place in its tree's packed output), ``length, position, text, loss`` (spans in the
      text), ``ancestors`` (intervals of the packed output that it may attend to besides its own).
    * members: ``conv_id, n_turns, path`` (its segments from the root), ``length`` (characters of the path that are the conversation's).

    Turns are put in order by (turn, role, text); a null turn comes first, a null role or text counts as empty, a null
    conv_id is a conversation of its own; repeated rows are turns of their own; other columns are ignored.
    """
    spark = conversations.sparkSession
    turns = written(spark, turns_of(conversations), "chat-turns")
    turns = written(spark, segmented(turns), "chat-segments")
    nodes = (turns.groupBy("node").agg(F.min("segment").alias("segment"), F.min("position").alias("position"), F.min("size").alias("size"), F.min("shown").alias("shown"),
                                       F.min("loss_start").alias("loss_start"), F.min("loss_size").alias("loss_size")))
    parts = F.array_sort(F.collect_list(F.struct(F.col("node.n").alias("n"), "position", "size", "shown", "loss_start", "loss_size")))
    chains = (nodes.groupBy("segment").agg(parts.alias("parts")).withColumn("position", F.col("parts")[0]["position"])
              .withColumn("text", F.array_join(F.col("parts.shown"), ""))
              .withColumn("length", F.length("text").cast("long"))
              .withColumn("loss", F.transform(F.filter("parts", lambda p: p["loss_start"].isNotNull()),
                                              lambda p: F.struct((p["position"] - F.col("position") + p["loss_start"]).alias("start"), p["loss_size"].alias("size"))))
              .drop("parts"))

    opens = F.when(F.col("branch"), F.struct("n", "node"))
    members = (turns.groupBy("conv_id").agg(F.max("n").cast("long").alias("n_turns"), F.sum("size").alias("length"),
                                            F.transform(F.array_sort(F.collect_list(opens)), lambda x: x["node"]).alias("path")))
    # A path is needed once per segment: the longest common part of all that pass is any path cut at the segment.
    paths = (members.select("path").distinct().select("path", F.posexplode("path").alias("at", "segment"))
             .groupBy("segment").agg(F.min(F.slice("path", F.lit(1), F.col("at") + 1)).alias("path")))
    placed = written(spark, placed_in_order(chains.join(paths, "segment")), "chat-order")
    trees = placed.where(F.size("path") == 1).select(F.col("segment").alias("tree"), F.col("at").alias("tree_at"))
    segments = (placed.withColumn("tree", F.col("path")[0]).join(trees, "tree").withColumn("start", F.col("at") - F.col("tree_at")))
    where = segments.select("segment", "start", "length")
    above = (segments.select("segment", F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("above"))
             .join(where.select(F.col("segment").alias("above"), "start", "length"), "above")
             .groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("ancestors")))
    segments = (segments.join(above, "segment", "left")
                .select("tree", "segment", F.size("path").alias("depth"), "start", "length", "position", "text", "loss",
                        F.coalesce("ancestors", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("ancestors")))
    return segments, members


def placed_in_order(chains: DataFrame) -> DataFrame:
    """Add ``at``, the running sum of lengths in the order of ``path`` (parents before children): depth-first, over all trees.

    Rows are range-partitioned by path and summed inside partitions; only one total per partition, a number that does not
    follow the rows, is carried across.
    """
    spark = chains.sparkSession
    ranged = chains.repartitionByRange("path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id())
    ranged = written(spark, ranged, "chat-range")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("length").alias("total")).withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    inside = Window.partitionBy("part").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (ranged.withColumn("upto", F.sum("length").over(inside)).join(F.broadcast(totals.select("part", "base")), "part")
            .withColumn("at", F.col("base") + F.col("upto") - F.col("length")).drop("part", "base", "upto"))


def read_back(segments: DataFrame, members: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns`` (role and text, unescaped), ``loss_texts, formatted_chars``, parsed from the packed output alone."""
    steps = members.select("conv_id", "n_turns", F.col("length").alias("chars"), F.posexplode("path").alias("k", "segment"))
    said = F.transform("loss", lambda s: F.struct((s["start"] + F.col("position")).alias("at"), unescape(F.substring(F.col("text"), s["start"].cast("int") + 1, s["size"].cast("int"))).alias("said")))
    own = segments.select("segment", "text", said.alias("said"))
    whole = (steps.join(own, "segment").groupBy("conv_id", "n_turns", "chars")
             .agg(F.array_sort(F.collect_list(F.struct("k", "text", "said"))).alias("parts")))
    formatted = F.substring(F.array_join(F.col("parts.text"), ""), F.lit(1), F.col("chars").cast("int"))
    pieces = F.split("formatted", re.escape(DONE))

    def turn(piece: Column) -> Column:
        sides = F.split(piece, re.escape(SAYS))
        return let(sides, lambda s: F.struct(unescape(F.substring(s[0], len(TURN) + 1, 2_147_483_647)).alias("role"), unescape(s[1]).alias("text")))

    return (whole.withColumn("formatted", formatted)
            .select("conv_id", F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn).alias("turns"),
                    F.transform(F.filter(F.flatten("parts.said"), lambda s: s["at"] < F.col("chars")), lambda s: s["said"]).alias("loss_texts"),
                    F.length("formatted").cast("long").alias("formatted_chars"))
            .withColumn("n_turns", F.size("turns").cast("long")))
