"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.sources.scratch import written


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for the nodes of ``links(a, b)``; nodes that reach each other share a label.

    Each round renames every node to the smallest name among itself and its neighbours and drops links within a name.
    Names must be spread at random (hashes), so that a constant share of names goes in each round whatever the shape
    of the graph, long chains included. Nothing is gathered per component; rounds go through written tables.
    """
    spark = links.sparkSession
    links = written(spark, links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    names = written(spark, links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("label", F.col("node")), "names")
    while not links.isEmpty():
        both = links.union(links.select("b", "a")).toDF("node", "other")
        least = written(spark, both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("new")), "least")
        a, b = least.toDF("a", "na"), least.toDF("b", "nb")
        links = written(spark, links.join(a, "a").join(b, "b").where("na != nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "links")
        names = written(spark, names.join(least.toDF("label", "new"), "label", "left").select("node", F.coalesce("new", "label").alias("label")), "names")
    return names
