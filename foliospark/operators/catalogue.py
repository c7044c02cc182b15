"""Filters and ranking over a catalogue of items (tools, posts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def post_filter(posts: DataFrame, category: str | None = None, query: str | None = None) -> DataFrame:
    if category:
        posts = posts.filter(F.lower("category") == category.lower())
    if query:
        q = query.lower()
        hit = (F.lower("title").contains(q) | F.lower("description").contains(q) | F.exists("keywords", lambda k: F.lower(k).contains(q)))
        posts = posts.filter(hit)
    return posts


def ranked_search(items: DataFrame, query: str) -> DataFrame:
    """Items containing every term; title prefix 3, title 2, elsewhere 1 point per term."""
    terms = query.lower().split()
    title = F.lower("title")
    text = F.lower(F.concat_ws(" ", "title", "description", "keywords_text"))
    score = F.lit(0)
    for t in terms:
        items = items.filter(text.contains(t))
        score = score + F.when(title.startswith(t), 3).when(title.contains(t), 2).otherwise(1)
    return items.withColumn("score", score).orderBy(F.desc("score"), "pos")


def categories(items: DataFrame) -> DataFrame:
    """Distinct categories in first-seen order."""
    return items.groupBy("category").agg(F.min("pos").alias("first_pos")).orderBy("first_pos")
