"""Search, replace and redaction over page text and word boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Predefined redaction patterns, with Unicode classes as in the source dialect.
PATTERNS = {
    "email": r"[\w.-]+@[\w.-]+\.\w+",
    "phone": r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "credit_card": r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}",
}
MASK = "█"


def literal(term: str) -> str:
    """Regular expression matching exactly this text."""
    return "".join("\\" + c if not (c.isalnum() or c.isspace() or ord(c) > 127) else c for c in term)


def _flags(match_case: bool) -> str:
    return "" if match_case else "(?iu)"


def find_text(pages: DataFrame, term: str, match_case: bool = False, page: int | None = None) -> DataFrame:
    """Occurrences of a term as rows: page, place in the page, character offset."""
    if page is not None:
        pages = pages.filter(F.col("page_no") == page)
    pattern = _flags(match_case) + literal(term)
    hit = pages.filter(F.col("text").rlike(pattern))
    pieces = F.split("text", pattern)
    sizes = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p))
    rows = hit.select("doc_id", "page_no", F.posexplode(sizes).alias("match_no", "gap"))
    sofar = Window.partitionBy("doc_id", "page_no").orderBy("match_no").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum("gap").over(sofar) + F.col("match_no") * len(term)
    return rows.select("doc_id", "page_no", "match_no", start.alias("start"))


def match_counts(pages: DataFrame, term: str, match_case: bool = False) -> DataFrame:
    n = F.regexp_count("text", F.lit(_flags(match_case) + literal(term)))
    return pages.groupBy("doc_id").agg(F.sum(n).alias("total_matches"), F.count_if(n > 0).alias("pages_with_matches"))


def replace_text(pages: DataFrame, pairs: list[tuple[str, str, int | None]]) -> DataFrame:
    """Replacements applied in order, each on every page or on one, with the number made."""
    df = pages.withColumn("replaced", F.lit(0))
    for term, new, page in pairs:
        on = F.lit(True) if page is None else F.col("page_no") == page
        pattern = _flags(False) + literal(term)
        count = F.when(on, F.regexp_count("text", F.lit(pattern))).otherwise(0)
        done = F.when(on, F.regexp_replace("text", pattern, new.replace("\\", "\\\\").replace("$", "\\$"))).otherwise(F.col("text"))
        df = df.withColumns({"replaced": F.col("replaced") + count, "text": done})
    return df


def redact_terms(text: Column, terms: list[str]) -> Column:
    """Each occurrence of each term masked, whatever its case."""
    kept = [t.strip() for t in terms if t.strip()]
    if not kept:
        raise ValueError("give at least one term")
    return reduce(lambda c, t: F.regexp_replace(c, _flags(False) + literal(t), MASK * len(t)), kept, text)


def matches_pattern(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs, ignoring case. Patterns without letters need no case folding, and
    an address is only looked for where there is an ``@``: the plain test is far cheaper."""
    if pattern in PATTERNS.values():
        found = text.rlike("(?U)" + pattern)
        return text.contains("@") & found if pattern == PATTERNS["email"] else found
    return text.rlike("(?iU)" + pattern)


def redact_spans(text: Column, patterns: list[str]) -> Column:
    """A span with any match is masked whole."""
    hit = reduce(lambda a, b: a | b, [matches_pattern(text, p) for p in patterns])
    return F.when(hit, F.repeat(F.lit(MASK), F.length(text))).otherwise(text)


def redaction_report(documents: DataFrame) -> DataFrame:
    """Masked lines and documents per language and source, for each predefined pattern.

    Documents are tested whole first: only those with a hit have their lines taken apart.
    """
    def lines(pattern: str) -> Column:
        n = F.size(F.filter(F.split("text", "\n"), lambda s: matches_pattern(s, pattern)))
        return F.when(matches_pattern(F.col("text"), pattern), n).otherwise(0)

    counted = documents.select("lang", "source", *[lines(p).alias(name) for name, p in PATTERNS.items()])
    aggs = [F.count(F.lit(1)).alias("documents")]
    for name in PATTERNS:
        aggs += [F.sum(name).alias(f"{name}_lines"), F.count_if(F.col(name) > 0).alias(f"{name}_documents")]
    return counted.groupBy("lang", "source").agg(*aggs)


def area_redact(words: DataFrame, areas: DataFrame) -> DataFrame:
    """Words with those touched by an area of their page marked.

    ``areas`` (doc_id, page_no, x0, y0, x1, y1) takes defaults 0, 0, 100, 100. The few areas of a page
    travel as an array to its words, which are read once and joined with nothing else.
    """
    page = ["doc_id", "page_no"]
    a = areas.select("doc_id", F.coalesce("page_no", F.lit(1)).alias("page_no"),
                     F.struct(*[F.coalesce(F.col(c), F.lit(v)).cast("double").alias(c) for c, v in (("x0", 0), ("y0", 0), ("x1", 100), ("y1", 100))]).alias("a"))
    by_page = a.groupBy(*page).agg(F.collect_list("a").alias("_areas"))

    def touches(a):
        return (F.col("x0") < a["x1"]) & (F.col("x1") > a["x0"]) & (F.col("y0") < a["y1"]) & (F.col("y1") > a["y0"])

    out = words.join(by_page.hint("shuffle_hash"), page, "left").withColumn("masked", F.coalesce(F.exists("_areas", touches), F.lit(False))).drop("_areas")
    return out.withColumn("text", F.when(F.col("masked"), F.repeat(F.lit(MASK), F.length("text"))).otherwise(F.col("text")))
