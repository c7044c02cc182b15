"""Five page-specification dialects; each keeps its own rules on order, repeats, clipping and errors.

Every function maps a specification and a page count to an array of 1-based page numbers (or
ranges). An empty result means the job fails where the dialect calls for that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.binding import let

_EMPTY = "array<long>"


def _is_all(spec: Column) -> Column:
    return F.lower(spec) == "all"


def _every(total: Column) -> Column:
    return F.when(total >= 1, F.sequence(F.lit(1).cast("long"), total.cast("long"))).otherwise(F.array().cast(_EMPTY))


def _span(lo: Column, hi: Column, total: Column) -> Column:
    """lo..hi clipped to 1..total, or nothing when empty or not a number."""
    first, last = F.greatest(lo, F.lit(1)), F.least(hi, total.cast("long"))
    return F.when(lo.isNotNull() & hi.isNotNull() & (first <= last), F.sequence(first, last)).otherwise(F.array().cast(_EMPTY))


def _num(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("long"))


def _ends(part: Column) -> tuple[Column, Column]:
    """First and last page of a part, split at its first hyphen."""
    dash = part.contains("-")
    first = F.regexp_extract(part, r"^([^-]*)", 1)
    rest = F.regexp_replace(part, r"^[^-]*-", "")
    return _num(first), F.when(dash, _num(rest)).otherwise(_num(first))


def page_ranges(spec: Column, total: Column) -> Column:
    """Array of (start, end): order and repeats kept, a range beyond the end dropped whole."""
    def rng(part: Column) -> Column:
        ranged = part.contains("-")
        lo = F.when(ranged, F.regexp_extract(part, r"^([0-9]+)-[0-9]+", 1).try_cast("long")).otherwise(_num(part))
        hi = F.when(ranged, F.regexp_extract(part, r"^[0-9]+-([0-9]+)", 1).try_cast("long")).otherwise(_num(part))
        return F.struct(lo.alias("start"), hi.alias("end"))

    parts = F.transform(F.split(F.replace(spec, F.lit(" "), F.lit("")), ","), rng)
    good = F.filter(parts, lambda r: F.coalesce((r["start"] >= 1) & (r["start"] <= r["end"]) & (r["end"] <= total), F.lit(False)))
    return F.when(_is_all(spec), F.transform(_every(total), lambda p: F.struct(p.alias("start"), p.alias("end")))).otherwise(good)


def page_list(spec: Column, total: Column) -> Column:
    """Clipped, each page once in first-seen order; never an error."""
    def pages(part: Column) -> Column:
        lo, hi = _ends(part)
        return _span(lo, hi, total)

    some = F.array_distinct(F.flatten(F.transform(F.split(spec, ","), lambda p: let(F.trim(p), pages))))
    return F.when(spec.isNull() | (F.trim(spec) == "") | _is_all(F.trim(spec)), _every(total)).otherwise(some)


def page_set(spec: Column, total: Column) -> Column:
    """Clipped, sorted, unique; a range with an open end is ignored."""
    def pages(part: Column) -> Column:
        lo, hi = _ends(part)
        span = _span(lo, hi, total)
        single = F.when((lo >= 1) & (lo <= total), F.array(lo)).otherwise(F.array().cast(_EMPTY))
        return F.when(part.contains("-"), span).otherwise(single)

    parts = F.split(F.replace(spec, F.lit(" "), F.lit("")), ",")
    return F.when(_is_all(spec), _every(total)).otherwise(F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages)))))


def page_crop_list(spec: Column, total: Column) -> Column:
    """Clipped, order and repeats kept; null (job error) when a part is not numeric."""
    parts = F.transform(F.split(spec, ","), lambda p: F.trim(p))
    shaped = F.forall(parts, lambda p: p.rlike(r"^[0-9]+$") | p.rlike(r"^[0-9]+\s*-\s*[0-9]+$"))

    def pages(part: Column) -> Column:
        lo, hi = _ends(part)
        return _span(lo, hi, total)

    return F.when(_is_all(spec), _every(total)).when(shaped, F.flatten(F.transform(parts, pages)))


def validate_ranges(spec: Column, total: Column) -> Column:
    """First message of the strict check, or null when the specification is valid."""
    def message(part: Column) -> Column:
        lo, hi = _ends(part)
        n = total.cast("string")
        beyond = F.concat(F.lit("Page "), hi.cast("string"), F.lit(" exceeds document length ("), n, F.lit(" pages)"))
        bad_range = F.concat(F.lit("Invalid page range: "), part)
        ranged = (F.when(~part.rlike(r"^[0-9]+-[0-9]+$"), bad_range).when((lo < 1) | (hi < 1), "Page numbers must be positive")
                  .when(lo > hi, F.concat(F.lit("Invalid range: "), lo.cast("string"), F.lit("-"), hi.cast("string")))
                  .when(hi > total, beyond))
        single = (F.when(lo.isNull(), F.concat(F.lit("Invalid page number: "), part))
                  .when(lo < 1, "Page numbers must be positive").when(lo > total, beyond))
        return F.when(part.contains("-"), ranged).otherwise(single)

    squeezed = F.replace(spec, F.lit(" "), F.lit(""))
    first = F.get(F.filter(F.transform(F.split(squeezed, ","), message), lambda m: m.isNotNull()), F.lit(0))
    return F.when(_is_all(spec), None).when(~squeezed.rlike(r"^[0-9,\-]+$"),
                                            "Invalid page range format. Use format like '1-3,5,7-10'").otherwise(first)
