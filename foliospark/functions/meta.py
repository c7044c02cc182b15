"""Document metadata and audit details."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def metadata_patch(old: dict[str, Column], new: dict[str, Column], now: Column) -> list[Column]:
    """Fields after an edit: a given value replaces, a missing one keeps the old, or reads as ''."""
    cols = [F.coalesce(new.get(k, F.lit(None)), v, F.lit("")).alias(k) for k, v in old.items()]
    return [*cols, now.alias("modified")]


# Detail fields of each audit event.
DETAIL_FIELDS = {
    "upload": ["file_name", "file_size"],
    "download": ["file_name"],
    "process": ["tool_type", "input_files", "output_size", "processing_time_ms"],
    "delete": ["reason"],
    "error": ["error_id", "error_type"],
}


def audit_details(event_type: Column, fields: dict[str, Column]) -> Column:
    """JSON of the detail fields of an event; file names are cut to 255 characters."""
    def value(name: str) -> Column:
        text = fields[name].cast("string")
        text = F.substring(text, 1, 255) if name == "file_name" else text
        return F.coalesce(text, F.lit("manual")) if name == "reason" else text

    out = F.lit(None).cast("string")
    for kind, wanted in DETAIL_FIELDS.items():
        pairs = [x for name in wanted if name in fields for x in (F.lit(name), value(name))]
        if pairs:
            out = F.when(event_type == kind, F.to_json(F.create_map(*pairs))).otherwise(out)
    return out
