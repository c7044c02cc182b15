"""Form fields and edit operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUE_WORDS = ("true", "yes", "on", "1")
FIELD_TYPES = ("text", "checkbox", "radio", "dropdown", "listbox", "button", "signature", "unknown")


def coerce(field_type: Column, value: Column) -> Column:
    """Checkbox values become true or false, others stay text."""
    return F.when(field_type == "checkbox", F.lower(value).isin(*TRUE_WORDS).cast("string")).otherwise(value)


def fill_form(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Fields with given values set; read-only fields and unknown names are left alone.

    ``values`` has (doc_id, name, new_value); where a name is given twice, the last by ``ord`` wins.
    """
    given = values.groupBy("doc_id", "name").agg(F.max_by("new_value", "ord").alias("new_value"))
    j = fields.join(given, ["doc_id", "name"], "left")
    fill = F.col("new_value").isNotNull() & ~F.coalesce("read_only", F.lit(False))
    return j.withColumns({"filled": fill, "value": F.when(fill, coerce(F.col("field_type"), F.col("new_value"))).otherwise(F.col("value"))}).drop("new_value")


def filled_count(filled: DataFrame) -> DataFrame:
    return filled.groupBy("doc_id").agg(F.count_if("filled").alias("filled_count"))


def reset_form(fields: DataFrame) -> DataFrame:
    return fields.withColumn("value", F.coalesce("default_value", F.lit("")))


def form_summary(fields: DataFrame) -> DataFrame:
    return fields.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("field_count"), (F.count(F.lit(1)) > 0).alias("has_form"), F.count_if("required").alias("required_fields"),
        F.count_if("read_only").alias("read_only_fields"), F.count_if(F.col("options").isNotNull()).alias("choice_fields"))


# One wide row per edit operation; ``type`` tells which fields count.
EDIT_OPERATION = ("type string, page int, x double, y double, x1 double, y1 double, x2 double, y2 double, width double, height double, "
                  "text string, content string, author string, icon string, image_index int, font_size int, font_name string, color string, "
                  "stroke_color string, fill_color string, stroke_width double, opacity double, rotation double")

# Fields each operation needs.
REQUIRED = {
    "text": ["text", "page", "x", "y"], "image": ["image_index", "page", "x", "y"],
    "rectangle": ["page", "x", "y", "width", "height"], "line": ["page", "x1", "y1", "x2", "y2"],
    "highlight": ["page", "x", "y", "width", "height"], "comment": ["page", "x", "y", "content"],
    "redact": ["page", "x", "y", "width", "height"],
}


def edit_operations(requests: DataFrame, column: str = "operations") -> DataFrame:
    """Edit operations of JSON requests as rows, with defaults filled and each row's validity."""
    ops = requests.select("request_id", F.posexplode(F.from_json(column, f"array<struct<{EDIT_OPERATION.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double')}>>")).alias("op_no", "op"))
    o = ops.select("request_id", "op_no", "op.*")
    has = F.lit(False)
    for kind, needed in REQUIRED.items():
        ok = F.lit(True)
        for name in needed:
            ok = ok & F.col(name).isNotNull()
        has = F.when(F.col("type") == kind, ok).otherwise(has)
    opacity = F.coalesce("opacity", F.when(F.col("type") == "highlight", 0.5).otherwise(1.0))
    size = F.coalesce("font_size", F.lit(12))
    least_width = F.when(F.col("type") == "line", F.coalesce("width", F.lit(1.0)) >= 0.1).otherwise(F.coalesce("stroke_width", F.lit(1.0)) >= 0)
    in_range = opacity.between(0.0, 1.0) & size.between(6, 144) & least_width
    return o.withColumns({"opacity": opacity, "font_size": size}).withColumn("valid", F.coalesce(has & in_range, F.lit(False)))
