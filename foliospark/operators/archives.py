"""Names inside an archive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.names import path_stem, path_suffix
from foliospark.operators.skew import bucketed_row_number


def _family_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk the sorted names of each family; a name starts to look for a free number where it last found one."""
    family, used, reached = None, set(), {}
    for pdf in batches:
        names = []
        for job, root, arcname, stem, ext in zip(pdf["job"], pdf["_root"], pdf["arcname"], pdf["_stem"], pdf["_ext"]):
            if (job, root) != family:
                family, used, reached = (job, root), set(), {}
            name, n = arcname, reached.get(arcname, 1)
            while name in used:
                n += 1
                name = f"{stem}_{n}{ext}"
            used.add(name)
            reached[arcname] = n
            names.append(name)
        yield pdf[["job", "pos", "arcname"]].assign(name=names)


def zip_names(entries: DataFrame, block: int = 100_000) -> DataFrame:
    """Distinct entry names per job (job, pos, arcname): repeats get ``_2``, ``_3``, skipping taken ones.

    Two names can only meet when they are equal but for trailing ``_n``; so a job is cut into such
    families. A family of one name needs ranks only, taken in blocks so that one very common
    name is spread. A family of several names of one archive is walked in order, in linear time: its
    rows stream through a task that remembers the names given so far.
    """
    d = entries.withColumns({"_stem": path_stem(F.col("arcname")), "_ext": path_suffix(F.col("arcname"))})
    d = d.withColumn("_root", F.concat(F.regexp_replace("_stem", r"(_[0-9]+)+$", ""), "_ext"))
    kinds = d.groupBy("job", "_root").agg((F.min("arcname") != F.max("arcname")).alias("_mixed"))
    d = d.join(kinds, ["job", "_root"])
    plain = bucketed_row_number(d.filter(~F.col("_mixed")), ["job", "arcname"], ["pos"], F.floor(F.col("pos") / block), "_n")
    named = F.when(F.col("_n") == 1, F.col("arcname")).otherwise(F.concat("_stem", F.lit("_"), F.col("_n").cast("string"), "_ext"))
    simple = plain.select("job", "pos", "arcname", named.alias("name"))
    mixed = d.filter("_mixed").select("job", "_root", F.col("pos").cast("long").alias("pos"), "arcname", "_stem", "_ext")
    walked = mixed.repartition("job", "_root").sortWithinPartitions("job", "_root", "pos").mapInPandas(_family_names, simple.withColumn("pos", F.col("pos").cast("long")).schema)
    return simple.unionByName(walked)
