"""Tables from cell boxes: grid lines, typed rows, headers, continuations, ruled cells."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as geo
from foliospark.functions import text as tx
from foliospark.functions.binding import let, let_all
from foliospark.functions.numbers import is_number, parse_number, snap_size

TABLE = ["doc_id", "page_no", "table_no"]


def _distinct_edges(values: Column, tolerance: float) -> Column:
    """Sorted edges, each more than the tolerance beyond the last one kept."""
    return F.aggregate(F.sort_array(F.array_compact(F.array_distinct(values))), F.array().cast("array<double>"), lambda kept, v: F.when(
        (F.size(kept) == 0) | (v - F.get(kept, F.size(kept) - 1) > tolerance), F.array_append(kept, v)).otherwise(kept))


def _nearest(lines: Column, value: Column) -> Column:
    return F.array_min(F.transform(lines, lambda x, i: F.struct(F.abs(x - value).alias("d"), i.alias("i"))))["i"]


def grid_lines(cells: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Row and column span of each cell; cells over several slots are merged ranges.

    The cells of a table, which lies on one page, are gathered once and placed within that row;
    nothing is joined back. ``filled`` tells whether the table has any text.
    """
    text = F.regexp_replace(tx.strip(F.coalesce("text", F.lit(""))), r"[ \t]*\n[ \t]*", "\n")
    g = cells.groupBy(*TABLE).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1", text.alias("text"))).alias("cs"))

    def edges(cs: Column) -> Column:
        xs = F.array_distinct(F.flatten(F.transform(cs, lambda c: F.array(c["x0"], c["x1"]))))
        ys = F.array_distinct(F.flatten(F.transform(cs, lambda c: F.array(c["y0"], c["y1"]))))
        return let_all(lines, cs=cs, vx=xs, vy=ys, xs=_distinct_edges(xs, tolerance), ys=_distinct_edges(ys, tolerance), filled=F.exists(cs, lambda c: c["text"] != ""))

    def lines(v: Column) -> Column:
        # Cells share their edges: the line of each different edge is looked for once.
        at = lambda edges, kept: F.transform(edges, lambda e: _nearest(kept, e))
        return let_all(place, cs=v["cs"], xs=v["xs"], ys=v["ys"], filled=v["filled"], vx=v["vx"], vy=v["vy"], ax=at(v["vx"], v["xs"]), ay=at(v["vy"], v["ys"]))

    def place(v: Column) -> Column:
        def line(k: str, edge: Column) -> Column:
            return F.coalesce(F.get(v[f"a{k}"], (F.array_position(v[f"v{k}"], edge) - 1).cast("int")), F.lit(0))

        spans = F.transform(v["cs"], lambda c: F.struct(
            line("y", c["y0"]).alias("row_no"), line("x", c["x0"]).alias("col_no"), line("y", c["y1"]).alias("row_end"),
            line("x", c["x1"]).alias("col_end"), c["text"].alias("text"), v["filled"].alias("filled")))
        real = F.filter(spans, lambda s: (s["row_end"] > s["row_no"]) & (s["col_end"] > s["col_no"]))
        return F.struct(v["xs"].alias("xs"), v["ys"].alias("ys"), real.alias("cells"))

    d = g.select(*TABLE, let(F.col("cs"), edges).alias("t")).select(*TABLE, "t.xs", F.inline("t.cells"))
    return d.withColumn("merged", (F.col("row_end") - F.col("row_no") > 1) | (F.col("col_end") - F.col("col_no") > 1))


def table_cells(cells: DataFrame) -> DataFrame:
    """Cells in long form (table, row_no, col_no, text); tables without any text are dropped."""
    return grid_lines(cells).filter("filled")


def header_rows(cells: DataFrame, keys: list[str] = TABLE) -> DataFrame:
    """Whether the first row of each table is a header: not more than half of it numbers."""
    first = cells.filter((F.col("row_no") == 0) & (F.coalesce("text", F.lit("")) != ""))
    g = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_number(F.col("text"))).alias("k"))
    return g.select(*keys, (F.col("k") <= F.floor(F.col("n") / 2)).alias("has_header"))


def table_rows(cells: DataFrame, keys: list[str] = TABLE) -> DataFrame:
    """Typed cells: header cells stay text, others are numbers where they look like it.

    The header vote runs as a window over the table, whose cells already lie together.
    """
    table = Window.partitionBy(*keys)
    first = (F.col("row_no") == 0) & (F.coalesce("text", F.lit("")) != "")
    d = cells.withColumn("v", parse_number(F.col("text"))).select(*cells.columns, "v.*")
    n, k = F.count_if(first).over(table), F.count_if(first & (F.col("kind") != "text")).over(table)
    d = d.withColumns({"_n": n, "_k": k}).withColumn("has_header", (F.col("_n") > 0) & (F.col("_k") <= F.floor(F.col("_n") / 2)))
    typed = (F.col("row_no") > 0) | ~F.col("has_header")
    kind = F.when(F.coalesce("text", F.lit("")) == "", "empty").when(typed, F.col("kind")).otherwise("text")
    return d.withColumns({"kind": kind, "long_value": F.when(typed, F.col("long_value")), "double_value": F.when(typed, F.col("double_value"))}).drop("_n", "_k")


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk sorted tables; only the head of the open chain is held."""
    place, head, at = None, None, None
    for pdf in batches:
        out = []
        for doc, run, page, no, n_cols, widths, header, merged in pdf.itertuples(index=False):
            if (doc, run) != place:
                place, head = (doc, run), None
            follows = head is not None and page == at + 1 and n_cols == head[2] and not merged and not head[5]
            same = follows and list(header) == list(head[4])
            joins = same or (follows and len(widths) and len(head[3]) and all(abs(x - y) < 3 for x, y in zip(head[3], widths)))
            if not joins:
                head = (page, no, n_cols, widths, header, merged)
            at = page
            out.append((doc, page, no, head[0], head[1], same))
        yield pd.DataFrame(out, columns=["doc_id", "page_no", "table_no", "head_page", "head_table", "drop_header"])


def table_chains(tables: DataFrame) -> DataFrame:
    """Head of each table's chain: a table on the next page continues the chain whose head looks alike.

    ``tables`` has doc_id, page_no, table_no, n_cols, widths, header, merged. A chain can only run
    over consecutive pages, so documents are first cut where a page without tables ends every
    chain, by a window over the tables themselves: they are read once. Likeness to a head is no equivalence, so a run of pages is walked in order: its rows stream
    through a task that holds one head, and no row or array grows with the run.
    """
    w = Window.partitionBy("doc_id").orderBy("page_no")
    before = F.lag("page_no").over(w)
    cut = before.isNull() | (before < F.col("page_no") - 1)
    runs = tables.dropna(subset=["doc_id", "page_no"]).withColumn("_cut", cut.cast("int")).withColumn("run", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    look = [F.col("page_no").cast("long").alias("page_no"), F.col("table_no").cast("long").alias("table_no"), "n_cols", F.coalesce("widths", F.array().cast("array<double>")).alias("widths"),
            F.transform("header", lambda h: F.coalesce(h, F.lit(""))).alias("header"), F.coalesce("merged", F.lit(False)).alias("merged")]
    placed = runs.select("doc_id", "run", *look).repartition("doc_id", "run").sortWithinPartitions("doc_id", "run", "page_no", "table_no")
    doc = tables.schema["doc_id"].dataType.simpleString()
    return placed.mapInPandas(_chained, f"doc_id {doc}, page_no long, table_no long, head_page long, head_table long, drop_header boolean")


def ruled_cells(words: DataFrame, grids: DataFrame, dpi: float = 72.0) -> DataFrame:
    """Cells of ruled tables from the words inside: text, alignment, bold and table size.

    ``words`` has grid_no set; ``grids`` has xs and ys, the ruled line positions. The words are read once, the size of a
    table comes by a window over those inside it.
    """
    key = ["doc_id", "page_no", "grid_no"]
    d = words.filter(F.col("grid_no").isNotNull()).join(grids.select(*key, "xs", "ys").hint("shuffle_hash"), key)
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    d = d.withColumns({"col_no": geo.grid_index(F.col("xs"), cx), "row_no": geo.grid_index(F.col("ys"), cy), "cy": cy})
    d = d.withColumn("middle", F.percentile(F.when(F.col("fsize") > 0, F.col("fsize")), F.lit(0.5)).over(Window.partitionBy(*key)))
    ws = F.sort_array(F.collect_list(F.struct("cy", "x0", "word_no", "text", F.col("y1") - F.col("y0"))))
    g = d.groupBy(*key, "row_no", "col_no").agg(ws.alias("ws"), F.min("x0").alias("tx0"), F.max("x1").alias("tx1"), F.bool_and("bold").alias("all_bold"),
                                               F.first("xs").alias("xs"), F.first("middle").alias("middle"))
    # Visual lines of a cell: a word starts one when its centre leaves the line's first word by 0.6 of its height.
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("n"), F.array().cast("array<struct<n:int,x0:double,text:string>>").alias("out"))

    def step(a: Column, w: Column) -> Column:
        new = a["anchor"].isNull() | (F.abs(w["cy"] - a["anchor"]) >= 0.6 * w["col5"])
        return let(new, lambda b: F.struct(F.when(b, w["cy"]).otherwise(a["anchor"]).alias("anchor"), (a["n"] + b.cast("int")).alias("n"),
                                           F.array_append(a["out"], F.struct((a["n"] + b.cast("int")).alias("n"), w["x0"].alias("x0"), w["text"].alias("text"))).alias("out")))

    placed = F.array_sort(F.aggregate("ws", start, step, lambda a: a["out"]))
    lines = let(placed, lambda p: F.transform(F.array_distinct(F.transform(p, lambda w: w["n"])), lambda k: tx.join_words(
        F.transform(F.filter(p, lambda w: w["n"] == k), lambda w: w["text"]))))
    left, right = F.get("xs", F.col("col_no")), F.get("xs", F.col("col_no") + 1)
    size = F.when(F.col("middle").isNotNull(), snap_size(F.col("middle") * 72.0 / dpi / geo.FSIZE_TO_EM))
    return g.select(*key, "row_no", "col_no", tx.paragraph_text(lines).alias("text"),
                    geo.cell_align(F.col("tx0") - left, right - F.col("tx1"), right - left).alias("align"), "all_bold", size.alias("size"))
