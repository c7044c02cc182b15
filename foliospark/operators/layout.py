"""Page layout: lines, columns, reading order, paragraphs and document-level votes.

The unit of work is a page, which is bounded by paper: windows and groups here are keyed by
document and page (or finer), never by document alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import geometry as geo
from foliospark.functions import text as tx
from foliospark.functions.binding import let, let_all
from foliospark.functions.numbers import snap_size

PAGE = ["doc_id", "page_no"]
LINE = [*PAGE, "line_no"]


def box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def lines_of(words: DataFrame, dpi: float = 72.0, bare: bool = False, sized: bool = False) -> DataFrame:
    """Lines with box, ordered words, text and size in points; ``bare`` ones come without words and size, and gather only what the text is made of.

    ``sized`` ones are bare lines with their size: each word brings its height and whether it is sure, too.
    """
    if bare or sized:
        more = ["height", "fsize", "sure"] if sized else []
        words = words.withColumns({"height": F.col("y1") - F.col("y0"), "sure": F.col("conf") >= 50}) if sized else words
        ws = F.sort_array(F.collect_list(F.struct("x0", "word_no", "text", *more)))
        g = words.groupBy(*LINE).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("par").alias("par"), ws.alias("words"))
        size = {"size_pt": geo.line_size(F.col("words"), dpi, lambda w: w["sure"], lambda w: w["height"])} if sized else {}
        return g.withColumns({"text": tx.join_words(F.transform("words", lambda w: w["text"])), **size, "base": F.col("y1"), "n_words": F.size("words")}).drop("words")
    bold = F.col("bold") if "bold" in words.columns else F.lit(None).cast("boolean").alias("bold")
    word = F.struct("x0", "word_no", "text", "y0", "x1", "y1", "conf", "fsize", bold)
    g = words.groupBy(*LINE).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
                                 F.min("par").alias("par"), F.sort_array(F.collect_list(word)).alias("words"))
    return g.withColumns({"text": tx.join_words(F.transform("words", lambda w: w["text"])), "size_pt": geo.line_size(F.col("words"), dpi),
                          "base": F.col("y1"), "n_words": F.size("words")})


def tab_segments(words: DataFrame, em: Column, gap_em: float = 2.5) -> DataFrame:
    """Segment number of each word: a new one after a gap wider than ``gap_em`` em."""
    w = Window.partitionBy(*LINE).orderBy("word_no")
    wide = F.coalesce((F.col("x0") - F.lag("x1").over(w)) > gap_em * em, F.lit(False)).cast("int")
    return words.withColumn("_new", wide).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def tab_rows(words: DataFrame, em: Column, col_left: Column, col_right: Column) -> DataFrame:
    """Segments of tabbed lines with their tab stop: right-set at the margin, else left."""
    s = tab_segments(words, em).groupBy(*LINE, "segment").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max(em).alias("em"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"]), " ").alias("text"))
    line = Window.partitionBy(*LINE)
    order = line.orderBy("segment")
    s = s.withColumns({"segments": F.count(F.lit(1)).over(line), "before": F.lag("x1").over(order)}).filter(F.col("segments") > 1)
    last = F.col("segment") == F.col("segments") - 1
    right = last & ((col_right - F.col("x1")) < 0.04 * (col_right - col_left)) & ((F.col("x0") - F.col("before")) > 4 * F.col("em"))
    return s.withColumn("stop", F.when(F.col("segment") == 0, None).when(right, F.col("x1") - col_left).otherwise(F.col("x0") - col_left)).withColumn(
        "kind", F.when(F.col("segment") == 0, "start").when(right, "right").otherwise("left")).drop("em", "before")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _crossings(starts: pd.Series, ends: pd.Series, limit: pd.Series) -> pd.Series:
    """Places of a page where coverage crosses the limit, in order: the first exceeds it, the second falls to it, and so on."""
    def places(s: np.ndarray, e: np.ndarray, most: float) -> np.ndarray:
        x, at = np.unique(np.concatenate([s, e]).astype("int64"), return_inverse=True)
        over = np.cumsum(np.bincount(at[:len(s)], minlength=len(x)) - np.bincount(at[len(s):], minlength=len(x)))
        opens = over <= most
        return x[opens != np.concatenate([[True], opens[:-1]])] if len(x) else x

    return pd.Series([places(*v) for v in zip(starts, ends, limit)], dtype=object)


def find_columns(words: DataFrame, page_width: float, max_cols: int = 3) -> DataFrame:
    """Text columns of each page as an ordered array of (x0, x1).

    Words are gathered by line and lines by page, which is bounded by paper; everything else happens in that row, and nothing is
    joined back. What lies between a place where coverage by words falls to the limit and the next where it exceeds it is a gutter
    if it is wide enough.
    """
    lines = words.groupBy(*LINE).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n"),
                                     F.collect_list(F.greatest(F.floor("x0"), F.lit(0))).alias("starts"), F.collect_list(F.floor("x1") + 1).alias("ends"))
    body = F.col("n") >= 2
    page = lines.groupBy(*PAGE).agg(
        F.min("x0").alias("min_x"), F.max("x1").alias("max_x"), F.count_if(body).alias("k"), F.sort_array(F.collect_list(F.when(body, F.col("x0")))).alias("lefts"), F.sort_array(F.collect_list(F.when(body, F.col("x1")))).alias("rights"),
        F.collect_list(F.when(body, F.struct(F.col("x0").alias("a"), F.col("x1").alias("b"), "y0", "y1"))).alias("body"),
        *[F.flatten(F.collect_list(F.when(body, F.col(c)))).alias(c) for c in ("starts", "ends")])
    nth = lambda c, share: F.get(c, F.floor(share * (F.size(c) - 1)).cast("int"))
    page = page.withColumns({"left": nth("lefts", 0.02), "right": nth("rights", 0.98)}).drop("lefts", "rights")
    span = F.col("right") - F.col("left")
    page = page.withColumns({"lo": F.floor(F.col("left") + 0.15 * span).cast("double"), "hi": F.floor(F.col("right") - 0.15 * span).cast("double")})
    wide = max(0.02 * page_width, 12)
    gutter = lambda a, b: F.struct(a.alias("a"), b.alias("b"))

    found = (F.col("k") >= 8) & (F.col("right") > F.col("left"))
    page = page.withColumn("crossings", _crossings("starts", "ends", 0.2 * F.col("k"))).drop("starts", "ends")

    def between(x: Column, i: Column) -> Column:
        opens = i % 2 == 1
        low = F.when(opens, F.greatest(x, F.col("lo"))).when(i == 0, F.col("lo"))
        high = F.least(F.when(opens, F.coalesce(F.get("crossings", i + 1), F.col("hi"))).otherwise(x), F.col("hi"))
        return gutter(low.cast("double"), high.cast("double"))

    none = F.array().cast("array<struct<a:double,b:double>>")
    whole = F.when(F.col("hi") - F.col("lo") >= wide, F.array(gutter(F.col("lo"), F.col("hi")))).otherwise(none)
    gutters = F.sort_array(F.filter(F.transform("crossings", between), lambda g: g["b"] - g["a"] >= wide))
    cuts = F.slice(F.when(F.size("crossings") > 0, gutters).otherwise(whole), 1, max_cols - 1)
    page = page.withColumn("cuts", F.when(found, cuts).otherwise(none)).drop("crossings")
    marks = F.concat(F.array("left"), F.flatten(F.transform("cuts", lambda c: F.array(c["a"], c["b"]))), F.array("right"))
    split = let(marks, lambda m: F.transform(F.sequence(F.lit(0), F.floor(F.size(m) / 2).cast("int") - 1), lambda i: F.struct(F.get(m, 2 * i).alias("x0"), F.get(m, 2 * i + 1).alias("x1"))))
    page = page.withColumn("split", F.when(F.size("cuts") > 0, split))

    # Four wide lines in each column, and columns that overlap vertically.
    inside = lambda c, v: (v["a"] >= c["x0"] - 2) & (v["b"] <= c["x1"] + 2) & (v["b"] - v["a"] >= 0.25 * (c["x1"] - c["x0"]))
    part = lambda vs: F.struct(F.size(vs).alias("lines"), F.array_min(F.transform(vs, lambda v: v["y0"])).alias("top"), F.array_max(F.transform(vs, lambda v: v["y1"])).alias("bottom"))
    parts = F.transform("split", lambda c: let(F.filter("body", lambda v: inside(c, v)), part))

    def stands(ps: Column) -> Column:
        shortest = F.array_min(F.transform(ps, lambda p: p["bottom"] - p["top"]))
        shared = F.array_min(F.transform(ps, lambda p: p["bottom"])) - F.array_max(F.transform(ps, lambda p: p["top"]))
        return F.forall(ps, lambda p: p["lines"] >= 4) & (shortest > 0) & (shared >= 0.5 * shortest)

    single = lambda x0, x1: F.array(F.struct(x0.cast("double").alias("x0"), x1.cast("double").alias("x1")))
    otherwise = F.when(F.col("k") < 8, single(F.col("min_x"), F.col("max_x"))).otherwise(single(F.col("left"), F.col("right")))
    return page.withColumn("good", F.when(F.col("split").isNotNull(), let(parts, stands))).select(*PAGE, F.when(F.col("good"), F.col("split")).otherwise(otherwise).alias("cols"))


def two_columns(words: DataFrame, page_width: float) -> DataFrame:
    """Midpoint rule: two columns when the sides leave more than 30 between them."""
    mid = page_width / 2
    g = words.groupBy(*PAGE).agg(F.max(F.when(F.col("x0") < mid - 20, F.col("x0"))).alias("l"), F.min(F.when(F.col("x0") > mid + 20, F.col("x0"))).alias("r"))
    return g.select(*PAGE, F.when(F.col("r") - F.col("l") > 30, 2).otherwise(1).alias("n_cols"))


def split_gutters(words: DataFrame, columns: DataFrame) -> DataFrame:
    """Part number of each word of a line cut where the words leave most of a gutter."""
    gaps = F.expr("CASE WHEN size(cols) > 1 THEN transform(sequence(0, size(cols) - 2), i -> struct(cols[i].x1 AS a, cols[i + 1].x0 AS b)) END")
    d = words.join(columns.select(*PAGE, gaps.alias("gaps")), PAGE)
    w = Window.partitionBy(*LINE).orderBy("word_no")
    d = d.withColumn("_p", F.lag("x1").over(w))
    cut = F.exists("gaps", lambda g: (F.col("_p") <= g["a"] + 0.4 * (g["b"] - g["a"])) & (F.col("x0") >= g["b"] - 0.4 * (g["b"] - g["a"]))
                   & ((F.col("x0") - F.col("_p")) >= 0.6 * (g["b"] - g["a"])))
    return (d.withColumn("_c", F.coalesce(cut, F.lit(False)).cast("int"))
            .withColumn("part", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_p", "_c", "gaps"))


def assign_columns(items: DataFrame, columns: DataFrame) -> DataFrame:
    """Column of each item, -1 when it spans several; ``ncols`` of its page."""
    d = items.join(columns.select(*PAGE, "cols"), PAGE)

    def place(v: Column) -> Column:
        hit = F.filter(v["cols"], lambda c: (F.least(v["x1"], c["x1"]) - F.greatest(v["x0"], c["x0"])) > 0.15 * (c["x1"] - c["x0"]))
        far = F.transform(v["cols"], lambda c, i: F.struct(F.abs((v["x0"] + v["x1"]) / 2 - (c["x0"] + c["x1"]) / 2).alias("d"), i.alias("i")))
        return F.when(F.size(v["cols"]) == 1, 0).when(F.size(hit) >= 2, -1).otherwise(F.array_min(far)["i"])

    return d.withColumns({"ncols": F.size("cols"), "col": let_all(place, cols=F.col("cols"), x0=F.col("x0"), x1=F.col("x1"))})


def reading_order(items: DataFrame) -> DataFrame:
    """Position of each item: full-width items cut bands, inside a band columns are read in turn."""
    by_y = Window.partitionBy(*PAGE).orderBy("y0", "x0", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    full = (F.col("col") == -1) & (F.col("ncols") > 1)
    d = items.withColumn("band", F.when(F.col("ncols") > 1, F.sum(full.cast("int")).over(by_y)).otherwise(0))
    key = F.when(F.col("ncols") > 1, F.col("col")).otherwise(0)
    order = Window.partitionBy(*PAGE).orderBy("band", F.desc(full), key, "y0", "x0", "line_no")
    return d.withColumn("pos", F.row_number().over(order))


def page_bands(items: DataFrame) -> DataFrame:
    """Runs of consecutive items that are in columns or full width."""
    order = Window.partitionBy(*PAGE).orderBy("pos")
    multi = (F.col("ncols") > 1) & (F.col("col") != -1)
    d = items.withColumn("multi", multi).withColumn("_c", F.coalesce((F.lag("multi").over(order) != F.col("multi")).cast("int"), F.lit(0)))
    return d.withColumn("run", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def spacing_before(items: DataFrame) -> DataFrame:
    """Space above each item (top, bottom, run, multi, col, pos): 0 for the first of a page."""
    order = Window.partitionBy(*PAGE).orderBy("pos")
    runs = items.groupBy(*PAGE, "run").agg(F.min("top").alias("run_top"), F.max("bottom").alias("run_bottom"), F.max("multi").alias("run_multi"))
    by_run = Window.partitionBy(*PAGE).orderBy("run")
    runs = runs.withColumn("prev_run_bottom", F.when(F.lag("run_multi").over(by_run), F.lag("run_bottom").over(by_run)))
    d = items.join(runs.drop("run_multi", "run_bottom"), [*PAGE, "run"])
    d = d.withColumns({"_b": F.lag("bottom").over(order), "_c": F.lag("col").over(order), "_r": F.lag("run").over(order)})
    same = F.col("_r") == F.col("run")
    prev = F.when(~same, F.coalesce("prev_run_bottom", "_b")).otherwise(F.col("_b"))
    start = same & F.col("multi") & (F.col("col") != F.col("_c"))
    space = F.when(F.col("_b").isNull(), 0.0).when(start, F.greatest(F.lit(0.0), F.col("top") - F.col("run_top"))).otherwise(F.greatest(F.lit(0.0), F.col("top") - prev))
    return d.withColumn("space_before", space).drop("_b", "_c", "_r", "prev_run_bottom", "run_top")


def page_extents(items: DataFrame, width: float, height: float) -> DataFrame:
    """Margins of each page from its item boxes, clamped."""
    def clamp(v, low, size):
        return F.least(F.greatest(v, F.lit(low)), F.lit(size * 0.4))

    return items.groupBy(*PAGE).agg(clamp(F.min("x0"), 18.0, width).alias("left"), clamp(F.min("y0") - 2, 18.0, height).alias("top"),
                                    clamp(width - F.max("x1"), 18.0, width).alias("right"), clamp(height - F.max("y1") - 30.0, 36.0, height).alias("bottom"))


def line_pitch(lines: DataFrame) -> DataFrame:
    """Median baseline distance over size, from consecutive lines of one paragraph; else 1.2."""
    w = Window.partitionBy(*PAGE).orderBy("pos")
    p = {c: F.lag(c).over(w) for c in ("par", "col", "size_pt", "base")}
    near = (p["par"] == F.col("par")) & (p["col"] == F.col("col")) & (F.abs(p["size_pt"] - F.col("size_pt")) < 0.1 * F.greatest(p["size_pt"], F.lit(1.0))) & (p["size_pt"] > 0)
    r = F.when(near, (F.col("base") - p["base"]) / p["size_pt"])
    d = lines.withColumn("_r", r).withColumn("_r", F.when((F.col("_r") > 0.9) & (F.col("_r") < 2.2), F.col("_r")))
    return d.groupBy(*PAGE).agg(F.when(F.count("_r") >= 3, F.percentile("_r", F.lit(0.5))).otherwise(1.2).alias("pitch"))


def column_extents(lines: DataFrame, columns: DataFrame) -> DataFrame:
    """Extents of each column of a page, and of all of them as column -1: ``col_left, col_right`` as found, ``cl, cr`` from the column's own lines where it has three."""
    pick = lambda c, share: let(F.sort_array(F.collect_list(c)), lambda v: F.when(F.size(v) >= 3, F.get(v, F.floor(share * (F.size(v) - 1)).cast("int"))))
    own = lines.filter("n_words >= 3").groupBy(*PAGE, "col").agg(pick("x0", 0.1).alias("cl"), pick("x1", 0.9).alias("cr"))
    each = columns.select(*PAGE, F.posexplode("cols").alias("col", "c")).join(own, [*PAGE, "col"], "left").select(
        *PAGE, "col", F.col("c.x0").alias("col_left"), F.col("c.x1").alias("col_right"), F.coalesce("cl", "c.x0").alias("cl"), F.coalesce("cr", "c.x1").alias("cr"))
    across = each.groupBy(*PAGE).agg(F.lit(-1).alias("col"), F.min("col_left").alias("col_left"), F.max("col_right").alias("col_right"), F.min("cl").alias("cl"), F.max("cr").alias("cr"))
    return each.unionByName(across)


def first_two(lines: DataFrame) -> Column:
    """The words with their boxes that can be a list marker and the word after it: column ``two``, where lines bring it, so that ``words`` need no heights."""
    return F.col("two") if "two" in lines.columns else F.slice("words", 1, 2)


def paragraph_breaks(lines: DataFrame, columns: DataFrame, pitch: DataFrame) -> DataFrame:
    """Paragraph number of each ordered line (``pos``, ``col``, ``tabbed``, ``words``, ``size_pt``, ``base``, ``par``); ``opens`` marks its first line.

    Most breaks depend on two neighbouring lines. The rest depends on the open list item, which is no more than the place its
    text hangs at, or nothing: a marked line opens it, a line to the left of it, or any hard break, closes it. So between two hard
    breaks the item is known from the first line until the first line that leaves it, and no state has to be folded.
    """
    # Words are moved as arrays of their values, without a row for each.
    word = lines.schema["words"].dataType
    d = lines.withColumns({"_two": first_two(lines), "words": F.struct(*[F.col("words")[f].alias(f) for f in word.elementType.names])})
    # A page's few columns travel as an array, so that lines are moved once, by page.
    extent = F.struct("col", "col_left", "col_right", "cl", "cr")
    page = column_extents(lines, columns).groupBy(*PAGE).agg(F.collect_list(extent).alias("_ext")).join(pitch, PAGE)
    d = d.join(page, PAGE).withColumn("_own", F.filter("_ext", lambda e: e["col"] == F.col("col"))).select(*lines.columns, "_two", "pitch", F.inline("_own").alias("_col", "col_left", "col_right", "cl", "cr"))
    keep = [*lines.columns, "pitch", "cl", "cr", "col_left", "col_right", "mark"]
    d = d.withColumn("mark", geo.list_marker(F.get("_two", F.lit(0)), F.get("_two", F.lit(1)), F.col("size_pt"), F.col("cl")))
    w = Window.partitionBy(*PAGE).orderBy("pos")
    d = d.withColumn("p", F.lag(F.struct("col", "tabbed", "size_pt", "base", "par", "x0", "x1")).over(w))
    p, em, width = F.col("p"), F.greatest(F.col("size_pt"), F.lit(1.0)), F.greatest(F.col("cr") - F.col("cl"), F.lit(1.0))
    new_par = F.col("par") != p["par"]
    big, dist = F.greatest(F.col("size_pt"), p["size_pt"]), F.col("base") - p["base"]
    expect = F.col("pitch") * big
    hard = (p.isNull() | (p["col"] != F.col("col")) | p["tabbed"] | F.col("tabbed") | F.col("mark").isNotNull()
            | (F.abs(F.col("size_pt") - p["size_pt"]) > F.when(new_par, 0.1).otherwise(0.2) * big) | (dist > 1.3 * expect + 0.5) | (dist < 0.3 * expect))
    short = (F.col("cr") - p["x1"]) > 0.3 * width
    indent = ((F.col("x0") - F.col("cl")) > 1.2 * em) & ((p["x0"] - F.col("cl")) < 0.6 * em)
    ragged = (((p["x1"] - p["x0"]) < 0.55 * width) & ((F.col("x1") - F.col("x0")) < 0.55 * width) & ((p["x0"] - F.col("cl")) < 0.1 * width) & (F.abs(p["x0"] - F.col("x0")) < 0.05 * width))
    d = d.withColumns({"hard": hard, "soft": short | (new_par & (indent | ragged)), "hang": F.col("x0") + 1.5 * em}).withColumn("piece", F.sum(F.col("hard").cast("int")).over(w))
    piece = Window.partitionBy(*PAGE, "piece")
    d = d.withColumn("item", F.max(F.when(F.col("hard"), F.col("mark.text_left"))).over(piece))
    d = d.withColumn("leaves", F.min(F.when(~F.col("hard") & (F.col("hang") < F.col("item")), F.col("pos"))).over(piece))
    left = F.col("item").isNull() | (F.col("pos") > F.col("leaves"))
    opens = F.col("hard") | F.coalesce(F.col("pos") == F.col("leaves"), F.lit(False)) | (F.coalesce(left, F.lit(False)) & F.col("soft"))
    d = d.withColumn("opens", opens).withColumn("para", F.sum(F.col("opens").cast("int")).over(w).cast("int"))
    return d.withColumn("words", F.arrays_zip(*[F.col("words")[f] for f in word.elementType.names])).select(*keep, "opens", "para")


def paragraphs(lines: DataFrame, dpi: float = 72.0, gap_em: float = 2.5) -> DataFrame:
    """Paragraph rows from numbered lines: runs of one weight, tab stops, indents, pitch, box, alignment and marker.

    Runs are islands over the words of a paragraph; how a word meets the next is decided by these two. A tabbed paragraph is one line
    and has a run of a tab before each further segment. A list marker leaves the text; the label of a numbered item comes back as its first run.
    """
    para, points = [*PAGE, "para"], 72.0 / dpi
    d = lines.withColumn("_two", first_two(lines))
    em = F.col("size_pt") * dpi / 72.0
    mark = F.when(F.col("opens"), geo.list_marker(F.get("_two", F.lit(0)), F.get("_two", F.lit(1)), em, F.col("col_left")))
    d = d.withColumns({"mark": mark, "em": em, "step": F.col("base") - F.lag("base").over(Window.partitionBy(*para).orderBy("pos"))})

    at_first = lambda c: F.max(F.when(F.col("opens"), F.col(c)))
    line = F.struct("pos", "x0", "x1")
    rows = d.groupBy(*para, "col").agg(
        F.max("col_left").alias("cl"), F.max("col_right").alias("cr"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.percentile("size_pt", F.lit(0.5)).alias("size_pt"), F.count(F.lit(1)).cast("int").alias("n_lines"), at_first("tabbed").alias("tabbed"), at_first("mark").alias("mark"),
        at_first("x0").alias("first_x0"), at_first("base").alias("first_base"), F.max_by("base", "pos").alias("last_base"), at_first("em").alias("em"),
        F.min(F.when(~F.col("opens"), F.col("x0"))).alias("rest_x0"), F.percentile("step", F.lit(0.5)).alias("step"), F.sort_array(F.collect_list(line)).alias("ls"))

    listed = F.col("mark").isNotNull() & ~F.col("tabbed")
    # Lines are moved to their paragraph before they become words, with the values that are read of these.
    read = ["text", "x0", "x1", "bold"]
    ws = d.select(*para, "pos", "tabbed", "em", listed.alias("listed"), *[F.col("words")[c].alias(c) for c in read]).repartition(*para)
    ws = ws.withColumn("words", F.arrays_zip(*read)).select(*para, "pos", "tabbed", "em", "listed", F.posexplode("words").alias("i", "w"))
    ws = ws.filter(~(F.col("listed") & (F.col("i") == 0)) & (F.col("w.text") != "")).select(*para, "pos", "i", "tabbed", "em", "w.text", "w.x0", "w.x1", F.coalesce("w.bold", F.lit(False)).alias("bold"))
    w = Window.partitionBy(*para).orderBy("pos", "i")
    ws = ws.withColumns({"before": F.lag("bold").over(w), "cut": F.coalesce(F.col("tabbed") & (F.col("x0") - F.lag("x1").over(w) > gap_em * F.col("em")), F.lit(False))})
    ws = ws.withColumn("new", F.col("cut") | F.coalesce(F.col("before") != F.col("bold"), F.lit(True)))
    ws = ws.withColumns({"segment": F.sum(F.col("cut").cast("int")).over(w), "run": F.sum(F.col("new").cast("int")).over(w), "next": F.lead(F.struct("text", "bold", "pos", "cut")).over(w)})
    text, nxt = F.col("text"), F.col("next")
    spaced = F.when(tx.both_cjk(text, nxt["text"]), text).otherwise(F.concat(text, F.lit(" ")))
    shorter = F.left(text, F.length(text) - 1)
    how = tx.line_joint(text, nxt["text"], ~F.col("new") | (F.length(text) >= 3))
    split_word = text.rlike(r"\p{L}-$") & nxt["text"].rlike(r"^\p{Ll}")
    joined = F.when(nxt["bold"] != F.col("bold"), F.when(split_word, shorter).otherwise(spaced)).otherwise(F.when(how == "glue", text).when(how == "drop", shorter).otherwise(F.concat(text, F.lit(" "))))
    piece = F.when(nxt.isNull() | nxt["cut"], text).when(nxt["pos"] == F.col("pos"), spaced).otherwise(joined)
    runs = ws.withColumn("piece", piece).groupBy(*para, "segment", "run").agg(F.max("bold").alias("bold"), F.sum(F.length("text") * F.col("bold").cast("int")).alias("bold_letters"), F.sum(F.length("text")).alias("letters"), F.min("x0").alias("a"), F.max("x1").alias("b"),
                                                                             F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "i", "piece"))), lambda x: x["piece"]), "").alias("text"))
    run = F.struct("segment", "run", "text", "bold", "a", "b")
    runs = runs.groupBy(*para).agg(F.sort_array(F.collect_list(run)).alias("all_runs"), F.sum("bold_letters").alias("bold_letters"), F.sum("letters").alias("letters"))

    d = rows.join(runs, para, "left").withColumn("runs", F.filter("all_runs", lambda r: r["text"] != ""))
    # Tab stops: the segments of a tabbed line after the first.
    segment = lambda k: let(F.filter("all_runs", lambda r: r["segment"] == k), lambda rs: F.struct(F.array_min(F.transform(rs, lambda r: r["a"])).alias("a"), F.array_max(F.transform(rs, lambda r: r["b"])).alias("b")))
    n_stops = F.get("all_runs", F.size("all_runs") - 1)["segment"]
    stop = lambda at, kind: F.struct((at * points).cast("double").alias("at"), kind.alias("kind"))

    def stop_of(segments: Column, k: Column) -> Column:
        a, b = F.get(segments, k)["a"], F.get(segments, k)["b"]
        right = (k == n_stops) & (F.col("cr") - b < 0.04 * (F.col("cr") - F.col("cl"))) & (a - F.get(segments, k - 1)["b"] > 4 * F.col("em"))
        return stop(F.when(right, b).otherwise(a) - F.col("cl"), F.when(right, "right").otherwise("left"))

    counted = lambda low: F.sequence(F.lit(low).cast("bigint"), n_stops)
    stops = let(F.transform(counted(0), segment), lambda segments: F.transform(counted(1), lambda k: stop_of(segments, k.cast("int"))))
    d = d.withColumn("stops", F.when(F.col("tabbed") & (n_stops > 0), stops))
    listed, tabbed = F.col("mark").isNotNull() & ~F.col("tabbed"), F.col("tabbed")
    offset = lambda c: (c - F.col("cl")) * points
    ext = F.transform("ls", lambda v: F.struct(v["x0"].alias("x0"), v["x1"].alias("x1")))
    d = d.withColumns({"extents": ext, "cont": F.coalesce("rest_x0", "x0"), "first_at": offset(F.col("first_x0")), "hung": F.greatest(F.lit(0.0), offset(F.col("mark.text_left")))})
    d = d.withColumn("align", F.when(F.col("mark").isNotNull() | tabbed, "left").otherwise(geo.align_of(F.col("extents"), F.col("cl"), F.col("cr"), F.lit(False))))
    flush = F.col("align").isin("left", "justify")
    lone = (F.col("n_lines") == 1) & (F.col("first_x0") - F.col("cl") > 0.06 * (F.col("cr") - F.col("cl")))
    left = F.when(tabbed, 0.0).when(listed, F.col("hung")).when(flush & lone, F.col("first_at")).when(flush & (offset(F.col("cont")) > 6), offset(F.col("cont"))).otherwise(0.0)
    hanging = (F.col("first_x0") - F.col("cont")) * points
    first = (F.when(tabbed, 0.0).when(listed, F.greatest(F.col("first_at"), F.lit(0.0)) - F.col("hung"))
             .when(flush & (F.col("n_lines") > 1) & (F.abs(hanging) > 0.7 * F.col("size_pt")), hanging).otherwise(0.0))
    leading = tabbed & (F.col("first_x0") - F.col("cl") > 0.5 * F.col("em"))
    no_runs, no_tabs = F.array().cast("array<struct<text:string,bold:boolean>>"), F.array().cast("array<struct<at:double,kind:string>>")
    one_run = lambda text: F.array(F.struct(text.alias("text"), F.lit(False).alias("bold")))
    own = F.coalesce(F.flatten(F.transform("runs", lambda r, i: F.concat(F.when((i > 0) & (r["segment"] > F.get("runs", i - 1)["segment"]), one_run(F.lit("\t"))).otherwise(no_runs),
                                                                          F.array(F.struct(r["text"].alias("text"), r["bold"].alias("bold")))))), no_runs)
    label = F.when(listed & (F.col("mark.kind") == "number"), one_run(F.concat("mark.text", F.lit("\t")))).when(leading, one_run(F.lit("\t"))).otherwise(no_runs)
    stops = F.coalesce("stops", no_tabs)
    d = d.withColumns({"runs": F.concat(label, own), "left_indent": left, "first_indent": first, "line_pitch": F.coalesce(F.greatest(F.col("step") * points, "size_pt"), F.lit(0.0)),
                       "tabs": F.when(listed & (F.col("mark.kind") == "number"), F.array(stop(F.col("hung") / points, F.lit("left")))).when(leading, F.concat(F.array(stop(F.col("first_at") / points, F.lit("left"))), stops)).otherwise(stops)})
    pitch = F.when(F.col("line_pitch") > 0, F.col("line_pitch")).otherwise(F.col("size_pt") * 1.2)
    d = d.withColumns({"text": F.array_join(F.transform("runs", lambda r: r["text"]), ""), "top": F.col("first_base") * points - 0.8 * pitch, "bottom": F.col("last_base") * points + 0.2 * pitch})
    heavy = F.coalesce((F.col("letters") > 0) & (F.col("bold_letters") >= 0.7 * F.col("letters")), F.lit(False))
    return d.select(*para, "col", "cl", "cr", "x0", "y0", "x1", "y1", "size_pt", "text", "n_lines", F.when(listed, F.col("mark.kind")).alias("list_kind"), "tabbed", "align", "extents", "runs", "tabs",
                    "left_indent", "first_indent", "line_pitch", "top", "bottom", tx.is_rtl_line(F.col("text")).alias("rtl"), heavy.alias("all_bold"))


def justify_prior(paras: DataFrame) -> DataFrame:
    """Short paragraphs aligned anew, knowing whether their page is mostly justified."""
    plain = F.col("list_kind").isNull() & ~F.col("tabbed")
    long = plain & (F.col("n_lines") >= 3)
    votes = paras.groupBy(*PAGE).agg(F.count_if(long).alias("k"), F.count_if(long & (F.col("align") == "justify")).alias("j"))
    d = paras.join(votes.select(*PAGE, ((F.col("k") >= 2) & (F.col("j") / F.greatest(F.col("k"), F.lit(1)) >= 0.6)).alias("justified")), PAGE)
    redo = geo.align_of(F.col("extents"), F.col("cl"), F.col("cr"), F.col("justified"))
    return d.withColumn("align", F.when(plain & (F.col("n_lines") <= 2), redo).otherwise(F.col("align")))


def body_font_size(items: DataFrame, size: str = "size_pt", weight: Column | None = None) -> DataFrame:
    """Body size of each document: weighted mode of the snapped sizes, the smallest on ties."""
    s = items.select("doc_id", snap_size(F.col(size)).alias("snapped"), (weight if weight is not None else F.lit(1)).alias("w"))
    t = s.groupBy("doc_id", "snapped").agg(F.sum("w").alias("w"))
    return t.groupBy("doc_id").agg(F.max_by("snapped", F.struct("w", -F.col("snapped"))).alias("body"))


def collapse_to_body(size: Column, body: Column) -> Column:
    return let_all(lambda v: F.when(F.abs(v["s"] - v["b"]) / v["b"] < 0.09, v["b"]).otherwise(v["s"]), s=snap_size(size), b=body)


def headings(paras: DataFrame) -> DataFrame:
    """Paragraphs with final sizes and heading levels 1-3 (0 for none).

    The three largest candidate sizes of a document are found by aggregation over its few distinct
    sizes, so no window ever spans a document.
    """
    body = body_font_size(paras, "size_pt", F.greatest(F.length("text"), F.lit(1)))
    d = paras.join(body, "doc_id").withColumn("size_pt", collapse_to_body(F.col("size_pt"), F.col("body")))
    t = F.trim("text")
    cand = (~F.col("tabbed") & F.col("list_kind").isNull() & (F.col("size_pt") >= F.col("body") * 1.15) & (F.col("n_lines") <= 3) & (F.length(t) <= 140) & ~t.endswith("."))
    d = d.withColumn("candidate", cand)
    top = d.filter("candidate").groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_set("size_pt"), asc=False), 1, 3).alias("tops"))
    level = F.coalesce(F.array_position("tops", F.col("size_pt")), F.lit(0))
    return d.join(top, "doc_id", "left").withColumn("heading", F.when(F.col("candidate"), level).otherwise(0).cast("int")).drop("tops", "candidate")


def outline(paras: DataFrame) -> DataFrame:
    """Heading, list or paragraph per row."""
    kind = F.when(F.col("heading") > 0, F.concat(F.lit("heading"), F.col("heading").cast("string"))).when(F.col("list_kind").isNotNull(), F.col("list_kind")).otherwise("paragraph")
    return headings(paras).withColumn("kind", kind)


def dominant_font(spans: DataFrame) -> DataFrame:
    """Main font and size of each document by characters, per script; Latin first, then the others."""
    s = spans.filter(F.trim("text") != "").withColumns({"script": tx.script_class(F.col("text")), "n": F.length(F.trim("text"))})
    def top(value, scripts):
        t = s.filter(F.col("script").isin(scripts) & F.col(value).isNotNull()).groupBy("doc_id", "script", value).agg(F.sum("n").alias("n"), F.min("span_no").alias("first"))
        return t.groupBy("doc_id").agg(*[F.max_by(value, F.when(F.col("script") == k, F.struct("n", -F.col("first")))).alias(f"{k}_{value}") for k in scripts])
    fonts, sizes = top("font", ["latin", "east_asian", "complex"]), top("size", ["latin", "complex"])
    d = fonts.join(sizes, "doc_id", "full_outer")
    return d.select("doc_id", F.coalesce("latin_font", "east_asian_font", "complex_font").alias("font"), F.coalesce("latin_size", "complex_size").alias("size"),
                    F.coalesce("complex_size", "latin_size").alias("size_complex"))


def serif_vote(pages: DataFrame) -> DataFrame:
    """Majority over the pages with a vote; a tie means serif."""
    return pages.filter(F.col("serif").isNotNull()).groupBy("doc_id").agg((F.count_if("serif") * 2 >= F.count(F.lit(1))).alias("serif"))


def rotation_vote(words: DataFrame) -> DataFrame:
    """Turn of each page: the commonest line angle when most of at least five words lie sideways."""
    lines = words.groupBy(*LINE).agg(F.max("textangle").alias("textangle"), F.count(F.lit(1)).alias("n"))
    side = F.col("textangle").isin(90, 180, 270)
    c = lines.groupBy(*PAGE, "textangle").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.min("line_no").alias("first"))
    g = c.groupBy(*PAGE).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0)).alias("sideways"),
                             F.max_by("textangle", F.when(side, F.struct("k", -F.col("first")))).alias("angle"))
    return g.select(*PAGE, F.when((F.col("n") >= 5) & (F.col("sideways") > 0.5 * F.col("n")), F.col("angle")).otherwise(0).alias("rotated"))


def page_suspicious(words: DataFrame, dark: DataFrame) -> DataFrame:
    """Pages whose words look misread: few on a dark page, unsure, or mostly in tall lines."""
    lines = words.groupBy(*LINE).agg(F.count(F.lit(1)).alias("n"), F.sum("conf").alias("c"), (F.max("y1") - F.min("y0")).alias("h"), (F.max("x1") - F.min("x0")).alias("w"))
    tall = (F.col("h") > 1.5 * F.col("w")) & (F.col("n") >= 2)
    g = lines.groupBy(*PAGE).agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.coalesce(F.sum(F.when(tall, F.col("n"))), F.lit(0)).alias("tall"))
    d = dark.join(g, PAGE, "left").fillna(0, ["n", "tall"])
    bad = ((F.col("n") < 3) & (F.col("dark") > 0.02)) | ((F.col("n") >= 3) & (F.col("c") / F.greatest(F.col("n"), F.lit(1)) < 55)) | ((F.col("n") >= 5) & (F.col("tall") > 0.5 * F.col("n")))
    return d.select(*PAGE, F.coalesce(bad, F.lit(False)).alias("suspicious"))


def bold_words(words: DataFrame) -> DataFrame:
    """Bold flag per word from its stroke ratio against the page median; short words follow their neighbours.

    The words are read once: the page's figures come by a window over it, and the sweep along a line by a running ``last``.
    """
    measured = F.when((F.length("text") >= 2) & (F.col("fsize") / geo.FSIZE_TO_EM >= 12), F.col("stroke_ratio"))
    page = Window.partitionBy(*PAGE)
    d = words.dropna(subset=PAGE).select(*LINE, F.col("word_no").cast("long").alias("word_no"), F.length("text").alias("len"), "fsize", F.when(F.col("fsize") > 0, measured).alias("ratio"))
    d = d.withColumns({"k": F.count_if(F.col("fsize") > 0).over(page), "m": F.count("ratio").over(page), "ref": F.percentile("ratio", F.lit(0.5)).over(page),
                       "med": F.percentile(F.when(F.col("fsize") > 0, F.col("fsize")), F.lit(0.5)).over(page)})
    factor = F.when(F.col("fsize") > 1.15 * F.col("med"), 1.2).otherwise(1.28)
    d = d.select(*LINE, "word_no", "len", F.when((F.col("k") >= 15) & (F.col("m") >= 15), F.col("ratio") > F.col("ref") * factor).alias("b0"))
    # The sweep runs left to right: a word sees its left neighbour's final flag and its right one's first. A word either
    # settles its flag by itself or takes over its left neighbour's, so its flag is that of the last word that settled.
    line = Window.partitionBy(*LINE).orderBy("word_no", "b0", "len")
    d = d.withColumns({"nxt": F.coalesce(F.lead("b0").over(line), F.lit(False)),
                       "inner": F.lag(F.lit(True)).over(line).isNotNull() & F.lead(F.lit(True)).over(line).isNotNull()})
    b0, nxt = F.col("b0"), F.col("nxt")
    settled = F.when(b0, F.when((F.col("len") >= 4) | nxt, True)).when(~b0 | ~(F.col("inner") & nxt), False)
    return d.select(*LINE, "word_no", F.coalesce(F.last(settled, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(False)).alias("bold"))


def style_segments(spans: DataFrame) -> DataFrame:
    """Segment of each span of a line, and the space a positional gap stands for."""
    w = Window.partitionBy(*LINE).orderBy("span_no")
    gap = F.col("x0") - F.lag("x1").over(w)
    cut = (gap > 0.6 * F.col("size")) & ~(F.lag("text").over(w).endswith(" ") & (gap < 1.5 * F.col("size")))
    d = spans.withColumn("_c", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("segment", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*LINE, "segment").orderBy("span_no")
    after = F.lead("x0").over(inside) - F.col("x1")
    pad = (after > 0.15 * F.col("size")) & ~F.col("text").endswith(" ") & ~F.lead("text").over(inside).startswith(" ")
    return d.withColumn("text", F.when(F.coalesce(pad, F.lit(False)), F.concat("text", F.lit(" "))).otherwise(F.col("text"))).drop("_c")


def block_grouping(lines: DataFrame) -> DataFrame:
    """Block number: a new one when a line is more than two heights from the line before."""
    w = Window.partitionBy(*PAGE).orderBy("pos")
    cut = F.coalesce((F.abs(F.col("y0") - F.lag("y0").over(w)) > 2 * (F.col("y1") - F.col("y0"))).cast("int"), F.lit(0))
    return lines.withColumn("_c", cut).withColumn("block_no", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


LIST_START = r"^(•|-|●|○|■|▪|►"


def block_type_by_height(blocks: DataFrame) -> DataFrame:
    """Title, heading, list or text from line heights (first_height, first_text, text, y0, page_height_avg)."""
    tall, n = F.col("first_height") / F.col("page_height_avg"), F.length("text")
    head = F.trim(F.substring("first_text", 1, 3))
    listed = F.trim("first_text").rlike(LIST_START + r"|\*)") | ((F.length("first_text") >= 2) & head.rlike(r"^[0-9][.):]"))
    return blocks.withColumn("block_type", F.when(F.col("block_type") != "text", F.col("block_type")).when((tall > 1.5) & (n < 100) & (F.col("y0") < 150), "title")
                             .when((tall > 1.3) & (n < 150), "heading").when(listed, "list").otherwise("text"))


def block_type_by_font(avg_size: Column, median_size: Column, all_bold: Column, first_text: Column, text: Column, elements: Column, scanned: bool) -> Column:
    """Heading, list or paragraph from font sizes; scanned pages compare with their median."""
    if scanned:
        upper = lambda t: t.rlike(r"\p{L}") & (t == F.upper(t))
        title = first_text.rlike(r"^[^\p{L}]*(\p{Lu}\p{Ll}*[^\p{L}]+)*\p{Lu}\p{Ll}*[^\p{L}]*$")
        like = upper(first_text) | title | upper(text)
        heading = (F.length(text) < 150) & ((avg_size > median_size * 1.3) | (like & (elements <= 3)))
    else:
        heading = (avg_size >= 14) | (all_bold & (F.length(first_text) < 100))
    return F.when(heading, "heading").when(first_text.rlike(LIST_START + ")") | first_text.rlike(r"^[0-9][.):]"), "list").otherwise("paragraph")


def text_layer(pages: DataFrame) -> DataFrame:
    """Whether a document has a text layer: at least half its pages hold 20 visible characters."""
    seen = F.length(F.regexp_replace("text", r"(?U)\s", ""))
    g = pages.groupBy("doc_id").agg(F.count_if(seen >= 20).alias("with_text"), F.count(F.lit(1)).alias("total"))
    return g.withColumn("has_layer", F.col("with_text") / F.col("total") >= 0.5)


def is_digital(pages: DataFrame) -> DataFrame:
    n = F.length(tx.strip(F.col("text")))
    return pages.groupBy("doc_id").agg((F.sum(n) > 100).alias("digital"), F.count_if(n < 50).alias("pages_for_ocr"))


def page_editable(lines: DataFrame) -> DataFrame:
    n = F.length(F.replace("text", F.lit(" "), F.lit("")))
    return lines.groupBy(*PAGE).agg((F.sum(n) >= 20).alias("editable"))


UNSAFE = r"[\x{e000}-\x{f8ff}\x{fffd}\x00-\x08\x0b-\x1f\x{200e}\x{200f}\x{202a}-\x{202e}]"


def line_safe(dx: Column, dy: Column, text: Column, smallest: Column, line: tuple[Column, ...], page: tuple[Column, ...]) -> Column:
    """A line that can become an editable text box."""
    inside = geo.overlap_area(line, page) >= 0.9 * geo.box_area(line)
    return ((dx > 0.999) & (F.abs(dy) < 0.02) & ~text.rlike(UNSAFE) & ~text.rlike(f"[{tx.RTL}]") & (smallest >= 1) & inside
            & (line[2] - line[0] > 0.5) & (line[3] - line[1] > 0.5))


def hidden_text(lines: DataFrame, invisible: DataFrame) -> DataFrame:
    """Lines more than half covered by an invisible-text box of their page."""
    inv = invisible.select(*PAGE, *[F.col(c).alias(f"i{c}") for c in ("x0", "y0", "x1", "y1")])
    cover = geo.overlap_area(box(), box("i")) > 0.5 * geo.box_area(box())
    return lines.join(inv, (lines.doc_id == inv.doc_id) & (lines.page_no == inv.page_no) & cover, "left_semi")


def word_in_grid(words: DataFrame, grids: DataFrame, pictures: DataFrame) -> DataFrame:
    """Where each word belongs: the first grid holding its centre, nowhere (noise in a picture), or the text.

    Grids and pictures of a page are few; they travel with the page as arrays, so each word is
    tested in place and no word is sorted or duplicated by a range join.
    """
    g = grids.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("grid_no", "x0", "y0", "x1", "y1"))).alias("grids"))
    p = pictures.groupBy(*PAGE).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("pics"))
    d = words.join(g.hint("shuffle_hash"), PAGE, "left").join(p.hint("shuffle_hash"), PAGE, "left")
    f = lambda b: (b["x0"], b["y0"], b["x1"], b["y1"])
    grid = F.get(F.filter("grids", lambda b: geo.centre_inside(box(), f(b), 2)), F.lit(0))["grid_no"]
    noise = F.exists("pics", lambda b: geo.centre_inside(box(), f(b))) & (F.col("conf") < 85)
    return d.withColumn("grid_no", grid).withColumn("place", F.when(F.col("grid_no").isNotNull(), "table").when(F.coalesce(noise, F.lit(False)), "dropped").otherwise("text")).drop("grids", "pics")


# Layout labels of the detection model and the block types they mean.
LABELS = {"title": "title", "section_header": "heading", "text": "text", "list_item": "list", "table": "table", "figure": "figure", "caption": "caption"}


def layout_labels(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Block type from the last label box that overlaps the block."""
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    b = labels.select(*PAGE, "box_no", F.coalesce(F.try_element_at(known, F.lower("label")), F.lit("text")).alias("named"), *[F.col(c).alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")])
    touch = (F.col("x0") < F.col("lx1")) & (F.col("x1") > F.col("lx0")) & (F.col("y0") < F.col("ly1")) & (F.col("y1") > F.col("ly0"))
    hit = blocks.join(b, PAGE).filter(touch).groupBy(*PAGE, "block_no").agg(F.max_by("named", "box_no").alias("named"))
    return blocks.join(hit, [*PAGE, "block_no"], "left").withColumn("block_type", F.coalesce("named", "block_type")).drop("named")


def extra_pictures(found: DataFrame, known: DataFrame) -> DataFrame:
    """Found boxes that no known picture of the page overlaps by more than 0.3."""
    k = known.select(*PAGE, *[F.col(c).alias(f"k{c}") for c in ("x0", "y0", "x1", "y1")])
    hit = (found.doc_id == k.doc_id) & (found.page_no == k.page_no) & (geo.overlap_share(box(), box("k")) > 0.3)
    return found.join(k, hit, "left_anti")


def reading_order_simple(blocks: DataFrame) -> DataFrame:
    w = Window.partitionBy(*PAGE).orderBy("col", "y0", "block_no")
    return blocks.withColumn("pos", F.row_number().over(w))


def ocr_tsv_lines(words: DataFrame, dpi: float) -> DataFrame:
    """Lines of an OCR word table (block, line_no, left, top, width, height, conf, text)."""
    scale = 72.0 / dpi
    w = words.filter((F.trim("text") != "") & (F.col("conf") > 30))
    g = w.groupBy(*PAGE, "block", "line_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", "word_no", F.trim("text").alias("text")))), lambda v: v["text"]), " ").alias("text"),
        (F.min("left") * scale).alias("x"), (F.min("top") * scale).alias("y"), (F.max(F.col("left") + F.col("width")) * scale).alias("right"),
        (F.max(F.col("top") + F.col("height")) * scale).alias("bottom"), geo.tsv_font_size(F.avg("height"), dpi).alias("font_size"))
    return g.select(*PAGE, "block", "line_no", "text", "x", "y", (F.col("right") - F.col("x")).alias("width"), (F.col("bottom") - F.col("y")).alias("height"), "font_size")
