"""Catalogue: page layout, tables and folds over word boxes derived from ``documents``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as geo
from foliospark.functions.numbers import SIZE_STEPS
from foliospark.operators import folds, layout, tables
from foliospark.plans.fixtures import ctes, table, view
from foliospark.plans.registry import query
from foliospark.sources.scratch import dropped, written
from foliospark.sources.sinks import write_tables

W = ctes("words")
T2 = ctes("two_col_words")


def _words(spark, d):
    return view(spark, d, "words")


def _lines(spark, d):
    return layout.lines_of(_words(spark, d))


def _two_columns(spark, d):
    """Words of a two-column page: each side's line is a line of its own; long words are bold."""
    return view(spark, d, "two_col_words").withColumns({"line_no": F.col("line_no") * 2 + F.col("side"), "bold": F.length("text") >= 8})


def _ordered(spark, d):
    """Lines with column, order, band and tab flag (every tenth line), on two-column pages.

    Both tables feed several later steps, so they are written once instead of computed for each.
    """
    w = _two_columns(spark, d)
    cols = written(spark, layout.find_columns(w, 1224), "columns")
    lines = layout.reading_order(layout.assign_columns(layout.lines_of(w), cols)).withColumn("tabbed", F.col("line_no") % 10 == 9)
    # Of a word, what comes after the size of its line needs text, sides and weight; of the first two, which can be a list marker, the whole box.
    part = lambda *fields: lambda w: F.struct(*[w[c].alias(c) for c in fields])
    words = {"two": F.transform(F.slice("words", 1, 2), part("text", "x0", "y0", "x1", "y1")), "words": F.transform("words", part("text", "x0", "x1", "bold"))}
    return written(spark, lines.drop("cols", "text", "band", "ncols").withColumns(words), "lines"), cols


@query("line_boxes", W + "SELECT doc_id, page_no, line_no, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, string_agg(text, ' ' ORDER BY word_no) AS text FROM words GROUP BY ALL")
def _(spark, d):
    return _lines(spark, d).select("doc_id", "page_no", "line_no", "x0", "x1", "y0", "y1", "text")


@query("line_size", W + r"""SELECT doc_id, page_no, line_no, round(CASE WHEN length(t) >= 6 AND regexp_matches(t, '[\p{Lu}\p{Nd}bdfhklt]') AND NOT regexp_matches(t, '[gjpqy,;()\[\]{}|/@Q]') AND NOT regexp_matches(t, '[^\x{00}-\x{2ff}]') AND 0.9 * b <= a * 1.35 AND b > a THEN least(b, a * 1.3) ELSE a END, 6) AS size_pt
 FROM (SELECT doc_id, page_no, line_no, string_agg(text, '' ORDER BY word_no) AS t, coalesce(median(fsize) FILTER (conf >= 50), median(fsize)) / 0.925 AS a, max(y1 - y0) / 0.70 AS b FROM words GROUP BY ALL)""")
def _(spark, d):
    return _lines(spark, d).select("doc_id", "page_no", "line_no", F.round("size_pt", 6).alias("size_pt"))


@query("tab_segments", W + "SELECT doc_id, page_no, line_no, word_no, CAST(sum(g) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY word_no) AS BIGINT) AS segment FROM (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY word_no) > 2.5 * 11 THEN 1 ELSE 0 END AS g FROM words)")
def _(spark, d):
    return layout.tab_segments(_words(spark, d), F.lit(11.0)).select("doc_id", "page_no", "line_no", "word_no", "segment")


@query("tab_rows", W.rstrip() + """, s AS (SELECT *, sum(g) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY word_no) AS seg FROM (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY word_no) > 2.5 * 11 THEN 1 ELSE 0 END AS g FROM words)),
 t AS (SELECT doc_id, page_no, line_no, seg, min(x0) AS x0, max(x1) AS x1, string_agg(text, ' ' ORDER BY word_no) AS text FROM s GROUP BY ALL),
 u AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_no, line_no) AS n, lag(x1) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY seg) AS b FROM t)
 SELECT doc_id, page_no, line_no, CAST(seg AS BIGINT) AS segment, text, CASE WHEN seg = 0 THEN 'start' WHEN seg = n - 1 AND 548 - x1 < 0.04 * 476 AND x0 - b > 44 THEN 'right' ELSE 'left' END AS kind,
 CASE WHEN seg = 0 THEN NULL WHEN seg = n - 1 AND 548 - x1 < 0.04 * 476 AND x0 - b > 44 THEN x1 - 72 ELSE x0 - 72 END AS stop FROM u WHERE n > 1""")
def _(spark, d):
    return layout.tab_rows(_words(spark, d), F.lit(11.0), F.lit(72.0), F.lit(548.0)).select("doc_id", "page_no", "line_no", "segment", "text", "kind", "stop")


#: Words, lines and columns of two-column pages; ``fc`` has a row per column.
_COLUMNS = T2.rstrip() + r""", w0 AS (SELECT * EXCLUDE (line_no, side), line_no * 2 + side AS line_no, length(text) >= 8 AS bold FROM two_col_words),
 l0 AS (SELECT doc_id, page_no, line_no, count(*) AS n, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, max(y1) AS base, min(par) AS par, string_agg(text, '' ORDER BY x0, word_no) AS t,
   coalesce(median(fsize) FILTER (conf >= 50), median(fsize)) / 0.925 AS a, max(y1 - y0) / 0.70 AS b FROM w0 GROUP BY ALL),
 l AS (SELECT * EXCLUDE (t, a, b), CASE WHEN length(t) >= 6 AND regexp_matches(t, '[\p{Lu}\p{Nd}bdfhklt]') AND NOT regexp_matches(t, '[gjpqy,;()\[\]{}|/@Q]') AND NOT regexp_matches(t, '[^\x{00}-\x{2ff}]')
   AND 0.9 * b <= a * 1.35 AND b > a THEN least(b, a * 1.3) ELSE a END AS size_pt FROM l0),
 pg AS (SELECT doc_id, page_no, min(x0) AS mn, max(x1) AS mx, count(*) FILTER (n >= 2) AS k, list_sort(list(x0) FILTER (n >= 2)) AS xs, list_sort(list(x1) FILTER (n >= 2)) AS ys FROM l GROUP BY ALL),
 ps AS (SELECT *, xs[floor(0.02 * (k - 1))::INT + 1] AS lf, ys[floor(0.98 * (k - 1))::INT + 1] AS rt FROM pg),
 pb AS (SELECT *, floor(lf + 0.15 * (rt - lf)) AS lo, floor(rt - 0.15 * (rt - lf)) AS hi FROM ps),
 ev AS (SELECT doc_id, page_no, x, sum(d) AS d FROM (SELECT doc_id, page_no, greatest(floor(w0.x0), 0) AS x, 1 AS d FROM w0 JOIN l USING (doc_id, page_no, line_no) WHERE n >= 2
   UNION ALL SELECT doc_id, page_no, floor(w0.x1) + 1, -1 FROM w0 JOIN l USING (doc_id, page_no, line_no) WHERE n >= 2) GROUP BY ALL),
 cv AS (SELECT ev.*, sum(d) OVER (PARTITION BY doc_id, page_no ORDER BY x) AS o, 0.2 * k AS lim, lo, hi FROM ev JOIN pb USING (doc_id, page_no)),
 cx AS (SELECT *, lead(x) OVER w AS nx, row_number() OVER w AS rn FROM cv WHERE (o - d <= lim) <> (o <= lim) WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY x)),
 ga AS (SELECT doc_id, page_no, CASE WHEN o <= lim THEN greatest(x, lo) WHEN rn = 1 THEN lo END AS a, CASE WHEN o <= lim THEN least(coalesce(nx, hi), hi) ELSE least(x, hi) END AS b FROM cx),
 gn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY a) AS i FROM (SELECT * FROM ga UNION ALL SELECT doc_id, page_no, lo, hi FROM pb ANTI JOIN cx USING (doc_id, page_no)) WHERE b - a >= 24.48),
 gc AS (SELECT doc_id, page_no, list(a ORDER BY i) AS cas, list(b ORDER BY i) AS cbs FROM gn JOIN pb USING (doc_id, page_no) WHERE i <= 2 AND k >= 8 AND rt > lf GROUP BY ALL),
 tc AS (SELECT doc_id, page_no, i AS col, CASE WHEN i = 0 THEN lf ELSE cbs[i] END AS x0, CASE WHEN i = len(cas) THEN rt ELSE cas[i + 1] END AS x1, len(cas) + 1 AS m FROM (SELECT *, unnest(range(len(cas) + 1)) AS i FROM gc JOIN pb USING (doc_id, page_no))),
 tb AS (SELECT tc.doc_id, tc.page_no, m, col, count(*) AS c, min(y0) AS t, max(y1) AS b FROM tc JOIN l ON l.doc_id = tc.doc_id AND l.page_no = tc.page_no AND l.n >= 2 AND l.x0 >= tc.x0 - 2 AND l.x1 <= tc.x1 + 2 AND l.x1 - l.x0 >= 0.25 * (tc.x1 - tc.x0) GROUP BY ALL),
 ok AS (SELECT doc_id, page_no FROM tb GROUP BY doc_id, page_no HAVING count(*) = any_value(m) AND min(c) >= 4 AND min(b - t) > 0 AND min(b) - max(t) >= 0.5 * min(b - t)),
 fc AS (SELECT doc_id, page_no, col::INT AS col, x0, x1 FROM tc SEMI JOIN ok USING (doc_id, page_no) UNION ALL SELECT doc_id, page_no, 0, CASE WHEN k < 8 THEN mn ELSE lf END, CASE WHEN k < 8 THEN mx ELSE rt END FROM pb ANTI JOIN ok USING (doc_id, page_no))"""


@query("find_columns", _COLUMNS + " SELECT doc_id, page_no, col, x0, x1 FROM fc")
def _(spark, d):
    c = layout.find_columns(_two_columns(spark, d), 1224)
    return c.select("doc_id", "page_no", F.posexplode("cols").alias("col", "c")).select("doc_id", "page_no", "col", "c.x0", "c.x1")


@query("two_columns", T2 + "SELECT doc_id, page_no, CASE WHEN min(x0) FILTER (x0 > 632) - max(x0) FILTER (x0 < 592) > 30 THEN 2 ELSE 1 END AS n_cols FROM two_col_words GROUP BY ALL")
def _(spark, d):
    return layout.two_columns(view(spark, d, "two_col_words"), 1224)


_GUT = [(548.0, 632.0)]


@query("split_gutters", T2.rstrip() + """, w AS (SELECT *, side * 12 + word_no AS wn FROM two_col_words), g AS (SELECT *, lag(x1) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY wn) AS p FROM w)
 SELECT doc_id, page_no, line_no, wn AS word_no, CAST(sum(CASE WHEN p <= 548 + 0.4 * 84 AND x0 >= 632 - 0.4 * 84 AND x0 - p >= 0.6 * 84 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY wn) AS BIGINT) AS part FROM g""")
def _(spark, d):
    w = view(spark, d, "two_col_words").withColumn("word_no", F.col("side") * 12 + F.col("word_no"))
    fixed = F.array(F.struct(F.lit(72.0).alias("x0"), F.lit(548.0).alias("x1")), F.struct(F.lit(632.0).alias("x0"), F.lit(1108.0).alias("x1")))
    cols = w.select("doc_id", "page_no").distinct().withColumn("cols", fixed)
    return layout.split_gutters(w, cols).select("doc_id", "page_no", "line_no", "word_no", "part")


_COLS2 = "VALUES (0, 72.0, 548.0), (1, 632.0, 1108.0)"


def _fixed_items(spark, d):
    """Lines with a full-width heading line per page, on two fixed columns."""
    lines = layout.lines_of(_two_columns(spark, d))
    wide = F.when(F.col("line_no") == 10, F.col("x1") + 600).otherwise(F.col("x1"))
    fixed = F.array(F.struct(F.lit(72.0).alias("x0"), F.lit(548.0).alias("x1")), F.struct(F.lit(632.0).alias("x0"), F.lit(1108.0).alias("x1")))
    items = lines.withColumn("x1", wide)
    return layout.assign_columns(items, items.select("doc_id", "page_no").distinct().withColumn("cols", fixed))


_ITEMS = T2.rstrip() + """, items AS (SELECT doc_id, page_no, line_no * 2 + side AS line_no, min(x0) AS x0, max(x1) + CASE WHEN line_no * 2 + side = 10 THEN 600 ELSE 0 END AS x1, min(y0) AS y0, max(y1) AS y1 FROM two_col_words GROUP BY doc_id, page_no, line_no, side),
 a AS (SELECT *, CASE WHEN least(x1, 548) - greatest(x0, 72) > 0.15 * 476 AND least(x1, 1108) - greatest(x0, 632) > 0.15 * 476 THEN -1 WHEN abs((x0 + x1) / 2 - 310) <= abs((x0 + x1) / 2 - 870) THEN 0 ELSE 1 END AS col FROM items),
 b AS (SELECT *, count(*) FILTER (col = -1) OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, line_no ROWS UNBOUNDED PRECEDING) AS band FROM a),
 o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY band, col = -1 DESC, col, y0, x0, line_no) AS pos FROM b)"""


@query("assign_columns", _ITEMS + " SELECT doc_id, page_no, line_no, col FROM a")
def _(spark, d):
    return _fixed_items(spark, d).select("doc_id", "page_no", "line_no", "col")


@query("bands", _ITEMS + " SELECT doc_id, page_no, line_no, band FROM o")
def _(spark, d):
    return layout.reading_order(_fixed_items(spark, d)).select("doc_id", "page_no", "line_no", "band")


@query("reading_order", _ITEMS + " SELECT doc_id, page_no, line_no, col, pos FROM o")
def _(spark, d):
    return layout.reading_order(_fixed_items(spark, d)).select("doc_id", "page_no", "line_no", "col", "pos")


_RUNS = _ITEMS + """, r AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id, page_no ORDER BY pos) AS run FROM (SELECT *, CASE WHEN (lag(col) OVER (PARTITION BY doc_id, page_no ORDER BY pos) = -1) <> (col = -1) THEN 1 ELSE 0 END AS ch FROM o))"""


@query("page_bands", _RUNS + " SELECT doc_id, page_no, line_no, col <> -1 AS multi, CAST(run AS BIGINT) AS run FROM r")
def _(spark, d):
    return layout.page_bands(layout.reading_order(_fixed_items(spark, d))).select("doc_id", "page_no", "line_no", "multi", "run")


@query("spacing_before", _RUNS + """, q AS (SELECT doc_id, page_no, run, min(y0) AS rt, max(y1) AS rb, bool_or(col <> -1) AS rm FROM r GROUP BY ALL), q2 AS (SELECT *, lag(rb) OVER (PARTITION BY doc_id, page_no ORDER BY run) AS pb, lag(rm) OVER (PARTITION BY doc_id, page_no ORDER BY run) AS pm FROM q),
 z AS (SELECT r.*, rt, pb, pm, lag(y1) OVER w AS lb, lag(col) OVER w AS lc, lag(r.run) OVER w AS lr FROM r JOIN q2 USING (doc_id, page_no, run) WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY pos))
 SELECT doc_id, page_no, line_no, CAST(CASE WHEN lb IS NULL THEN 0 WHEN lr = run AND col <> -1 AND col <> lc THEN greatest(0, y0 - rt) WHEN lr = run THEN greatest(0, y0 - lb) WHEN pm THEN greatest(0, y0 - pb) ELSE greatest(0, y0 - lb) END AS DOUBLE) AS space_before FROM z""")
def _(spark, d):
    items = layout.page_bands(layout.reading_order(_fixed_items(spark, d))).withColumns({"top": F.col("y0"), "bottom": F.col("y1")})
    return layout.spacing_before(items).select("doc_id", "page_no", "line_no", "space_before")


@query("page_extents", W + """SELECT doc_id, page_no, least(greatest(min(x0), 18), 612 * 0.4)::DOUBLE AS "left", least(greatest(min(y0) - 2, 18), 792 * 0.4)::DOUBLE AS top, least(greatest(612 - max(x1), 18), 612 * 0.4)::DOUBLE AS "right", least(greatest(792 - max(y1) - 30, 36), 792 * 0.4)::DOUBLE AS bottom FROM words GROUP BY ALL""")
def _(spark, d):
    return layout.page_extents(_words(spark, d), 612.0, 792.0)


@query("line_pitch", W.rstrip() + """, l AS (SELECT doc_id, page_no, line_no, min(par) AS par, max(y1) AS base FROM words GROUP BY ALL), r AS (SELECT *, (base - lag(base) OVER w) / 11.0 AS r, lag(par) OVER w = par AS same FROM l WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_no))
 SELECT doc_id, page_no, CASE WHEN count(*) FILTER (same AND r > 0.9 AND r < 2.2) >= 3 THEN round(median(r) FILTER (same AND r > 0.9 AND r < 2.2), 9) ELSE 1.2 END AS pitch FROM r GROUP BY ALL""")
def _(spark, d):
    lines = _lines(spark, d).withColumns({"pos": F.col("line_no"), "col": F.lit(0), "size_pt": F.lit(11.0)})
    return layout.line_pitch(lines).select("doc_id", "page_no", F.round("pitch", 9).alias("pitch"))


def _mark(em: str, left: str) -> str:
    """SQL struct of the list marker of a line from its first two words ``f`` and ``g``, null without one."""
    number, width, gap = "^(\\(?[0-9]{1,3}[.)]|\\(?[a-zA-Z][.)]|\\(?[ivxIVX]{1,4}[.)])$", "(f.x1 - f.x0)", "(g.x0 - f.x1)"
    numeric = f"regexp_matches(f.text, '{number}') AND {gap} >= 0.2 * {em}"
    symbol = f"(list_contains({geo.BULLET_CHARS + geo.BULLET_SYMBOLS}, f.text) OR (length(f.text) <= 1 AND NOT regexp_matches(f.text, '^[\\p{{L}}\\p{{N}}]$')))"
    return f"""CASE WHEN {numeric} THEN CASE WHEN regexp_matches(regexp_replace(f.text, '[().]', '', 'g'), '^[0-9]+$') OR f.x0 - {left} >= 0.8 * {em} THEN {{kind: 'number', label: f.text, hang: g.x0}} END
 WHEN {symbol} THEN CASE WHEN {gap} >= 0.45 * {em} AND {width} <= 1.2 * {em} THEN {{kind: 'bullet', label: f.text, hang: g.x0}} END
 WHEN list_contains({geo.BULLET_LETTERS}, f.text) AND {gap} >= 0.6 * {em} AND {width} <= 0.7 * {em} AND f.y1 - f.y0 < 0.7 * (g.y1 - g.y0) AND f.x0 - {left} >= 0 THEN {{kind: 'bullet', label: f.text, hang: g.x0}} END"""


#: Numbered lines ``nl``: the breaks are walked line by line with the open item as the only state.
_BREAKS = _COLUMNS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", ac AS (SELECT l.doc_id, l.page_no, line_no, any_value(l.x0) AS x0, any_value(l.x1) AS x1, any_value(y0) AS y0, any_value(n) AS n, count(*) AS ncols,
   count(*) FILTER (least(l.x1, fc.x1) - greatest(l.x0, fc.x0) > 0.15 * (fc.x1 - fc.x0)) AS hits, min(struct_pack(d := abs((l.x0 + l.x1) / 2 - (fc.x0 + fc.x1) / 2), i := col)).i AS best FROM l JOIN fc USING (doc_id, page_no) GROUP BY l.doc_id, l.page_no, line_no),
 ab AS (SELECT *, CASE WHEN ncols = 1 THEN 0 WHEN hits >= 2 THEN -1 ELSE best END AS col FROM ac),
 ad AS (SELECT *, CASE WHEN ncols > 1 THEN count(*) FILTER (col = -1) OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, line_no ROWS UNBOUNDED PRECEDING) ELSE 0 END AS band FROM ab),
 ao AS (SELECT doc_id, page_no, line_no, col, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY band, (col = -1 AND ncols > 1) DESC, CASE WHEN ncols > 1 THEN col ELSE 0 END, y0, x0, line_no) AS pos FROM ad),
 ol AS (SELECT l.*, col, pos, line_no % 10 = 9 AS tabbed FROM l JOIN ao USING (doc_id, page_no, line_no)),
 pr AS (SELECT *, (base - lag(base) OVER w) / lag(size_pt) OVER w AS r, lag(par) OVER w = par AND lag(col) OVER w = col AND abs(lag(size_pt) OVER w - size_pt) < 0.1 * greatest(lag(size_pt) OVER w, 1) AS near FROM ol WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY pos)),
 pt AS (SELECT doc_id, page_no, CASE WHEN count(*) FILTER (near AND r > 0.9 AND r < 2.2) >= 3 THEN median(r) FILTER (near AND r > 0.9 AND r < 2.2) ELSE 1.2 END AS pitch FROM pr GROUP BY ALL),
 xs AS (SELECT doc_id, page_no, col, list_sort(list(x0)) AS a, list_sort(list(x1)) AS b FROM ol WHERE n >= 3 GROUP BY ALL),
 ce AS (SELECT fc.doc_id, fc.page_no, fc.col, x0 AS c0, x1 AS c1, CASE WHEN len(a) >= 3 THEN a[floor(0.1 * (len(a) - 1))::INT + 1] ELSE x0 END AS cl, CASE WHEN len(b) >= 3 THEN b[floor(0.9 * (len(b) - 1))::INT + 1] ELSE x1 END AS cr FROM fc LEFT JOIN xs USING (doc_id, page_no, col)),
 ca AS (SELECT * FROM ce UNION ALL SELECT doc_id, page_no, -1, min(c0), max(c1), min(cl), max(cr) FROM ce GROUP BY ALL),
 wr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, line_no ORDER BY x0, word_no) - 1 AS i FROM w0),
 lm AS (SELECT o.*, c0, c1, cl, cr, pitch, greatest(size_pt, 1) AS em, {_mark("greatest(size_pt, 1)", "cl")} AS mk, {_mark("greatest(size_pt, 1)", "c0")} AS own FROM ol o JOIN ca USING (doc_id, page_no, col) JOIN pt USING (doc_id, page_no)
   LEFT JOIN wr f ON f.doc_id = o.doc_id AND f.page_no = o.page_no AND f.line_no = o.line_no AND f.i = 0 LEFT JOIN wr g ON g.doc_id = o.doc_id AND g.page_no = o.page_no AND g.line_no = o.line_no AND g.i = 1),
 lg AS (SELECT *, lag(col) OVER w AS pc, lag(tabbed) OVER w AS ptab, lag(size_pt) OVER w AS psz, lag(base) OVER w AS pbase, lag(par) OVER w AS ppar, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1 FROM lm WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY pos)),
 lh AS (SELECT *, pc IS NULL OR pc <> col OR ptab OR tabbed OR mk IS NOT NULL OR abs(size_pt - psz) > CASE WHEN par <> ppar THEN 0.1 ELSE 0.2 END * greatest(size_pt, psz) OR base - pbase > 1.3 * pitch * greatest(size_pt, psz) + 0.5 OR base - pbase < 0.3 * pitch * greatest(size_pt, psz) AS hard,
   cr - px1 > 0.3 * greatest(cr - cl, 1) OR (par <> ppar AND ((x0 - cl > 1.2 * em AND px0 - cl < 0.6 * em) OR (px1 - px0 < 0.55 * greatest(cr - cl, 1) AND x1 - x0 < 0.55 * greatest(cr - cl, 1) AND px0 - cl < 0.1 * greatest(cr - cl, 1) AND abs(px0 - x0) < 0.05 * greatest(cr - cl, 1)))) AS soft FROM lg),
 walk AS (SELECT doc_id, page_no, pos, mk.hang AS item, 1 AS para, true AS opens FROM lh WHERE pos = 1
   UNION ALL SELECT h.doc_id, h.page_no, h.pos, CASE WHEN b THEN h.mk.hang ELSE item END, para + b::INT, b FROM (SELECT lh.*, item, para, hard OR CASE WHEN item IS NOT NULL THEN x0 + 1.5 * em < item ELSE soft END AS b FROM walk JOIN lh ON lh.doc_id = walk.doc_id AND lh.page_no = walk.page_no AND lh.pos = walk.pos + 1) h),
 nl AS (SELECT lh.*, para, opens FROM lh JOIN walk USING (doc_id, page_no, pos))"""


def _numbered(spark, d):
    lines, cols = _ordered(spark, d)
    return layout.paragraph_breaks(lines, cols, layout.line_pitch(lines)), (lines, cols)


def _written_lines(spark, d):
    """Numbered lines feed the rows, the runs and the tab stops of paragraphs: written once, so that each reads only the columns it needs."""
    numbered, read = _numbered(spark, d)
    lines = written(spark, numbered, "numbered")
    dropped(*read)
    return lines


def _unwritten_paragraphs(spark, d):
    return layout.paragraphs(_written_lines(spark, d))


def _paragraphs(spark, d, *columns):
    """Paragraphs feed several aggregates of the same query: written once, with the ``columns`` that it reads."""
    lines = _written_lines(spark, d)
    paras = written(spark, layout.paragraphs(lines).select("doc_id", "page_no", "para", *columns), "paragraphs")
    dropped(lines)
    return paras


#: What headings are told by.
_HEADING = ("size_pt", "text", "n_lines", "tabbed", "list_kind")


@query("paragraph_breaks", _BREAKS + " SELECT doc_id, page_no, line_no, col, pos, para FROM nl")
def _(spark, d):
    return _numbered(spark, d)[0].select("doc_id", "page_no", "line_no", "col", "pos", "para")


#: Alignment of a paragraph of ``pl`` from the extents of its lines; ``prior`` says whether its page is justified.
_ALIGN = """CASE WHEN k = 1 THEN CASE WHEN r1 - l0 > 0.9 * wd THEN CASE WHEN {prior} THEN 'justify' ELSE 'left' END WHEN abs((l0 - c0) - (c1 - r1)) <= 0.04 * wd AND l0 - c0 > 0.06 * wd THEN 'center' WHEN c1 - r1 <= 0.03 * wd AND l0 - c0 > 0.1 * wd THEN 'right' ELSE 'left' END
 WHEN (k >= 3 AND b1 - b0 <= tol AND abs(bm - c1) <= 0.05 * wd AND n1 - n0 <= 2 * tol) OR (k = 2 AND abs(b1 - c1) <= tol AND {prior}) THEN 'justify'
 WHEN m1 - m0 <= tol * 1.5 AND l1 - l0 > 3 * tol AND r1 - r0 > 3 * tol THEN 'center' WHEN r1 - r0 <= tol AND l1 - l0 > 3 * tol THEN 'right' ELSE 'left' END"""

#: Paragraphs ``pf`` with runs, tab stops, indents and box.
_PARAS = _BREAKS + r""", li AS (SELECT *, CASE WHEN opens THEN own END AS mark, base - lag(base) OVER (PARTITION BY doc_id, page_no, para ORDER BY pos) AS step, row_number() OVER (PARTITION BY doc_id, page_no, para ORDER BY pos) AS li, count(*) OVER (PARTITION BY doc_id, page_no, para) AS k FROM nl),
 pl AS (SELECT doc_id, page_no, para, any_value(col) AS col, any_value(c0) AS c0, any_value(c1) AS c1, any_value(k) AS k, median(size_pt) AS size_pt, max(size_pt) FILTER (opens) AS em, bool_or(tabbed) FILTER (opens) AS tabbed, any_value(mark) AS mark, max(x0) FILTER (opens) AS fx, min(x0) FILTER (NOT opens) AS rx, median(step) AS step,
   max(base) FILTER (opens) AS fb, arg_max(base, pos) AS lb, greatest(any_value(c1 - c0), 1) AS wd, greatest(0.014 * greatest(any_value(c1 - c0), 1), 4) AS tol, min(x0) AS l0, max(x0) AS l1, min(x1) AS r0, max(x1) AS r1, min((x0 + x1) / 2) AS m0, max((x0 + x1) / 2) AS m1,
   min(x1) FILTER (li < k OR k = 1) AS b0, max(x1) FILTER (li < k OR k = 1) AS b1, avg(x1) FILTER (li < k) AS bm, min(x0) FILTER (li > 1 OR k <= 2) AS n0, max(x0) FILTER (li > 1 OR k <= 2) AS n1 FROM li GROUP BY doc_id, page_no, para),
 q0 AS (SELECT wr.doc_id, wr.page_no, para, pos, i, text, wr.x0, wr.x1, bold, tabbed, size_pt AS em, c0, c1 FROM wr JOIN li USING (doc_id, page_no, line_no) WHERE text <> '' AND NOT (mark IS NOT NULL AND NOT tabbed AND i = 0)),
 q1 AS (SELECT *, coalesce(tabbed AND x0 - lag(x1) OVER w > 2.5 * em, false) AS cut, coalesce(lag(bold) OVER w <> bold, true) AS turn FROM q0 WINDOW w AS (PARTITION BY doc_id, page_no, para ORDER BY pos, i)),
 q2 AS (SELECT *, sum(cut::INT) OVER w AS seg, sum((cut OR turn)::INT) OVER w AS run, lead(text) OVER w AS nt, lead(bold) OVER w AS nb, lead(pos) OVER w AS np, lead(cut) OVER w AS nc FROM q1 WINDOW w AS (PARTITION BY doc_id, page_no, para ORDER BY pos, i)),
 q3 AS (SELECT *, CASE WHEN nt IS NULL OR nc THEN text WHEN np = pos THEN text || ' ' WHEN nb <> bold THEN CASE WHEN regexp_matches(text, '\p{L}-$') AND regexp_matches(nt, '^\p{Ll}') THEN text[:-2] ELSE text || ' ' END
   WHEN regexp_matches(text, '.[-\x{ad}\x{2010}]$') AND (NOT (cut OR turn) OR length(text) >= 3) AND regexp_matches(text, '\p{L}.$') AND regexp_matches(nt, '^\p{Ll}') THEN text[:-2]
   WHEN regexp_matches(text, '.[-\x{ad}\x{2010}]$') AND (NOT (cut OR turn) OR length(text) >= 3) AND regexp_matches(text, '[\p{L}\p{N}].$') AND regexp_matches(nt, '^[\p{L}\p{N}]') THEN text ELSE text || ' ' END AS piece FROM q2),
 q4 AS (SELECT doc_id, page_no, para, seg, run, string_agg(piece, '' ORDER BY pos, i) AS rt, bool_or(bold) AS rb, sum(length(text)) AS rl FROM q3 GROUP BY ALL),
 q5 AS (SELECT doc_id, page_no, para, list({seg: seg, run: run, rt: rt, rb: rb} ORDER BY run) AS rs, sum(rl) AS letters, coalesce(sum(rl) FILTER (rb), 0) AS heavy FROM q4 GROUP BY ALL),
 s1 AS (SELECT doc_id, page_no, para, seg, min(x0) AS a, max(x1) AS b, any_value(em) AS em, any_value(c0) AS c0, any_value(c1) AS c1 FROM q2 WHERE tabbed GROUP BY doc_id, page_no, para, seg),
 s2 AS (SELECT *, a - lag(b) OVER w AS gap, lead(seg) OVER w IS NULL AND c1 - b < 0.04 * (c1 - c0) AS ends FROM s1 WINDOW w AS (PARTITION BY doc_id, page_no, para ORDER BY seg)),
 s3 AS (SELECT doc_id, page_no, para, string_agg(CASE WHEN ends AND gap > 4 * em THEN round(b - c0, 6)::VARCHAR || 'right' ELSE round(a - c0, 6)::VARCHAR || 'left' END, ' ' ORDER BY seg) AS ts FROM s2 WHERE seg > 0 GROUP BY ALL),
 pm AS (SELECT *, CASE WHEN mark IS NOT NULL OR tabbed THEN 'left' ELSE """ + _ALIGN.format(prior="false") + r""" END AS align, mark IS NOT NULL AND NOT tabbed AS listed, tabbed AND fx - c0 > 0.5 * em AS leads, coalesce(rx, fx) AS cont FROM pl LEFT JOIN q5 USING (doc_id, page_no, para) LEFT JOIN s3 USING (doc_id, page_no, para)),
 pf AS (SELECT *, list_concat(CASE WHEN listed AND mark.kind = 'number' THEN [{t: mark.label || chr(9), b: false}] WHEN leads THEN [{t: chr(9), b: false}] ELSE [] END,
   flatten(list_transform(coalesce(rs, []), lambda r, i: list_concat(CASE WHEN i > 1 AND r.seg > rs[i - 1].seg THEN [{t: chr(9), b: false}] ELSE [] END, [{t: r.rt, b: r.rb}])))) AS runs,
   concat_ws(' ', CASE WHEN listed AND mark.kind = 'number' THEN round(greatest(0, mark.hang - c0), 6)::VARCHAR || 'left' WHEN leads THEN round(fx - c0, 6)::VARCHAR || 'left' END, ts) AS tabs,
   CASE WHEN tabbed THEN 0 WHEN listed THEN greatest(0, mark.hang - c0) WHEN align NOT IN ('left', 'justify') THEN 0 WHEN k = 1 AND fx - c0 > 0.06 * (c1 - c0) THEN fx - c0 WHEN cont - c0 > 6 THEN cont - c0 ELSE 0 END AS left_indent,
   CASE WHEN tabbed THEN 0 WHEN listed THEN greatest(fx - c0, 0) - greatest(0, mark.hang - c0) WHEN align IN ('left', 'justify') AND k > 1 AND abs(fx - cont) > 0.7 * size_pt THEN fx - cont ELSE 0 END AS first_indent,
   coalesce(greatest(step, size_pt), 0) AS line_pitch FROM pm),
 pp AS (SELECT *, array_to_string(list_transform(runs, lambda r: r.t), '') AS text, CASE WHEN listed THEN mark.kind END AS list_kind FROM pf)"""


@query("paragraphs", _PARAS + r""" SELECT doc_id, page_no, para, col, k AS n_lines, align, list_kind, round(size_pt, 6) AS size_pt, text, array_to_string(list_transform(runs, lambda r: CASE WHEN r.b THEN '<b>' ELSE '<n>' END || r.t), '') AS runs, coalesce(tabs, '') AS tabs,
 round(left_indent, 6)::DOUBLE AS left_indent, round(first_indent, 6)::DOUBLE AS first_indent, round(line_pitch, 6)::DOUBLE AS line_pitch, round(fb - 0.8 * CASE WHEN line_pitch > 0 THEN line_pitch ELSE size_pt * 1.2 END, 6) AS top,
 round(lb + 0.2 * CASE WHEN line_pitch > 0 THEN line_pitch ELSE size_pt * 1.2 END, 6) AS bottom, false AS rtl, coalesce(letters > 0 AND heavy >= 0.7 * letters, false) AS all_bold FROM pp""")
def _(spark, d):
    p = _unwritten_paragraphs(spark, d)
    runs = F.array_join(F.transform("runs", lambda r: F.concat(F.when(r["bold"], "<b>").otherwise("<n>"), r["text"])), "")
    tabs = F.array_join(F.transform("tabs", lambda t: F.concat(F.round(t["at"], 6).cast("string"), t["kind"])), " ")
    figures = ["size_pt", "left_indent", "first_indent", "line_pitch", "top", "bottom"]
    return p.select("doc_id", "page_no", "para", "col", "n_lines", "align", "list_kind", "text", runs.alias("runs"), tabs.alias("tabs"), *[F.round(c, 6).alias(c) for c in figures], "rtl", "all_bold")


_VOTED = _PARAS + """, vo AS (SELECT doc_id, page_no, count(*) FILTER (plain AND k >= 3) >= 2 AND count(*) FILTER (plain AND k >= 3 AND align = 'justify') >= 0.6 * count(*) FILTER (plain AND k >= 3) AS justified FROM (SELECT *, mark IS NULL AND NOT tabbed AS plain FROM pp) GROUP BY ALL)"""


@query("justify_prior", _VOTED + " SELECT doc_id, page_no, para, k AS n_lines, justified, CASE WHEN mark IS NULL AND NOT tabbed AND k <= 2 THEN " + _ALIGN.format(prior="justified") + " ELSE align END AS align FROM pp JOIN vo USING (doc_id, page_no)")
def _(spark, d):
    return layout.justify_prior(_paragraphs(spark, d, "cl", "cr", "extents", "n_lines", "align", "tabbed", "list_kind")).select("doc_id", "page_no", "para", "n_lines", "justified", "align")


_SNAP = f"(list_min(list_transform({list(map(float, SIZE_STEPS))}, lambda s: {{d: abs(s - size_pt) / s, s: s}})).s)"
_HEADS = _PARAS + """, sz AS (SELECT doc_id, {snap} AS s, sum(greatest(length(text), 1)) AS w FROM pp GROUP BY ALL), bd AS (SELECT doc_id, max(struct_pack(w := w, s := -s)).s * -1 AS body FROM sz GROUP BY doc_id),
 fz AS (SELECT pp.* EXCLUDE (size_pt), body, CASE WHEN abs({snap} - body) / body < 0.09 THEN body ELSE {snap} END AS size_pt FROM pp JOIN bd USING (doc_id)),
 cd AS (SELECT *, NOT tabbed AND list_kind IS NULL AND size_pt >= body * 1.15 AND k <= 3 AND length(trim(text)) <= 140 AND NOT ends_with(trim(text), '.') AS cand FROM fz),
 lv AS (SELECT doc_id, size_pt, row_number() OVER (PARTITION BY doc_id ORDER BY size_pt DESC) AS lvl FROM (SELECT DISTINCT doc_id, size_pt FROM cd WHERE cand)),
 hd AS (SELECT cd.*, CASE WHEN cand AND lvl <= 3 THEN lvl ELSE 0 END AS heading FROM cd LEFT JOIN lv USING (doc_id, size_pt))""".replace("{snap}", _SNAP)


@query("heading_levels", _HEADS + " SELECT doc_id, page_no, para, size_pt, body, heading FROM hd")
def _(spark, d):
    return layout.headings(_paragraphs(spark, d, *_HEADING)).select("doc_id", "page_no", "para", "size_pt", "body", "heading")


@query("document_finalise", _HEADS + " SELECT doc_id, body, count(*) AS paragraphs, count(*) FILTER (heading > 0) AS headings FROM hd GROUP BY ALL")
def _(spark, d):
    h = layout.headings(_paragraphs(spark, d, *_HEADING))
    return h.groupBy("doc_id", "body").agg(F.count(F.lit(1)).alias("paragraphs"), F.count_if(F.col("heading") > 0).alias("headings"))


@query("outline_of_text", _HEADS + " SELECT doc_id, page_no, para, CASE WHEN heading > 0 THEN 'heading' || heading WHEN list_kind IS NOT NULL THEN list_kind ELSE 'paragraph' END AS kind, text FROM hd")
def _(spark, d):
    return layout.outline(_paragraphs(spark, d, *_HEADING)).select("doc_id", "page_no", "para", "kind", "text")


@query("align_of", W.rstrip() + """, l AS (SELECT doc_id, page_no, par, line_no, min(x0) AS x0, max(x1) AS x1 FROM words GROUP BY ALL), n AS (SELECT *, count(*) OVER p AS n, row_number() OVER (PARTITION BY doc_id, page_no, par ORDER BY line_no) AS i FROM l WINDOW p AS (PARTITION BY doc_id, page_no, par)),
 g AS (SELECT doc_id, page_no, par, any_value(n) AS n, min(x1) FILTER (i < n) AS b0, max(x1) FILTER (i < n) AS b1, avg(x1) FILTER (i < n) AS bm, min((x0 + x1) / 2) AS c0, max((x0 + x1) / 2) AS c1, min(x0) AS l0, max(x0) AS l1, min(x1) AS r0, max(x1) AS r1 FROM n GROUP BY doc_id, page_no, par)
 SELECT doc_id, page_no, par, CASE WHEN n = 1 THEN CASE WHEN r1 - l0 > 0.9 * 476 THEN 'left' WHEN abs((l0 - 72) - (548 - r1)) <= 0.04 * 476 AND l0 - 72 > 0.06 * 476 THEN 'center' WHEN 548 - r1 <= 0.03 * 476 AND l0 - 72 > 0.1 * 476 THEN 'right' ELSE 'left' END
 WHEN n >= 3 AND b1 - b0 <= 6.664 AND abs(bm - 548) <= 0.05 * 476 THEN 'justify' WHEN c1 - c0 <= 6.664 * 1.5 AND l1 - l0 > 3 * 6.664 AND r1 - r0 > 3 * 6.664 THEN 'center' WHEN r1 - r0 <= 6.664 AND l1 - l0 > 3 * 6.664 THEN 'right' ELSE 'left' END AS align FROM g""")
def _(spark, d):
    ext = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "x0", "x1"))), lambda v: F.struct(v["x0"].alias("x0"), v["x1"].alias("x1")))
    p = _lines(spark, d).groupBy("doc_id", "page_no", "par").agg(ext.alias("e"))
    return p.select("doc_id", "page_no", "par", geo.align_of(F.col("e"), F.lit(72.0), F.lit(548.0), F.lit(False)).alias("align"))


@query("list_marker", W + r"""SELECT doc_id, page_no, line_no, CASE WHEN num THEN CASE WHEN regexp_matches(regexp_replace(t, '[().]', '', 'g'), '^[0-9]+$') OR x - 72 >= 0.8 * 11 THEN 'number' END WHEN (length(t) <= 1 AND NOT regexp_matches(t, '^[\p{L}\p{N}]$')) AND gap >= 0.45 * 11 AND wd <= 1.2 * 11 THEN 'bullet' END AS kind FROM (
 SELECT doc_id, page_no, line_no, t, x, gap, wd, regexp_matches(t, '^(\(?[0-9]{1,3}[.)]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,4}[.)])$') AND gap >= 0.2 * 11 AS num FROM (
 SELECT doc_id, page_no, line_no, min(text) FILTER (word_no = 0) AS t, min(x0) FILTER (word_no = 0) AS x, min(x0) FILTER (word_no = 1) - min(x1) FILTER (word_no = 0) AS gap, min(x1 - x0) FILTER (word_no = 0) AS wd FROM words GROUP BY ALL HAVING count(*) >= 2))""")
def _(spark, d):
    lines = _lines(spark, d).filter("n_words >= 2")
    m = geo.list_marker(F.get("words", F.lit(0)), F.get("words", F.lit(1)), F.lit(11.0), F.lit(72.0))
    return lines.select("doc_id", "page_no", "line_no", m["kind"].alias("kind"))


@query("body_font_size", W + "SELECT doc_id, CASE WHEN sum(length(text)) FILTER (fsize = 16) > sum(length(text)) FILTER (fsize = 11) THEN 16.0 WHEN sum(length(text)) FILTER (fsize = 11) IS NULL THEN 16.0 ELSE 11.0 END::DOUBLE AS body FROM words GROUP BY doc_id")
def _(spark, d):
    return layout.body_font_size(_words(spark, d), "fsize", F.length("text"))


_SPANS = """s AS (SELECT doc_id, line_no, CASE line_no % 3 WHEN 0 THEN 'Arial' WHEN 1 THEN 'Georgia' ELSE 'Tahoma' END AS font, 20 + line_no % 2 AS size, text FROM line_text WHERE trim(text) <> '')"""


@query("dominant_font", ctes("line_text", more=_SPANS + """, f AS (SELECT doc_id, font, sum(length(trim(text))) AS n, min(line_no) AS fl FROM s GROUP BY ALL), z AS (SELECT doc_id, size, sum(length(trim(text))) AS n, min(line_no) AS fl FROM s GROUP BY ALL)""") +
       "SELECT doc_id, arg_max(font, (f.n, -f.fl)) AS font, (SELECT arg_max(size, (z.n, -z.fl)) FROM z WHERE z.doc_id = f.doc_id) AS size FROM f GROUP BY doc_id")
def _(spark, d):
    s = view(spark, d, "line_text").select("doc_id", F.col("line_no").alias("span_no"), "text", (F.lit(20) + F.col("line_no") % 2).alias("size"),
                                           F.expr("CASE line_no % 3 WHEN 0 THEN 'Arial' WHEN 1 THEN 'Georgia' ELSE 'Tahoma' END").alias("font"))
    return layout.dominant_font(s).select("doc_id", "font", "size")


@query("serif_vote", ctes("page_text") + "SELECT doc_id, count(*) FILTER (length(text) % 3 = 0) * 2 >= count(*) AS serif FROM page_text WHERE page_no % 4 <> 3 GROUP BY doc_id")
def _(spark, d):
    p = view(spark, d, "page_text").withColumn("serif", F.when(F.col("page_no") % 4 != 3, F.length("text") % 3 == 0))
    return layout.serif_vote(p)


@query("rotation_vote", W.rstrip() + """, w AS (SELECT *, CASE WHEN (doc_id + line_no) % 3 = 0 THEN 0 WHEN line_no % 2 = 0 THEN 90 ELSE 270 END AS a FROM words), l AS (SELECT doc_id, page_no, line_no, a, count(*) AS n FROM w GROUP BY ALL), c AS (SELECT doc_id, page_no, a, sum(n) AS n, count(*) AS k, min(line_no) AS f FROM l GROUP BY ALL)
 SELECT doc_id, page_no, CASE WHEN sum(n) >= 5 AND coalesce(sum(n) FILTER (a > 0), 0) > 0.5 * sum(n) THEN arg_max(a, (k, -f)) FILTER (a > 0) ELSE 0 END AS rotated FROM c GROUP BY doc_id, page_no""")
def _(spark, d):
    a = F.when((F.col("doc_id") + F.col("line_no")) % 3 == 0, 0).when(F.col("line_no") % 2 == 0, 90).otherwise(270)
    return layout.rotation_vote(_words(spark, d).withColumn("textangle", a))


@query("page_suspicious", W + "SELECT doc_id, page_no, (count(*) < 3 AND doc_id % 2 = 0) OR (count(*) >= 3 AND avg(conf) < 55) AS suspicious FROM words GROUP BY doc_id, page_no")
def _(spark, d):
    w = _words(spark, d)
    dark = w.select("doc_id", "page_no").distinct().withColumn("dark", F.when(F.col("doc_id") % 2 == 0, 0.05).otherwise(0.0))
    return layout.page_suspicious(w, dark)


@query("bold_reference", W.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """, w0 AS (SELECT *, fsize + 2 AS fs, CASE WHEN length(text) >= 2 AND (fsize + 2) / 0.925::DOUBLE >= 12 THEN 0.1::DOUBLE + (word_no % 5) * 0.02::DOUBLE END AS ratio FROM words),
 p AS (SELECT doc_id, page_no, count(*) AS k, count(ratio) AS m, median(ratio) AS ref, median(fs) AS med FROM w0 GROUP BY ALL),
 b AS (SELECT doc_id, page_no, line_no, word_no, length(text) AS len, CASE WHEN k >= 15 AND m >= 15 THEN ratio > ref * CASE WHEN fs > 1.15::DOUBLE * med THEN 1.2::DOUBLE ELSE 1.28::DOUBLE END END AS b0 FROM w0 JOIN p USING (doc_id, page_no)),
 n AS (SELECT *, coalesce(lead(b0) OVER w, false) AS nx, row_number() OVER w AS i, lead(word_no) OVER w IS NULL AS last FROM b WINDOW w AS (PARTITION BY doc_id, page_no, line_no ORDER BY word_no)),
 r AS (SELECT doc_id, page_no, line_no, word_no, i, coalesce(b0, false) AND NOT (len < 4 AND NOT nx) AS bold FROM n WHERE i = 1
  UNION ALL SELECT n.doc_id, n.page_no, n.line_no, n.word_no, n.i, coalesce(n.b0, NOT n.last AND r.bold AND n.nx) AND NOT (n.len < 4 AND NOT r.bold AND NOT n.nx) FROM r JOIN n ON n.doc_id = r.doc_id AND n.page_no = r.page_no AND n.line_no = r.line_no AND n.i = r.i + 1)
 SELECT doc_id, page_no, line_no, word_no, bold FROM r""")
def _(spark, d):
    w = _words(spark, d).withColumns({"fsize": F.col("fsize") + 2, "stroke_ratio": F.lit(0.1) + (F.col("word_no") % 5) * 0.02})
    return layout.bold_words(w)


@query("style_segments", W + """SELECT doc_id, page_no, line_no, word_no AS span_no, CAST(sum(c) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY word_no) AS BIGINT) AS segment FROM (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY word_no) > 0.6 * fsize THEN 1 ELSE 0 END AS c FROM words)""")
def _(spark, d):
    s = _words(spark, d).withColumnsRenamed({"word_no": "span_no", "fsize": "size"})
    return layout.style_segments(s).select("doc_id", "page_no", "line_no", "span_no", "segment")


@query("block_grouping", W.rstrip() + """, l AS (SELECT doc_id, page_no, line_no, min(y0) + min(par) % 3 * 20 AS y0, max(y1) + min(par) % 3 * 20 AS y1 FROM words GROUP BY ALL)
 SELECT doc_id, page_no, line_no, CAST(sum(c) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS BIGINT) AS block_no FROM (SELECT *, CASE WHEN abs(y0 - lag(y0) OVER (PARTITION BY doc_id, page_no ORDER BY line_no)) > 2 * (y1 - y0) THEN 1 ELSE 0 END AS c FROM l)""")
def _(spark, d):
    shift = (F.col("par") % 3) * 20
    lines = _lines(spark, d).withColumns({"pos": F.col("line_no"), "y0": F.col("y0") + shift, "y1": F.col("y1") + shift})
    return layout.block_grouping(lines).select("doc_id", "page_no", "line_no", "block_no")


def _blocks(spark, d):
    """One block per paragraph of the word grid."""
    lines = _lines(spark, d)
    first = F.min_by("text", "line_no")
    return lines.groupBy("doc_id", "page_no", F.col("par").alias("block_no")).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), first.alias("first_text"), F.min_by(F.col("y1") - F.col("y0"), "line_no").alias("first_height"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda v: v["text"]), " ").alias("text")).withColumn("block_type", F.lit("text"))


_BLK = W.rstrip() + """, l AS (SELECT doc_id, page_no, par, line_no, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, string_agg(text, ' ' ORDER BY word_no) AS text FROM words GROUP BY ALL),
 blk AS (SELECT doc_id, page_no, par AS block_no, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, arg_min(text, line_no) AS first_text, arg_min(y1 - y0, line_no) AS fh, string_agg(text, ' ' ORDER BY line_no) AS text FROM l GROUP BY ALL)"""


@query("block_type", _BLK + r""" SELECT doc_id, page_no, block_no, CASE WHEN fh > 1.5 * 10 AND length(text) < 100 AND y0 < 150 THEN 'title' WHEN fh > 1.3 * 10 AND length(text) < 150 THEN 'heading' WHEN regexp_matches(trim(first_text), '^(•|-|●|○|■|▪|►|\*)')
 OR (length(first_text) >= 2 AND regexp_matches(trim(substr(first_text, 1, 3)), '^[0-9][.):]')) THEN 'list' ELSE 'text' END AS block_type FROM blk""")
def _(spark, d):
    b = _blocks(spark, d).withColumn("page_height_avg", F.lit(10.0))
    return layout.block_type_by_height(b).select("doc_id", "page_no", "block_no", "block_type")


@query("block_type_font", _BLK + r""" SELECT doc_id, page_no, block_no, CASE WHEN fh >= 14 THEN 'heading' WHEN regexp_matches(first_text, '^(•|-|●|○|■|▪|►)') OR regexp_matches(first_text, '^[0-9][.):]') THEN 'list' ELSE 'paragraph' END AS block_type FROM blk""")
def _(spark, d):
    t = layout.block_type_by_font(F.col("first_height"), F.lit(11.0), F.lit(False), F.col("first_text"), F.col("text"), F.lit(1), False)
    return _blocks(spark, d).select("doc_id", "page_no", "block_no", t.alias("block_type"))


@query("reading_order_simple", _BLK + " SELECT doc_id, page_no, block_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY block_no % 2, y0, block_no) AS pos FROM blk")
def _(spark, d):
    b = _blocks(spark, d).withColumn("col", F.col("block_no") % 2)
    return layout.reading_order_simple(b).select("doc_id", "page_no", "block_no", "pos")


@query("text_layer", ctes("page_text") + r"SELECT doc_id, count(*) FILTER (length(regexp_replace(text, '\s', '', 'g')) >= 20) AS with_text, count(*) AS total, count(*) FILTER (length(regexp_replace(text, '\s', '', 'g')) >= 20) / count(*) >= 0.5 AS has_layer FROM page_text GROUP BY doc_id")
def _(spark, d):
    return layout.text_layer(view(spark, d, "page_text"))


@query("is_digital", ctes("page_text") + "SELECT doc_id, sum(length(trim(text))) > 100 AS digital, count(*) FILTER (length(trim(text)) < 50) AS pages_for_ocr FROM page_text GROUP BY doc_id")
def _(spark, d):
    return layout.is_digital(view(spark, d, "page_text"))


@query("page_editable", W + "SELECT doc_id, page_no, sum(length(text)) >= 20 AS editable FROM words GROUP BY ALL")
def _(spark, d):
    return layout.page_editable(_lines(spark, d))


@query("line_safe", W.rstrip() + ", l AS (SELECT doc_id, page_no, line_no, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM words GROUP BY ALL) SELECT doc_id, page_no, line_no, line_no % 7 <> 3 AND (least(x1, 540) - x0) * (least(y1, 600) - y0) >= 0.9 * (x1 - x0) * (y1 - y0) AND y1 <= 600 + (y1 - y0) AND y0 < 600 AS safe FROM l")
def _(spark, d):
    dy = F.when(F.col("line_no") % 7 == 3, 0.5).otherwise(0.0)
    page = (F.lit(0.0), F.lit(0.0), F.lit(540.0), F.lit(600.0))
    safe = layout.line_safe(F.lit(1.0), dy, F.lit("x"), F.lit(11.0), layout.box(), page)
    return _lines(spark, d).select("doc_id", "page_no", "line_no", safe.alias("safe"))


def _areas(spark, d):
    """One box on every page, at a place that depends on document and page."""
    n_pages = F.greatest(F.lit(1), F.ceil(F.size(F.expr("filter(split(text, '[ \\n]'), w -> w <> '')")) / 432))
    pages = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), n_pages.cast("long"))).alias("page_no"))
    dx, dy = F.col("page_no") % 3 * 40.0, F.col("doc_id") % 2 * 56.0
    return pages.select("doc_id", "page_no", (dx + 72).alias("x0"), (dy + 100).alias("y0"), (dx + 400).alias("x1"), (dy + 200).alias("y1"))


_AREAS = ctes("words", more="a AS (SELECT DISTINCT doc_id, page_no, page_no % 3 * 40 AS dx, doc_id % 2 * 56 AS dy FROM words)").rstrip()


@query("hidden_text", _AREAS + """, l AS (SELECT doc_id, page_no, line_no, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM words GROUP BY ALL) SELECT doc_id, page_no, line_no FROM l JOIN a USING (doc_id, page_no)
 WHERE greatest(0, least(x1, 400 + dx) - greatest(x0, 72 + dx)) * greatest(0, least(y1, 200 + dy) - greatest(y0, 100 + dy)) > 0.5 * (x1 - x0) * (y1 - y0)""")
def _(spark, d):
    return layout.hidden_text(_lines(spark, d).drop("words"), _areas(spark, d)).select("doc_id", "page_no", "line_no")


@query("word_in_grid", _AREAS + """ SELECT doc_id, page_no, line_no, word_no, CASE WHEN (x0 + x1) / 2 - dx BETWEEN 70 AND 402 AND (y0 + y1) / 2 - dy BETWEEN 98 AND 202 THEN 'table'
 WHEN (x0 + x1) / 2 - dx BETWEEN 300 AND 500 AND (y0 + y1) / 2 - dy BETWEEN 150 AND 400 AND conf < 85 THEN 'dropped' ELSE 'text' END AS place FROM words JOIN a USING (doc_id, page_no)""")
def _(spark, d):
    a = _areas(spark, d)
    pics = a.select("doc_id", "page_no", (F.col("x0") + 228).alias("x0"), (F.col("y0") + 50).alias("y0"), (F.col("x1") + 100).alias("x1"), (F.col("y1") + 200).alias("y1"))
    return layout.word_in_grid(_words(spark, d), a.withColumn("grid_no", F.lit(0)), pics).select("doc_id", "page_no", "line_no", "word_no", "place")


@query("word_to_cell", W + "SELECT doc_id, page_no, line_no, word_no, CAST(greatest(0, least(2, (CASE WHEN c > 60 THEN 1 ELSE 0 END + CASE WHEN c > 200 THEN 1 ELSE 0 END + CASE WHEN c > 400 THEN 1 ELSE 0 END + CASE WHEN c > 500 THEN 1 ELSE 0 END) - 1)) AS INT) AS col_no FROM (SELECT *, (x0 + x1) / 2 AS c FROM words)")
def _(spark, d):
    xs = F.array(*[F.lit(v) for v in (60.0, 200.0, 400.0, 500.0)])
    return _words(spark, d).select("doc_id", "page_no", "line_no", "word_no", geo.grid_index(xs, (F.col("x0") + F.col("x1")) / 2).alias("col_no"))


@query("layout_labels", _BLK + """ SELECT doc_id, page_no, block_no, CASE WHEN y0 < 300 + doc_id % 2 * 56 AND y1 > 250 + doc_id % 2 * 56 THEN 'table' WHEN y0 < 260 + doc_id % 2 * 56 AND y1 > 100 + doc_id % 2 * 56 THEN 'heading' ELSE 'text' END AS block_type FROM blk""")
def _(spark, d):
    def label(no, name, top, bottom):
        return _areas(spark, d).select("doc_id", "page_no", F.lit(no).alias("box_no"), F.lit(name).alias("label"), F.lit(0.0).alias("x0"), (F.col("y0") + top).alias("y0"), F.lit(600.0).alias("x1"), (F.col("y0") + bottom).alias("y1"))
    labels = label(0, "Section_Header", 0, 160).unionByName(label(1, "Table", 150, 200))
    return layout.layout_labels(_blocks(spark, d), labels).select("doc_id", "page_no", "block_no", "block_type")


@query("box_overlap", _BLK + """ SELECT doc_id, page_no, block_no FROM (SELECT *, page_no % 3 * 40 AS dx, doc_id % 2 * 56 AS dy FROM blk)
 WHERE NOT greatest(0, least(x1, 400 + dx) - greatest(x0, 72 + dx)) * greatest(0, least(y1, 200 + dy) - greatest(y0, 100 + dy)) / greatest(least((x1 - x0) * (y1 - y0), 328 * 100), 1) > 0.3""")
def _(spark, d):
    return layout.extra_pictures(_blocks(spark, d), _areas(spark, d)).select("doc_id", "page_no", "block_no")


@query("cell_align", W + "SELECT doc_id, page_no, line_no, word_no, CASE WHEN abs(lg - rg) < 0.12 * 80 AND lg > 0.12 * 80 THEN 'center' WHEN rg < lg * 0.5 AND rg < 0.15 * 80 AND lg > 0.2 * 80 THEN 'right' ELSE 'left' END AS align FROM (SELECT *, x0 % 80 AS lg, 80 - x1 % 80 AS rg FROM words)")
def _(spark, d):
    a = geo.cell_align(F.col("x0") % 80, F.lit(80.0) - F.col("x1") % 80, F.lit(80.0))
    return _words(spark, d).select("doc_id", "page_no", "line_no", "word_no", a.alias("align"))


def _boxes(spark, d):
    """Words as text boxes whose tops wander a little, so that anchors matter."""
    y = F.col("y0") + (F.col("word_no") % 4) * 2
    return _words(spark, d).select("doc_id", "page_no", (F.col("line_no") * 100 + F.col("word_no")).alias("box_no"), F.col("x0").alias("x"), y.alias("y"), (F.col("x1") - F.col("x0")).alias("width"), "text")


@query("visual_lines", W.rstrip() + """, b AS (SELECT doc_id, page_no, line_no * 100 + word_no AS box_no, x0, x1, dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY line_no, word_no % 4 = 3) - 1 AS "group" FROM words),
 g AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY doc_id, page_no, "group" ORDER BY x0) AS gap FROM b) SELECT doc_id, page_no, box_no, "group", CASE WHEN gap > 20 THEN 'tab' WHEN gap > 5 THEN 'space' ELSE 'none' END AS joint FROM g""")
def _(spark, d):
    return folds.visual_lines(_boxes(spark, d)).select("doc_id", "page_no", "box_no", "group", "joint")


_RECURSIVE = W.replace("WITH", "WITH RECURSIVE", 1).rstrip()


@query("flow_paragraphs", _RECURSIVE + """, b AS (SELECT doc_id, page_no, line_no * 100 + word_no AS box_no, x0 AS x, y0 + (word_no % 4) * 2 AS y, text FROM words), ys AS (SELECT DISTINCT doc_id, page_no, y FROM b),
 nx AS (SELECT a.doc_id, a.page_no, a.y, min(c.y) AS ny FROM ys a JOIN ys c ON c.doc_id = a.doc_id AND c.page_no = a.page_no AND c.y > a.y + 15 GROUP BY ALL),
 an AS (SELECT doc_id, page_no, min(y) AS y FROM ys GROUP BY ALL UNION ALL SELECT n.doc_id, n.page_no, n.ny FROM an JOIN nx n ON n.doc_id = an.doc_id AND n.page_no = an.page_no AND n.y = an.y),
 g AS (SELECT b.doc_id, b.page_no, b.box_no, any_value(b.x) AS x, any_value(b.y) AS y, any_value(b.text) AS text, count(*) - 1 AS "group" FROM b JOIN an ON an.doc_id = b.doc_id AND an.page_no = b.page_no AND an.y <= b.y GROUP BY b.doc_id, b.page_no, b.box_no)
 SELECT doc_id, page_no, "group", string_agg(text, ' ' ORDER BY y, x, box_no) AS text FROM g GROUP BY doc_id, page_no, "group" """)
def _(spark, d):
    return folds.flow_paragraphs(_boxes(spark, d))


@query("same_row_merge", T2.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + r""", l0 AS (SELECT doc_id, page_no, line_no * 2 + side AS line_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, ' ' ORDER BY x0, word_no) AS text, string_agg(text, '' ORDER BY x0, word_no) AS t,
  coalesce(median(fsize) FILTER (conf >= 50), median(fsize)) / 0.925 AS a, max(y1 - y0) / 0.70 AS b FROM two_col_words GROUP BY doc_id, page_no, line_no, side),
 l AS (SELECT * EXCLUDE (t, a, b), CASE WHEN length(t) >= 6 AND regexp_matches(t, '[\p{Lu}\p{Nd}bdfhklt]') AND NOT regexp_matches(t, '[gjpqy,;()\[\]{}|/@Q]') AND NOT regexp_matches(t, '[^\x{00}-\x{2ff}]') AND 0.9 * b <= a * 1.35 AND b > a THEN least(b, a * 1.3) ELSE a END AS size FROM l0),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY (y0 + y1) / 2, x0, line_no) AS i FROM l),
 r AS (SELECT doc_id, page_no, line_no, i, x0, y0, x1, y1, text, [{a: y0, b: y1, s: size}] AS heads, 0::BIGINT AS row_no FROM k WHERE i = 1
  UNION ALL SELECT doc_id, page_no, line_no, i, x0, y0, x1, y1, text, CASE WHEN hit IS NULL THEN list_append(heads, {a: y0, b: y1, s: size}) ELSE heads END, coalesce(hit - 1, len(heads)) FROM (
   SELECT k.*, r.heads, list_position(list_transform(r.heads, lambda h: least(h.b - h.a, k.y1 - k.y0) > 0 AND least(h.b, k.y1) - greatest(h.a, k.y0) >= least(h.b - h.a, k.y1 - k.y0) * 0.6 AND abs(h.s - k.size) <= greatest(k.size, 1) * 0.25), true) AS hit FROM r JOIN k ON k.doc_id = r.doc_id AND k.page_no = r.page_no AND k.i = r.i + 1))
 SELECT doc_id, page_no, line_no, row_no, string_agg(text, ' ' ORDER BY x0, line_no) OVER w AS row_text,
  min(x0) OVER w AS row_x0, min(y0) OVER w AS row_y0, max(x1) OVER w AS row_x1, max(y1) OVER w AS row_y1, median(y1) OVER w AS row_base FROM r WINDOW w AS (PARTITION BY doc_id, page_no, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def _(spark, d):
    # Written once: rows are made of lines, and nothing of a word goes on with them.
    lines = written(spark, layout.lines_of(_two_columns(spark, d), sized=True).drop("par", "n_words"), "lines")
    rows = folds.same_row_merge(lines)
    return rows.select("doc_id", "page_no", "line_no", "row_no", "row_text", *[F.col(f"row_box.{c}").alias(f"row_{c}") for c in ("x0", "y0", "x1", "y1")], "row_base")


@query("box_merge", _RECURSIVE + """, ln AS (SELECT doc_id, page_no, line_no AS seg_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, 11.0::DOUBLE AS size FROM words GROUP BY doc_id, page_no, line_no),
 o AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_no, round(y0, 1), round(y1, 1)) = 1 AS alone, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY round(y0, 1), round(y1, 1), x0, seg_no) AS k FROM ln),
 r AS (SELECT doc_id, page_no, seg_no, x0, x1, y0, size, k, 0::BIGINT AS box_no, CASE WHEN alone THEN 1 ELSE 0 END AS held, x0 AS fx0, x1 AS fx1, 0.0::DOUBLE AS stride, 'l' AS edge FROM o WHERE k = 1
 UNION ALL SELECT doc_id, page_no, seg_no, x0, x1, y0, size, k, CASE WHEN ok THEN box ELSE box + 1 END, CASE WHEN ok THEN held + 1 WHEN alone THEN 1 ELSE 0 END, CASE WHEN ok THEN fx0 ELSE x0 END, CASE WHEN ok THEN fx1 ELSE x1 END,
 CASE WHEN ok THEN y0 - py ELSE 0 END, CASE WHEN ok AND held = 1 THEN CASE WHEN l THEN 'l' WHEN c THEN 'c' ELSE 'r' END WHEN ok THEN edge ELSE 'l' END FROM
 (SELECT *, alone AND held > 0 AND abs(size - ps) <= 0.1 * ps AND y0 - py > 0.8 * ps AND y0 - py < 2.2 * ps AND CASE WHEN held >= 2 THEN abs(y0 - py - stride) <= 0.12 * stride + 0.3 AND CASE edge WHEN 'l' THEN l WHEN 'c' THEN c ELSE r END ELSE l OR c OR r END AS ok
 FROM (SELECT o.*, r.box_no AS box, r.held, r.fx0, r.fx1, r.stride, r.edge, r.y0 AS py, r.size AS ps, abs(o.x0 - r.fx0) <= 1.5 AS l, abs((o.x0 + o.x1 - r.fx0 - r.fx1) / 2) <= 1.5 AS c, abs(o.x1 - r.fx1) <= 1.5 AS r
 FROM r JOIN o ON o.doc_id = r.doc_id AND o.page_no = r.page_no AND o.k = r.k + 1))),
 m AS (SELECT *, y0 - lag(y0) OVER (PARTITION BY doc_id, page_no, box_no ORDER BY k) AS below, last_value(edge) OVER (PARTITION BY doc_id, page_no, box_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS align FROM r)
 SELECT doc_id, page_no, seg_no, box_no, align, median(below) OVER (PARTITION BY doc_id, page_no, box_no) AS pitch FROM m""")
def _(spark, d):
    s = _lines(spark, d).select("doc_id", "page_no", F.col("line_no").alias("seg_no"), "x0", "y0", "x1", "y1", F.lit(11.0).alias("size"))
    return folds.box_merge(s).select("doc_id", "page_no", "seg_no", "box_no", "align", "pitch")


# All words as pictures, a word's confidence as its fill. In SQL a paragraph's columns are cut where none of its words reaches the next;
# what is left is a list of boxes per block, in which the first pair in reach is united until there is none.
_PICS = """p AS (SELECT doc_id, page_no, par, line_no * 100 + word_no AS pic_no, x0, y0, x1, y1, conf / 100 AS fill FROM words),
 c AS (SELECT *, CASE WHEN x0 - 4 > max(x1) OVER (PARTITION BY doc_id, page_no, par ORDER BY x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM p),
 k AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, page_no, par ORDER BY x0) AS col FROM c),
 r AS (SELECT doc_id, page_no, par, col, list({'pic_no': pic_no, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'fill': fill} ORDER BY pic_no) AS b, true AS more FROM k GROUP BY ALL
 UNION ALL SELECT doc_id, page_no, par, col, CASE WHEN h IS NULL THEN b ELSE list_transform(list_filter(b, lambda v: v.pic_no <> h.b.pic_no), lambda v: CASE WHEN v.pic_no <> h.a.pic_no THEN v ELSE {'pic_no': v.pic_no,
   'x0': least(h.a.x0, h.b.x0), 'y0': least(h.a.y0, h.b.y0), 'x1': greatest(h.a.x1, h.b.x1), 'y1': greatest(h.a.y1, h.b.y1),
   'fill': (h.a.fill * ((h.a.x1 - h.a.x0) * (h.a.y1 - h.a.y0)) + h.b.fill * ((h.b.x1 - h.b.x0) * (h.b.y1 - h.b.y0))) / greatest((h.a.x1 - h.a.x0) * (h.a.y1 - h.a.y0) + (h.b.x1 - h.b.x0) * (h.b.y1 - h.b.y0), 1)} END) END, h IS NOT NULL
 FROM (SELECT *, flatten(list_transform(b, lambda v: list_transform(list_filter(b, lambda w: w.pic_no > v.pic_no AND v.x0 - 4 <= w.x1 AND w.x0 - 4 <= v.x1 AND v.y0 - 4 <= w.y1 AND w.y0 - 4 <= v.y1)[:1], lambda w: {'a': v, 'b': w})))[1] AS h FROM r WHERE more))
 SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY v.pic_no) - 1 AS pic_no, v.x0 AS x0, v.y0 AS y0, v.x1 AS x1, v.y1 AS y1, round(v.fill, 9) AS fill FROM (SELECT doc_id, page_no, unnest(b) AS v FROM r WHERE NOT more)"""


@query("picture_merge", ctes("words", more=_PICS).replace("WITH", "WITH RECURSIVE", 1))
def _(spark, d):
    p = _words(spark, d).select("doc_id", "page_no", (F.col("line_no") * 100 + F.col("word_no")).alias("pic_no"), "x0", "y0", "x1", "y1", (F.col("conf") / 100).alias("fill"))
    return folds.picture_merge(p, 4.0).withColumn("fill", F.round("fill", 9))


_LINE_TEXT = ctes("line_text").replace("WITH", "WITH RECURSIVE", 1).rstrip()


@query("list_groups", _LINE_TEXT + """, o AS (SELECT doc_id, line_no // 8 AS run, line_no AS pos, length(text) % 3 * 360 AS lft, CASE WHEN length(text) % 5 = 0 THEN 'bullet' ELSE 'number' END AS kind FROM line_text),
 r AS (SELECT *, 0 AS list_no, CASE WHEN lft = 0 THEN kind END AS a, CASE WHEN lft = 360 THEN kind END AS b, CASE WHEN lft = 720 THEN kind END AS c FROM o WHERE pos % 8 = 0
 UNION ALL SELECT doc_id, run, pos, lft, kind, list_no + brk, CASE WHEN lft = 0 THEN kind WHEN brk = 0 THEN a END, CASE WHEN lft = 360 THEN kind WHEN brk = 0 THEN b END, CASE WHEN lft = 720 THEN kind WHEN brk = 0 THEN c END
 FROM (SELECT o.*, r.list_no, r.a, r.b, r.c, CASE WHEN coalesce(CASE o.lft WHEN 0 THEN r.a WHEN 360 THEN r.b ELSE r.c END, o.kind) <> o.kind THEN 1 ELSE 0 END AS brk FROM r JOIN o ON o.doc_id = r.doc_id AND o.run = r.run AND o.pos = r.pos + 1))
 SELECT doc_id, run, pos, lft AS "left", kind, list_no, dense_rank() OVER (PARTITION BY doc_id, run, list_no ORDER BY lft) - 1 AS level, NOT (count(*) OVER (PARTITION BY doc_id, run, list_no) = 1 AND kind = 'number') AS is_list FROM r""")
def _(spark, d):
    i = view(spark, d, "line_text").select("doc_id", F.floor(F.col("line_no") / 8).alias("run"), F.col("line_no").alias("pos"), (F.length("text") % 3 * 360).alias("left"),
                                           F.when(F.length("text") % 5 == 0, "bullet").otherwise("number").alias("kind"))
    return folds.list_groups(i)


@query("split_runs", _LINE_TEXT + """, o AS (SELECT doc_id, line_no // 40 AS page_no, line_no AS pos, text, length(text) % 2 = 0 AS just, length(text) % 3 * 30 AS lft, length(text) % 100 AS bef, length(text) % 11 = 0 AS blocked FROM line_text),
 r AS (SELECT *, pos AS head_pos, just AS hj, lft AS hl, blocked OR trim(text) = '' AS hb FROM o WHERE pos % 40 = 0 UNION ALL
 SELECT doc_id, page_no, pos, text, just, lft, bef, blocked, CASE WHEN ok THEN head_pos ELSE pos END, CASE WHEN ok THEN hj ELSE just END, CASE WHEN ok THEN hl ELSE lft END, CASE WHEN ok THEN hb ELSE blocked OR trim(text) = '' END
 FROM (SELECT o.*, r.head_pos, r.hj, r.hl, r.hb, r.hj AND NOT o.just AND NOT r.hb AND NOT o.blocked AND trim(o.text) <> '' AND abs(r.hl - o.lft) <= 40 AND o.bef <= 77 AS ok FROM r JOIN o ON o.doc_id = r.doc_id AND o.page_no = r.page_no AND o.pos = r.pos + 1))
 SELECT doc_id, page_no, pos, head_pos, text, CASE WHEN pos = head_pos THEN string_agg(text, '') OVER (PARTITION BY doc_id, page_no, head_pos ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS joined FROM r""")
def _(spark, d):
    n = F.length("text")
    look = {"jc": F.when(n % 2 == 0, "both").otherwise("left"), "left": n % 3 * 30, "first_line": F.lit(0), "hanging": F.lit(0), "font_first": F.lit("Arial"), "font_last": F.lit("Arial"),
            "size_first": F.lit(22), "size_last": F.lit(22), "before": n % 100, "blocked": n % 11 == 0}
    p = view(spark, d, "line_text").select("doc_id", F.floor(F.col("line_no") / 40).alias("page_no"), F.col("line_no").cast("long").alias("pos"), "text").withColumns(look)
    return folds.split_runs(p)


def _cells(spark, d):
    """Each order is a page holding one table: its rows in order of line number, three columns of 100 by 20; in every third table the last column is text."""
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    li = table(spark, d, "lineitem").withColumn("rn", F.row_number().over(place))
    last = F.concat(F.when(F.col("l_orderkey") % 3 == 0, "n").otherwise(""), F.col("l_linenumber").cast("string"))
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), t.alias("text")) for c, t in enumerate((F.col("l_returnflag"), F.format_number("l_extendedprice", 2), last))])).alias("v")
    c = li.select(F.floor(F.col("l_orderkey") / 4).alias("doc_id"), (F.col("l_orderkey") % 4 + 1).alias("page_no"), F.lit(0).cast("long").alias("table_no"), "rn", cell)
    return c.select("doc_id", "page_no", "table_no", (50.0 + 100 * F.col("v.c")).alias("x0"), (20.0 * F.col("rn") + F.col("v.c") * 0.5).alias("y0"),
                    (150.0 + 100 * F.col("v.c")).alias("x1"), (20.0 * F.col("rn") + 20).alias("y1"), F.col("v.text").alias("text"))


_CELLS = ctes(more="""k AS (SELECT l_orderkey // 4 AS doc_id, l_orderkey % 4 + 1 AS page_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) - 1 AS r, l_returnflag AS f, l_extendedprice AS p,
 l_orderkey % 3 = 0 AS hd, l_linenumber AS ln, CASE WHEN l_orderkey % 3 = 0 THEN 'n' ELSE '' END || l_linenumber AS t FROM lineitem)""")


@query("grid_lines", _CELLS + "SELECT doc_id, page_no, CAST(r AS INT) AS row_no, CAST(c AS INT) AS col_no, CASE c WHEN 0 THEN f WHEN 1 THEN format('{:,.2f}', p) ELSE t END AS text, false AS merged FROM k, (SELECT unnest([0, 1, 2]) AS c)")
def _(spark, d):
    return tables.table_cells(_cells(spark, d)).select("doc_id", "page_no", "row_no", "col_no", "text", "merged")


@query("header_row", _CELLS + "SELECT doc_id, page_no, hd AS has_header FROM k WHERE r = 0")
def _(spark, d):
    return tables.header_rows(tables.table_cells(_cells(spark, d))).select("doc_id", "page_no", "has_header")


@query("table_rows", _CELLS + """SELECT doc_id, page_no, CAST(r AS INT) AS row_no, CAST(c AS INT) AS col_no, CASE WHEN c = 0 OR hd AND (r = 0 OR c = 2) THEN 'text' WHEN c = 1 THEN 'float' ELSE 'int' END AS kind, CASE WHEN c = 2 AND NOT hd THEN CAST(ln AS BIGINT) END AS long_value,
 CASE WHEN c = 1 AND NOT (hd AND r = 0) THEN CAST(format('{:.2f}', p) AS DOUBLE) END AS double_value FROM k, (SELECT unnest([0, 1, 2]) AS c)""")
def _(spark, d):
    return tables.table_rows(tables.table_cells(_cells(spark, d))).select("doc_id", "page_no", "row_no", "col_no", "kind", "long_value", "double_value")


@query("table_continuation", _CELLS.rstrip() + """, h AS (SELECT doc_id, page_no, (f, format('{:,.2f}', p), t) AS head, page_no - row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS isle FROM k WHERE r = 0)
 SELECT doc_id, page_no, 0::BIGINT AS table_no, min(page_no) OVER (PARTITION BY doc_id, isle) AS head_page, page_no > min(page_no) OVER (PARTITION BY doc_id, isle) AND head = first_value(head) OVER (PARTITION BY doc_id, isle ORDER BY page_no) AS drop_header FROM h""")
def _(spark, d):
    c = tables.table_cells(_cells(spark, d))
    t = c.groupBy("doc_id", "page_no", "table_no").agg(
        (F.size(F.first("xs")) - 1).alias("n_cols"), F.first(F.expr("transform(sequence(0, size(xs) - 2), i -> xs[i + 1] - xs[i])")).alias("widths"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("row_no") == 0, F.struct("col_no", "text")))), lambda v: v["text"]).alias("header"), F.bool_or("merged").alias("merged"))
    return tables.table_chains(t).select("doc_id", "page_no", "table_no", "head_page", "drop_header")


# Words of one line share their middle, those of two lines lie further apart than a line of a cell may.
@query("ruled_table_items", _AREAS + f""", w AS (SELECT *, CASE WHEN (x0 + x1) / 2 > 200 + dx THEN 1 ELSE 0 END AS col_no, CASE WHEN (y0 + y1) / 2 > 130 + dy THEN 1 ELSE 0 END AS row_no FROM words JOIN a USING (doc_id, page_no)
  WHERE (x0 + x1) / 2 - dx BETWEEN 70 AND 402 AND (y0 + y1) / 2 - dy BETWEEN 98 AND 202),
 z AS (SELECT doc_id, page_no, {_SNAP.replace('size_pt', '(m / 0.925)')} AS size FROM (SELECT doc_id, page_no, median(fsize) AS m FROM w GROUP BY ALL)),
 t AS (SELECT doc_id, page_no, row_no, col_no, line_no, string_agg(text, ' ' ORDER BY x0, text) AS line, min(x0) AS x0, max(x1) AS x1, bool_and(word_no % 2 = 0) AS bold, any_value(dx) AS dx FROM w GROUP BY ALL),
 g AS (SELECT doc_id, page_no, row_no, col_no, string_agg(line, ' ' ORDER BY line_no) AS text, bool_and(bold) AS all_bold, min(x0) - any_value(dx) - CASE col_no WHEN 0 THEN 72 ELSE 200 END AS lg,
  CASE col_no WHEN 0 THEN 200 ELSE 400 END + any_value(dx) - max(x1) AS rg, CASE col_no WHEN 0 THEN 128 ELSE 200 END AS wd FROM t GROUP BY doc_id, page_no, row_no, col_no)
 SELECT doc_id, page_no, 0 AS grid_no, row_no, col_no, text, CASE WHEN abs(lg - rg) < 0.12 * wd AND lg > 0.12 * wd THEN 'center' WHEN rg < lg * 0.5 AND rg < 0.15 * wd AND lg > 0.2 * wd THEN 'right' ELSE 'left' END AS align, all_bold, size FROM g JOIN z USING (doc_id, page_no)""")
def _(spark, d):
    ruled = {"xs": F.array("x0", F.col("x0") + 128, "x1"), "ys": F.array("y0", F.col("y0") + 30, "y1")}
    a = _areas(spark, d).withColumn("grid_no", F.lit(0)).withColumns(ruled)
    placed = layout.word_in_grid(_words(spark, d).withColumn("bold", F.col("word_no") % 2 == 0), a, a.filter(F.lit(False)))
    return tables.ruled_cells(placed, a)


@query("table_sink", _CELLS + """SELECT doc_id, page_no, CAST(r AS INT) AS row_no, CAST(c AS INT) AS col_no, CASE c WHEN 0 THEN f WHEN 1 THEN format('{:,.2f}', p) ELSE t END AS text,
 CASE WHEN c = 2 AND NOT hd THEN CAST(ln AS BIGINT) END AS long_value, CASE WHEN c = 1 AND NOT (hd AND r = 0) THEN CAST(format('{:.2f}', p) AS DOUBLE) END AS double_value FROM k, (SELECT unnest([0, 1, 2]) AS c)""")
def _(spark, d):
    cells = tables.table_rows(tables.table_cells(_cells(spark, d))).select("doc_id", "page_no", "table_no", "row_no", "col_no", "kind", "text", "long_value", "double_value")
    return spark.read.parquet(write_tables(spark, cells)).select("doc_id", "page_no", "row_no", "col_no", "text", "long_value", "double_value")
