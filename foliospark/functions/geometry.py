"""Word, line and cell geometry as column expressions. Boxes are x0, y0, x1, y1 with y downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.binding import let, let_all
from foliospark.functions.text import CJK

# OCR font size to em; glyphs with descenders; marker look-alikes of OCR.
FSIZE_TO_EM = 0.925
DESCENDERS = r"[gjpqy,;()\[\]{}|/@Q]"
BULLET_CHARS = list("•·●○▪■◦–—-*»›>▶►")
BULLET_SYMBOLS = list("¢«°@©®¥+»")
BULLET_LETTERS = list("eoxwc")
NUMBER_MARKER = r"^(\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,4}[.)])$"


def overlap_area(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_area(a: tuple[Column, ...]) -> Column:
    return F.greatest(a[2] - a[0], F.lit(0.0)) * F.greatest(a[3] - a[1], F.lit(0.0))


def overlap_share(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap over the smaller area."""
    return overlap_area(a, b) / F.greatest(F.least(box_area(a), box_area(b)), F.lit(1.0))


def centre_inside(a: tuple[Column, ...], b: tuple[Column, ...], margin: float = 0.0) -> Column:
    cx, cy = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2
    return cx.between(b[0] - margin, b[2] + margin) & cy.between(b[1] - margin, b[3] + margin)


def median_of(values: Column) -> Column:
    n = F.size(values)
    return F.when(n > 0, let(F.sort_array(values), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2))


def grid_index(lines: Column, centre: Column) -> Column:
    """Index of the cell that holds a coordinate between ordered grid lines, clamped to the ends."""
    below = F.size(F.filter(lines, lambda x: x < centre)) - 1
    return F.greatest(F.lit(0), F.least(F.size(lines) - 2, below))


def cell_align(left_gap: Column, right_gap: Column, width: Column) -> Column:
    return (F.when((F.abs(left_gap - right_gap) < 0.12 * width) & (left_gap > 0.12 * width), "center")
            .when((right_gap < left_gap * 0.5) & (right_gap < 0.15 * width) & (left_gap > 0.2 * width), "right").otherwise("left"))


def line_size(words: Column, dpi: float, sure_of=lambda w: w["conf"] >= 50, height_of=lambda w: w["y1"] - w["y0"]) -> Column:
    """Font size in points of a line from its words (text, fsize, and y0, y1, conf or what ``sure_of`` and ``height_of`` read)."""
    sure = F.transform(F.filter(words, lambda w: (w["fsize"] > 0) & sure_of(w)), lambda w: w["fsize"])
    some = F.transform(F.filter(words, lambda w: w["fsize"] > 0), lambda w: w["fsize"])
    heights = F.transform(words, height_of)

    def size(v: Column) -> Column:
        text, n = v["text"], F.length(v["text"])
        a = F.coalesce(v["fs"] * 72.0 / dpi / FSIZE_TO_EM, F.lit(0.0))
        b = v["tallest"] * 72.0 / dpi / 0.70
        cjk = (n > 0) & (F.regexp_count(text, F.lit(f"[{CJK}]")) >= 0.5 * n)
        plain = (n >= 6) & text.rlike(r"[\p{Lu}\p{Nd}bdfhklt]") & ~text.rlike(DESCENDERS) & ~text.rlike(r"[^\x00-\x{2ff}]")
        return (F.when(cjk, F.coalesce(v["fs"] * 72.0 / dpi / 1.2, F.lit(0.0))).when(plain & (a <= 0), b)
                .when(plain & (0.9 * b <= a * 1.35) & (b > a), F.least(b, a * 1.3)).when(a > 0, a)
                .otherwise(F.coalesce(v["middle"] * 72.0 / dpi / 0.8, F.lit(11.0))))

    return let_all(size, text=F.array_join(F.transform(words, lambda w: w["text"]), ""), tallest=F.array_max(heights),
                   fs=F.coalesce(median_of(sure), median_of(some)), middle=median_of(heights))


def list_marker(w0: Column, w1: Column, em: Column, col_left: Column) -> Column:
    """Struct (kind, text, text_left) when the first word of a line is a list marker."""
    def classify(v: Column) -> Column:
        a, b, e = v["a"], v["b"], F.greatest(v["em"], F.lit(1.0))
        t, gap, width, indent = a["text"], b["x0"] - a["x1"], a["x1"] - a["x0"], a["x0"] - v["left"]
        numeric = t.rlike(NUMBER_MARKER) & (gap >= 0.2 * e)
        number = numeric & (F.regexp_replace(t, r"[().]", "").rlike("^[0-9]+$") | (indent >= 0.8 * e))
        symbol = t.isin(BULLET_CHARS) | ((F.length(t) <= 1) & ~t.rlike(r"^[\p{L}\p{N}]$")) | t.isin(BULLET_SYMBOLS)
        letter = t.isin(BULLET_LETTERS) & (gap >= 0.6 * e) & (width <= 0.7 * e) & ((a["y1"] - a["y0"]) < 0.7 * (b["y1"] - b["y0"])) & (indent >= 0)
        bullet = ~numeric & ((symbol & (gap >= 0.45 * e) & (width <= 1.2 * e)) | (~symbol & letter))
        kind = F.when(number, "number").when(bullet, "bullet")
        return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), t.alias("text"), b["x0"].alias("text_left")))

    return F.when(w0.isNotNull() & w1.isNotNull(), let_all(classify, a=w0, b=w1, em=em, left=col_left))


def _spread(values: Column) -> Column:
    return F.array_max(values) - F.array_min(values)


def align_of(extents: Column, col_left: Column, col_right: Column, justified_prior: Column) -> Column:
    """left, center, right or justify from the (x0, x1) of a paragraph's lines, in order."""
    def decide(v: Column) -> Column:
        e, cl, cr = v["e"], v["cl"], v["cr"]
        width = F.greatest(cr - cl, F.lit(1.0))
        n = F.size(e)
        return let_all(several, e=e, cr=cr, tol=F.greatest(0.014 * width, F.lit(4.0)), width=width, n=n, prior=v["prior"],
                       single=single(F.get(e, F.lit(0)), cl, cr, width, v["prior"]))

    def single(x: Column, cl: Column, cr: Column, width: Column, prior: Column) -> Column:
        lg, rg = x["x0"] - cl, cr - x["x1"]
        return (F.when(x["x1"] - x["x0"] > 0.9 * width, F.when(prior, "justify").otherwise("left"))
                .when((F.abs(lg - rg) <= 0.04 * width) & (lg > 0.06 * width), "center")
                .when((rg <= 0.03 * width) & (lg > 0.1 * width), "right").otherwise("left"))

    def several(v: Column) -> Column:
        e, n, tol = v["e"], v["n"], v["tol"]
        lefts, rights = F.transform(e, lambda x: x["x0"]), F.transform(e, lambda x: x["x1"])
        centres = F.transform(e, lambda x: (x["x0"] + x["x1"]) / 2)
        cont = F.when(n > 2, F.slice(lefts, 2, F.greatest(n - 1, F.lit(1)))).otherwise(lefts)
        body = F.slice(rights, F.lit(1), F.greatest(n - 1, F.lit(1)))
        mean = F.aggregate(body, F.lit(0.0), lambda a, x: a + x) / F.size(body)
        even = (n >= 3) & (_spread(body) <= tol) & (F.abs(mean - v["cr"]) <= 0.05 * v["width"]) & (_spread(cont) <= 2 * tol)
        pair = (n == 2) & (F.abs(F.get(body, F.lit(0)) - v["cr"]) <= tol) & v["prior"]
        return (F.when(n == 0, "left").when(n == 1, v["single"]).when(even | pair, "justify")
                .when((_spread(centres) <= tol * 1.5) & (_spread(lefts) > 3 * tol) & (_spread(rights) > 3 * tol), "center")
                .when((_spread(rights) <= tol) & (_spread(lefts) > 3 * tol), "right").otherwise("left"))

    return let_all(decide, e=extents, cl=col_left, cr=col_right, prior=justified_prior)


def tsv_font_size(avg_height: Column, dpi: float) -> Column:
    return F.greatest(F.lit(8.0), F.least(avg_height * (72.0 / dpi) * 0.75, F.lit(24.0)))
