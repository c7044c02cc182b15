"""Operators with state or folds, compared with plain loops on small inputs."""

import os
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from foliospark.operators import archives, folds, layout, limits, pages, redact, skew, tables
from foliospark.sources import scans

def brute_limiter(rows, burst=10, minute=60, hour=1000):
    accepted, out = {}, {}
    for client, t, seq in sorted(rows, key=lambda r: (r[1], r[2])):
        q = accepted.setdefault(client, deque())
        n = lambda w: sum(1 for x in q if x > t - w)
        ok = n(1) < burst and n(60) < minute and n(3600) < hour
        out[(client, seq)] = ok
        if ok:
            q.append(t)
    return out


@pytest.mark.parametrize("lim", [limits.Limits(), limits.Limits(burst=2, minute=5, hour=12)])
def test_sliding_limiter_equals_a_loop_over_hours(spark, lim):
    rng = random.Random(5)
    rows = [("hot", float(rng.randrange(0, 4 * 3600)), i) for i in range(2500)] + [("cold", float(rng.randrange(0, 7200)), i) for i in range(40)]
    df = spark.createDataFrame(rows, "client string, t double, seq long")
    got = {(r.client, r.seq): r.allowed for r in limits.sliding_window(spark, df, lim).collect()}
    assert got == brute_limiter(rows, lim.burst, lim.minute, lim.hour)


def test_skew_forms_equal_plain_windows(spark):
    from pyspark.sql import Window

    rng = random.Random(3)
    rows = [(rng.choice("aaab"), rng.randrange(0, 500), i, rng.choice("xyz")) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, sec long, seq long, v string")
    w = Window.partitionBy("k").orderBy("sec", "seq")
    a = skew.bucketed_lag(df, ["k"], ["sec", "seq"], F.floor(F.col("sec") / 20), "v", "p").select("seq", "p")
    b = df.select("seq", F.lag("v").over(w).alias("p"))
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    a = skew.bucketed_row_number(df, ["k"], ["sec", "seq"], F.floor(F.col("sec") / 20), "n").select("seq", "n")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, df.select("seq", F.row_number().over(w).alias("n")).collect()))


def test_zip_names(spark):
    """Names are unique, free names stay, and the n-th holder of a name gets the first free number from its rank on."""
    arc = ["m.txt", "m.txt", "m_2.txt", "m.txt", "n", "n", "m_2.txt", "z.tar"]
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(arc)], "job long, pos long, arcname string")
    got = [r.name for r in archives.zip_names(df, 2).orderBy("pos").collect()]
    assert got == ["m.txt", "m_2.txt", "m_2_2.txt", "m_3.txt", "n", "n_2", "m_2_3.txt", "z.tar"] and len(set(got)) == len(got)


def test_find_text_offsets(spark):
    df = spark.createDataFrame([(1, 1, "The cat. the CAT; x.y x-y"), (1, 2, "none")], "doc_id long, page_no long, text string")
    assert [r.start for r in redact.find_text(df, "cat").orderBy("match_no").collect()] == [4, 13]
    assert [r.start for r in redact.find_text(df, "x.y").collect()] == [18]
    assert redact.find_text(df, "cat", match_case=True).count() == 1


SCHEMA = "doc_id long, page_no long, line_no long, word_no long, text string, x0 double, y0 double, x1 double, y1 double, conf double, fsize double, par string"
STEP = 20.0


def line(no, text, left, top, right, par="a", size=10.0):
    """Words of one line in points, of equal width with a narrow gap, the last one ending at ``right``."""
    parts = text.split()
    width = (right - left) / len(parts)
    return [(1, 1, no, i, t, left + i * width, float(top), right if i + 1 == len(parts) else left + i * width + 0.8 * width, top + size, 90.0, size, par) for i, t in enumerate(parts)]


def newspaper(rows=9):
    """Two columns, 40 to 250 and 330 to 560."""
    out = []
    for i in range(rows):
        out += line(2 * i, "west side story goes on", 40.0, 100 + i * STEP, 250.0, "w") + line(2 * i + 1, "east of here it rains", 330.0, 100 + i * STEP, 560.0, "e")
    return out


def test_columns_and_reading_order(spark):
    w = spark.createDataFrame(newspaper() + line(77, "Headline over both columns", 40.0, 50.0, 560.0, "h"), SCHEMA)
    cols = layout.find_columns(w, 600.0)
    c = cols.first()["cols"]
    assert len(c) == 2 and c[0]["x1"] < 300 and c[1]["x0"] > 300
    read = layout.reading_order(layout.assign_columns(layout.lines_of(w, 72.0), cols)).orderBy("pos").collect()
    assert [r.text.split()[0] for r in read] == ["Headline"] + ["west"] * 9 + ["east"] * 9
    prose = spark.createDataFrame([r for i in range(9) for r in line(i, "plain text of a single wide column", 40.0, 100 + i * STEP, 560.0)], SCHEMA)
    assert len(layout.find_columns(prose, 600.0).first()["cols"]) == 1


def test_gutter_split(spark):
    across = line(0, "one two", 40.0, 100.0, 250.0) + [(*r[:3], r[3] + 2, *r[4:]) for r in line(0, "three four five", 330.0, 100.0, 560.0)]
    cols = layout.find_columns(spark.createDataFrame(newspaper(), SCHEMA), 600.0)
    got = layout.split_gutters(spark.createDataFrame(across, SCHEMA), cols).orderBy("word_no").collect()
    assert [r.part for r in got] == [0, 0, 1, 1, 1]


def paragraph_sizes(spark, lines):
    """Lines per paragraph for (top, right end, par, size) in one column from 50 to 500."""
    w = spark.createDataFrame([r for i, (top, right, par, size) in enumerate(lines) for r in line(i, "some words on this line", 50.0, top, right, par, float(size))], SCHEMA)
    ls = layout.lines_of(w).withColumns({"size_pt": F.col("y1") - F.col("y0"), "base": F.col("y0") + 8.0, "pos": F.col("line_no"), "col": F.lit(0), "tabbed": F.lit(False)})
    cols = ls.select("doc_id", "page_no").distinct().withColumn("cols", F.array(F.struct(F.lit(50.0).alias("x0"), F.lit(500.0).alias("x1"))))
    return [r["count"] for r in layout.paragraph_breaks(ls, cols, layout.line_pitch(ls)).groupBy("para").count().orderBy("para").collect()]


def prose(n, top, par, end=280.0):
    return [(top + 13.0 * i, end if i + 1 == n else 500.0, par, 11) for i in range(n)]


def test_paragraphs(spark):
    assert paragraph_sizes(spark, prose(5, 100.0, "a") + prose(4, 100.0 + 5 * 13 + 9, "b")) == [5, 4]
    assert paragraph_sizes(spark, prose(5, 100.0, "a") + prose(4, 165.0, "a")) == [5, 4]
    assert paragraph_sizes(spark, [(60.0, 260.0, "t", 22), *prose(4, 110.0, "a")]) == [1, 4]


def test_visual_lines_keep_the_first_box_as_anchor(spark):
    rows = [(1, 1, i, float(x), float(y), 10.0, "t") for i, (x, y) in enumerate([(0, 100), (20, 104), (50, 108), (0, 120)])]
    df = spark.createDataFrame(rows, "doc_id long, page_no long, box_no long, x double, y double, width double, text string")
    got = folds.visual_lines(df).orderBy("box_no").collect()
    assert [r.group for r in got] == [0, 0, 1, 2]
    assert [r.joint for r in got] == ["none", "space", "none", "none"]


PICTURE = "doc_id long, page_no long, pic_no long, x0 double, y0 double, x1 double, y1 double, fill double"


def united(boxes, gap):
    """Plain form: the first pair in reach unites until no pair is in reach."""
    boxes = [list(b) for b in boxes]
    while True:
        pair = next(((i, j) for i in range(len(boxes)) for j in range(i + 1, len(boxes)) if all(
            boxes[i][k] - gap <= boxes[j][k + 2] and boxes[j][k] - gap <= boxes[i][k + 2] for k in (0, 1))), None)
        if pair is None:
            return boxes
        a, b = boxes[pair[0]], boxes.pop(pair[1])
        wa, wb = ((v[2] - v[0]) * (v[3] - v[1]) for v in (a, b))
        boxes[pair[0]] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), (a[4] * wa + b[4] * wb) / max(wa + wb, 1)]


def test_picture_merge_grows(spark):
    rows = [(1, 1, 0, 0., 0., 10., 10., 1.), (1, 1, 1, 14., 0., 20., 10., 0.), (1, 1, 2, 24., 0., 30., 10., None), (1, 1, 3, 100., 100., 110., 110., .5), (1, 1, 4, None, 0., 1., 1., .5)]
    got = sorted(folds.picture_merge(spark.createDataFrame(rows, PICTURE), 5.0).collect())
    assert [(r.pic_no, r.x0, r.x1, round(r.fill, 6)) for r in got] == [(0, 0.0, 30.0, round(100 / 160 * 200 / 260, 6)), (1, 100.0, 110.0, 0.5)]
    assert folds.picture_merge(spark.createDataFrame([], PICTURE), 5.0).count() == 0


def test_picture_merge_equals_the_plain_form(spark):
    rng = random.Random(9)
    papers = {}
    for page in range(40):
        papers[page] = [(x := rng.randrange(200), y := rng.randrange(200), x + rng.randrange(25), y + rng.randrange(25), rng.randrange(100) / 100) for _ in range(rng.randrange(1, 30))]
    rows = [(1, page, i, *map(float, b)) for page, boxes in papers.items() for i, b in enumerate(boxes)]
    got = {}
    for r in folds.picture_merge(spark.createDataFrame(rows, PICTURE), 3.0).orderBy("page_no", "pic_no").collect():
        got.setdefault(r.page_no, []).append([r.x0, r.y0, r.x1, r.y1, r.fill])
    assert got == {page: united([list(map(float, b)) for b in boxes], 3.0) for page, boxes in papers.items()}


def test_bookmark_remap_equals_a_walk_of_the_tree(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for doc in range(30):
        parents, path = [], []
        for node in range(rng.randrange(1, 60)):
            del path[rng.randrange(len(path) + 1):]
            parents.append(path[-1] if path else None)
            path.append(node)
        rows += [(doc, i, p, rng.randrange(40)) for i, p in enumerate(parents)]
    rows += [(99, i, i - 1 if i else -1, 0 if i == 2999 else 50) for i in range(3000)]
    kept = {doc: {page: page * 10 for page in range(0, 40, 7)} for doc in {r[0] for r in rows}}
    own = {(d, i): kept[d].get(page) for d, i, _, page in rows}
    for d, i, p, _ in sorted(rows, reverse=True):
        if own[d, i] is not None:
            want[d, i] = own[d, i]
        if (d, i) in want and p is not None and p >= 0 and own[d, p] is None:
            want[d, p] = want[d, i]
    marks = spark.createDataFrame(rows, "doc_id long, id long, parent_id long, dest_page long")
    out = pages.bookmark_remap(marks, spark.createDataFrame([(d, p, o) for d, m in kept.items() for p, o in m.items()], "doc_id long, page_no long, out_page long"))
    assert {(r.doc_id, r.id): r.dest for r in out.collect()} == want


def test_list_groups(spark):
    rows = [(1, 1, 0, 0, "bullet"), (1, 1, 1, 360, "number"), (1, 1, 2, 360, "number"), (1, 1, 3, 0, "number"), (1, 2, 9, 0, "number")]
    df = spark.createDataFrame(rows, "doc_id long, run long, pos long, left long, kind string")
    got = folds.list_groups(df).orderBy("pos").collect()
    assert [(r.run, r.list_no, r.level, r.is_list) for r in got] == [(1, 0, 0, True), (1, 0, 1, True), (1, 0, 1, True), (1, 1, 0, False), (2, 0, 0, False)]


def test_table_chain_and_merged_header(spark):
    def row(page, top, texts):
        return [(1, page, 0, 30.0 + 80 * i, float(top), 110.0 + 80 * i, top + 15.0, t) for i, t in enumerate(texts)]

    schema = "doc_id long, page_no long, table_no long, x0 double, y0 double, x1 double, y1 double, text string"
    head = ["Town", "People", "Area"]
    cells = row(1, 0, head) + row(1, 15, ["Ulm", "126", "118.69"]) + row(2, 0, head) + row(2, 15, ["Hof", "45", "58.02"])
    c = tables.table_cells(spark.createDataFrame(cells, schema))
    rows = {(r.page_no, r.row_no, r.col_no): (r.kind, r.long_value, r.double_value) for r in tables.table_rows(c).collect()}
    assert rows[(1, 0, 1)] == ("text", None, None) and rows[(1, 1, 1)] == ("int", 126, None) and rows[(2, 1, 2)] == ("float", None, 58.02)
    t = c.groupBy("doc_id", "page_no", "table_no").agg(F.lit(3).alias("n_cols"), F.array(*[F.lit(80.0)] * 3).alias("widths"), F.bool_or("merged").alias("merged"),
                                                      F.transform(F.array_sort(F.collect_list(F.when(F.col("row_no") == 0, F.struct("col_no", "text")))), lambda v: v["text"]).alias("header"))
    got = tables.table_chains(t).orderBy("page_no").collect()
    assert [(r.head_page, r.drop_header) for r in got] == [(1, False), (1, True)]
    wide = [(1, 1, 0, 30.0, 0.0, 190.0, 15.0, "Both"), (1, 1, 0, 190.0, 0.0, 270.0, 15.0, "Third")] + row(1, 15, ["p", "q", "4"])
    m = {r.text: r for r in tables.table_cells(spark.createDataFrame(wide, schema)).collect()}
    assert m["Both"].merged and m["Third"].col_no == 2 and not m["p"].merged


def test_hocr(spark):
    from foliospark.sources import scans
    page = """<div class='ocr_carea' id='b1'><p class='ocr_par'><span class='ocr_line' title="bbox 10 20 110 40; baseline 0 -4">
      <span class='ocrx_word' title='bbox 10 20 50 40; x_wconf 96; x_fsize 14'><strong>A&amp;B</strong></span>
      <span class='ocrx_word' title='bbox 60 22 70 40; x_wconf 10'>x</span> <span class='ocrx_word' title='bbox 80 22 110 40; x_wconf 20'>7</span></span></p></div>
      <div class='ocr_photo' title='bbox 1 2 3 4'></div>"""
    df = spark.createDataFrame([(1, 1, page)], "doc_id long, page_no long, hocr string")
    w = scans.hocr_scan(df).orderBy("word_no").collect()
    assert [(r.text, r.bold, r.conf, r.base) for r in w] == [("A&B", True, 96.0, 36.0), ("7", False, 20.0, 36.0)]
    assert [(r.x0, r.y1) for r in scans.hocr_photos(df).collect()] == [(1.0, 4.0)]


def test_split_runs_keep_the_head(spark):
    def p(pos, jc, text, left=0, before=0, size=22):
        return (1, 1, pos, jc, left, 0, 0, "A", "A", size, size, before, False, text)

    rows = [p(0, "both", "head"), p(1, "left", "tail", left=30), p(2, "left", "more"), p(3, "left", "far", before=200), p(4, "both", "next"), p(5, "left", "big", size=30)]
    schema = ("doc_id long, page_no long, pos long, jc string, left int, first_line int, hanging int, font_first string, font_last string, "
              "size_first int, size_last int, before int, blocked boolean, text string")
    got = folds.split_runs(spark.createDataFrame(rows, schema)).orderBy("pos").collect()
    assert [r.head_pos for r in got] == [0, 0, 0, 3, 4, 5]
    assert [r.joined for r in got] == ["headtailmore", None, None, "far", "next", "big"]


def test_same_row_merge_joins_from_the_left(spark):
    rows = [(1, 1, 0, 200.0, 100.0, 260.0, 110.0, 10.0, 108.0, "right"), (1, 1, 1, 20.0, 102.0, 90.0, 112.0, 11.0, 109.0, "left"), (1, 1, 2, 100.0, 101.0, 140.0, 125.0, 20.0, 125.0, "tall"),
            (1, 1, 3, 20.0, 120.0, 90.0, 130.0, 10.0, 127.0, "below")]
    df = spark.createDataFrame(rows, "doc_id long, page_no long, line_no long, x0 double, y0 double, x1 double, y1 double, size_pt double, base double, text string")
    got = folds.same_row_merge(df).orderBy("line_no").collect()
    assert [(r.row_no, r.row_text) for r in got] == [(0, "left right"), (0, "left right"), (1, "tall"), (2, "below")]
    assert [(*r.row_box, r.row_base, r.row_size) for r in got] == [(20.0, 100.0, 260.0, 112.0, 108.5, 11.0)] * 2 + [(100.0, 101.0, 140.0, 125.0, 125.0, 20.0), (20.0, 120.0, 90.0, 130.0, 127.0, 10.0)]


def test_box_merge_keeps_pitch_and_edge(spark):
    """Left-aligned lines 12 apart; a wider step, a pair on one line and a larger size each open a box."""
    def seg(no, top, left=50.0, right=200.0, size=10.0):
        return (1, 1, no, left, top, right, top + size, size)

    rows = [seg(0, 0.0), seg(1, 12.0, right=180.0), seg(2, 24.0, right=150.0), seg(3, 42.0), seg(4, 60.0, right=90.0), seg(5, 60.0, left=120.0), seg(6, 72.0), seg(7, 90.0, size=16.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_no long, seg_no long, x0 double, y0 double, x1 double, y1 double, size double")
    got = folds.box_merge(df).orderBy("seg_no").collect()
    assert [r.box_no for r in got] == [0, 0, 0, 1, 2, 3, 4, 5]
    assert [(got[0].align, got[0].pitch), (got[3].align, got[3].pitch)] == [("l", 12.0), ("l", None)]


def test_bold_words_follow_neighbours(spark):
    ratios = [0.10] * 16 + [0.20, None, 0.20, 0.10, 0.20]
    texts = ["word"] * 16 + ["bold", "x", "bold", "word", "ab"]
    rows = [(1, 1, i // 8, i % 8, t, 14.0, r) for i, (t, r) in enumerate(zip(texts, ratios))]
    df = spark.createDataFrame(rows, "doc_id long, page_no long, line_no long, word_no long, text string, fsize double, stroke_ratio double")
    got = [r.bold for r in layout.bold_words(df).orderBy("line_no", "word_no").collect()]
    # The unmeasured "x" lies between bold words; the short last word has no bold neighbour.
    assert got == [False] * 16 + [True, True, True, False, False]


def test_list_items_hang_and_a_line_to_the_left_leaves_them(spark):
    """Continuation lines of an item hang at its text, whatever their length; a line at the margin starts a paragraph, a hung one does not."""
    def words(no, left, text, right, top):
        return line(no, text, left, top, right, "p", 11.0)

    def item(no, label, text, right, top):
        label_at, rest = (1, 1, no, 0, label, 62.0, top, 68.0, top + 11, 90.0, 11.0, "p"), words(no, 80.0, text, right, top)
        return [label_at, *[(*r[:3], r[3] + 1, *r[4:]) for r in rest]]

    rows = item(0, "1.", "an item that goes on", 500.0, 100.0) + words(1, 80.0, "short", 120.0, 113.0) + words(2, 80.0, "and on again", 500.0, 126.0)
    rows += words(3, 50.0, "the margin again, a full line", 500.0, 139.0) + words(4, 50.0, "which continues here", 500.0, 152.0) + item(5, "•", "bullet", 300.0, 165.0)
    rows += words(6, 50.0, "unlike this interna-", 500.0, 178.0) + words(7, 50.0, "tional line", 200.0, 191.0)
    w = spark.createDataFrame(rows, SCHEMA).withColumn("bold", F.col("text").isin("margin", "again,", "interna-"))
    ls = layout.lines_of(w).withColumns({"size_pt": F.lit(11.0), "base": F.col("y0") + 8.0, "pos": F.col("line_no") + 1, "col": F.lit(0), "tabbed": F.lit(False)})
    cols = ls.select("doc_id", "page_no").distinct().withColumn("cols", F.array(F.struct(F.lit(50.0).alias("x0"), F.lit(500.0).alias("x1"))))
    pitch = ls.select("doc_id", "page_no").distinct().withColumn("pitch", F.lit(13 / 11))
    got = layout.paragraphs(layout.paragraph_breaks(ls, cols, pitch)).orderBy("para").collect()
    assert [(r.n_lines, r.list_kind) for r in got] == [(3, "number"), (2, None), (1, "bullet"), (2, None)]
    assert [[(x.text, x.bold) for x in r.runs] for r in got] == [
        [("1.\t", False), ("an item that goes on short and on again", False)],
        [("the ", False), ("margin again, ", True), ("a full line which continues here", False)],
        [("bullet", False)],
        [("unlike this ", False), ("interna", True), ("tional line", False)]]
    assert [[(t.at, t.kind) for t in r.tabs] for r in got] == [[(30.0, "left")], [], [], []]
    assert [(r.left_indent, r.first_indent) for r in got] == [(30.0, -18.0), (0.0, 0.0), (30.0, -18.0), (0.0, 0.0)]
    assert [(r.top, r.bottom, r.line_pitch) for r in got[:2]] == [(108 - 0.8 * 13, 134 + 0.2 * 13, 13.0), (147 - 0.8 * 13, 160 + 0.2 * 13, 13.0)]
    assert not got[1].rtl and not got[1].all_bold and got[0].text.startswith("1.\tan item")


def test_tabbed_lines_have_stops(spark):
    row = lambda i, text, x0, x1: (1, 1, 0, i, text, float(x0), 100.0, float(x1), 111.0, 90.0, 11.0, "p")
    w = spark.createDataFrame([row(0, "1.", 60, 66), row(1, "Name", 150, 170), row(2, "Total", 300, 320), row(3, "sum", 323, 340), row(4, "12", 480, 498)], SCHEMA)
    ls = layout.lines_of(w).withColumns({"size_pt": F.lit(11.0), "base": F.col("y0") + 8.0, "pos": F.lit(1), "col": F.lit(0), "tabbed": F.lit(True)})
    cols = ls.select("doc_id", "page_no").withColumn("cols", F.array(F.struct(F.lit(50.0).alias("x0"), F.lit(500.0).alias("x1"))))
    got = layout.paragraphs(layout.paragraph_breaks(ls, cols, ls.select("doc_id", "page_no", F.lit(1.2).alias("pitch")))).first()
    assert got.text == "\t1.\tName\tTotal sum\t12" and got.align == "left" and got.list_kind is None
    assert [(t.at, t.kind) for t in got.tabs] == [(10.0, "left"), (100.0, "left"), (250.0, "left"), (448.0, "right")]


def test_zip_names_of_one_mixed_family(spark):
    """Repeats and names that look numbered in one archive, against the plain rule; the family is long."""
    from foliospark.operators import archives

    names = [("scan.pdf", "scan_2.pdf", "scan_2_2.pdf", "scan.pdf", "scan_3.pdf")[i * i % 5] for i in range(400)] + ["scan.pdf"] * 30_000 + [f"scan_{i}.pdf" for i in range(29_000, 31_000)]
    used, reached, want = set(), {}, []
    for arcname in names:
        name, n = arcname, reached.get(arcname, 1)
        while name in used:
            n += 1
            name = f"{arcname[:-4]}_{n}.pdf"
        used.add(name)
        reached[arcname] = n
        want.append(name)
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)] + [(2, 0, "scan.pdf"), (2, 1, "other.txt")], "job long, pos long, arcname string").repartition(5)
    got = {(r.job, r.pos): r.name for r in archives.zip_names(df).collect()}
    assert [got[(1, i)] for i in range(len(names))] == want and got[(2, 0)] == "scan.pdf" and got[(2, 1)] == "other.txt"


def test_table_chains_of_a_document_that_never_pauses(spark):
    """Likeness to a head is no equivalence: widths that drift leave the head, a repeated header rejoins."""
    rows, head, want = [], None, []
    for page in range(3000):
        look = (3, [80.0 + page % 7, 80.0, 80.0], ["a", "b", "c" if page % 50 else "d"], page % 400 == 7)
        joins = head is not None and not look[3] and not head[1][3] and (look[2] == head[1][2] or abs(look[1][0] - head[1][1][0]) < 3)
        want.append((head[0] if joins else page, bool(joins and look[2] == head[1][2])))
        head = head if joins else (page, look)
        rows.append((1, page, 0, *look))
    t = spark.createDataFrame(rows, "doc_id long, page_no long, table_no long, n_cols int, widths array<double>, header array<string>, merged boolean").repartition(4)
    got = tables.table_chains(t).orderBy("page_no").collect()
    assert [(r.head_page, r.drop_header) for r in got] == want


def test_sliding_limiter_over_weeks_of_one_client(spark):
    """A client that always runs into its hourly limit: what an hour accepts depends on all hours before."""
    rng = random.Random(8)
    lim = limits.Limits(burst=3, minute=5, hour=12)
    times = sorted([rng.randrange(3600 * 24 * 15) for _ in range(4000)] + [3600 * h + rng.randrange(3600) for h in range(360) for _ in range(20)])
    rows = [("busy", float(t), i) for i, t in enumerate(times)] + [("calm", 500.0 * i, 100_000 + i) for i in range(300)]
    state, want = {}, {}
    for client, t, seq in rows:
        ok, kind, retry = state.setdefault(client, limits.SlidingState(lim)).offer(t, 1)
        want[seq] = (bool(ok), kind, retry)
    df = spark.createDataFrame(rows, "client string, t double, seq long").repartition(3)
    got = {r.seq: (r.allowed, r.limit_type, r.retry_after) for r in limits.sliding_window(spark, df, lim).collect()}
    assert got == want


@pytest.mark.parametrize("recursive", [True, False])
@pytest.mark.parametrize("links", [True, False])
def test_file_inventory_equals_a_walk(spark, tmp_path, recursive, links):
    root = tmp_path / "up loads"
    for i, folder in enumerate(("", "a", "a/b", "a/b/c", "a/b/c/d", "é")):
        (root / folder).mkdir(parents=True, exist_ok=True)
        (root / folder / f"f{i}.pdf").write_bytes(b"x" * i)
        (root / folder / f"g{i}.txt").write_bytes(b"y")
    (root / "linked.pdf").symlink_to(root / "a" / "f1.pdf")
    (root / "a" / "gone.pdf").symlink_to(root / "nowhere")
    (root / "a" / "round").symlink_to(root)
    os.utime(root / "f0.pdf", (1_700_000_000, 1_700_000_000))
    files = root.rglob("*.pdf") if recursive else root.glob("*.pdf")
    want = {(str(f), f.stat().st_size) for f in files if f.is_file() and (links or not f.is_symlink())}
    got = scans.file_inventory(spark, f"file://{root}".replace(" ", "%20"), "*.pdf", recursive, links).collect()
    assert len(got) == len(want) and {(r.path, r.length) for r in got} == want
    assert [r.modificationTime.timestamp() for r in got if r.path.endswith("f0.pdf")] == [1_700_000_000]
    assert scans.file_inventory(spark, str(root / "missing"), None, recursive, links).count() == 0
