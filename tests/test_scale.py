"""What grows with the input: parts of the page words, steps that move words, cells and hOCR."""

from pyspark.sql import functions as F

from foliospark.operators import layout, tables
from foliospark.plans import fixtures, layouts
from foliospark.plans.catalog import QUERIES


def _documents(spark, tmp_path, texts):
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_of_words_grow_with_text(spark, tmp_path, monkeypatch):
    d = _documents(spark, tmp_path, ["a bc " * 500, "", None, "x", " \n "])
    monkeypatch.setattr(fixtures, "TEXT_PER_TASK", 100)
    words = fixtures.view(spark, d, "words")
    assert words.rdd.getNumPartitions() == 26
    got = words.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"), F.min("line_no").alias("a"), F.max("line_no").alias("b"), F.max("word_no").alias("w")).orderBy("doc_id", "page_no").collect()
    assert [tuple(r) for r in got] == [(0, 1, 432, 0, 39, 11), (0, 2, 432, 0, 39, 11), (0, 3, 136, 0, 12, 11), (3, 1, 1, 0, 0, 0)]


def test_columns_of_a_page_join_nothing(spark, tmp_path):
    d = _documents(spark, tmp_path, ["word " * 900])
    found = QUERIES["find_columns"](spark, d)
    assert "Join" not in _plan(found)
    assert found.count() == 5


def test_paragraphs_move_words_twice(spark, tmp_path):
    d = _documents(spark, tmp_path, ["some words-\nof a text. " * 200])
    p = layouts._unwritten_paragraphs(spark, d)
    moved = [line for line in _plan(p).split("\n") if "Generate" in line and "words" in line]
    assert len(moved) == 1
    assert p.agg(F.sum("n_lines")).first()[0] > 0


def test_areas_come_to_words_once(spark, tmp_path):
    d = _documents(spark, tmp_path, ["word " * 900, "a b", None])
    done = QUERIES["area_redact"](spark, d)
    assert _plan(done).count("Join") == 1 and "SortMergeJoin" not in _plan(done)
    assert done.filter("text like '%█%'").count() > 0 and done.count() == 902


def test_chains_read_their_tables_once(spark, tmp_path):
    rows = [(k, 1, 1, 1, 1.0, 9.5, 0.0, 0.0, "R", "O") for k in (4, 5, 7)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    chains = QUERIES["table_continuation"](spark, str(tmp_path))
    assert _plan(chains).count("FileScan") == 1
    assert [(r.page_no, r.head_page) for r in chains.orderBy("page_no").collect()] == [(1, 1), (2, 1), (4, 4)]


def test_texts_in_normal_form_are_not_rebuilt(spark):
    import pyarrow as pa

    from foliospark.functions import names

    plain = pa.array(["aé"] * 300 + [None])
    kept = names._NORMAL["NFC"].func(plain)
    assert isinstance(kept, pa.Array) and kept.equals(plain)
    texts = ["é"] * 300 + [None, ""] + ["x"] * 300
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(names.unicode_normalize(F.col("t"), "NFC")).collect()
    assert [r[0] for r in got] == ["é"] * 300 + [None, ""] + ["x"] * 300


def test_purge_parts_grow_with_rows(spark, monkeypatch):
    import datetime

    from foliospark.operators import retention

    monkeypatch.setattr(retention, "ROWS_PER_TASK", 10)
    day = datetime.datetime(2000, 1, 1)
    rows = [(k if k % 50 else None, f"n{k}", datetime.datetime(2002, 1, 1) if k % 3 else day) for k in range(200)] + [(3, "again", day)]
    outputs = spark.createDataFrame(rows, "task_id long, file_id string, expires_at timestamp")
    tasks, inputs = outputs.select("task_id"), outputs.select("task_id", F.col("file_id").alias("stored_name"))
    expired = retention.expired_task_ids(outputs, F.lit("2001-01-01").cast("timestamp"))
    gone = retention.purge_cascade(tasks, inputs, outputs, expired)
    plan = _plan(gone)
    moved = [line for line in plan.split("\n") if "hashpartitioning(task_id" in line]
    assert moved and all(", 21)" in line for line in moved)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    ids = {k for k in range(200) if k % 50 and k % 3 == 0}
    want = sorted([("task", str(k)) for k in ids] + [(kind, f"n{k}") for k in ids for kind in ("input", "output")] + [("task", "3"), ("input", "again"), ("output", "again")])
    assert sorted((r.kind, r["item"]) for r in gone.collect()) == want


def test_purge_finds_uploads_by_name_prefix(spark):
    """A file whose row is gone, or stands under another task, belongs to the task that its stored name begins with."""
    from foliospark.operators import retention

    inputs = spark.createDataFrame([(1, "1_0_a.pdf"), (1, "1_0_a.pdf"), (1, "odd"), (2, "1_1_b.pdf"), (None, "1_2_c.pdf"), (None, "1_2_c.pdf"), (None, "01_d.pdf"), (None, "2_e.pdf"), (1, None)], "task_id long, stored_name string")
    none = inputs.where("false").withColumn("file_id", F.col("stored_name"))
    expired = spark.createDataFrame([(1,)], "task_id long").repartition(4, "task_id").distinct()
    files = lambda *uploads: sorted(((r.task_id, r["item"]) for r in retention.purge_cascade(none, inputs, none, expired, *uploads).collect()), key=str)
    own = [(1, "1_0_a.pdf"), (1, "1_0_a.pdf"), (1, None), (1, "odd")]
    assert files() == sorted([*own, (1, "1_1_b.pdf"), (1, "1_2_c.pdf")], key=str)
    listed = spark.createDataFrame([("1_0_a.pdf",), ("1_9_gone.pdf",), ("1_9_gone.pdf",), ("11_x.pdf",), ("plain",), (None,)], "stored_name string")
    assert files(listed) == sorted([*own, (1, "1_9_gone.pdf")], key=str)


class _Kept:
    """A value of a state store that counts what it is asked."""

    def __init__(self, value=None):
        self.value, self.asked = value, 0

    def exists(self):
        self.asked += 1
        return self.value is not None

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.asked += 1
        self.value = value


class _Handle:
    def __init__(self, value=None):
        self.kept, self.timers = _Kept(value), []

    def getValueState(self, *_):
        return self.kept

    def getMapState(self, *_):
        return {}

    def registerTimer(self, at):
        self.timers.append(at)


def _fed(processor, handle, frames):
    processor.init(handle)
    return [tuple(r) for f in processor.handleInputRows((7,), iter(frames), None) for r in (f.itertuples(index=False) if len(f) else [None])]


def test_a_key_asks_its_state_once():
    import pandas as pd

    from foliospark.streaming.jobs import ExpiryTimer, LatestProgress

    t0 = pd.Timestamp("2024-01-01 00:00:00.123456")
    at = [t0 + pd.Timedelta(seconds=s) for s in range(200)]
    rows = pd.DataFrame({"ts": at[::-1], "seq": range(200), "expires_at": [t0 + pd.Timedelta(hours=1)] * 200})
    handle = _Handle()
    assert _fed(ExpiryTimer(120), handle, [rows]) == [(7, "expiry", pd.Timestamp("2024-01-01 00:02:00.123"))]
    assert handle.kept.asked == 2 and handle.kept.value == (int(t0.value // 1000000) + 120000, False)
    assert handle.timers == [int(t0.value // 1000000) + 121000]
    again = _Handle(handle.kept.value)
    assert _fed(ExpiryTimer(120), again, [rows]) == [] and again.kept.asked == 1 and not again.timers

    rows = pd.DataFrame({"ts": at[::-1], "seq": range(200), "status": [None, "queued"] + ["completed"] * 100 + ["queued"] * 98})
    handle = _Handle()
    assert _fed(LatestProgress(), handle, [rows]) == [(7, 199, at[0], "queued"), (7, 101, at[98], "completed"), (7, 1, at[198], "queued"), (7, 0, at[199], None)]
    assert handle.kept.asked == 2 and handle.kept.value == (None, True, int(t0.value // 1000000) + 600000)
    done = LatestProgress()
    done.init(handle)
    assert not list(done.handleExpiredTimer((7,), None, None))


def test_rows_are_ordered_as_by_sort_values():
    import pandas as pd

    from foliospark.streaming.ordered import ordered

    t = pd.to_datetime([3, None, 1, 1, 3, None], unit="s")
    for seq in ([5, 4, 3, 2, 5, 1], [None, 4, 3, None, 5, 1], pd.Series([5, None, 3, 2, 5, 1], dtype=object)):
        frame = pd.DataFrame({"t": t, "seq": seq, "row": range(6)}, index=[9, 8, 7, 6, 5, 4])
        pd.testing.assert_frame_equal(ordered(frame, ["t", "seq"]), frame.sort_values(["t", "seq"]).reset_index(drop=True))


def test_boxes_look_their_height_up(spark):
    from foliospark.operators import folds

    inf, nan = float("inf"), float("nan")
    heights = [0.0, 4.0, 5.0, 5.5, 10.5, 11.0, 30.0, 30.0, nan, None, -inf]
    rows = [(p, 1, i, float(i * 50), y, 10.0, "w") for p in (1, 2) for i, y in enumerate(heights)] + [(3, 1, 0, 0.0, None, 10.0, "w")]
    lines = folds.visual_lines(spark.createDataFrame(rows, "doc_id long, page_no long, box_no int, x double, y double, width double, text string"))
    assert "array_position(heights" in _plan(lines) and "filter(anchors" not in _plan(lines)
    got = {(r.doc_id, r.box_no): r["group"] for r in lines.collect()}
    want = [1, 1, 1, 2, 2, 3, 4, 4, 5, -1, 0]
    assert got == {**{(p, i): g for p in (1, 2) for i, g in enumerate(want)}, (3, 0): -1}


def test_bold_words_are_read_once(spark, tmp_path):
    d = _documents(spark, tmp_path, ["some words of a text " * 120, "a", None])
    bold = QUERIES["bold_reference"](spark, d)
    assert "Join" not in _plan(bold) and _plan(bold).count("FileScan") == 1
    assert bold.count() == 601


def test_bold_flags_of_repeated_words_and_lines_without_page(spark):
    rows = [(1, 1, 0, i % 9, "long" if i % 3 else "x", 14.0, 0.3 if i % 5 == 0 else 0.1) for i in range(18)] + [(None, 1, 0, 0, "long", 14.0, 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, page_no long, line_no long, word_no long, text string, fsize double, stroke_ratio double")
    got = layout.bold_words(df)
    assert got.schema["word_no"].dataType.simpleString() == "bigint"
    assert [(r.word_no, r.bold) for r in got.orderBy("word_no", "bold").collect()] == [(i // 2, False) for i in range(18)]


def test_words_of_ruled_tables_are_read_once(spark, tmp_path):
    d = _documents(spark, tmp_path, ["word " * 900, "a b", None])
    cells = QUERIES["ruled_table_items"](spark, d)
    plan = _plan(cells)
    assert plan.count("FileScan") == 3 and "SortMergeJoin" not in plan
    assert sorted({(r.doc_id, r.page_no) for r in cells.collect()}) == [(0, 1), (0, 2), (0, 3)]


def test_ruled_table_without_sizes_has_none(spark):
    words = spark.createDataFrame([(1, 1, 0, 1, "a", 1.0, 1.0, 3.0, 3.0, 0.0, True), (1, 2, 0, 1, "b", 1.0, 1.0, 3.0, 3.0, 11.1, True)],
                                  "doc_id long, page_no long, grid_no int, word_no long, text string, x0 double, y0 double, x1 double, y1 double, fsize double, bold boolean")
    grids = spark.createDataFrame([(1, p, 0, [0.0, 5.0, 9.0], [0.0, 9.0]) for p in (1, 2)], "doc_id long, page_no long, grid_no int, xs array<double>, ys array<double>")
    cells = tables.ruled_cells(words, grids)
    assert _plan(cells).count("Scan ExistingRDD") == 2
    assert [(r.page_no, r.text, r.size) for r in cells.orderBy("page_no").collect()] == [(1, "a", None), (2, "b", 12.0)]


def test_bare_lines_gather_only_their_text(spark, tmp_path):
    words = fixtures.view(spark, _documents(spark, tmp_path, ["some words-\nof a text. " * 200]), "words")
    full, bare = layout.lines_of(words), layout.lines_of(words, bare=True)
    assert set(full.columns) - set(bare.columns) == {"words", "size_pt"}
    assert full.select(bare.columns).exceptAll(bare).count() == 0 == bare.exceptAll(full.select(bare.columns)).count()
    assert "struct(x0, x0" in _plan(bare) and "conf" not in _plan(bare)
    assert "conf" not in _plan(QUERIES["same_row_merge"](spark, str(tmp_path)))


def test_rows_are_merged_by_the_size_of_their_lines(spark, tmp_path):
    """A heading's line of 16 and the line of 11 beside it share a height and are two rows, as their sizes differ."""
    words = fixtures.view(spark, _documents(spark, tmp_path, ["over a mere word " * 108, "no, 中文 字 g Tall " * 90, None]), "words")
    full, sized = layout.lines_of(words), layout.lines_of(words, sized=True)
    assert set(full.columns) - set(sized.columns) == {"words"}
    assert full.select(sized.columns).exceptAll(sized).count() == 0 == sized.exceptAll(full.select(sized.columns)).count()
    rows = {r.line_no: r.row_no for r in QUERIES["same_row_merge"](spark, str(tmp_path)).where("doc_id = 0 and page_no = 1").collect()}
    assert rows[0] != rows[1] and rows[2] == rows[3]


def test_paragraph_tables_go_when_they_are_read(spark, tmp_path, monkeypatch):
    """Of what is written on the way only the table that the result reads is left, with the columns that it reads."""
    import os

    from foliospark.sources import scratch

    d = _documents(spark, tmp_path, ["some words-\nof a text. " * 200, None])
    cleanup = spark.conf.get(scratch.CLEANUP)
    monkeypatch.setattr(scratch, "shared_dir", lambda _, purpose: f"{tmp_path}/shared/{purpose}")
    levels = QUERIES["heading_levels"](spark, d)
    assert os.listdir(f"{tmp_path}/shared") == ["paragraphs"]
    assert set(spark.read.parquet(f"{tmp_path}/shared/paragraphs").columns) == {"doc_id", "page_no", "para", "size_pt", "text", "n_lines", "tabbed", "list_kind"}
    assert levels.count() > 0 and spark.conf.get(scratch.CLEANUP) == cleanup


def test_lines_may_bring_only_their_first_two_boxes(spark, tmp_path):
    d = _documents(spark, tmp_path, ["1. some words-\nof a text. " * 200])
    lines, cols = layouts._ordered(spark, d)
    assert lines.schema["words"].dataType.elementType.names == ["text", "x0", "x1", "bold"] and "text" not in lines.columns
    whole = layout.reading_order(layout.assign_columns(layout.lines_of(layouts._two_columns(spark, d)), cols)).withColumn("tabbed", F.col("line_no") % 10 == 9)
    full, lean = (layout.paragraphs(layout.paragraph_breaks(x, cols, layout.line_pitch(x))) for x in (whole, lines))
    assert full.count() == lean.count() and full.exceptAll(lean).isEmpty()
