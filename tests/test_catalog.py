"""Every query with an oracle agrees with DuckDB on the smallest tables; streams equal their batch twins."""

import pytest

from foliospark.plans.catalog import ORACLES, QUERIES
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_parity(spark, con, name):
    why, *_ = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert why is None, why


def test_markdown_text_covers_every_line(spark, con):
    from foliospark.plans.fixtures import ctes

    lines = con.execute(ctes("line_text") + " SELECT count(*) FROM line_text").fetchone()[0]
    assert QUERIES["markdown_text"](spark, SF).count() == lines


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_sliding_stream_equals_batch(spark):
    a = QUERIES["sliding_limiter"](spark, SF).select("seq", "allowed").collect()
    b = QUERIES["sliding_limiter_stream"](spark, SF).select("seq", "allowed").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_subscription_stream_equals_batch(spark):
    cols = ["sub_id", "status", "tier", "plan", "applied"]
    a = QUERIES["subscription_fold"](spark, SF).select(cols).collect()
    b = QUERIES["subscription_stream"](spark, SF).select(cols).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.mark.parametrize("name", ["fixed_limiter", "sliding_limiter_stream", "endpoint_limiter_stream", "subscription_stream", "latest_progress", "stalled_tasks", "expiry_timer"])
def test_streams_do_not_depend_on_chunks(spark, name):
    """Rows of a key that come in many chunks are put aside by spans of time; the result is that of one chunk."""
    whole = sorted(map(str, QUERIES[name](spark, SF).collect()))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "3")
    try:
        assert sorted(map(str, QUERIES[name](spark, SF).collect())) == whole
    finally:
        spark.conf.set(size, before)


def test_rows_of_a_key_come_in_order_of_time():
    import random

    import pandas as pd

    from foliospark.streaming.ordered import Aside

    class Store(dict):
        updateValue, getValue, removeKey = dict.__setitem__, dict.__getitem__, dict.__delitem__

    class Handle:
        def __init__(self):
            self.store = Store()

        def getMapState(self, *_):
            return self.store

    rng = random.Random(5)
    rows = [(t if i % 50 else None, i) for i, t in enumerate(rng.choices(range(4000), k=700))]
    for cast in (lambda t: t.astype("float64"), lambda t: pd.to_datetime(t, unit="s")):
        frame = pd.DataFrame(rows, columns=["t", "seq"])
        frame["t"] = cast(frame["t"])
        handle = Handle()
        given = list(Aside(handle).in_order((frame[i:i + 90] for i in range(0, 700, 90)), "t", ["t", "seq"]))
        pd.testing.assert_frame_equal(pd.concat(given, ignore_index=True), frame.sort_values(["t", "seq"], ignore_index=True))
        assert len(given) > 30 and not handle.store
        assert [len(f) for f in Aside(handle).in_order(iter([frame]), "t", ["t", "seq"])] == [700]
        assert not list(Aside(handle).in_order(iter([]), "t", ["t", "seq"]))
