import datetime as dt
import random

import pandas as pd
import pytest

from gridmere.operators.asof import asof_backward, asof_nearest

D = dt.date


def day(n):
    return D(2024, 1, 1) + dt.timedelta(days=n)


def rows(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=repr)


@pytest.fixture
def frames(spark):
    left = spark.createDataFrame(
        [(1, "a", day(10)), (2, "a", day(17)), (3, "a", day(18)), (4, "b", day(5)), (5, None, day(5)), (6, "a", None), (7, "a", day(-1))],
        "id long, k string, d date",
    )
    right = spark.createDataFrame(
        [("a", day(10), 1.0), ("a", day(10), 2.0), ("a", day(0), 3.0), (None, day(1), 4.0), ("a", None, 5.0), ("c", day(1), 6.0)],
        "k string, rd date, v double",
    )
    return left, right


def test_tolerance_edge_and_nulls(frames):
    left, right = frames
    out = asof_backward(left, right, ["k"], "d", "rd", ["v"], dt.timedelta(days=7), lag="lag")
    assert rows(out, "id", "v", "lag") == sorted(
        [(1, 2.0, 0), (2, 2.0, 7), (3, None, None), (4, None, None), (5, None, None), (6, None, None), (7, None, None)],
        key=repr,
    )


def test_empty_right(frames):
    left, right = frames
    out = asof_backward(left, right.limit(0), ["k"], "d", "rd", ["v"])
    assert out.count() == 7 and out.where("v is not null").count() == 0


def test_nearest_tie_goes_back(spark):
    left = spark.createDataFrame([(1, "a", day(5)), (2, "a", day(6)), (3, "a", day(30))], "id long, k string, d date")
    right = spark.createDataFrame([("a", day(0), 1.0), ("a", day(10), 2.0)], "k string, rd date, v double")
    out = asof_nearest(left, right, ["k"], "d", "rd", ["v"], dt.timedelta(days=10))
    assert rows(out, "id", "v") == [(1, 1.0), (2, 2.0), (3, None)]


def test_name_clash_is_refused(frames):
    left, right = frames
    with pytest.raises(ValueError):
        asof_backward(left.withColumn("v", left.id), right, ["k"], "d", "rd", ["v"])


@pytest.mark.parametrize("direction", ["backward", "nearest"])
def test_hot_key_timestamps_equal_brute_force(spark, direction):
    """Nearly all rows share one key, spread over many hours with gaps."""
    rng = random.Random(3)
    base = dt.datetime(2024, 1, 1)

    def stamp():
        return base + dt.timedelta(seconds=rng.randrange(0, 40 * 24 * 3600, 37))

    left = pd.DataFrame([(i, "hot" if rng.random() < 0.9 else "b", stamp()) for i in range(400)], columns=["id", "k", "t"])
    right = pd.DataFrame([("hot" if rng.random() < 0.9 else "b", stamp(), float(i)) for i in range(150)], columns=["k", "rt", "v"])
    right = right.groupby(["k", "rt"], as_index=False)["v"].max()
    tol = dt.timedelta(hours=5)
    fn = asof_backward if direction == "backward" else asof_nearest
    sl = spark.createDataFrame(left, "id long, k string, t timestamp_ntz")
    sr = spark.createDataFrame(right, "k string, rt timestamp_ntz, v double")
    got = {r["id"]: r["v"] for r in fn(sl, sr, ["k"], "t", "rt", ["v"], tol).collect()}
    want = pd.merge_asof(
        left.sort_values("t"), right.sort_values("rt"), left_on="t", right_on="rt", by="k",
        direction=direction, tolerance=pd.Timedelta(tol),
    )
    for i, v in zip(want["id"], want["v"]):
        assert got[i] == (None if pd.isna(v) else v)
    assert len(got) == 400
