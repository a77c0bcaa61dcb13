import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridmere.functions import dates as D
from gridmere.functions import numbers as N
from gridmere.functions import text as X
from gridmere.operators import crosswalk as W
from gridmere.operators import tables as T
from gridmere.operators import trend


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_numbers(spark):
    assert one(spark, *[N.to_number(F.lit(v)) for v in ("1.5", "np", "NaN", "Infinity", " 7 ")]) == (1.5, None, None, None, 7.0)
    assert one(spark, N.ratio(F.lit(1.0), F.lit(0.0)), N.growth_pct(F.lit(3.0), F.lit(2.0))) == (None, 50.0)
    b = [N.blend(F.lit(m).cast("double"), F.lit(10.0), F.lit(c).cast("double")) for m, c in ((2.0, 0.5), (None, 0.5), (2.0, None), (2.0, 7.0))]
    assert one(spark, *b) == (6.0, 10.0, 10.0, 2.0)


def test_text(spark):
    assert one(spark, X.code_key(F.lit(" 206.0")), X.code_key(F.lit(None).cast("string"))) == ("206", None)
    assert one(spark, X.place_key(F.lit("Hillside (Melton - Vic.) ")), X.area_key(F.lit("Colac-Otway (S)"))) == ("HILLSIDE", "COLAC OTWAY S")
    assert one(spark, X.name_hint(F.lit("Hillside (East Gippsland - Vic.)")), X.name_hint(F.lit("Ascot"))) == ("EAST GIPPSLAND", "")
    names = ["Flinders Street Station", "Ballan Railway Station (Ballan)", "Lift", None]
    assert one(spark, *[X.station_name(F.lit(n).cast("string")) for n in names]) == ("Flinders Street", "Ballan", None, None)
    flags = X.label_flags(X.labels_of(F.lit("Gymnasium, Study,  Pool")), {"gym": r"\bgym\b", "study": "study", "pool": "^pool$"})
    assert one(spark, *flags) == (0, 1, 1)
    assert one(spark, *X.label_flags(X.labels_of(F.lit(None).cast("string")), {"gym": "gym"})) == (None,)


def test_dates(spark):
    c = [D.period_close(F.lit(y), F.lit(m)) for y, m in (("2024", " february"), ("x", "March"), ("2025", "Marchy"), ("2025.0", "March"))]
    assert one(spark, *c) == (dt.date(2024, 2, 29), None, None, dt.date(2025, 3, 31))
    assert one(spark, D.fiscal_year_end(F.lit("2022-23")), D.month_or_sentinel(F.lit(None).cast("date"))) == (2023, -1)


def test_shares_sum_to_one_and_fall_back(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.0, 3.0), ("b", 2.0, 1.0), ("b", 6.0, 9.0)], "k string, w double, s double")
    got = sorted((r["k"], r["share"]) for r in T.with_shares(df, {"k": "share"}, "w", "s").collect())
    assert got == [("a", 0.25), ("a", 0.75), ("b", 0.25), ("b", 0.75)]


def test_crosswalk_renormalises_per_column(spark):
    bridge = spark.createDataFrame([("t", 1, 0.5), ("t", 2, 0.3), ("t", 3, 0.2), ("u", 9, 1.0)], "t string, s long, share double")
    values = spark.createDataFrame([(1, 10.0, None), (2, None, 4.0), (3, 20.0, 8.0)], "s long, a double, b double")
    got = {r["t"]: (r["a"], r["b"], r["coverage"]) for r in W.weighted_values(bridge, values, "t", "s", "share").collect()}
    assert got["t"] == (pytest.approx(9 / 0.7), pytest.approx(2.8 / 0.5), pytest.approx(0.7)) and got["u"] == (None, None, 0.0)


def test_rescale(spark):
    schema = "k string, y string, v double, age double, r string"
    old = spark.createDataFrame([("a", "1", 10.0, 40.0, "o"), ("a", "2", 20.0, 41.0, "o"), ("z", "1", 5.0, 30.0, "o")], schema)
    new = spark.createDataFrame([("a", "2", 30.0, 41.0, "n")], schema)
    got = sorted(tuple(r) for r in W.rescale_release(old, new, "k", "y", ["v"], "r").collect())
    assert got[:2] == [("a", "1", 15.0, 40.0, "o (rescaled)"), ("a", "2", 30.0, 41.0, "o (rescaled)")]
    assert got[2] == ("z", "1", None, 30.0, "o (rescaled)")
    same = W.rescale_release(old, old, "k", "y", ["v"], "r")
    assert sorted(tuple(r) for r in same.collect()) == sorted(tuple(r) for r in old.collect())


def test_trend_guards(spark):
    def month(i):
        return dt.date(2020 + i // 12, i % 12 + 1, 15)

    rows = []
    for i in range(60):
        rows += [("steady", month(i), 100 * 1.05 ** (i / 12)), ("wild", month(i), 100 * 1.5 ** (i / 12)), ("flat", month(i), 100.0)]
        if i > 40:
            rows.append(("short", month(i), 100.0 + i))
    df = spark.createDataFrame(rows, "k string, d date, v double")
    got = {r["k"]: r for r in trend.monthly_trend(df, "k", "d", "v").collect()}
    assert set(got) == {"steady"}
    assert got["steady"]["rent_growth_pct"] == pytest.approx(5, abs=0.05) and got["steady"]["trend_n_months"] == 37
    flat = trend.monthly_trend(df, "k", "d", "v", min_distinct=0.0).where("k = 'flat'").first()
    assert flat["rent_growth_pct"] == pytest.approx(0) and flat["trend_r2"] is None


def test_one_row_per_key_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = T.keep_first(df, ["k"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") >= 0 and plan.count("WindowGroupLimit") == 2


def test_copies_and_exempt_rows(spark):
    rows = [(1, "x", dt.date(2024, 1, 1)), (2, "x", None), (3, "x", dt.date(2024, 1, 1)), (4, None, None), (5, None, None)]
    df = spark.createDataFrame(rows, "id long, a string, d date")
    kept = T.keep_latest_copies(df, ["a"], "d", "id", F.col("a").isNull())
    assert sorted(r["id"] for r in kept.collect()) == [3, 4, 5]


def test_last_values_per_column(spark):
    rows = [("a", 1, 1.0, None), ("a", 2, None, 5.0), ("a", 3, None, None), ("b", 1, None, None)]
    df = spark.createDataFrame(rows, "k string, t long, x double, y double")
    assert {r["k"]: (r["x"], r["y"]) for r in T.last_values(df, "k", ["t"], ["x", "y"]).collect()} == {"a": (1.0, 5.0), "b": (None, None)}
