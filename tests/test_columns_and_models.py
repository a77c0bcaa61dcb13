import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from gridmere.operators import cleaning as C
from gridmere.operators import columns as K
from gridmere.operators import correlation as R
from gridmere.operators import models as M


def test_exact_medians(spark):
    import numpy as np

    from gridmere.operators import models as M

    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 999, 5000):
        a, b = rng.normal(size=n), rng.integers(0, 4, n).astype(float)
        rows = [(float(x), float(y) if i % 3 else None, None) for i, (x, y) in enumerate(zip(a, b))]
        df = spark.createDataFrame(rows, "a double, b double, c double")
        got = M.exact_medians(df, ["a", "b", "c"])
        some = [y for i, y in enumerate(b) if i % 3]
        want = {"a": np.median(a)} | ({"b": np.median(some)} if some else {})
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,), (None,)], "x double")
    assert sorted(r["x"] for r in M.fill_medians(df, ["x"]).collect()) == [1.0, 2.0, 6.0, 10.0, 20.0]


def test_correlation_plan_does_not_grow(spark):
    import numpy as np
    import pandas as pd

    from gridmere.operators import correlation as R

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 120))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 3.0
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(120)])
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf.columns))
    want = pdf.corr().abs()
    for r in R.pearson_pairs(df, list(pdf.columns)).collect():
        expected = want.loc[r["a"], r["b"]]
        assert (r["r"] is None) if np.isnan(expected) else abs(r["r"] - expected) < 1e-9


def test_vintages_and_preference():
    cols = ["erp_2024", "erp_2025", "erp_change_number_2024_25", "tax_income_earners_2021_22", "tax_income_earners_2022_23"]
    assert K.superseded_vintages(cols) == {"erp_2024": "erp_2025", "tax_income_earners_2021_22": "tax_income_earners_2022_23"}
    assert K.in_order_of_preference(["zzz", "census_a", "x_2022_23", "erp_2025"]) == ["erp_2025", "x_2022_23", "census_a", "zzz"]


def test_correlation_keeps_the_preferred_column(spark):
    df = spark.range(200).select(
        F.col("id").cast("double").alias("vif_population_2026"), (F.col("id") * 2.0).alias("erp_2025"),
        F.pmod(F.col("id") * 7919, F.lit(101)).cast("double").alias("noise"), F.lit(3.0).alias("same"),
        F.when(F.col("id") < 3, 1.0).alias("mostly_null"),
    )
    lost = K.correlated_columns(df, df.columns)
    assert lost == {"vif_population_2026": "erp_2025", "same": "constant", "mostly_null": "constant"}


def test_correlations_equal_pandas(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(150, 4)) * 3) + 1e6
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    pdf = df.toPandas()[list("abcd")].astype(float)
    pearson, ranks = pdf.corr().abs(), {}
    for r in R.pearson_pairs(df, list("abcd")).collect():
        assert r["r"] == pytest.approx(pearson.loc[r["a"], r["b"]], abs=1e-9)
    for r in R.spearman_pairs(df, list("abcd"), "id", slices=5).collect():
        both = pdf[[r["a"], r["b"]]].dropna().rank()
        assert r["r"] == pytest.approx(both.corr().iloc[0, 1], abs=1e-9)


def test_cleaning_needs_its_target_and_tolerates_missing_columns(spark):
    with pytest.raises(KeyError):
        C.clean_listings(spark.range(1))
    df = spark.createDataFrame([(1, 0.0), (2, 90.0), (3, 4000.0)], "listing_id long, weekly_rent double")
    assert sorted((r[0], r[2]) for r in C.clean_listings(df).collect()) == [(2, 0), (3, 1)]


def test_ledger_adds_up(spark):
    df = spark.createDataFrame([(i, float(i * 40), "House", 1.0 + i % 6) for i in range(60)], "listing_id long, weekly_rent double, property_type string, bedrooms double")
    rows = C.cleaning_ledger(df).orderBy("step").collect()
    assert rows[0]["rows_in"] == 60 and rows[-1]["rows_out"] == C.clean_listings(df).count()
    assert all(a["rows_out"] == b["rows_in"] for a, b in zip(rows, rows[1:]))
    assert all(r["rows_in"] - r["rows_out"] == r["dropped"] for r in rows)


@pytest.fixture(scope="module")
def planted(spark):
    """y = 3 a - 2 b + 5 + kind, in a known way."""
    i = F.col("id")
    df = spark.range(600).select(
        i.alias("row_id"), (i % 30).alias("area"), F.pmod(i * 37, F.lit(101)).cast("double").alias("a"),
        F.pmod(i * 53, F.lit(89)).cast("double").alias("b"), F.when(i % 3 == 0, "x").otherwise("y").alias("kind"),
    )
    return df.withColumn("y", 3 * F.col("a") - 2 * F.col("b") + 5 + F.when(F.col("kind") == "x", 10.0).otherwise(0.0)).cache()


def test_linear_recovers_coefficients(planted):
    make = Pipeline(stages=[*M.preparation(["a", "b"], ["kind"], scale=False), M.linear("y")])
    model = make.fit(planted)
    names = M.slots(model.transform(planted))
    w = dict(zip(names, model.stages[-1].coefficients))
    assert w["a"] == pytest.approx(3, abs=1e-3) and w["b"] == pytest.approx(-2, abs=1e-3)
    unseen = planted.limit(5).withColumn("kind", F.lit("never seen"))
    assert model.transform(unseen).count() == 5


def test_splits_do_not_depend_on_partitioning(planted):
    one, two = M.train_test(planted, "row_id"), M.train_test(planted.repartition(7), "row_id")
    ids = [sorted(r[0] for r in part.select("row_id").collect()) for part in (one[1], two[1])]
    assert ids[0] == ids[1] and 60 < len(ids[0]) < 180
    train, test = M.train_test(planted, "area")
    areas = [{r[0] for r in d.select("area").distinct().collect()} for d in (train, test)]
    assert not areas[0] & areas[1] and areas[1]


def test_no_row_is_predicted_by_a_model_that_saw_it(planted):
    """A model of fold means: a row's own fold cannot be in its prediction."""
    folded = M.with_fold(planted, "row_id", 4).withColumn("y", F.col("fold").cast("double"))
    make = lambda: Pipeline(stages=[*M.preparation(["a"], scale=False), M.linear("y").setRegParam(1e6)])
    out = M.out_of_fold(folded, make, 4)
    assert out.count() == 600
    means = {r["fold"]: r["p"] for r in out.groupBy("fold").agg(F.avg("prediction").alias("p")).collect()}
    all_y = {r["fold"]: (r["n"], r["s"]) for r in folded.groupBy("fold").agg(F.count("y").alias("n"), F.sum("y").alias("s")).collect()}
    for f, p in means.items():
        rest = [(n, s) for k, (n, s) in all_y.items() if k != f]
        assert p == pytest.approx(sum(s for _, s in rest) / sum(n for n, _ in rest), abs=1e-3)


def test_ridge_leaves_one_out_as_brute_force_does(planted):
    df = planted.withColumn("y", F.col("y") + F.pmod(F.col("row_id") * 17, F.lit(23)))
    alphas = [0.1, 10.0, 1000.0]
    got = M.ridge_search(df, ["a", "b"], "y", alphas=alphas)
    pdf = df.select("a", "b", "y").toPandas()
    x, y = pdf[["a", "b"]].to_numpy(), pdf["y"].to_numpy()
    z = (x - x.mean(0)) / x.std(0)

    def fit(z, y, alpha):
        m = z.mean(0)
        beta = np.linalg.solve((z - m).T @ (z - m) + alpha * np.eye(2), (z - m).T @ (y - y.mean()))
        return beta, y.mean() - m @ beta

    errors = []
    for alpha in alphas:
        lost = 0.0
        for i in range(len(y)):
            beta, base = fit(np.delete(z, i, 0), np.delete(y, i), alpha)
            lost += (y[i] - base - z[i] @ beta) ** 2
        errors.append(lost / len(y))
    best = alphas[int(np.argmin(errors))]
    beta, base = fit(z, y, best)
    assert got["alpha"] == best and got["cv_mse"] == pytest.approx(min(errors))
    assert list(got["coefficients"].values()) == pytest.approx(list(beta))
    scored = M.ridge_predict(df, got).select("a", "b", "prediction").toPandas()
    assert np.allclose(scored["prediction"], (scored[["a", "b"]].to_numpy() - x.mean(0)) / x.std(0) @ beta + base)


def test_extra_trees_split_where_they_must(spark):
    """Pure groups far apart: every tree ends in them; small ones are kept together by the leaf size."""
    steps = {0.0: 5.0, 1.0: 9.0, 2.0: -3.0, 100.0: 40.0}
    rows = [(x, 7.0, (i * 37) % 11 * 1.0, y) for x, y in steps.items() for i in range(25)]
    df = spark.createDataFrame([*rows, (0.0, 7.0, 0.0, None)], "x double, same double, noise double, y double").repartition(3)
    assemble = VectorAssembler(inputCols=["x", "same", "noise"], outputCol="features")
    model = M.randomised_forest("y", trees=40).fit(assemble.transform(df))
    got = model.transform(assemble.transform(df)).groupBy("x").agg(F.min("prediction"), F.max("prediction")).collect()
    assert {r[0]: (round(r[1], 9), round(r[2], 9)) for r in got} == {x: (y, y) for x, y in steps.items()}
    assert model.featureImportances[1] == 0 and model.featureImportances[0] > 0.8
    again = M.randomised_forest("y", trees=40).fit(assemble.transform(df.repartition(7)))
    assert [t[1].tolist() for t in again.trees] == [t[1].tolist() for t in model.trees]
    small = M.randomised_forest("y", trees=5, leaf=30).fit(assemble.transform(df))
    assert all(len(t[0]) <= 7 for t in small.trees)


def test_extra_trees_count_rows_exactly(spark):
    """Groups of as many rows as a leaf needs: each becomes a leaf, however the rows are dealt."""
    rows = [(float(x), (x * 29) % 67 + 0.1 * x) for x in range(64) for _ in range(7)]
    df = spark.createDataFrame(rows, "x double, y double").repartition(11)
    model = M.randomised_forest("y", trees=30, leaf=7, depth=40).fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(df))
    assert {len(t[0]) for t in model.trees} == {127}


def test_extra_trees_draw_thresholds_evenly(spark):
    """One feature from 0 to 1, with an outlier that only widens the limits below the first cut."""
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, 400)
    df = spark.createDataFrame([(float(a), float(a > 0.5) * 2 + float(a)) for a in x], "x double, y double")
    assemble = VectorAssembler(inputCols=["x"], outputCol="features")
    model = M.randomised_forest("y", trees=300, depth=1).fit(assemble.transform(df))
    cuts = np.array([t[1][0] for t in model.trees])
    assert abs(cuts.mean() - 0.5) < 0.06 and abs(cuts.std() - 12**-0.5) < 0.03


def test_pipelines_fill_with_exact_medians_and_modes_and_can_be_saved(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    rows = [(i, float(i * i), None if i % 5 == 0 else ["u", "v", "v"][i % 3]) for i in range(1, 11)]
    df = spark.createDataFrame([*rows, (11, None, None), (12, float("nan"), "w")], "id int, a double, k string").withColumn("none", F.lit(None).cast("double"))
    model = Pipeline(stages=M.preparation(["a", "none"], ["k"], scale=False)).fit(df)
    model.write().overwrite().save(str(tmp_path / "model"))
    saved = PipelineModel.load(str(tmp_path / "model"))
    out = [m.transform(df).orderBy("id").select("a__filled", "none__filled", "k__filled", vector_to_array("features")).collect() for m in (model, saved)]
    assert out[0] == out[1]
    assert out[0][10][:3] == ((25.0 + 36.0) / 2, 0.0, "v") and out[0][11][:3] == (30.5, 0.0, "w")


def test_the_forest_on_steps_reads_every_line_item(spark, tmp_path):
    from gridmere.catalog import QUERIES

    lines = [(i, n, float(i % 50)) for i in range(60) for n in range(1, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(
        str(tmp_path / "lineitem.parquet")
    )
    parts = [(i, i % 50, 900.0 + i) for i in range(70)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double").write.parquet(
        str(tmp_path / "part.parquet")
    )
    got = sorted(tuple(r) for r in QUERIES["forest_on_steps"](spark, str(tmp_path)).collect())
    step = {1: 100.0, 2: 100.0, 3: 250.0, 4: 250.0}
    assert got == [(float(n), step.get(n, 40.0), step.get(n, 40.0), 60) for n in range(1, 8)]


@pytest.mark.parametrize("ids", ["unique", "repeated"])
def test_rank_correlation_by_looked_up_ranks_equals_the_joined_one(spark, ids, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        row = [None if rng.random() < 0.15 else float(rng.integers(0, 3 + 4 * j)) for j in range(5)]
        row[2] = float("nan") if i % 50 == 7 else row[2]
        key = i if ids == "unique" else None if i % 90 == 3 else i // 2
        rows.append((key, *row, 1.0))
    names = [f"c{j}" for j in range(6)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names)).repartition(3)
    looked_up = R._few_values(df, names, "id")
    assert looked_up is not None
    few = {(r["a"], r["b"]): r["r"] for r in R.spearman_pairs(df, names, "id").collect()}
    monkeypatch.setattr(R, "_RANKS", 12)
    assert R._few_values(df, names, "id") is None
    joined = {(r["a"], r["b"]): r["r"] for r in R.spearman_pairs(df, names, "id").collect()}
    assert few.keys() == joined.keys() and len(few) == 15
    for pair, r in joined.items():
        assert few[pair] is None if r is None else few[pair] == pytest.approx(r, abs=1e-9), pair
