"""
Models (M1-M15, A19, T3), with the settings that the operators have by default. Ensembles are fitted
on facts about every part, summed up from all its line items.
"""

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from gridmere.catalog.registry import query, r6, shaped, table
from gridmere.operators import models as M
from gridmere.operators.tables import top, union_all

_ITEMS = """SELECT l_orderkey * 8 + l_linenumber AS row_id, l_suppkey AS area, l_extendedprice AS price,
  CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_quantity END AS quantity, l_discount AS discount, l_tax AS tax,
  CAST(p_size AS DOUBLE) AS size, p_retailprice AS retail, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE p_type END AS kind, p_brand AS brand
  FROM lineitem JOIN part ON l_partkey = p_partkey"""
NUMBERS = ["quantity", "discount", "tax", "size", "retail"]


_PARTS = """SELECT p_partkey AS row_id, p_partkey % 97 AS area, avg(l_extendedprice) AS price, avg(l_quantity) AS quantity, avg(l_discount) AS discount,
  avg(l_tax) AS tax, CAST(max(p_size) AS DOUBLE) AS size, max(p_retailprice) AS retail, max(p_brand) AS kind
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey"""


def items(spark, sf):
    return shaped(spark, sf, _ITEMS)


def parts(spark, sf):
    return shaped(spark, sf, _PARTS)


@query(
    "median_imputation",
    f"""SELECT row_id, price, coalesce(quantity, (SELECT median(quantity) FROM ({_ITEMS}) u)) AS quantity FROM ({_ITEMS}) t""",
)
def median_imputation(spark, sf):
    return M.fill_medians(items(spark, sf), ["quantity"]).select("row_id", "price", "quantity")


@query(
    "most_frequent_imputation",
    f"""WITH t AS ({_ITEMS}), m AS (SELECT kind FROM t WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)
  SELECT row_id, price, coalesce(kind, (SELECT kind FROM m)) AS kind FROM t""",
)
def most_frequent_imputation(spark, sf):
    return M.fill_most_frequent(items(spark, sf), ["kind"]).select("row_id", "price", "kind")


@query(
    "one_hot_encoding",
    f"""WITH t AS ({_ITEMS}), f AS (SELECT kind, count(*) AS n FROM t WHERE kind IS NOT NULL GROUP BY 1),
  m AS (SELECT kind FROM f ORDER BY n DESC, kind LIMIT 1), u AS (SELECT row_id, price, coalesce(kind, (SELECT kind FROM m)) AS kind FROM t),
  s AS (SELECT kind, row_number() OVER (ORDER BY count(*) DESC, kind) - 1 AS slot FROM u GROUP BY 1)
  SELECT row_id, price, kind, slot, 1e0 AS total FROM u JOIN s USING (kind)""",
)
def one_hot_encoding(spark, sf):
    from pyspark.ml.functions import vector_to_array

    df = M.fill_most_frequent(items(spark, sf), ["kind"])
    made = Pipeline(stages=M.preparation([], ["kind"])).fit(df).transform(df)
    flags = made.select("row_id", "price", "kind", vector_to_array("features").alias("flags"))
    total = F.aggregate("flags", F.lit(0.0), lambda s, v: s + v)
    return flags.select(
        "row_id", "price", "kind", (F.array_position("flags", 1.0) - 1).alias("slot"), total.alias("total")
    )


@query(
    "standardisation",
    """SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS l_quantity,
  round((l_tax - (SELECT avg(l_tax) FROM lineitem)) / (SELECT stddev_pop(l_tax) FROM lineitem), 6) AS l_tax FROM lineitem""",
)
def standardisation(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return M.standardise(df, ["l_quantity", "l_tax"]).select(
        "l_orderkey", "l_linenumber", r6("l_quantity", "l_quantity"), r6("l_tax", "l_tax")
    )


@query(
    "linear_model",
    """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem""",
)
def linear_model(spark, sf):
    df = table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity")
    model = Pipeline(stages=[*M.preparation(["l_quantity"], scale=False), M.linear("l_extendedprice")]).fit(df)
    fit = model.stages[-1]
    return spark.createDataFrame(
        [(round(float(fit.coefficients[0]), 4), round(float(fit.intercept), 2))], "slope double, intercept double"
    )


def _scored(spark, sf, regressor, scale=False, categorical=("kind",)):
    train, test = M.train_test(parts(spark, sf), "area")
    model = Pipeline(stages=[*M.preparation(NUMBERS, list(categorical), scale), regressor]).fit(train)
    return M.metrics(model.transform(test), "price"), model, test


@query("forest_model")
def forest_model(spark, sf):
    return _scored(spark, sf, M.forest("price"))[0]


@query("boosting_model")
def boosting_model(spark, sf):
    return _scored(spark, sf, M.boosting("price"))[0]


@query("randomised_forest_model")
def randomised_forest_model(spark, sf):
    return _scored(spark, sf, M.randomised_forest("price"), categorical=())[0]


# A price in steps: every tree must end in pure leaves, so that its means are the steps.
_STEPS = """SELECT p_partkey AS row_id, CAST(p_size % 7 AS DOUBLE) AS x, p_retailprice AS noise, 1e0 AS flat,
  CASE WHEN p_size % 7 < 3 THEN 100e0 WHEN p_size % 7 < 5 THEN 250e0 ELSE 40e0 END AS y FROM part"""
_STEPS_SQL = f"SELECT x, min(y) AS low, max(y) AS high, count(*) AS rows FROM ({_STEPS}) t GROUP BY 1"


# The same over all line items, whose line numbers make the steps.
_LINE_STEPS = """SELECT concat(l_orderkey, '-', l_linenumber) AS row_id, CAST(l_linenumber AS DOUBLE) AS x,
  CAST(l_quantity AS DOUBLE) AS noise, CASE WHEN l_linenumber < 3 THEN 100e0 WHEN l_linenumber < 5 THEN 250e0 ELSE 40e0 END AS y
  FROM lineitem"""
_LINE_STEPS_SQL = f"SELECT x, min(y) AS low, max(y) AS high, count(*) AS rows FROM ({_LINE_STEPS}) t GROUP BY 1"


def _on_steps(spark, sf, regressor, steps=_STEPS):
    df = shaped(spark, sf, steps)
    model = Pipeline(stages=[*M.preparation(["x", "noise"], scale=False), regressor]).fit(df)
    p = F.round("prediction", 6)
    return model.transform(df).groupBy("x").agg(
        F.min(p).alias("low"), F.max(p).alias("high"), F.count(F.lit(1)).alias("rows")
    )


@query("forest_on_steps", _LINE_STEPS_SQL)
def forest_on_steps(spark, sf):
    return _on_steps(spark, sf, M.forest("y"), _LINE_STEPS)


@query("boosting_on_steps", _STEPS_SQL)
def boosting_on_steps(spark, sf):
    return _on_steps(spark, sf, M.boosting("y"))


@query("randomised_forest_on_steps", _STEPS_SQL)
def randomised_forest_on_steps(spark, sf):
    return _on_steps(spark, sf, M.randomised_forest("y"))


@query(
    "importances_on_steps",
    f"""SELECT feature, label, importance AS value, importance FROM (SELECT 'x' AS feature, 'Size class' AS label, count(DISTINCT x) > 1 AS used FROM ({_STEPS}) t
  UNION ALL SELECT 'flat', 'flat', count(DISTINCT flat) > 1 FROM ({_STEPS}) t) q, LATERAL (SELECT CAST(used AS DOUBLE) AS importance) i""",
)
def importances_on_steps(spark, sf):
    df = shaped(spark, sf, _STEPS)
    model = Pipeline(stages=[*M.preparation(["x", "flat"], scale=False), M.forest("y")]).fit(df)
    names = M.slots(model.transform(df), numeric=["x", "flat"])
    found = M.importances(spark, names, model.stages[-1].featureImportances.toArray(), {"x": "Size class"})
    return top(found.withColumns({c: r6(c, c) for c in ("value", "importance")}), "importance", 10, "feature")


@query("ridge_model")
def ridge_model(spark, sf):
    known, _ = M.train_test(items(spark, sf), "area")
    train, test = M.train_test(M.fill_medians(items(spark, sf), NUMBERS, source=known), "area")
    fit = M.ridge_search(train, NUMBERS, "price")
    scored = M.metrics(M.ridge_predict(test, fit), "price")
    return scored.select("*", F.lit(fit["alpha"]).alias("alpha"))


_ALPHAS = "SELECT pow(10e0, -3 + i * 7e0 / 149) AS alpha FROM (SELECT unnest(range(150)) AS i) q"
# Leave-one-out by the leverage of every row, written out for two standardised features with correlation c.
_TWO = "SELECT CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 1000 AS DOUBLE) AS b, p_retailprice + p_size * p_size AS y FROM part"


@query(
    "ridge_of_two_features",
    f"""WITH t AS ({_TWO}), s AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM t),
  z AS (SELECT (a - ma) / sa AS u, (b - mb) / sb AS v, y - my AS w, n FROM t, s),
  g AS (SELECT max(n) AS n, sum(u * v) AS c, sum(u * w) AS p, sum(v * w) AS q FROM z),
  k AS (SELECT alpha, n, ((n + alpha) * p - c * q) / d AS bu, ((n + alpha) * q - c * p) / d AS bv, (n + alpha) / d AS h1, -c / d AS h2
    FROM (SELECT alpha, g.*, (n + alpha) * (n + alpha) - c * c AS d FROM g, ({_ALPHAS}) x) r),
  e AS (SELECT alpha, any_value(bu) AS bu, any_value(bv) AS bv, avg(pow((w - bu * u - bv * v) / (1 - 1e0 / k.n - (u * u + v * v) * h1 - 2 * u * v * h2), 2)) AS mse FROM z, k GROUP BY alpha),
  best AS (SELECT arg_min(alpha, mse) AS alpha, arg_min(bu, mse) AS bu, arg_min(bv, mse) AS bv, min(mse) AS mse FROM e)
  SELECT round(alpha, 6) AS alpha, round(bu, 6) AS beta_a, round(bv, 6) AS beta_b, round(my - bu / sa * ma - bv / sb * mb, 6) AS intercept, round(mse, 4) AS mse FROM best, s""",
)
def ridge_of_two_features(spark, sf):
    fit = M.ridge_search(shaped(spark, sf, _TWO), ["a", "b"], "y")
    row = (round(fit["alpha"], 6), *[round(fit["coefficients"][c], 6) for c in "ab"], round(fit["intercept"], 6), round(fit["cv_mse"], 4))
    return spark.createDataFrame([row], "alpha double, beta_a double, beta_b double, intercept double, mse double")


def bucket_sql(key: str, seed: int) -> str:
    return f"CAST(concat('0x', substr(md5(concat({key}, '|{seed}')), 1, 8)) AS BIGINT) % 10000"


@query(
    "train_test_split",
    f"SELECT o_orderkey AS row_id, CASE WHEN {bucket_sql('o_orderkey', 67)} < 2000 THEN 'test' ELSE 'train' END AS part FROM orders",
)
def train_test_split(spark, sf):
    train, test = M.train_test(table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id")), "row_id")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "grouped_split",
    f"""SELECT l_suppkey AS area, CASE WHEN {bucket_sql('l_suppkey', 67)} < 2000 THEN 'test' ELSE 'train' END AS part, count(*) AS rows
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
def grouped_split(spark, sf):
    train, test = M.train_test(items(spark, sf), "area")
    parts = union_all([train.select("area", F.lit("train").alias("part")), test.select("area", F.lit("test").alias("part"))])
    return parts.groupBy("area", "part").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "out_of_fold_linear",
    f"""WITH t AS (SELECT o_orderkey AS row_id, CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y, ({bucket_sql('o_orderkey', 68)}) % 5 AS fold FROM orders),
  f AS (SELECT k AS fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t, (SELECT unnest(range(5)) AS k) q WHERE t.fold <> k GROUP BY 1)
  SELECT row_id, CAST(t.fold AS INT) AS fold, round(a + b * x, 1) AS prediction FROM t JOIN f ON t.fold = f.fold""",
)
def out_of_fold_linear(spark, sf):
    df = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y")
    )
    make = lambda: Pipeline(stages=[*M.preparation(["x"], scale=False), M.linear("y")])
    out = M.out_of_fold(M.with_fold(df, "row_id"), make)
    return out.select("row_id", "fold", F.round("prediction", 1).alias("prediction"))


def _linear_on(columns, categorical=()):
    return lambda: Pipeline(stages=[*M.preparation(columns, list(categorical)), M.linear("price")])


@query("out_of_fold_predictions")
def out_of_fold_predictions(spark, sf):
    folded = M.with_fold(items(spark, sf), "row_id")
    return M.out_of_fold(folded, _linear_on(NUMBERS, ["kind"])).select("row_id", "fold", r6("prediction", "prediction"))


@query("stacked_model")
def stacked_model(spark, sf):
    train, test = M.train_test(parts(spark, sf), "row_id")
    makers = {
        "internal": _linear_on(["quantity", "size"], ["kind"]),
        "external": lambda: Pipeline(stages=[*M.preparation(["retail", "tax", "discount"]), M.forest("price")]),
        "combined": lambda: Pipeline(stages=[*M.preparation(NUMBERS, ["kind"], scale=False), M.boosting("price", rounds=30)]),
    }
    _, scored = M.stack(train, test, "row_id", "price", makers)
    return union_all(
        [M.metrics(scored, "price", c).select(F.lit(c).alias("model"), "*") for c in [*makers, "stacked"]]
    )


_PAIR = "SELECT p_partkey AS row_id, CAST(p_size AS DOUBLE) AS size, CAST(p_partkey % 1000 AS DOUBLE) AS code, p_retailprice + p_size * p_size AS price FROM part"


@query(
    "stacked_linear",
    f"""WITH t AS (SELECT *, ({bucket_sql('row_id', 67)}) < 2000 AS test, ({bucket_sql('row_id', 68)}) % 5 AS fold FROM ({_PAIR}) p), tr AS (SELECT * FROM t WHERE NOT test),
  f AS (SELECT k AS fold, regr_slope(price, size) AS b1, regr_intercept(price, size) AS a1, regr_slope(price, code) AS b2, regr_intercept(price, code) AS a2
    FROM tr, (SELECT unnest(range(5)) AS k) q WHERE tr.fold <> k GROUP BY 1),
  m AS (SELECT price AS y, a1 + b1 * size AS p, a2 + b2 * code AS q FROM tr JOIN f ON tr.fold = f.fold),
  c AS (SELECT var_pop(p) AS vp, var_pop(q) AS vq, covar_pop(p, q) AS pq, covar_pop(y, p) AS yp, covar_pop(y, q) AS yq, avg(y) AS my, avg(p) AS mp, avg(q) AS mq FROM m),
  w AS (SELECT (yp * vq - yq * pq) / (vp * vq - pq * pq) AS wp, (yq * vp - yp * pq) / (vp * vq - pq * pq) AS wq, my, mp, mq FROM c),
  g AS (SELECT regr_slope(price, size) AS b1, regr_intercept(price, size) AS a1, regr_slope(price, code) AS b2, regr_intercept(price, code) AS a2 FROM tr)
  SELECT row_id, round(a1 + b1 * size, 3) AS size_model, round(a2 + b2 * code, 3) AS code_model,
    round(my + wp * (a1 + b1 * size - mp) + wq * (a2 + b2 * code - mq), 3) AS stacked FROM t, g, w WHERE test""",
)
def stacked_linear(spark, sf):
    train, test = M.train_test(shaped(spark, sf, _PAIR), "row_id")
    makers = {"size_model": _linear_on(["size"]), "code_model": _linear_on(["code"])}
    _, scored = M.stack(train, test, "row_id", "price", makers)
    return scored.select("row_id", *[F.round(c, 3).alias(c) for c in (*makers, "stacked")])


@query("feature_importances")
def feature_importances(spark, sf):
    _, model, test = _scored(spark, sf, M.forest("price"))
    names = M.slots(model.transform(test))
    table_ = M.importances(spark, names, model.stages[-1].featureImportances.toArray(), {"size": "Part size"})
    return top(table_, "importance", 10, "feature")


@query("feature_set_comparison")
def feature_set_comparison(spark, sf):
    from gridmere.plans.compare import compare_feature_sets

    sets = {"Size": ["quantity", "size"], "Price": ["retail", "tax", "discount"], "All": NUMBERS}
    performance, _ = compare_feature_sets(parts(spark, sf), sets, "price", "row_id", trees=50)
    return performance


@query(
    "regression_metrics",
    """SELECT count(*) AS rows, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - avg(e * e) / var_pop(y), 6) AS r2
  FROM (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 1000 AS e FROM lineitem) t""",
)
def regression_metrics(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("p", F.col("l_quantity") * 1000)
    m = M.metrics(df, "l_extendedprice", "p")
    return m.select("rows", *[r6(c, c) for c in ("mae", "rmse", "r2")])


@query("growth_model")
def growth_model(spark, sf):
    from gridmere.plans.growth import fit_growth

    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    by = o.groupBy(F.col("c_custkey").alias("sal_code_2021")).agg(
        F.avg("o_totalprice").alias("erp_2025"), F.max("c_acctbal").alias("irsad_score"),
        F.count(F.lit(1)).cast("double").alias("school_count"),
        F.avg(F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice") / 100000)).alias("rent_growth_pct"),
        F.avg(F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.2)).alias("sqm_coverage"),
    )
    scored, _, _ = fit_growth(by, features=["erp_2025", "irsad_score", "school_count"], trees=50)
    return scored


# Nations whose growth is a step of their region; only some are measured, fully or not at all.
_MEASURED = """SELECT n_nationkey AS sal_code_2021, CAST(n_regionkey AS DOUBLE) AS erp_2025, CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE 3e0 * n_regionkey + 1 END AS rent_growth_pct,
  CASE WHEN n_nationkey % 4 = 3 THEN 0e0 ELSE 1e0 END AS sqm_coverage, count(*) AS dwellings_2021 FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey"""


@query(
    "growth_on_steps",
    f"""SELECT sal_code_2021, 3e0 * erp_2025 + 1 AS model_growth_pct, 3e0 * erp_2025 + 1 AS predicted_growth_pct, dwellings_2021 FROM ({_MEASURED}) t""",
)
def growth_on_steps(spark, sf):
    from gridmere.plans.growth import fit_growth

    # a suburb for every region and customer count, so that leaves of three rows are pure
    scored, _, _ = fit_growth(shaped(spark, sf, _MEASURED), features=["erp_2025"])
    return scored.select("sal_code_2021", r6("model_growth_pct", "model_growth_pct"), r6("predicted_growth_pct", "predicted_growth_pct"), "dwellings_2021")
