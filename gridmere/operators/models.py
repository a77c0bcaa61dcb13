"""
Regression on Spark ML: imputation, encoding, splits that survive a re-run, folds,
out-of-fold predictions, stacking, metrics and importances.

Rows go to folds and test sets by a hash of their key, so the same row lands in the
same place whatever the partitioning or a lost executor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.base import Estimator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmere import fixed
from gridmere.functions.numbers import finite
from gridmere.operators.correlation import profile
from gridmere.operators.extra_trees import ExtraTreesRegressor
from gridmere.operators.tables import union_all
from gridmere.session import materialise

_BUCKETS = 10_000


# --- splits -----------------------------------------------------------------


def _bucket(key: str, seed: int):
    """0..9999 from the key's text: the first eight hex digits of an MD5."""
    text = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("long") % _BUCKETS


def train_test(
    df: DataFrame, key: str, test_share: float = 0.2, seed: int = 67
) -> tuple[DataFrame, DataFrame]:
    """
    Train and test rows by a hash of the key. With an area code as the key whole areas
    stay together, so that rows sharing area columns are not on both sides.
    """
    test = _bucket(key, seed) < int(test_share * _BUCKETS)
    return df.where(~test), df.where(test)


def with_fold(df: DataFrame, key: str, folds: int = 5, seed: int = 67, name: str = "fold") -> DataFrame:
    return df.withColumn(name, F.pmod(_bucket(key, seed + 1), F.lit(folds)).cast("int"))


# --- preparation ------------------------------------------------------------


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """The commonest value per column; of equally common ones the smallest."""
    if not columns:
        return {}
    cells = F.array(
        *[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)]
    )
    counts = df.select(F.inline(cells)).where("v IS NOT NULL").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("i").agg(F.min(F.struct(-F.col("n"), F.col("v"))).alias("best"))
    found = {r["i"]: r["best"]["v"] for r in best.collect()}  # one row per column
    types = {c: df.schema[c].dataType for c in columns}
    return {
        c: found[i] if isinstance(types[c], T.StringType) else float(found[i])
        for i, c in enumerate(columns) if i in found
    }


def fill_most_frequent(df: DataFrame, columns: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    return df.fillna(most_frequent(source if source is not None else df, columns))


def exact_medians(df: DataFrame, columns: Sequence[str], error: float = 0.001) -> dict[str, float]:
    """
    The exact median per column, the mean of the middle two for an even count; columns
    without a value are left out.

    Approximate quantiles give brackets around the middle. One pass counts the values below
    and inside each bracket, and the middle ranks are then found among the distinct values inside,
    a share of about four times `error` of the column.
    """
    cols = list(columns)
    num = df.select(*[finite(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)])
    names = num.columns
    low, high = max(0.0, 0.5 - error), min(1.0, 0.5 + error)
    near = num.approxQuantile(names, [low, high], error / 2)
    bounds = {v: tuple(q) for v, q in zip(names, near, strict=True) if q}
    if not bounds:
        return {}
    counts = num.agg(
        *[F.count(v).alias(f"n{v}") for v in bounds],
        *[F.count(F.when(F.col(v) < F.lit(a), 1)).alias(f"b{v}") for v, (a, _) in bounds.items()],
        *[
            F.count(F.when(F.col(v).between(F.lit(a), F.lit(b)), 1)).alias(f"m{v}")
            for v, (a, b) in bounds.items()
        ],
    ).first()
    wanted = {}
    for v, (a, b) in bounds.items():
        n, below, inside = counts[f"n{v}"], counts[f"b{v}"], counts[f"m{v}"]
        ranks = [(n - 1) // 2 - below, n // 2 - below]
        wanted[v] = F.percentile(
            F.when(F.col(v).between(F.lit(a), F.lit(b)), F.col(v)),
            [min(1.0, max(0.0, r / max(1, inside - 1))) for r in ranks],
        ).alias(v)
    middle = num.agg(*wanted.values()).first()
    return {cols[int(v[1:])]: sum(middle[v]) / 2 for v in bounds}


def fill_medians(
    df: DataFrame, columns: Sequence[str], source: DataFrame | None = None, error: float = 0.001
) -> DataFrame:
    """Missing values to the exact median of the source rows (the training rows, say)."""
    medians = exact_medians(source if source is not None else df, columns, error)
    return df.withColumns(
        {c: F.coalesce(finite(F.col(c).cast("double")), F.lit(m)) for c, m in medians.items()}
    )


def standardise(df: DataFrame, columns: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    """Mean 0 and population deviation 1 over the source; a constant column is only centred."""
    base = source if source is not None else df
    row = base.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return df.withColumns(
        {
            c: (F.col(c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0)
            for i, c in enumerate(columns)
        }
    )


class _FillParams(Params):
    numeric = Param(Params._dummy(), "numeric", "columns filled with their median", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "columns filled with their mode", TypeConverters.toListString)
    suffix = Param(Params._dummy(), "suffix", "ending of the filled columns' names", TypeConverters.toString)


class FillMissing(Estimator, _FillParams, DefaultParamsReadable, DefaultParamsWritable):
    """
    Exact medians of numbers and modes of categories (of equally common ones the smallest), learned
    from the rows it is fitted on. The filled columns stand beside the given ones, under
    their names and `suffix`. A number column without a value is filled with 0, a category with ''.
    """

    def __init__(self, numeric: Sequence[str] = (), categorical: Sequence[str] = (), suffix: str = "__filled"):
        super().__init__()
        self._set(numeric=list(numeric), categorical=list(categorical), suffix=suffix)

    def _fit(self, df: DataFrame) -> FillMissingModel:
        numeric, categorical = self.getOrDefault("numeric"), self.getOrDefault("categorical")
        medians = exact_medians(df, numeric) if numeric else {}
        modes = most_frequent(df.select(*[F.col(c).cast("string").alias(c) for c in categorical]), categorical)
        return self._copyValues(FillMissingModel())._set(
            medians=[medians.get(c, 0.0) for c in numeric], modes=[modes.get(c, "") for c in categorical]
        )


class FillMissingModel(Model, _FillParams, DefaultParamsReadable, DefaultParamsWritable):
    """What `FillMissing` learned; a savable stage of a pipeline."""

    medians = Param(Params._dummy(), "medians", "one per numeric column", TypeConverters.toListFloat)
    modes = Param(Params._dummy(), "modes", "one per categorical column", TypeConverters.toListString)

    def _transform(self, df: DataFrame) -> DataFrame:
        numeric, categorical, suffix = (self.getOrDefault(p) for p in ("numeric", "categorical", "suffix"))
        filled = {
            f"{c}{suffix}": F.coalesce(finite(F.col(c).cast("double")), F.lit(m))
            for c, m in zip(numeric, self.getOrDefault("medians"), strict=True)
        } | {
            f"{c}{suffix}": F.coalesce(F.col(c).cast("string"), F.lit(m))
            for c, m in zip(categorical, self.getOrDefault("modes"), strict=True)
        }
        return df.withColumns(filled)


def preparation(
    numeric: Sequence[str], categorical: Sequence[str] = (), scale: bool = True, out: str = "features"
) -> list[Estimator | Transformer]:
    """
    Missing numbers to the median, missing categories to the mode; (scaled) numbers and one-hot
    categories, where an unseen value is all zeros.
    """
    stages: list[Estimator | Transformer] = [FillMissing(numeric, categorical)]
    parts = []
    if numeric:
        stages.append(VectorAssembler(inputCols=[f"{c}__filled" for c in numeric], outputCol=f"{out}__num"))
        parts.append(f"{out}__num")
        if scale:
            stages.append(
                StandardScaler(inputCol=f"{out}__num", outputCol=f"{out}__scaled", withMean=True, withStd=True)
            )
            parts[-1] = f"{out}__scaled"
    if categorical:
        idx, hot = [f"{c}__index" for c in categorical], [f"{c}__hot" for c in categorical]
        stages += [
            StringIndexer(inputCols=[f"{c}__filled" for c in categorical], outputCols=idx, handleInvalid="keep"),
            OneHotEncoder(inputCols=idx, outputCols=hot, dropLast=True),
        ]
        parts += hot
    return [*stages, VectorAssembler(inputCols=parts, outputCol=out)]


def linear(label: str, features: str = "features", prediction: str = "prediction") -> LinearRegression:
    return LinearRegression(labelCol=label, featuresCol=features, predictionCol=prediction)


def forest(
    label: str, trees: int = 300, depth: int = 12, seed: int = 67, leaf: int = 1,
    features: str = "features", prediction: str = "prediction",
) -> RandomForestRegressor:
    return RandomForestRegressor(
        labelCol=label, featuresCol=features, predictionCol=prediction, numTrees=trees, maxDepth=depth,
        seed=seed, minInstancesPerNode=leaf, featureSubsetStrategy="all",
    )


def randomised_forest(
    label: str, trees: int = 500, depth: int = 12, seed: int = 42, leaf: int = 3,
    features: str = "features", prediction: str = "prediction",
) -> ExtraTreesRegressor:
    """Extremely randomised trees over all rows and features."""
    return ExtraTreesRegressor(trees, depth, leaf, seed, features, label, prediction)


def boosting(
    label: str, rounds: int = 300, rate: float = 0.05, depth: int = 5, seed: int = 67,
    features: str = "features", prediction: str = "prediction",
) -> GBTRegressor:
    """Spark ML has no cap on leaves; the depth bounds them at 2 ** depth."""
    return GBTRegressor(
        labelCol=label, featuresCol=features, predictionCol=prediction, maxIter=rounds, stepSize=rate,
        maxDepth=depth, seed=seed,
    )


# --- evaluation -------------------------------------------------------------


def metrics(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """One row: rows, mae, rmse, r2."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    return df.where(y.isNotNull() & p.isNotNull()).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
    )


def out_of_fold(
    df: DataFrame, make: Callable[[], Pipeline], folds: int = 5, fold: str = "fold",
    prediction: str = "prediction",
) -> DataFrame:
    """Each row predicted by the model that was fitted without its fold."""
    cached, parts = df.persist(), []
    for i in range(folds):
        model = make().fit(cached.where(F.col(fold) != i))
        # predicts from the rows themselves, so that the cached ones can go
        parts.append(model.transform(df.where(F.col(fold) == i)).select(*df.columns, prediction))
    cached.unpersist()
    return union_all(parts)


def stack(
    train: DataFrame, test: DataFrame, key: str, label: str, makers: Mapping[str, Callable[[], Pipeline]],
    folds: int = 5,
) -> tuple[PipelineModel, DataFrame]:
    """
    A linear model over the out-of-fold predictions of several models, applied to the
    test predictions of the same models refitted on all training rows. Returns it and the
    test rows: key, label, one prediction per model, and `stacked`.
    """
    folded = materialise(with_fold(train, key, folds), "folded")
    test = materialise(test, "held_out")
    meta, final = folded.select(key, label), test.select(key, label)
    for name, make in makers.items():
        oof = out_of_fold(folded, make, folds)
        meta = meta.join(oof.select(key, F.col("prediction").alias(name)), key)
        full = make().fit(folded)
        final = final.join(full.transform(test).select(key, F.col("prediction").alias(name)), key)
    names = list(makers)
    top = Pipeline(
        stages=[
            VectorAssembler(inputCols=names, outputCol="__meta"),
            linear(label, "__meta", "stacked"),
        ]
    ).fit(meta)
    return top, top.transform(final).select(key, label, *names, "stacked")


# --- explanation ------------------------------------------------------------


def slots(df: DataFrame, features: str = "features", numeric: Sequence[str] = ()) -> list[str]:
    """
    Names of the vector's entries, from the column metadata. Scaling drops the names of
    the numbers, so they are taken from the list given to `preparation`.
    """
    attrs = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    found = sorted((a["idx"], a.get("name", str(a["idx"]))) for kind in attrs.values() for a in kind)
    scaled = f"{features}__scaled_"
    out = []
    for _, name in found:
        if name.startswith(scaled):
            name = numeric[int(name.removeprefix(scaled))] if numeric else name
        out.append(name.removeprefix(f"{features}__num_").replace("__filled", "").replace("__hot", ""))
    return out


def importances(spark, names: Sequence[str], values, labels: Mapping[str, str] | None = None) -> DataFrame:
    """feature, label, value, importance (its size), largest first by position."""
    labels = labels or {}
    rows = [(n, labels.get(n, n), float(v), abs(float(v))) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature string, label string, value double, importance double")


# --- ridge ------------------------------------------------------------------


def _over_blocks(df: DataFrame, columns: Sequence[str], work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of `size` numbers that `work` makes of each block of rows."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += work(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype("f8"))
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(size), pa.int32()), "v": total})

    num = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    sums = num.mapInArrow(blocks, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in sums:
        out[r["at"]] = r["v"]
    return out


def ridge_search(
    df: DataFrame, features: Sequence[str], label: str, alphas: Sequence[float] | None = None
) -> dict:
    """
    Ridge regression on standardised features with the penalty of the least leave-one-out error.

    The data is read three times: for the means, for the matrix of products, and for the errors.
    In the axes of that matrix the fit and the leverage of a row are sums over the features, so that
    one product with a feature-by-penalty matrix gives them for a block of rows and all penalties; the
    row's error without itself is its residual over one less its leverage. Needs rows without
    missing values. Only sums come back: numbers per feature pair and per penalty.
    """
    if alphas is None:
        lo, hi, n = fixed.RIDGE_ALPHAS
        alphas = np.logspace(lo, hi, n)
    alphas, k, columns = np.asarray(alphas, float), len(features), [*features, label]
    known = profile(df, columns)
    rows = known[label][0]
    centre = np.array([known[c][4] for c in columns])

    def cross(x: np.ndarray) -> np.ndarray:
        x = x - centre
        return (x.T @ x).ravel()

    products = _over_blocks(df, columns, cross, (k + 1) ** 2).reshape(k + 1, k + 1)
    scale = np.sqrt(np.diag(products)[:k] / rows)
    scale[scale == 0] = 1.0
    values, axes = np.linalg.eigh(products[:k, :k] / np.outer(scale, scale))
    values = np.clip(values, 0, None)
    along = axes.T @ (products[:k, k] / scale)
    shrunk = 1 / (values[:, None] + alphas)

    def errors(x: np.ndarray) -> np.ndarray:
        x = x - centre
        own = (x[:, :k] / scale) @ axes
        leverage = (own * own) @ shrunk + 1 / rows
        left = x[:, k:] - (own * along) @ shrunk
        return ((left / (1 - leverage)) ** 2).sum(axis=0)

    loss = _over_blocks(df, columns, errors, len(alphas)) / rows
    best = int(np.argmin(loss))
    beta = axes @ (along * shrunk[:, best])
    weights = beta / scale
    return {
        "alpha": float(alphas[best]),
        "coefficients": dict(zip(features, map(float, beta))),
        "weights": dict(zip(features, map(float, weights))),
        "intercept": float(centre[k] - weights @ centre[:k]),
        "cv_mse": float(loss[best]),
    }


def ridge_predict(df: DataFrame, model: Mapping, name: str = "prediction") -> DataFrame:
    value = F.lit(model["intercept"])
    for c, w in model["weights"].items():
        value = value + F.col(c).cast("double") * F.lit(float(w))
    return df.withColumn(name, value)
