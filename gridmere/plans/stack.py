"""The stacked rent model: internal, external and combined features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmere import fixed
from gridmere.functions.dates import month_or_sentinel
from gridmere.operators import models as M
from gridmere.operators.columns import split_by_type
from gridmere.operators.correlation import spearman_pairs
from gridmere.operators.tables import exclude_listed, union_all


def model_table(clean: DataFrame, bad: Sequence[str] = tuple(fixed.BAD_LISTINGS)) -> DataFrame:
    """
    The cleaned table for modelling: months instead of dates (-1 when missing), target-derived
    and unused columns dropped where present, known bad listings left out.
    """
    df = exclude_listed(
        clean.drop(*fixed.TARGET_DERIVED, *fixed.STACK_NOT_USED).withColumn("listing_id", F.col("listing_id").cast("string")),
        "listing_id", list(bad),
    )
    months = {"date_listed": "listed_month", "available_date": "available_month"}
    df = df.withColumns({m: month_or_sentinel(F.col(d)) for d, m in months.items() if d in df.columns})
    df = df.drop(*months)
    if "days_listed" in df.columns:
        df = df.withColumn("days_listed", F.coalesce(F.col("days_listed"), F.lit(-1.0)))
    return df


def redundant_pairs(df: DataFrame, limit: float = fixed.CORRELATION_LIMIT) -> DataFrame:
    """Numeric column pairs with a rank correlation of at least the limit, either way."""
    skip = {*fixed.STACK_IDENTIFIERS, *fixed.STACK_CATEGORIES, fixed.TARGET}
    numeric, _, _ = split_by_type(df, [c for c in df.columns if c not in skip], [])
    return spearman_pairs(df, numeric, "listing_id").where(F.abs("r") >= limit)


def fit_stack(
    df: DataFrame, group: str = "sa2_code_2021", trees: int = 300, rounds: int = 300, depth: int = 5,
    forest_depth: int = 12, folds: int = 5, key: str = "listing_id",
) -> tuple[object, DataFrame, DataFrame]:
    """
    Linear on the listing's own features, forest on the area's, boosting on both, and a
    linear model over their out-of-fold predictions. Returns the top model, the scored test
    rows and a metrics table. The split keeps whole areas together; pass the key as the
    group for a plain random split.
    """
    label = fixed.TARGET
    internal = [c for c in fixed.STACK_INTERNAL if c in df.columns]
    external = [c for c in df.columns if c not in {*fixed.STACK_INTERNAL, *fixed.STACK_IDENTIFIERS, label}]
    cats = [c for c in fixed.STACK_CATEGORIES if c in df.columns]
    # Categories are text; a missing one takes the commonest value of the training rows.
    df = df.withColumns({c: F.col(c).cast("string") for c in cats})
    train, test = M.train_test(df, group)
    commonest = M.most_frequent(train, cats)
    train, test = train.fillna(commonest), test.fillna(commonest)

    def maker(columns, regressor, scale):
        number = [c for c in columns if c not in cats]
        category = [c for c in columns if c in cats]
        return lambda: Pipeline(stages=[*M.preparation(number, category, scale), regressor()])

    makers = {
        "internal": maker(internal, lambda: M.linear(label), True),
        "external": maker(external, lambda: M.forest(label, trees, forest_depth), True),
        "combined": maker([*internal, *external], lambda: M.boosting(label, rounds, depth=depth), False),
    }
    top, scored = M.stack(train, test, key, label, makers, folds)
    table = union_all(
        [M.metrics(scored, label, c).select(F.lit(c).alias("model"), "*") for c in [*makers, "stacked"]]
    )
    return top, scored, table
