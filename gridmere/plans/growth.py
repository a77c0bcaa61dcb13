"""Suburb growth: measured trends, area covariates, a model, and their blend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmere import fixed
from gridmere.functions.numbers import blend
from gridmere.operators import models as M
from gridmere.operators.crosswalk import weighted_values
from gridmere.operators.tables import last_values, left_join_all, top
from gridmere.operators.trend import monthly_trend, yearly_trend
from gridmere.session import materialise

AREA, SUBURB, NAME = "sa2_code_2021", "sal_code_2021", "sal_name_2021"
MODEL_FEATURES = [*fixed.AREA_FEATURES, *fixed.HISTORY_FEATURES, *fixed.INCIDENT_FEATURES]


def build_suburbs(
    bridge: DataFrame,
    index: DataFrame,
    area_master: DataFrame,
    area_yearly: DataFrame,
    master: DataFrame | None = None,
    series: str = "combined",
    features: Sequence[str] = tuple(fixed.AREA_FEATURES),
) -> DataFrame:
    """
    One row per suburb: its measured rent trend and the coverage of that, area covariates
    and their histories weighted onto the suburb, its latest incident rates, and dwellings.
    """
    on = [SUBURB, NAME]
    trends = monthly_trend(index, "postcode", "date", series).drop("current_market_rent")
    target = weighted_values(bridge, trends, on, "postcode", "share_of_suburb").withColumnRenamed(
        "coverage", "sqm_coverage"
    )
    covariates = weighted_values(
        bridge, area_master.select(AREA, *features), on, AREA, "share_of_suburb"
    ).drop("coverage")
    population = yearly_trend(area_yearly, AREA, "year", "erp", fixed.HISTORY_FEATURES[0])
    income = yearly_trend(area_yearly, AREA, "year", "income_median", fixed.HISTORY_FEATURES[1])
    history = weighted_values(
        bridge, population.join(income, AREA, "full_outer"), on, AREA, "share_of_suburb"
    ).drop("coverage")
    dwellings = bridge.where(F.col(SUBURB).isNotNull()).groupBy(SUBURB).agg(
        F.sum("dwellings_2021").alias("dwellings_2021")
    )
    out = target.join(covariates, on, "full_outer").join(history, on, "full_outer")
    extra = [dwellings]
    have = [c for c in fixed.INCIDENT_FEATURES if master is not None and c in master.columns]
    if have and SUBURB in master.columns:
        extra.insert(0, last_values(master, SUBURB, ["date_listed", "listing_id"], have))
    return left_join_all(out, extra, SUBURB)


def fit_growth(
    suburbs: DataFrame,
    features: Sequence[str] = tuple(MODEL_FEATURES),
    label: str = "rent_growth_pct",
    coverage: str = "sqm_coverage",
    key: str = SUBURB,
    trees: int = 500,
    depth: int = 12,
    folds: int = 5,
):
    """
    Trained on suburbs whose trend covers enough dwellings, applied to all. Returns the
    suburbs with `model_growth_pct` and `predicted_growth_pct`, the importances, and the
    cross-validated metrics.
    """
    spark = suburbs.sparkSession
    used = [c for c in features if c in suburbs.columns]
    usable = (F.col(coverage) >= fixed.MIN_TRAIN_COVERAGE) & F.col(label).isNotNull()
    train = materialise(M.with_fold(suburbs.where(usable), key, folds, seed=42), "train")

    def make():
        return Pipeline(
            stages=[
                *M.preparation(used, scale=False),
                M.randomised_forest(label, trees, depth, prediction="model_growth_pct"),
            ]
        )

    scores = M.metrics(M.out_of_fold(train, make, folds, prediction="model_growth_pct"), label, "model_growth_pct")
    model = make().fit(train)
    blended = blend(F.col(label), F.col("model_growth_pct"), F.col(coverage))
    predicted = (
        model.transform(suburbs)
        .select(*suburbs.columns, "model_growth_pct")
        .withColumn("predicted_growth_pct", blended)
    )
    weights = M.importances(spark, used, model.stages[-1].featureImportances.toArray())
    return predicted, weights, scores


def ranking(predicted: DataFrame, n: int = 10, least: int = fixed.RANKING_MIN_DWELLINGS) -> DataFrame:
    """The suburbs with the largest predicted growth among those large enough."""
    big = predicted.where(F.col("dwellings_2021") >= least)
    return top(big, "predicted_growth_pct", n, SUBURB).select(
        NAME, "predicted_growth_pct", "rent_growth_pct", "model_growth_pct", "sqm_coverage", "dwellings_2021"
    )
