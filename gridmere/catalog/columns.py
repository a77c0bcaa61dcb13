"""Column selection (F1-F8) over the cleaned listings and derived attribute columns."""

from pyspark.sql import functions as F

from gridmere.catalog.registry import CLEAN_LISTINGS, query, shaped, table
from gridmere.operators import cleaning as C
from gridmere.operators import columns as K

_WIDE = f"""SELECT *, bedrooms * 2 AS census_rooms, bedrooms AS tax_income_earners_2021_22, bathrooms AS tax_income_earners_2022_23,
  CAST(NULL AS DOUBLE) AS nothing, 1e0 AS always, weekly_rent * 4 AS bond, date_listed AS seen_on, bathrooms + 5 AS irsd_score,
  listing_id % 7 AS irsd_aus_decile, (listing_id * 7919) % 1000 AS erp_2024, (listing_id * 104729) % 997 AS erp_2025
  FROM ({CLEAN_LISTINGS}) t"""


def wide(spark, sf):
    return shaped(spark, sf, _WIDE)


def fates(spark, rows):
    return spark.createDataFrame(rows, "column string, reason string")


def with_counts(df, spark, rows):
    """Each column's fate beside its number of values, from one pass over the data."""
    from gridmere.operators.quality import non_null_rates

    return fates(spark, rows).join(non_null_rates(df), "column", "left").select("column", "reason", "filled")


def counts_sql(rows):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{why}' AS reason, count({c}) AS filled FROM w""" for c, why in rows
    )


_ROLE_ROWS = [
    ("bond", "computed from the target"),
    ("listing_id", "names a row or a place"),
    ("address", "names a row or a place"),
    ("postcode", "names a row or a place"),
    ("date_listed", "not known when the price is set"),
]


@query("role_rejection", f"WITH w AS ({_WIDE}) {counts_sql(_ROLE_ROWS)}")
def role_rejection(spark, sf):
    df = wide(spark, sf)
    return with_counts(df, spark, list(K.reject_by_role(df.columns).items()))


_PATTERN_ROWS = [
    ("irsd_aus_decile", "the percentile says the same, finer"),
    ("irsd_score", "the percentile says the same on a known scale"),
]


@query("pattern_rejection", f"WITH w AS ({_WIDE}) {counts_sql(_PATTERN_ROWS)}")
def pattern_rejection(spark, sf):
    df = wide(spark, sf)
    return with_counts(df, spark, list(K.reject_by_pattern(df.columns).items()))


_TYPE_ROWS = [("lat", "numeric"), ("property_type", "categorical"), ("seen_on", "no use for a date")]


@query("type_split", f"WITH w AS ({_WIDE}) {counts_sql(_TYPE_ROWS)}")
def type_split(spark, sf):
    df = wide(spark, sf)
    nums, cats, other = K.split_by_type(df, ["lat", "property_type", "seen_on"])
    rows = [(c, "numeric") for c in nums] + [(c, "categorical") for c in cats] + list(other.items())
    return with_counts(df, spark, rows)


@query("empty_rejection", f"WITH w AS ({_WIDE}) {counts_sql([('nothing', 'no value in any row')])}")
def empty_rejection(spark, sf):
    df = wide(spark, sf)
    rows = [(c, "no value in any row") for c in K.entirely_missing(df, ["bedrooms", "nothing", "lat"])]
    return with_counts(df, spark, rows)


_VINTAGE_ROWS = [("tax_income_earners_2021_22", "tax_income_earners_2022_23"), ("erp_2024", "erp_2025")]


@query("vintage_pruning", f"WITH w AS ({_WIDE}) {counts_sql(_VINTAGE_ROWS)}")
def vintage_pruning(spark, sf):
    df = wide(spark, sf)
    return with_counts(df, spark, list(K.superseded_vintages(df.columns).items()))


_CORR_ROWS = [("bedrooms", "census_rooms"), ("always", "constant")]


@query("correlation_pruning", f"WITH w AS ({_WIDE}) {counts_sql(_CORR_ROWS)}")
def correlation_pruning(spark, sf):
    df = wide(spark, sf)
    lost = K.correlated_columns(df, ["bedrooms", "bathrooms", "census_rooms", "always", "erp_2025"])
    return with_counts(df, spark, list(lost.items()))


# Expected fate of every column of the cleaned wide table.
_FEATURE_ROWS = [
    ("weekly_rent", "rejected", "target"),
    ("bond", "rejected", "computed from the target"),
    ("rent_outlier_high", "rejected", "computed from the target"),
    ("listing_id", "rejected", "names a row or a place"),
    ("address", "rejected", "names a row or a place"),
    ("address_key", "rejected", "names a row or a place"),
    ("postcode", "rejected", "names a row or a place"),
    ("date_listed", "rejected", "not known when the price is set"),
    ("irsd_score", "rejected", "the percentile says the same on a known scale"),
    ("irsd_aus_decile", "rejected", "the percentile says the same, finer"),
    ("seen_on", "rejected", "no use for a date"),
    ("nothing", "rejected", "no value in any row"),
    ("tax_income_earners_2021_22", "rejected", "older than tax_income_earners_2022_23"),
    ("erp_2024", "rejected", "older than erp_2025"),
    ("always", "rejected", "constant"),
    ("bathrooms", "rejected", "follows tax_income_earners_2022_23"),
    ("bedrooms", "rejected", "follows census_rooms"),
    ("census_rooms", "numeric", None), ("tax_income_earners_2022_23", "numeric", None),
    ("erp_2025", "numeric", None), ("carspaces", "numeric", None), ("lat", "numeric", None), ("lon", "numeric", None),
    ("carspaces_missing", "numeric", None), ("bedrooms_missing", "numeric", None),
    ("bathrooms_missing", "numeric", None), ("property_type", "categorical", None),
]


@query(
    "feature_selection",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{c}', '{r}', {'NULL' if w is None else repr(w)})" for c, r, w in _FEATURE_ROWS)
    + ') t("column", role, reason)',
)
def feature_selection(spark, sf):
    return K.select_features(C.clean_listings(wide(spark, sf))).as_table(spark)


@query(
    "present_columns",
    """SELECT 'lat' AS "column", true AS present, count(*) FILTER (c_acctbal > 0) AS positive FROM customer
  UNION ALL SELECT 'c_name', true, count(*) FILTER (c_acctbal > 0) FROM customer
  UNION ALL SELECT 'osm_hospital_count', false, count(*) FILTER (c_acctbal > 0) FROM customer""",
)
def present_columns(spark, sf):
    df = table(spark, sf, "customer").withColumn("lat", F.col("c_acctbal"))
    have, lack = K.present_and_absent(df, ["lat", "osm_hospital_count", "c_name"])
    names = F.array(
        *[F.struct(F.lit(c).alias("column"), F.lit(True).alias("present")) for c in have],
        *[F.struct(F.lit(c).alias("column"), F.lit(False).alias("present")) for c in lack],
    )
    positive = df.agg(F.count(F.when(F.col("lat") > 0, 1)).alias("positive"))
    return positive.select(F.explode(names).alias("n"), "positive").select("n.*", "positive")
