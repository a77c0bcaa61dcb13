"""Cleaning rules, one by one and together."""


from gridmere.catalog.registry import CLEAN_LISTINGS, query, shaped
from gridmere.operators import cleaning as C

_T = f"({CLEAN_LISTINGS}) t"


def listings(spark, sf):
    return shaped(spark, sf, CLEAN_LISTINGS)


@query("void_sentinels", f"SELECT listing_id, CASE WHEN weekly_rent <> 0 THEN weekly_rent END AS weekly_rent FROM {_T}")
def void_sentinels(spark, sf):
    return C.void_sentinels(listings(spark, sf)).select("listing_id", "weekly_rent")


@query("drop_unusable_target", f"SELECT listing_id, weekly_rent FROM {_T} WHERE weekly_rent >= 80 AND weekly_rent < 20000")
def drop_unusable_target(spark, sf):
    return C.drop_unusable_target(listings(spark, sf)).select("listing_id", "weekly_rent")


@query("drop_other_categories", f"SELECT listing_id, property_type FROM {_T} WHERE property_type IS NULL OR property_type NOT IN ('Car Space', 'Vacant land', 'Block of Units')")
def drop_other_categories(spark, sf):
    return C.drop_other_categories(listings(spark, sf)).select("listing_id", "property_type")


_ATTR = """SELECT *, CASE WHEN bedrooms > 12 THEN NULL ELSE bedrooms END AS b FROM {t}"""


@query(
    "void_implausible",
    f"""SELECT listing_id, b AS bedrooms, CASE WHEN bathrooms > 8 AND bathrooms > b + 2 THEN NULL ELSE bathrooms END AS bathrooms,
  CASE WHEN carspaces > 12 THEN NULL ELSE carspaces END AS carspaces FROM ({_ATTR.format(t=_T)}) q""",
)
def void_implausible(spark, sf):
    return C.void_implausible(listings(spark, sf)).select("listing_id", "bedrooms", "bathrooms", "carspaces")


@query(
    "drop_per_room",
    f"""SELECT listing_id, weekly_rent, bedrooms FROM {_T} WHERE NOT coalesce(bedrooms >= 4 AND weekly_rent / nullif(bedrooms, 0) < 80, false)""",
)
def drop_per_room(spark, sf):
    return C.drop_per_room(listings(spark, sf)).select("listing_id", "weekly_rent", "bedrooms")


@query(
    "drop_stale",
    f"SELECT listing_id, date_listed FROM {_T} WHERE NOT coalesce(date_diff('day', date_listed, (SELECT max(date_listed) FROM {_T})) > 365, false)",
)
def drop_stale(spark, sf):
    return C.drop_stale(listings(spark, sf)).select("listing_id", "date_listed")


_KEYED = """SELECT *, trim(regexp_replace(replace(upper(address) || ' ', ' AVE ', ' AVENUE '), '[^A-Z0-9]+', ' ', 'g')) AS address_key FROM {t}"""
_RANKED = """SELECT *, row_number() OVER (PARTITION BY address_key, postcode, bedrooms, bathrooms ORDER BY date_listed DESC NULLS LAST, listing_id DESC) AS rn FROM ({k}) k"""


@query(
    "drop_older_copies",
    f"SELECT listing_id, address_key, date_listed FROM ({_RANKED.format(k=_KEYED.format(t=_T))}) r WHERE address_key IS NULL OR rn = 1",
)
def drop_older_copies(spark, sf):
    return C.drop_older_copies(listings(spark, sf)).select("listing_id", "address_key", "date_listed")


_OUT = "lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat BETWEEN -39.25 AND -33.95 AND lon BETWEEN 140.90 AND 150.05)"


@query(
    "void_far_coordinates",
    f"SELECT listing_id, CASE WHEN NOT ({_OUT}) THEN lat END AS lat, CASE WHEN NOT ({_OUT}) THEN lon END AS lon FROM {_T}",
)
def void_far_coordinates(spark, sf):
    return C.void_far_coordinates(listings(spark, sf)).select("listing_id", "lat", "lon")


@query(
    "fill_zeros",
    f"SELECT listing_id, coalesce(carspaces, 0) AS carspaces, CAST(carspaces IS NULL AS INT) AS carspaces_missing FROM {_T}",
)
def fill_zeros(spark, sf):
    return C.fill_zeros(listings(spark, sf)).select("listing_id", "carspaces", "carspaces_missing")


@query(
    "missing_flags",
    f"SELECT listing_id, CAST(carspaces IS NULL AS INT) AS carspaces_missing, CAST(bedrooms IS NULL AS INT) AS bedrooms_missing, CAST(bathrooms IS NULL AS INT) AS bathrooms_missing FROM {_T}",
)
def missing_flags(spark, sf):
    return C.add_missing_flags(listings(spark, sf)).select(
        "listing_id", "carspaces_missing", "bedrooms_missing", "bathrooms_missing"
    )


@query("high_target_flag", f"SELECT listing_id, CAST(coalesce(weekly_rent > 3000, false) AS INT) AS rent_outlier_high FROM {_T}")
def high_target_flag(spark, sf):
    return C.flag_high_target(listings(spark, sf)).select("listing_id", "rent_outlier_high")


@query("target_range", f"SELECT listing_id, weekly_rent FROM {_T} WHERE weekly_rent BETWEEN 100 AND 5000")
def target_range(spark, sf):
    return C.keep_target_range(listings(spark, sf)).select("listing_id", "weekly_rent")


# Every rule in order, as a chain of subqueries.
_CHAIN = f"""WITH s0 AS (SELECT * REPLACE (CASE WHEN weekly_rent <> 0 THEN weekly_rent END AS weekly_rent) FROM {_T}),
  s1 AS (SELECT * FROM s0 WHERE weekly_rent >= 80 AND weekly_rent < 20000),
  s2 AS (SELECT * FROM s1 WHERE property_type IS NULL OR property_type NOT IN ('Car Space', 'Vacant land', 'Block of Units')),
  s3 AS (SELECT * REPLACE (CASE WHEN bedrooms > 12 THEN NULL ELSE bedrooms END AS bedrooms, CASE WHEN carspaces > 12 THEN NULL ELSE carspaces END AS carspaces) FROM s2),
  s4 AS (SELECT * REPLACE (CASE WHEN bathrooms > 8 AND bathrooms > bedrooms + 2 THEN NULL ELSE bathrooms END AS bathrooms) FROM s3),
  s5 AS (SELECT * FROM s4 WHERE NOT coalesce(bedrooms >= 4 AND weekly_rent / nullif(bedrooms, 0) < 80, false)),
  s6 AS (SELECT * FROM s5 WHERE NOT coalesce(date_diff('day', date_listed, (SELECT max(date_listed) FROM s5)) > 365, false)),
  s7 AS (SELECT * EXCLUDE (rn) FROM ({_RANKED.format(k=_KEYED.format(t='s6'))}) r WHERE address_key IS NULL OR rn = 1)"""


@query(
    "clean_listings",
    f"""{_CHAIN} SELECT listing_id, weekly_rent, property_type, bedrooms, bathrooms, coalesce(carspaces, 0) AS carspaces, date_listed, address, postcode,
  CASE WHEN NOT ({_OUT}) THEN lat END AS lat, CASE WHEN NOT ({_OUT}) THEN lon END AS lon, address_key, CAST(carspaces IS NULL AS INT) AS carspaces_missing,
  CAST(bedrooms IS NULL AS INT) AS bedrooms_missing, CAST(bathrooms IS NULL AS INT) AS bathrooms_missing, CAST(weekly_rent > 3000 AS INT) AS rent_outlier_high FROM s7""",
)
def clean_listings(spark, sf):
    return C.clean_listings(listings(spark, sf))


@query(
    "cleaning_ledger",
    f"""{_CHAIN}, n AS (SELECT (SELECT count(*) FROM s0) AS n0, (SELECT count(*) FROM s1) AS n1, (SELECT count(*) FROM s2) AS n2,
    (SELECT count(*) FROM s5) AS n3, (SELECT count(*) FROM s6) AS n4, (SELECT count(*) FROM s7) AS n5)
  SELECT 0 AS step, 'unusable_target' AS rule, n0 AS rows_in, n1 AS rows_out, n0 - n1 AS dropped FROM n
  UNION ALL SELECT 1, 'other_category', n1, n2, n1 - n2 FROM n UNION ALL SELECT 2, 'per_room_pricing', n2, n3, n2 - n3 FROM n
  UNION ALL SELECT 3, 'stale', n3, n4, n3 - n4 FROM n UNION ALL SELECT 4, 'older_copy', n4, n5, n4 - n5 FROM n""",
)
def cleaning_ledger(spark, sf):
    return C.cleaning_ledger(listings(spark, sf))


