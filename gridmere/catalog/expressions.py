"""Column expressions (E1-E25, G1, G6, and the scalar families)."""

from pyspark.sql import functions as F

from gridmere import fixed
from gridmere.catalog.registry import CLEAN_LISTINGS, GEO_LEFT, LABELS_TEXT, query, r6, shaped, table
from gridmere.functions import dates as D
from gridmere.functions import numbers as N
from gridmere.functions import sphere as S
from gridmere.functions import text as X
from gridmere.operators.columns import pick_column
from gridmere.operators.tables import exclude_listed, finite_columns


def sql_values(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def sql_case(column: str, mapping) -> str:
    return f"CASE {column} " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()
    ) + " END"


_CODES = """SELECT p_partkey AS id,
  CASE p_partkey % 4 WHEN 0 THEN concat(' ', 210000000 + p_partkey, '.0') WHEN 1 THEN concat(210000000 + p_partkey, '.0')
    WHEN 2 THEN concat('1.05', p_partkey, ' ') ELSE NULL END AS code FROM part"""


@query(
    "code_normalise",
    f"""SELECT id, trim(regexp_replace(code, '\\.0$', '')) AS code,
  trim(replace(code, '.0', '')) AS code_everywhere FROM ({_CODES}) t""",
)
def code_normalise(spark, sf):
    c = F.col("code")
    return shaped(spark, sf, _CODES).select(
        "id", X.code_key(c).alias("code"), X.code_key_everywhere(c).alias("code_everywhere")
    )


_NAMES = """SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN concat(' Colac-Otway ', c_custkey % 50)
  WHEN 1 THEN concat('Hillside (Melton - Vic.)') WHEN 2 THEN concat('St. Kilda/', c_nationkey, ' (Vic.)')
  WHEN 3 THEN concat(c_mktsegment, '  (Greater   Bendigo - Vic) ') WHEN 4 THEN NULL ELSE c_name END AS name FROM customer"""


@query(
    "place_keys",
    f"""WITH n AS ({_NAMES}), k AS (SELECT id, name, regexp_replace(trim(name), '\\s*\\([^)]*\\)\\s*$', '') AS bare,
    regexp_replace(regexp_extract(name, '\\(([^)]*)\\)\\s*$', 1), '\\s*-\\s*Vic\\.?\\s*$', '') AS hint FROM n)
  SELECT id, trim(regexp_replace(upper(trim(bare)), '[^A-Z0-9]+', ' ', 'g')) AS place_key,
    trim(regexp_replace(upper(trim(name)), '[^A-Z0-9]+', ' ', 'g')) AS area_key,
    trim(regexp_replace(upper(trim(hint)), '[^A-Z0-9]+', ' ', 'g')) AS hint FROM k""",
)
def place_keys(spark, sf):
    n = F.col("name")
    return shaped(spark, sf, _NAMES).select(
        "id", X.place_key(n).alias("place_key"), X.area_key(n).alias("area_key"), X.name_hint(n).alias("hint")
    )


@query("column_lookup", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def column_lookup(spark, sf):
    df = table(spark, sf, "nation")
    return df.select(
        F.col(pick_column(df, ["code", "N_NATIONKEY"])).alias("id"),
        F.col(pick_column(df, ["Name", "N_Name"])).alias("name"),
    )


_TEXT_NUMBERS = """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'np' WHEN 1 THEN '' WHEN 2 THEN NULL
  WHEN 3 THEN 'NaN' WHEN 4 THEN concat(CAST(o_custkey AS STRING), 'd') WHEN 5 THEN concat(' ', CAST(o_custkey AS STRING), CASE o_orderkey % 2 WHEN 0 THEN 'f' ELSE '.5e1 ' END)
  ELSE CAST(o_custkey AS STRING) END AS raw FROM orders"""


@query(
    "number_coercion",
    f"""SELECT id, CASE WHEN isfinite(TRY_CAST(raw AS DOUBLE)) THEN TRY_CAST(raw AS DOUBLE) END AS value
  FROM ({_TEXT_NUMBERS}) t""",
)
def number_coercion(spark, sf):
    return shaped(spark, sf, _TEXT_NUMBERS).select("id", N.to_number(F.col("raw")).alias("value"))


@query(
    "code_patterns",
    """SELECT c_custkey AS id, regexp_full_match(CAST(200000000 + c_custkey * 99991 AS VARCHAR), '2\\d{8}') AS is_area,
  regexp_full_match(CAST(20000000000 + c_custkey * 9999991 AS VARCHAR), '2\\d{10}') AS is_block,
  starts_with(CAST(c_custkey AS VARCHAR), '2') AS in_state FROM customer""",
)
def code_patterns(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("id"),
        X.matches_code((k * 99991 + 200000000).cast("string"), 8).alias("is_area"),
        X.matches_code((k * 9999991 + 20000000000).cast("string"), 10).alias("is_block"),
        F.startswith(k.cast("string"), F.lit("2")).alias("in_state"),
    )


@query(
    "membership_filters",
    """SELECT o_orderkey, o_orderpriority FROM orders
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')""",
)
def membership_filters(spark, sf):
    kept = table(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return exclude_listed(kept, "o_orderstatus", ["F"]).select("o_orderkey", "o_orderpriority")


@query("open_status", "SELECT o_orderkey, o_orderstatus FROM orders WHERE upper(o_orderstatus) = 'O'")
def open_status(spark, sf):
    return table(spark, sf, "orders").where(X.is_open(F.lower("o_orderstatus"))).select(
        "o_orderkey", "o_orderstatus"
    )


_STATIONS = """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN concat('Stop ', c_nationkey, ' Railway Station')
  WHEN 1 THEN concat('North ', c_nationkey, ' Station (Town)') WHEN 2 THEN concat('Lift ', c_nationkey)
  WHEN 3 THEN 'Station St/High St' ELSE concat('Central ', c_nationkey, ' Station') END AS name FROM customer"""


@query(
    "station_name",
    f"""SELECT id, trim(regexp_extract(name, '{fixed.STATION_NAME}', 1)) AS station
  FROM ({_STATIONS}) t WHERE trim(regexp_extract(name, '{fixed.STATION_NAME}', 1)) <> ''""",
)
def station_name(spark, sf):
    named = shaped(spark, sf, _STATIONS).select("id", X.station_name(F.col("name")).alias("station"))
    return named.where(F.col("station").isNotNull())


@query(
    "period_close",
    """WITH t AS (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m,
    o_orderkey % 11 = 0 AS bad FROM orders)
  SELECT id, CASE WHEN NOT bad THEN last_day(make_date(y, m, 1)) END AS closed FROM t""",
)
def period_close(spark, sf):
    name = F.when(F.col("o_orderkey") % 11 == 0, "Smarch").otherwise(
        F.concat(F.lit(" "), F.date_format("o_orderdate", "MMMM"))
    )
    year = F.year("o_orderdate").cast("string")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), D.period_close(year, name).alias("closed")
    )


_DIVISIONS = """SELECT event_id, concat(' ', CASE event_type WHEN 'signup' THEN 'a' WHEN 'purchase' THEN 'B' WHEN 'error' THEN 'C'
  WHEN 'view' THEN 'F' ELSE 'Z' END, ' Crimes') AS label FROM events"""


@query(
    "division_mapping",
    f"SELECT event_id, {sql_case('upper(substr(trim(label), 1, 1))', fixed.DIVISIONS)} AS division FROM ({_DIVISIONS}) t",
)
def division_mapping(spark, sf):
    return shaped(spark, sf, _DIVISIONS).select("event_id", X.division(F.col("label")).alias("division"))


def flags_sql(raw: str, patterns=fixed.LABEL_FLAGS) -> str:
    return ", ".join(
        f"""CASE WHEN {raw} IS NULL THEN NULL ELSE CAST(len(list_filter(string_split_regex({raw}, ',\\s*'),
    lambda t: regexp_matches(lower(trim(t)), '{p}'))) > 0 AS INT) END AS feat_{n}"""
        for n, p in patterns.items()
    )


@query(
    "label_flags",
    f"""SELECT id, {flags_sql('raw')}, {flags_sql('raw', {'brand_1': '^brand#1$', 'standard': 'standard|small', 'metal': '(?:steel|brass|tin)$'})}
  FROM ({LABELS_TEXT}) t""",
)
def label_flags(spark, sf):
    extra = {"brand_1": "^brand#1$", "standard": "standard|small", "metal": "(?:steel|brass|tin)$"}
    labels = F.col("labels")
    df = shaped(spark, sf, LABELS_TEXT).select("id", X.labels_of(F.col("raw")).alias("labels"))
    return df.select("id", *X.label_flags(labels), *X.label_flags(labels, extra))


@query(
    "share_and_rate_columns",
    """SELECT l_orderkey, l_linenumber, round(100 * l_tax / nullif(l_tax + l_discount, 0), 6) AS tax_pct,
  round(1000 * l_quantity / nullif(l_discount, 0), 6) AS per_1k FROM lineitem""",
)
def share_and_rate_columns(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        r6(N.share_pct(F.col("l_tax"), F.col("l_tax") + F.col("l_discount")), "tax_pct"),
        r6(N.per_thousand(F.col("l_quantity"), F.col("l_discount")), "per_1k"),
    )


@query(
    "guarded_ratio",
    """SELECT o_orderkey, round(nullif(CAST(o_orderkey % 7 AS DOUBLE), 0) / nullif(CAST(o_custkey % 5 AS DOUBLE), 0), 6) AS r FROM orders""",
)
def guarded_ratio(spark, sf):
    a, b = (F.col("o_orderkey") % 7).cast("double"), (F.col("o_custkey") % 5).cast("double")
    return table(spark, sf, "orders").select("o_orderkey", r6(N.ratio_to(a, b), "r"))


_TARGETS = f"""SELECT listing_id, weekly_rent, bedrooms, weekly_rent * (listing_id % 12) AS bond,
  CAST(listing_id % 4 AS DOUBLE) * 150 AS census_median_rent_weekly,
  CAST(1500 + listing_id % 900 AS DOUBLE) AS census_median_household_income_weekly FROM ({CLEAN_LISTINGS}) c"""


@query(
    "target_derived_split",
    f"""SELECT listing_id, CASE WHEN bond / nullif(weekly_rent, 0) BETWEEN 2 AND 8 THEN round(bond, 4) END AS bond,
  round(nullif(weekly_rent, 0) / nullif(bedrooms, 0), 6) AS rent_per_bedroom,
  round(nullif(weekly_rent, 0) / nullif(census_median_rent_weekly, 0), 6) AS rent_vs_2021_census_median,
  CAST(NULL AS DOUBLE) AS rent_vs_sqm_market,
  round(100 * (nullif(weekly_rent, 0) / nullif(census_median_household_income_weekly, 0)), 6) AS rent_to_area_median_hh_income_pct,
  main.predictors FROM ({_TARGETS}) t,
  (SELECT 'listing_id,weekly_rent,bedrooms,census_median_rent_weekly,census_median_household_income_weekly' AS predictors) main""",
)
def target_derived_split(spark, sf):
    from gridmere.plans.enrich import split_target_derived

    main, derived = split_target_derived(shaped(spark, sf, _TARGETS))
    return derived.select(
        "listing_id", F.round("bond", 4).alias("bond"),
        *[r6(c, c) for c in derived.columns if c not in ("listing_id", "bond")],
        F.lit(",".join(main.columns)).alias("predictors"),
    )


_TYPES = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'House' WHEN 1 THEN 'Studio' WHEN 2 THEN 'Castle' END AS fine,
  CASE o_custkey % 3 WHEN 0 THEN 'Apartment' WHEN 1 THEN 'Townhouse/Villa' ELSE 'Tent' END AS coarse,
  o_totalprice AS houses_all, o_totalprice + 1 AS units_all, CASE WHEN o_orderkey % 10 > 0 THEN o_totalprice + 2 END AS combined FROM orders"""


@query(
    "series_choice",
    f"""WITH t AS (SELECT *, coalesce({sql_case('fine', fixed.SERIES_BY_FINE_TYPE)},
    {sql_case('coarse', fixed.SERIES_BY_COARSE_TYPE)}, 'combined') AS series FROM ({_TYPES}) q)
  SELECT id, series, CASE series WHEN 'houses_all' THEN houses_all WHEN 'units_all' THEN units_all
    WHEN 'combined' THEN combined END AS market FROM t""",
)
def series_choice(spark, sf):
    series = N.choose_series(
        F.col("fine"), F.col("coarse"), fixed.SERIES_BY_FINE_TYPE, fixed.SERIES_BY_COARSE_TYPE
    )
    named = {c: F.col(c) for c in ("houses_all", "units_all", "combined")}
    return shaped(spark, sf, _TYPES).withColumn("series", series).select(
        "id", "series", N.column_named_by(F.col("series"), named).alias("market")
    )


@query(
    "fiscal_year",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) + 1 AS year FROM orders""",
)
def fiscal_year(spark, sf):
    y = F.year("o_orderdate")
    label = F.concat(y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))
    return table(spark, sf, "orders").select("o_orderkey", D.fiscal_year_end(label).alias("year"))


@query(
    "coordinate_key",
    f"""SELECT DISTINCT printf('%.5f,%.5f', lat, lon) AS origin_key FROM ({GEO_LEFT}) t""",
)
def coordinate_key(spark, sf):
    key = S.coordinate_key(F.col("lat"), F.col("lon"))
    return shaped(spark, sf, GEO_LEFT).select(key.alias("origin_key")).distinct()


@query(
    "month_parts",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN -1 ELSE CAST(month(o_orderdate) AS INT) END AS listed_month FROM orders""",
)
def month_parts(spark, sf):
    d = F.when(F.col("o_orderkey") % 19 != 0, F.col("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", D.month_or_sentinel(d).alias("listed_month"))


@query(
    "projected_growth",
    """SELECT p_partkey, round(100 * (p_retailprice / nullif(CAST(p_size % 9 AS DOUBLE), 0) - 1), 6) AS growth_pct FROM part""",
)
def projected_growth(spark, sf):
    start = (F.col("p_size") % 9).cast("double")
    return table(spark, sf, "part").select("p_partkey", r6(N.growth_pct(F.col("p_retailprice"), start), "growth_pct"))


@query(
    "suffixed_family",
    """SELECT o_custkey AS k, round(median(o_totalprice), 4) AS income_median_2022_23, round(avg(o_totalprice), 6) AS income_mean_2022_23,
  count(*) AS income_earners_2022_23 FROM orders GROUP BY 1""",
)
def suffixed_family(spark, sf):
    measures = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.median("o_totalprice").alias("income_median"), F.avg("o_totalprice").alias("income_mean"),
        F.count(F.lit(1)).alias("income_earners"), F.max("o_orderkey").alias("name_area"),
    )
    kept = measures.drop(*[c for c in measures.columns if c.endswith("_area")])
    named = kept.withColumnsRenamed({c: f"{c}_2022_23" for c in kept.columns if c != "k"})
    return named.select(
        "k", F.round("income_median_2022_23", 4).alias("income_median_2022_23"),
        F.round("income_mean_2022_23", 6).alias("income_mean_2022_23"), "income_earners_2022_23",
    )


@query(
    "infinite_to_null",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL WHEN l_tax = 0 THEN NULL ELSE l_quantity END AS v FROM lineitem""",
)
def infinite_to_null(spark, sf):
    v = (
        F.when(F.col("l_discount") == 0, F.lit(float("inf")))
        .when(F.col("l_tax") == 0, F.lit(float("nan")))
        .otherwise(F.col("l_quantity"))
    )
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"))
    return finite_columns(df, ["v"])


@query(
    "coverage_blend",
    """WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS m, l_quantity * 1000 AS p,
    CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity / 40 - 0.1e0 END AS c FROM lineitem),
  u AS (SELECT *, least(greatest(coalesce(c, 0e0), 0e0), 1e0) AS w FROM t)
  SELECT l_orderkey, l_linenumber, round(CASE WHEN m IS NOT NULL THEN w * m + (1 - w) * p ELSE p END, 5) AS blended FROM u""",
)
def coverage_blend(spark, sf):
    measured = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice"))
    cov = F.when(F.col("l_linenumber") != 3, F.col("l_quantity") / 40 - 0.1)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.round(N.blend(measured, F.col("l_quantity") * 1000, cov), 5).alias("blended"),
    )


@query(
    "address_key",
    """SELECT c_custkey AS id, concat(c_custkey % 40, ' SOUTH ', CASE c_custkey % 5 WHEN 0 THEN 'AVENUE' WHEN 1 THEN 'STREET'
    WHEN 2 THEN 'COURT' WHEN 3 THEN 'CRESCENT' ELSE 'STAVE ROAD' END) AS address_key FROM customer""",
)
def address_key(spark, sf):
    k = F.col("c_custkey")
    kind = (
        F.when(k % 5 == 0, "Ave.").when(k % 5 == 1, "st").when(k % 5 == 2, "Crt")
        .when(k % 5 == 3, "Cres").otherwise("Stave-Rd")
    )
    raw = F.concat(F.lit(" "), (k % 40).cast("string"), F.lit("  South, "), kind)
    return table(spark, sf, "customer").select(k.alias("id"), X.address_key(raw).alias("address_key"))


@query(
    "sphere_distance",
    f"""SELECT id, round(cos(radians(lat)) * cos(radians(lon)), 9) AS x, round(cos(radians(lat)) * sin(radians(lon)), 9) AS y,
  round(sin(radians(lat)), 9) AS z, round(2 * asin(least(1, (lat + 38) / 2)) * 6371.0088e0, 6) AS chord_km FROM ({GEO_LEFT}) t""",
)
def sphere_distance(spark, sf):
    df = shaped(spark, sf, GEO_LEFT)
    xyz = df.select("id", "lat", *S.unit_xyz(F.col("lat"), F.col("lon")))
    return xyz.select(
        "id", *[F.round(c, 9).alias(c) for c in "xyz"], r6(S.chord_to_km(F.col("lat") + 38), "chord_km")
    )


@query(
    "distance_to_centre",
    f"""SELECT id, round(2 * 6371.0088e0 * asin(sqrt(pow(sin(radians(-37.8183e0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(-37.8183e0))
  * pow(sin(radians(144.9671e0 - lon) / 2), 2))), 6) AS cbd_km FROM ({GEO_LEFT}) t""",
)
def distance_to_centre(spark, sf):
    km = S.km_to_point(F.col("lat"), F.col("lon"), fixed.CITY_CENTRE)
    return shaped(spark, sf, GEO_LEFT).select("id", r6(km, "cbd_km"))
