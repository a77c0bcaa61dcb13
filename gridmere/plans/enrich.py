"""
The master table build: listings placed in their areas and given distances, counts, lot
sizes, area covariates, and the rent index and incident rates as they stood on the
listing date.

Everything that depends only on where a listing is, is worked out once per distinct
position and joined to the listings in a single equi-join.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmere import fixed
from gridmere.functions.dates import fiscal_year_end, period_close
from gridmere.functions.numbers import (
    choose_series, column_named_by, number_or_null_zero, ratio_to, to_number,
)
from gridmere.functions.sphere import coordinate_key, km_to_point
from gridmere.functions.text import area_key, code_key, division, matches_code, name_hint, place_key, station_name
from gridmere.operators import quality as Q
from gridmere.operators.asof import asof_backward, year_on_year
from gridmere.operators.clusters import merge_same_name
from gridmere.operators.crosswalk import build_correspondence, rescale_release
from gridmere.operators.incidents import incident_rates
from gridmere.operators.nearest import nearest_k, with_nearest_km, with_nearest_km_by
from gridmere.operators.polygons import point_counts, point_counts_by, smallest_lot, with_containing_area
from gridmere.operators.routes import best_routes, routes_to
from gridmere.operators.tables import (
    dominant_child, join_area_table, join_unique, left_join_all, newest_release, not_null,
    one_point_per_name, pivot_first, resolve_candidates, union_all, with_padded_change,
)
from gridmere.session import materialise

AREA, SUBURB = "sa2_code_2021", "sal_code_2021"
AREA_NAMES = ["sa2_name_2021", "sa3_name_2021", "sa4_name_2021", "gccsa_name_2021", "area_albers_sqkm"]
INCOME = list(fixed.INCOME_MEASURES.values())


@dataclass
class Sources:
    """Landed tables. Optional ones may be absent; the build goes on and records it."""

    listings: DataFrame  # typed, see sources.tables.type_listings
    areas: DataFrame  # sa2_code_2021, names, area_albers_sqkm, edges
    blocks: DataFrame  # mesh blocks: area codes, postcode, dwellings, persons, area_sqkm
    snapshots: Mapping[str, DataFrame] = field(default_factory=dict)  # keyed by sa2_code_2021
    population: DataFrame | None = None  # sa2_code_2021, year, erp
    income: list[DataFrame] = field(default_factory=list)  # releases, newest first (long)
    income_year: str = "2022-23"
    schools: DataFrame | None = None  # school_id, school_lat, school_lon
    stops: DataFrame | None = None  # stop_id, stop_name, stop_mode, stop_lat, stop_lon
    amenities: DataFrame | None = None  # amenity_id, amenity_type, amenity_lat, amenity_lon
    routes: DataFrame | None = None  # origin_key, dest_key, drive_km, drive_min
    lots: DataFrame | None = None  # prop_pfi, edges
    index: DataFrame | None = None  # postcode, date, value series
    incidents: DataFrame | None = None  # year, year_ending, postcode, suburb, lga, offence_division, incidents
    suburb_population: DataFrame | None = None  # sal_code, sal_name, population


@dataclass
class Tables:
    master: DataFrame
    area_master: DataFrame
    area_yearly: DataFrame
    correspondence: DataFrame
    rent_ratios: DataFrame
    coverage: DataFrame


# --- areas ------------------------------------------------------------------


def suburb_bridge(blocks: DataFrame) -> DataFrame:
    """Suburb x postcode x area overlaps with the share of each they make up."""
    usable = blocks.where(
        matches_code(F.col("mb_code"), 10) & F.col("area_sqkm").isNotNull()
    ).fillna(0, subset=["dwellings", "persons"])
    return build_correspondence(
        usable,
        [SUBURB, "sal_name_2021", "postcode", AREA, "sa2_name_2021"],
        {"dwellings": "dwellings_2021", "persons": "persons_2021", "area_sqkm": "area_sqkm"},
        {SUBURB: "share_of_suburb", "postcode": "share_of_postcode", AREA: "share_of_sa2"},
        "dwellings", "area_sqkm",
    )


def with_suburb_code(listings: DataFrame, bridge: DataFrame) -> DataFrame:
    """Suburb code by (name, postcode); one row per listing."""
    pairs = bridge.select(SUBURB, "sal_name_2021", "postcode").distinct().select(
        place_key(F.col("sal_name_2021")).alias("__name"),
        F.col("postcode").cast("string").alias("__post"), SUBURB, "sal_name_2021",
    )
    keyed = listings.withColumns(
        {"__name": place_key(F.col("suburb")), "__post": F.col("postcode").cast("string")}
    )
    joined = join_unique(keyed, pairs, ["__name", "__post"], [F.col(SUBURB)])
    return joined.drop("__name", "__post")


def yearly_income(releases: list[DataFrame]) -> DataFrame:
    """
    Releases (newest first; sa2_code_2021, financial_year, measure, value, income_release)
    on one basis, the newest figure kept per area and year.
    """
    wide = [
        pivot_first(r, [AREA, "financial_year", "income_release"], "measure", INCOME, "value")
        for r in releases
    ]
    scaled = [m for m in INCOME if m != "income_earners_median_age"]
    out = wide[0]
    for older in wide[1:]:
        moved = rescale_release(older, out, AREA, "financial_year", scaled, "income_release")
        out = newest_release([out, moved], [AREA, "financial_year"])
    return out.select(
        AREA, fiscal_year_end(F.col("financial_year")).alias("year"), "financial_year", *INCOME, "income_release"
    )


def income_snapshot(yearly: DataFrame, year: str) -> DataFrame:
    suffix = year.replace("-", "_")
    return yearly.where(F.col("financial_year") == year).select(
        AREA,
        F.col("income_median").alias(f"tax_median_total_personal_income_{suffix}"),
        F.col("income_mean").alias(f"tax_mean_total_personal_income_{suffix}"),
        F.col("income_earners").alias(f"tax_income_earners_{suffix}"),
    )


def area_years(population: DataFrame | None, income: DataFrame | None, spark) -> DataFrame:
    """Population (with its growth) and income per area and year."""
    tables = []
    if population is not None:
        tables.append(with_padded_change(population, AREA, "year", "erp", "erp_growth_pct"))
    if income is not None:
        tables.append(income)
    if not tables:
        return spark.createDataFrame([], f"{AREA} string, year int")
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, [AREA, "year"], "full_outer")
    return out


# --- points -----------------------------------------------------------------


def stations(stops: DataFrame) -> DataFrame:
    """Train stations, one point each, from the stop records that name one."""
    train = stops.where(F.col("stop_mode").isin(fixed.TRAIN_MODES)).select(
        F.col("stop_id").alias("station_id"), station_name(F.col("stop_name")).alias("station_name"),
        F.col("stop_mode").alias("station_mode"), F.col("stop_lat").alias("station_lat"),
        F.col("stop_lon").alias("station_lon"),
    )
    return one_point_per_name(
        train, "station_name", "station_id", "station_mode", "station_lat", "station_lon"
    )


def point_layers(src: Sources) -> dict[str, DataFrame]:
    """name -> points (fid, lat, lon) for schools, stations and merged stops."""

    def layer(df: DataFrame, fid: str, lat: str, lon: str) -> DataFrame:
        return df.select(F.col(fid).alias("fid"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))

    out = {}
    if src.schools is not None:
        out["school"] = layer(src.schools, "school_id", "school_lat", "school_lon")
    if src.stops is not None:
        out["train_station"] = layer(stations(src.stops), "station_name", "station_lat", "station_lon")
        for name, modes in fixed.STOP_MODES.items():
            merged = merge_same_name(
                src.stops.where(F.col("stop_mode").isin(modes)), "stop_id", "stop_name",
                lat="stop_lat", lon="stop_lon",
            )
            out[f"{name}_stop"] = layer(merged, "stop_name", "stop_lat", "stop_lon")
    return out


def with_routes(positions: DataFrame, routes: DataFrame, points: DataFrame) -> DataFrame:
    """Driving distance and time to the centre and to the best of the nearest stations."""
    keyed = positions.withColumn("origin_key", coordinate_key(F.col("lat"), F.col("lon")))
    near = nearest_k(
        positions, points.withColumns({"plat": F.col("lat"), "plon": F.col("lon")}),
        fixed.ROUTE_CANDIDATES, keep=["plat", "plon"],
    )
    candidates = near.select(
        coordinate_key(F.col("lat"), F.col("lon")).alias("origin_key"),
        coordinate_key(F.col("plat"), F.col("plon")).alias("dest_key"),
    ).distinct()
    origin_keys = keyed.select("origin_key").distinct()
    found = routes_to(origin_keys, routes, "cbd").join(best_routes(candidates, routes), "origin_key", "left")
    return keyed.join(found, "origin_key", "left").drop("origin_key")


# --- as-of sources ----------------------------------------------------------


def with_market_index(
    master: DataFrame, index: DataFrame, tolerance_days: int = fixed.INDEX_TOLERANCE_DAYS
) -> DataFrame:
    """The rent index of the listing's postcode and dwelling type as it stood when listed."""
    series = [c for c in fixed.INDEX_SERIES if c in index.columns]
    yoy = year_on_year(
        index.select("postcode", "date", *series), ["postcode"], "date", series, fixed.YEAR_LAG_DAYS,
        timedelta(days=fixed.YEAR_LAG_TOLERANCE_DAYS),
    )
    values = {c: f"sqm_{c}" for c in yoy.columns if c not in ("postcode", "date")}
    right = yoy.withColumnsRenamed(values | {"date": "sqm_week", "postcode": "__post"})
    keyed = master.withColumn("__post", F.col("postcode").try_cast("long"))
    out = asof_backward(
        keyed, right, ["__post"], "date_listed", "sqm_week", list(values.values()),
        timedelta(days=tolerance_days), lag="sqm_week_lag_days",
    )
    has = set(out.columns)
    choice = choose_series(
        F.col("property_type") if "property_type" in has else None,
        F.col("primary_type") if "primary_type" in has else None,
        fixed.SERIES_BY_FINE_TYPE, fixed.SERIES_BY_COARSE_TYPE,
    )
    out = out.withColumn("__series", choice)
    s = F.col("__series")
    added = {
        "sqm_market_rent": column_named_by(s, {c: F.col(f"sqm_{c}") for c in series}),
        "sqm_market_rent_yoy_pct": column_named_by(s, {c: F.col(f"sqm_{c}_yoy_pct") for c in series}),
    }
    if "bedrooms" in has:
        none = F.lit(None).cast("double")
        three = F.col("sqm_houses_3") if "houses_3" in series else none
        two = F.col("sqm_units_2") if "units_2" in series else none
        added["sqm_market_rent_bedroom_matched"] = (
            F.when((s == "houses_all") & (F.col("bedrooms") == 3), three)
            .when((s == "units_all") & (F.col("bedrooms") == 2), two)
        )
    return out.withColumns(added).drop("__post", "__series", "sqm_week", *values.values())


def type_incidents(raw: DataFrame) -> DataFrame:
    """Keys, period close and division of each incident row that has all of them."""
    return raw.select(
        F.col("postcode").try_cast("double").try_cast("long").alias("postcode"),
        place_key(F.col("suburb")).alias("suburb_key"),
        area_key(F.col("lga")).alias("lga_key"),
        F.coalesce(to_number(F.col("incidents")), F.lit(0.0)).alias("incidents"),
        period_close(F.col("year").cast("string"), F.col("year_ending")).alias("period_end"),
        division(F.col("offence_division")).alias("division"),
    ).where(not_null("postcode", "period_end", "division"))


def incident_places(incidents: DataFrame, population: DataFrame) -> DataFrame:
    """(postcode, suburb_key) to one suburb code with its population."""
    suburbs = population.select(
        code_key(F.col("sal_code")).alias("sal_code"), place_key(F.col("sal_name")).alias("suburb_key"),
        name_hint(F.col("sal_name")).alias("__hint_name"),
        number_or_null_zero(F.col("population")).alias("crime_suburb_population"),
    )
    wanted = dominant_child(incidents, ["postcode", "suburb_key"], "lga_key", "incidents")
    return resolve_candidates(
        wanted, suburbs, "suburb_key", ["postcode", "suburb_key"], ("__hint_name", "lga_key"),
        "crime_suburb_population", "sal_code", "crime_sal_ambiguous",
    ).select("postcode", "suburb_key", "sal_code", "crime_suburb_population", "crime_sal_ambiguous")


def with_incident_rates(
    master: DataFrame, incidents: DataFrame, population: DataFrame,
    tolerance_days: int = fixed.INCIDENT_TOLERANCE_DAYS,
) -> DataFrame:
    """The suburb's incident rates of the last period closed before the listing date."""
    typed = type_incidents(incidents)
    places = incident_places(typed, population)
    rates = incident_rates(
        typed, places, ["postcode", "suburb_key"], "sal_code", "crime_suburb_population",
        sorted(fixed.DIVISIONS.values()),
    ).withColumnRenamed("sal_code", "__sal")
    payload = [c for c in rates.columns if c not in ("__sal", "period_end", "crime_suburb_incidents")]
    pairs = places.select(
        F.col("postcode").alias("__post"), F.col("suburb_key").alias("__name"), F.col("sal_code").alias("__sal")
    )
    keyed = master.withColumns(
        {"__post": F.col("postcode").try_cast("long"), "__name": place_key(F.col("suburb"))}
    ).join(pairs, ["__post", "__name"], "left")
    out = asof_backward(
        keyed, rates, ["__sal"], "date_listed", "period_end", payload, timedelta(days=tolerance_days)
    )
    return out.drop("__post", "__name", "__sal", "period_end")


# --- the split --------------------------------------------------------------


def split_target_derived(master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """
    The master table without columns computed from the rent, and those columns by
    listing. A bond is kept when it is between two and eight weeks of rent.
    """
    rent = number_or_null_zero(F.col(fixed.TARGET))

    def against(column: str) -> Column:
        if column not in master.columns:
            return F.lit(None).cast("double")
        return ratio_to(rent, to_number(F.col(column)))

    cols = [F.col("listing_id")]
    if "bond" in master.columns:
        weeks = to_number(F.col("bond")) / rent
        cols.append(F.when(weeks.between(*fixed.BOND_WEEKS), F.col("bond")).alias("bond"))
    if "bedrooms" in master.columns:
        cols.append(against("bedrooms").alias("rent_per_bedroom"))
    cols += [
        against("census_median_rent_weekly").alias("rent_vs_2021_census_median"),
        against("sqm_market_rent").alias("rent_vs_sqm_market"),
        (100 * against("census_median_household_income_weekly")).alias("rent_to_area_median_hh_income_pct"),
    ]
    return master.drop(*fixed.TARGET_DERIVED), master.select(*cols)


# --- the build --------------------------------------------------------------


def build_master(src: Sources) -> Tables:
    """
    The six tables. Optional sources may be absent, empty or broken: each contributes a table of its own,
    written as it is made, and one that fails is left out and recorded. The coverage table is
    counted during those writes; it also tells of columns without any value.
    """
    spark = src.listings.sparkSession
    audit = Q.Audit(spark)

    def given(source: str, needed, make):
        """What the source contributes, or None."""
        if needed is None or needed is False:
            audit.note(source, "skipped", "not supplied")
            return None
        return audit.attempt(source, make)

    bridge = materialise(
        audit.watch(suburb_bridge(src.blocks), "suburb/postcode/area correspondence", "overlaps"), "correspondence"
    )
    population = given("area population by year", src.population, lambda: materialise(
        audit.watch(src.population, "area population by year", "rows"), "population"
    ))
    income = given("area income by year", src.income or None, lambda: materialise(
        audit.watch(yearly_income(src.income), "area income by year", "rows"), "income"
    ))
    yearly = area_years(population, income, spark)

    # Areas with their snapshots; a source that matches too few is reported as failed.
    snapshots = dict(src.snapshots)
    if income is not None:
        snapshots[f"area income {src.income_year}"] = income_snapshot(income, src.income_year)
    names = [c for c in AREA_NAMES if c in src.areas.columns]
    base = src.areas.select(AREA, *names)
    gates, kept = [], []
    for source, table in snapshots.items():
        own = audit.attempt(source, lambda t=table: materialise(t, "snapshot"))
        if own is not None:
            gates.append(Q.match_gate(base, own, AREA, source))
            kept.append(own)
    area_master = left_join_all(base, kept, AREA)

    # Once per distinct position. Positions and point layers are stage tables, since every
    # search reads them; each search answers for the positions alone.
    spots = materialise(
        src.listings.where(not_null("lat", "lon")).select("lat", "lon").distinct(), "positions"
    )
    found = [
        with_containing_area(spots, src.areas, AREA, attributes=names),
        spots.select("lat", "lon", km_to_point(F.col("lat"), F.col("lon"), fixed.CITY_CENTRE).alias("cbd_km")),
    ]
    counts, layers = [], {}

    def layer(name: str, points: DataFrame) -> DataFrame:
        layers[name] = materialise(audit.watch(points, f"{name} points", "points"), name)
        return materialise(with_nearest_km(spots, layers[name], f"nearest_{name}_km"), f"nearest_{name}")

    for name, points in point_layers(src).items():
        near = audit.attempt(f"{name} points", lambda n=name, p=points: layer(n, p))
        if near is not None:
            found.append(near)
            counts.append(point_counts(layers[name], src.areas, AREA, f"{name}_count"))

    def routes() -> DataFrame:
        own = with_routes(spots, src.routes, layers["train_station"])
        return materialise(audit.watch(own, "driving routes", "positions with a route", "cbd_drive_km"), "routes")

    near = given("driving routes", src.routes is not None and "train_station" in layers, routes)
    found += [near] if near is not None else []

    def land() -> DataFrame:
        own = smallest_lot(spots, src.lots, "prop_pfi")
        return materialise(audit.watch(own, "land size", "positions on a lot", "land_lot_shared"), "land")

    near = given("land size", src.lots, land)
    found += [near] if near is not None else []

    def amenities() -> DataFrame | None:
        points = audit.watch(src.amenities.select(
            F.col("amenity_id").alias("fid"), "amenity_type", F.col("amenity_lat").alias("lat"),
            F.col("amenity_lon").alias("lon"),
        ), "amenities", "amenity points")
        points = materialise(points, "amenities")
        # the names of columns: more kinds than a table can have columns would be no categories
        kinds = sorted(r[0] for r in points.select("amenity_type").where("amenity_type IS NOT NULL").distinct().limit(_KINDS + 1).collect())
        if len(kinds) > _KINDS:
            raise ValueError(f"more than {_KINDS} kinds of amenities")
        if not kinds:
            return None
        near = materialise(with_nearest_km_by(spots, points, "amenity_type", kinds), "nearest_amenities")
        counts.append(point_counts_by(points, src.areas, AREA, "amenity_type", kinds))
        return near

    near = given("amenities", src.amenities, amenities)
    found += [near] if near is not None else []

    area_master = materialise(audit.watch_columns(left_join_all(area_master, counts, AREA), "area_master columns"), "area_master")
    placed = left_join_all(spots, found, ["lat", "lon"]).withColumnsRenamed({"lat": "__la", "lon": "__lo"})
    at = (F.col("lat") == F.col("__la")) & (F.col("lon") == F.col("__lo"))
    master = with_suburb_code(src.listings, bridge).join(placed, at, "left").drop("__la", "__lo")
    master = materialise(join_area_table(master, area_master, AREA), "placed_listings")

    def added(source: str, what: str, table: DataFrame, step) -> DataFrame:
        return materialise(step(master, materialise(audit.watch(table, source, what), "source")), "master")

    source = "weekly rent index"
    more = given(source, src.index, lambda: added(source, "postcode weeks", src.index, with_market_index))
    master = master if more is None else more
    source, whole = "incidents", src.incidents is not None and src.suburb_population is not None
    more = given(source, whole, lambda: added(
        source, "rows", src.incidents, lambda m, i: with_incident_rates(m, i, src.suburb_population)
    ))
    master = master if more is None else more

    master, ratios = split_target_derived(master)
    master = materialise(audit.watch_columns(master, "master columns"), "master")
    return Tables(master, area_master, yearly, bridge, ratios, union_all([*gates, audit.table()]))


#: Kinds of amenities that may become columns.
_KINDS = 500


def write_master(tables: Tables, folder: str, fmt: str = "parquet") -> None:
    """The six tables, one folder each."""
    from gridmere.sources.tables import write_table

    order = {"correspondence": [SUBURB, "postcode", AREA], "area_yearly": [AREA, "year"]}
    for name, df in vars(tables).items():
        write_table(df, f"{folder.rstrip('/')}/{name}", fmt, order_by=order.get(name, ()))
