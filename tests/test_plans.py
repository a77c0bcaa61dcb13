"""The composed plans on a small made-up state."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from gridmere.operators.polygons import edges_from_rings
from gridmere.session import materialise
from gridmere.plans import enrich, growth, prepare, stack
from gridmere.plans.compare import compare_feature_sets
from gridmere.sources.tables import type_listings, type_weekly_index

AREAS = {"206041117": (144.90, -37.85), "206041118": (145.00, -37.85), "206041119": (144.90, -37.75)}


def ring(x, y, s=0.1):
    return [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(11)
    areas = spark.createDataFrame(
        [(c, f"Area {c[-1]}", "S3", "S4", "GM", 9.0, [ring(*xy)]) for c, xy in AREAS.items()],
        "sa2_code_2021 string, sa2_name_2021 string, sa3_name_2021 string, sa4_name_2021 string, gccsa_name_2021 string, area_albers_sqkm double, rings array<array<array<double>>>",
    ).withColumn("edges", edges_from_rings(F.col("rings"))).drop("rings")
    blocks = spark.createDataFrame(
        [("20000000001", "206041117", "Area 7", "21001", "Abbotsford (Vic.)", "3067", 1.0, 100.0, 200.0),
         ("20000000002", "206041118", "Area 8", "21001", "Abbotsford (Vic.)", "3067", 1.0, 300.0, 500.0),
         ("20000000003", "206041118", "Area 8", "21002", "Hillside (Melton - Vic.)", "3037", 2.0, 0.0, 0.0),
         ("20000000004", "206041119", "Area 9", "21003", "Hillside (East Gippsland - Vic.)", "3875", 2.0, 50.0, 90.0),
         ("20000000005", "206041119", "Area 9", "21003", "Hillside (East Gippsland - Vic.)", "3875", None, 50.0, 90.0)],
        "mb_code string, sa2_code_2021 string, sa2_name_2021 string, sal_code_2021 string, sal_name_2021 string, postcode string, area_sqkm double, dwellings double, persons double",
    )
    rows = []
    for i in range(120):
        lat, lon = -37.85 + rng.random() * 0.2, 144.90 + rng.random() * 0.2
        name, post = [("Abbotsford", "3067"), ("Hillside", "3037"), ("Hillside", "3875"), ("Nowhere", "3999")][i % 4]
        beds = 1 + i % 4
        rows.append((
            str(i), name, post, str(200 + 120 * beds + i), str((200 + 120 * beds + i) * 4.345), None,
            str(dt.date(2025, 1, 1) + dt.timedelta(days=i)), "10", str(beds), "1", None if i % 5 == 0 else "1",
            ["House", "Studio"][i % 2], f"{i} High St", None if i == 7 else str(lat), str(lon), "House",
            None if i % 6 == 0 else "Gym, Heating", "u",
        ))
    cols = "listing_id suburb postcode weekly_rent bond available_date date_listed days_listed bedrooms bathrooms carspaces property_type address lat lon primary_type structured_features url".split()
    listings = type_listings(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)))
    weeks = [
        (p, str(dt.date(2021, 6, 6) + dt.timedelta(weeks=w)), str(500 * 1.04 ** (w / 52)), str(520 * 1.04 ** (w / 52)), "0", str(400 * 1.03 ** (w / 52)), str(450 * 1.04 ** (w / 52)))
        for p in ("3067", "3037") for w in range(206)
    ]
    index = type_weekly_index(spark.createDataFrame(weeks, "postcode string, date string, houses_all string, houses_3 string, units_2 string, units_all string, combined string"))
    incidents = spark.createDataFrame(
        [(str(y), "March", p, s, l, d, str(n + y - 2020))
         for y in range(2020, 2026) for p, s, l, n in (("3067", "Abbotsford", "Yarra", 10), ("3037", "Hillside", "Melton", 20), ("3875", "Hillside", "East Gippsland", 5))
         for d in ("A Crimes against the person", "B Property") if not (p == "3875" and y == 2022)],
        "year string, year_ending string, postcode string, suburb string, lga string, offence_division string, incidents string",
    )
    people = spark.createDataFrame(
        [("21001.0", "Abbotsford (Vic.)", "1000"), ("21002", "Hillside (Melton - Vic.)", "500"), ("21003", "Hillside (East Gippsland - Vic.)", "0")],
        "sal_code string, sal_name string, population string",
    )
    def income(release, years, scale):
        return spark.createDataFrame(
            [(c, y, m, v * scale * (1 + 0.03 * i), release) for i, y in enumerate(years) for c in AREAS
             for m, v in (("income_earners", 100.0), ("income_median", 50000.0), ("income_mean", 60000.0), ("income_sum", 6e6), ("income_earners_median_age", 40.0))],
            "sa2_code_2021 string, financial_year string, measure string, value double, income_release string",
        )
    stops = spark.createDataFrame(
        [("1", "Flinders Street Station", "METRO TRAIN", -37.818, 144.967), ("2", "Flinders Street Railway Station (Melbourne)", "REGIONAL TRAIN", -37.8182, 144.9672),
         ("3", "Lift", "METRO TRAIN", -37.8, 144.9), ("4", "1-High St", "METRO TRAM", -37.80, 144.95), ("5", "1-High St", "METRO TRAM", -37.8002, 144.9501),
         ("6", "9-High St", "METRO BUS", -37.78, 145.05), ("6", "9-High St", "REGIONAL BUS", -37.78, 145.05)],
        "stop_id string, stop_name string, stop_mode string, stop_lat double, stop_lon double",
    )
    return enrich.Sources(
        listings=listings, areas=areas, blocks=blocks,
        snapshots={"census": spark.createDataFrame([(c, 400.0 + i, 1500.0 + 10 * i) for i, c in enumerate(AREAS)], "sa2_code_2021 string, census_median_rent_weekly double, census_median_household_income_weekly double"),
                   "thin": spark.createDataFrame([("206041117", 1.0)], "sa2_code_2021 string, irsad_score double")},
        population=spark.createDataFrame([(c, y, 1000.0 + 20 * (y - 2018)) for c in AREAS for y in range(2018, 2026)], "sa2_code_2021 string, year int, erp double"),
        income=[income("2022-23", ["2020-21", "2021-22", "2022-23"], 1.0), income("2020-21", ["2019-20", "2020-21"], 0.9)],
        schools=spark.createDataFrame([(1, -37.80, 144.95), (2, -37.70, 144.95)], "school_id long, school_lat double, school_lon double"),
        stops=stops,
        amenities=spark.createDataFrame([(1, "cafe", -37.8, 144.95), (2, "park", -37.7, 144.93), (3, "cafe", -37.7, 144.99)], "amenity_id long, amenity_type string, amenity_lat double, amenity_lon double"),
        routes=spark.createDataFrame([("x", "cbd", 1.0, 2.0)], "origin_key string, dest_key string, drive_km double, drive_min double"),
        lots=spark.createDataFrame([(str(i), [ring(144.9 + 0.02 * i, -37.85, 0.02)]) for i in range(5)], "prop_pfi string, rings array<array<array<double>>>").select("prop_pfi", edges_from_rings(F.col("rings")).alias("edges")),
        index=index, incidents=incidents, suburb_population=people,
    )


@pytest.fixture(scope="module")
def tables(sources):
    t = enrich.build_master(sources)
    t.master = t.master.cache()
    return t


def test_master_keeps_every_listing_once(tables):
    rows = tables.master.collect()
    assert len(rows) == 120 and len({r["listing_id"] for r in rows}) == 120
    assert tables.rent_ratios.count() == 120 and "bond" not in tables.master.columns


def test_master_values(tables):
    by = {r["listing_id"]: r for r in tables.master.collect()}
    r = by["8"]
    assert (r["sal_code_2021"], r["feat_gym"], r["feat_heating"], r["feat_pool"]) == ("21001", 1, 1, 0)
    assert by["6"]["feat_gym"] is None and by["3"]["sal_code_2021"] is None
    assert by["9"]["sal_code_2021"] == "21002" and by["10"]["sal_code_2021"] == "21003"
    for k in ("nearest_school_km", "nearest_train_station_km", "nearest_tram_stop_km", "nearest_bus_stop_km", "nearest_cafe_km", "cbd_km"):
        assert r[k] is not None and by["7"][k] is None
    where = next((c for c, (x, y) in AREAS.items() if x < r["lon"] < x + 0.1 and y < r["lat"] < y + 0.1), None)
    assert r["sa2_code_2021"] == where
    assert 0 <= r["sqm_week_lag_days"] < 7 and by["10"]["sqm_market_rent"] is None
    listed = dt.date(2025, 1, 9)
    week = max(w for i in range(206) if (w := dt.date(2021, 6, 6) + dt.timedelta(weeks=i)) <= listed)
    i = (week - dt.date(2021, 6, 6)).days // 7
    assert r["sqm_market_rent"] == pytest.approx(500 * 1.04 ** (i / 52))
    assert r["sqm_market_rent_yoy_pct"] == pytest.approx(4)
    # The year ending March 2024 is the last one closed in January 2025.
    assert r["crime_suburb_rate_per_1k"] == pytest.approx(1000 * 2 * (10 + 4) / 1000)
    assert r["crime_suburb_rate_yoy_pct"] == pytest.approx(100 * (14 / 13 - 1))
    assert by["10"]["crime_suburb_rate_per_1k"] is None  # population 0
    assert r["tax_median_total_personal_income_2022_23"] in (None, pytest.approx(53000))


def test_area_tables_and_coverage(tables):
    m = {r["sa2_code_2021"]: r for r in tables.area_master.collect()}
    assert m["206041117"]["school_count"] == 1 and m["206041117"]["train_station_count"] == 1
    assert m["206041117"]["tram_stop_count"] == 1 and m["206041118"]["bus_stop_count"] == 1
    assert m["206041117"]["osm_cafe_count"] == 1 and m["206041119"]["osm_park_count"] == 1
    y = {(r["sa2_code_2021"], r["year"]): r for r in tables.area_yearly.collect()}
    assert y["206041117", 2020]["income_release"] == "2020-21 (rescaled)"
    assert y["206041117", 2020]["income_median"] == pytest.approx(50000 / 1.03)
    assert y["206041117", 2021]["income_release"] == "2022-23"
    assert y["206041117", 2018]["erp_growth_pct"] is None and y["206041117", 2019]["erp_growth_pct"] == pytest.approx(2)
    status = {r["source"]: r["status"] for r in tables.coverage.collect()}
    assert status["census"] == "joined" and status["thin"] == "failed" and status["incidents"] == "joined"
    shares = tables.correspondence.groupBy("sal_code_2021").agg(F.sum("share_of_suburb").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in shares) and len(shares) == 3


def test_the_build_goes_on_without_a_source_and_says_so(sources, spark):
    from dataclasses import replace

    from pyspark.sql import types as T

    broken = sources.index.withColumn("combined", F.raise_error(F.lit("cannot be read")).cast("double"))
    tables = enrich.build_master(replace(
        sources, index=broken, lots=None, stops=sources.stops.limit(0),
        routes=None, amenities=spark.createDataFrame([], sources.amenities.schema),
    ))
    rows = {r["source"]: r for r in tables.coverage.collect()}
    assert rows["weekly rent index"]["status"] == "failed" and "cannot be read" in rows["weekly rent index"]["detail"]
    assert rows["land size"]["status"] == rows["driving routes"]["status"] == "skipped"
    assert rows["amenities"]["status"] == rows["train_station points"]["status"] == "missing"
    assert rows["incidents"]["status"] == "joined" and rows["school points"]["status"] == "joined"
    assert rows["master columns"]["status"] == "failed" and "nearest_train_station_km" in rows["master columns"]["detail"]
    assert tables.master.count() == 120 and "sqm_market_rent" not in tables.master.columns
    assert T.StringType() == tables.coverage.schema["status"].dataType


def test_partial_answers(tables):
    rows = {r["source"]: r for r in tables.coverage.collect()}
    assert rows["land size"]["status"] == "partial" and "positions on a lot" in rows["land size"]["detail"]
    assert rows["driving routes"]["status"] == "failed" and rows["driving routes"]["detail"].startswith("0/")


def test_write_six_tables(tables, tmp_path, spark):
    enrich.write_master(tables, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["area_master", "area_yearly", "correspondence", "coverage", "master", "rent_ratios"]
    assert spark.read.parquet(str(tmp_path / "master")).count() == 120


@pytest.fixture(scope="module")
def prepared(tables, tmp_path_factory):
    return prepare.prepare(tables.master, str(tmp_path_factory.mktemp("prepared")))


def test_prepare(prepared):
    clean, feats = prepared
    assert 0 < clean.count() <= 120
    assert set(feats.columns) | set(feats.rejected) == set(clean.columns)
    assert not set(feats.columns) & set(feats.rejected)
    assert "weekly_rent" in feats.rejected and "bedrooms" in feats.numeric


def test_growth(tables, sources):
    features = ["census_median_rent_weekly", "school_count"]
    s = growth.build_suburbs(tables.correspondence, sources.index, tables.area_master, tables.area_yearly, tables.master, features=features)
    rows = {r["sal_code_2021"]: r for r in s.collect()}
    assert rows["21001"]["rent_growth_pct"] == pytest.approx(4, abs=0.1) and rows["21001"]["sqm_coverage"] == 1.0
    assert rows["21003"]["rent_growth_pct"] is None and rows["21003"]["sqm_coverage"] == 0.0
    assert rows["21001"]["census_median_rent_weekly"] == pytest.approx(0.25 * 400 + 0.75 * 401)
    assert rows["21001"]["erp_cagr_pct"] == pytest.approx(1.84, abs=0.1)
    assert rows["21001"]["crime_suburb_rate_per_1k"] is not None
    s = materialise(s, "suburbs")
    many = s
    for i in range(1, 12):
        many = many.unionByName(s.withColumn("sal_code_2021", F.concat(F.lit(f"{i}_"), "sal_code_2021")))
    many = materialise(many, "many_suburbs")
    predicted, weights, scores = growth.fit_growth(many, features=features, trees=4, depth=3, folds=2)
    assert predicted.count() == 36 and predicted.where("predicted_growth_pct is null").count() == 0
    assert scores.first()["rows"] == 24 and weights.count() == 2
    top = growth.ranking(predicted, 5, least=200).collect()
    assert len(top) == 5 and all(r["dwellings_2021"] >= 200 for r in top)


def test_stack_and_comparison(prepared):
    clean, _ = prepared
    df = stack.model_table(clean)
    assert not {"bond", "lat", "date_listed", "rent_outlier_high"} & set(df.columns)
    assert df.where("available_month = -1").count() == df.count()
    small = df.select("listing_id", "weekly_rent", "bedrooms", "carspaces", "property_type", "listed_month", "nearest_school_km", "cbd_km")
    top, scored, table = stack.fit_stack(small, group="listing_id", trees=4, rounds=4, depth=3, forest_depth=4, folds=2)
    m = {r["model"]: r for r in table.collect()}
    assert set(m) == {"internal", "external", "combined", "stacked"} and m["internal"]["mae"] < m["external"]["mae"]
    assert all(math.isfinite(r["rmse"]) for r in m.values())
    performance, details = compare_feature_sets(clean, {"own": ["bedrooms", "carspaces", "gone"], "place": ["cbd_km"]}, "weekly_rent", "listing_id", trees=4, depth=4)
    p = {r["feature_set"]: r for r in performance.collect()}
    assert p["own"]["ridge_r2"] > 0.9 > p["place"]["ridge_r2"] and details.count() == 6
    pairs = stack.redundant_pairs(df.select("listing_id", "weekly_rent", "cbd_km", (F.col("cbd_km") * 2).alias("twice")))
    assert [tuple(r) for r in pairs.select("a", "b").collect()] == [("cbd_km", "twice")]
