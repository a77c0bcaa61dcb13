import json

import pytest

from gridmere.sources import geojson as J
from gridmere.sources import tables as T


def test_absent_or_keyless_index_is_empty(spark, tmp_path):
    assert T.read_weekly_index(spark, str(tmp_path / "no.csv")).count() == 0
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    assert T.read_weekly_index(spark, str(tmp_path / "bad.csv")).columns[:2] == ["postcode", "date"]
    (tmp_path / "ok.csv").write_text("postcode,date,combined\n3067,2024-01-07,0\n3067.0,2024-01-14,510\n,2024-01-14,1\n3067,soon,2\n")
    rows = T.read_weekly_index(spark, str(tmp_path / "ok.csv")).collect()
    assert [(r["postcode"], r["combined"]) for r in rows] == [(3067, None), (3067, 510.0)]


def test_first_match_or_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        T.read_first_match(spark, str(tmp_path), "*G02*.csv")
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "2021_G02_VIC.csv").write_text("SA2_CODE_2021,m\n206,7\n")
    (tmp_path / "x" / "other.csv").write_text("a\n1\n")
    assert [tuple(r) for r in T.read_first_match(spark, str(tmp_path), "*G02*.csv").collect()] == [("206", "7")]


def test_multiline_geojson(spark, tmp_path):
    feats = [
        {"properties": {"STOP_ID": "1", "STOP_NAME": "A", "MODE": " metro tram "}, "geometry": {"type": "Point", "coordinates": [145.0, -37.0]}},
        {"properties": {"stop_id": "2", "stop_name": "B"}, "geometry": {"type": "Point", "coordinates": [145.5, -37.5]}},
        {"properties": {"stop_id": "3"}, "geometry": {"type": "Point", "coordinates": [145.5]}},
        {"properties": {"stop_id": "4"}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}},
        {"properties": {"stop_id": "5"}, "geometry": None},
    ]
    (tmp_path / "s.json").write_text(json.dumps({"type": "FeatureCollection", "features": feats}, indent=1))
    rows = sorted(tuple(r) for r in J.read_stops(spark, str(tmp_path / "s.json")).collect())
    assert rows == [("1", "A", "METRO TRAM", -37.0, 145.0), ("2", "B", "", -37.5, 145.5)]


def test_amenity_files(spark, tmp_path):
    (tmp_path / "osm_bar_pub.json").write_text(json.dumps([{"lat": 1.0, "lon": 2.0}, {"center": {"lat": 3.0, "lon": 4.0}}, {"id": 9}]))
    rows = sorted(tuple(r) for r in J.read_amenities(spark, str(tmp_path)).collect())
    assert rows == [("bar_pub", 1.0, 2.0), ("bar_pub", 3.0, 4.0)]


def test_standard_quoting_both_ways(spark, tmp_path):
    import pandas as pd

    rows = [("1", 'Flat "A", 3 High St', "X"), ("2", 'say ""hi""', "b,c"), ("3", "back\\slash", '"')]
    pdf = pd.DataFrame(rows, columns=["listing_id", "address", "suburb"])
    pdf.to_csv(tmp_path / "in.csv", index=False)
    read = T.read_text_table(spark, str(tmp_path / "in.csv"))
    assert sorted(tuple(r) for r in read.collect()) == rows
    T.write_table(read.coalesce(1), str(tmp_path / "out"), "csv")
    back = pd.concat(pd.read_csv(p, dtype=str) for p in (tmp_path / "out").glob("part-*.csv"))
    assert sorted(map(tuple, back.to_numpy().tolist())) == rows


def test_quoted_line_breaks_by_choice(spark, tmp_path):
    (tmp_path / "b.csv").write_text('listing_id,address\n1,"Unit 2\n5 Low St"\n2,"He said ""no"""\n')
    read = T.read_text_table(spark, str(tmp_path / "b.csv"), line_breaks=True)
    assert sorted(tuple(r) for r in read.collect()) == [("1", "Unit 2\n5 Low St"), ("2", 'He said "no"')]


def test_number_grammar(spark):
    from pyspark.sql import functions as F

    from gridmere.functions.numbers import to_number

    texts = ["5d", "7f", "1.5", " -2e3 ", ".5", "5.", "NaN", "Infinity", "0x1p3", "", "1,000", None, "1e999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", to_number(F.col("t")).alias("v")).collect()}
    assert {t: v for t, v in got.items() if v is not None} == {"1.5": 1.5, " -2e3 ": -2000.0, ".5": 0.5, "5.": 5.0}


def test_grid_with_two_header_rows(spark):
    body = spark.createDataFrame([("206", "1,234", "np", "40.5")], "k string, c1 string, c2 string, c3 string")
    header = [("c1", "Earners (persons)", "2020-21"), ("c2", None, "2021-22"), ("c3", "Median age of earners", "2020-21")]
    rows = sorted(tuple(r) for r in T.grid_to_long(body, "k", header).collect())
    assert rows == [("206", "2020-21", "income_earners", 1234.0), ("206", "2020-21", "income_earners_median_age", 40.5), ("206", "2021-22", "income_earners", None)]


def test_csv_and_parquet_sinks(spark, tmp_path):
    df = spark.range(20).selectExpr("id", "id % 2 AS half")
    T.write_table(df, str(tmp_path / "p"), partition_by=["half"])
    T.write_table(df, str(tmp_path / "c"), "csv", order_by=["id"])
    assert spark.read.parquet(str(tmp_path / "p")).where("half = 1").count() == 10
    assert T.read_text_table(spark, str(tmp_path / "c")).count() == 20
