"""Message rules on hand-written rows."""

import json

import pytest
from pyspark.sql import functions as F

from seawake.operators import parse as P

GOOD = {
    "mmsi": 1, "ship_name": "A", "latitude": 50.0, "longitude": 1.0, "cog": 10.0, "sog": 5.0, "heading": 11.0,
    "timestamp": "2024-01-01T00:00:00Z", "dim_a": 60.0, "dim_b": 10.0, "dim_c": 5.0, "dim_d": 5.0,
}


def message(**changes):
    m = {**GOOD, **changes}
    return json.dumps({k: v for k, v in m.items() if v != "absent"})


def parsed(spark, fn, *texts):
    return fn(spark.createDataFrame([(t,) for t in texts], "value string")).collect()


@pytest.mark.parametrize("parse", [P.parse_message, P.parse_positions])
def test_rejects(spark, parse):
    bad = ["", "not json", "[]", '{"mmsi": 1', *[message(**{k: v}) for k in P.REQUIRED for v in ("absent", None, "words")]]
    assert parsed(spark, parse, *bad) == []


def test_message_values(spark):
    (r,) = parsed(spark, P.parse_message, message(mmsi="17", heading="north", dim_c=None, dim_d="absent", ship_length=5))
    assert (r.mmsi, r.heading, r.dim_a, r.dim_c, r.dim_d, r.geohash) == (17, None, 60.0, None, None, "none")
    assert "ship_length" not in r.asDict()
    (r,) = parsed(spark, P.parse_message, message(geohash="u10", mmsi=211000000.0))
    assert r.geohash == "u10" and r.mmsi == 211000000
    assert parsed(spark, P.parse_message, message(dim_a="long")) == []


@pytest.mark.parametrize("parse", [P.parse_message, P.parse_positions])
def test_name_default_only_for_absent_key(spark, parse):
    rows = parsed(spark, parse, message(mmsi=1, ship_name="absent"), message(mmsi=2, ship_name=None), message(mmsi=3, ship_name=" UNKNOWN "))
    assert {r.mmsi: r.ship_name for r in rows} == {1: "Unknown", 2: None, 3: " UNKNOWN "}


def test_static(spark):
    texts = [message(), message(ship_name=" unKnown "), message(dim_b=None), message(dim_c="absent"), message(dim_a="x"),
             message(mmsi=2, latitude="absent")]
    assert sorted(r.mmsi for r in parsed(spark, P.parse_static, *texts)) == [1, 2]


def test_every_row_is_kept_or_rejected(spark):
    texts = [message(), "junk", message(sog=None), message(dim_a="x"), message(mmsi=3)]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    assert P.parse_message(df).count() == 2
    assert sorted(r.value for r in P.parse_message_rejects(df).collect()) == sorted(texts[1:4])


def envelope(kind="PositionReport", mmsi=1, received="2024-01-01T00:00:00+00:00", **body):
    meta = {"MMSI": mmsi}
    if received is not None:
        meta["TimeReceived"] = received
    return json.dumps({"MessageType": kind, "MetaData": meta, "Message": {kind: body}})


REPORT = {"Latitude": 50.0, "Longitude": 1.0, "Cog": 10.0, "Sog": 5.0, "TrueHeading": 12}


def envelopes(spark, *texts):
    return P.read_envelopes(spark.createDataFrame([(t,) for t in texts], "value string"))


def test_position_envelopes(spark):
    now = F.timestamp_seconds(F.lit(5))
    cases = {
        1: envelope(mmsi=1, **REPORT),
        2: envelope(mmsi=2, **{**REPORT, "TrueHeading": 511}),
        3: envelope(mmsi=3, **{**REPORT, "TrueHeading": "north"}),
        4: envelope(mmsi=4, **{**REPORT, "TrueHeading": "33.5"}, received=None),
        5: envelope(mmsi=5, **{k: v for k, v in REPORT.items() if k != "TrueHeading"}, received="soon"),
        6: envelope(mmsi=6),
        0: envelope(mmsi=0, **REPORT),
        7: envelope(mmsi=7, **{**REPORT, "Latitude": "50"}),
    }
    df = envelopes(spark, *cases.values(), "{broken", envelope("BaseStationReport", Sog=3))
    positions, statics = P.route_by_type(df)
    got = {r.mmsi: r for r in P.flatten_position(positions, now).withColumn("s", F.unix_timestamp("timestamp")).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 7] and statics.count() == 0
    assert [got[i].heading for i in (1, 2, 3, 4, 5)] == [12.0, 10.0, None, 33.5, None]
    assert [got[i].s for i in (1, 4, 5)] == [1704067200, 5, 5]
    assert got[7].latitude is None


def test_static_envelopes(spark):
    dims = {"A": 1, "B": 2.5, "C": "wide", "D": None}
    df = envelopes(
        spark,
        envelope("ShipStaticData", 1, ShipName="N", Name="M", Dimension=dims),
        envelope("ShipStaticData", 2, ShipName="", Name="M", Dimension=dims),
        envelope("ShipStaticData", 3, ShipName="", Dimension={}),
        envelope("ShipStaticData", 0, ShipName="N"),
    )
    got = {r.mmsi: r for r in P.flatten_static(P.route_by_type(df)[1]).collect()}
    assert {k: r.ship_name for k, r in got.items()} == {1: "N", 2: "M", 3: "Unknown"}
    assert [got[1][d] for d in ("dim_a", "dim_b", "dim_c", "dim_d")] == [1.0, 2.5, None, None]


def test_validity_edges(spark):
    rows = [(1, 180.0, 180.0, 2.0), (2, 180.1, 0.0, 2.0), (3, None, 0.0, 2.0), (4, 91.0, 0.0, 1.99), (5, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "id int, latitude double, longitude double, sog double")
    assert [r.id for r in P.valid_coordinate(df).collect()] == [1, 4, 5]
    assert [r.id for r in P.valid_coordinate(df, max_latitude=90).collect()] == [5]
    assert [r.id for r in P.under_way(df).collect()] == [1, 2, 3]


def test_boxes(spark):
    df = spark.createDataFrame([(1, 49.0, -2.0), (2, 51.0, 2.0), (3, 51.1, 0.0), (4, None, 0.0)], "id int, latitude double, longitude double")
    assert [r.id for r in P.in_boxes(df).collect()] == [1, 2]
    table = spark.createDataFrame([(48.5, 51.0, -3.0, 0.0), (48.0, 50.0, -3.0, 3.0)], "lat_min double, lat_max double, lon_min double, lon_max double")
    assert [r.id for r in P.in_boxes(df, table).collect()] == [1]


def test_dimensions(spark):
    rows = [(1, 0.0, None, 0.0, 0.0), (2, 0.0, 0.0, 0.0, 3.0), (3, 25.0, 25.0, None, None), (4, 26.0, 25.0, None, None), (5, None, 99.0, None, None)]
    df = spark.createDataFrame(rows, "id int, dim_a double, dim_b double, dim_c double, dim_d double")
    assert [r.id for r in P.has_dimensions(df).collect()] == [2, 3, 4, 5]
    assert [r.id for r in P.long_enough(df).collect()] == [4]
