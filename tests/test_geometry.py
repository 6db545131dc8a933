"""Golden values of the geometry and risk expressions."""

import math

import pytest
from pyspark.sql import functions as F

from seawake.functions import display as D
from seawake.functions import geo
from seawake.functions import risk as R

# (lat, lon, cog, sog) of A and B; F1 nm, F2 nm, F3, F4 cpa/tcpa min, F5 cpa/tcpa h, F6 tcpa min
GOLDEN = {
    "head-on": ((50, 0, 90, 10), (50, 0.1, 270, 10), 3.859326, 3.852561, True, (0.0, 11.557682), (0.0, 0.192836), 11.570177),
    "crossing": ((50, 0, 0, 12), (50.05, 0.08, 270, 12), 4.305188, 4.297641, True, (0.059174, 15.193015), (0.058103, 0.253424), 15.205426),
    "diverging": ((50, 0, 270, 10), (50, 0.1, 90, 10), 3.859326, 3.852561, False, (9999, -1), (3.856726, 0), 0),
    "same velocity": ((50, 0, 45, 10), (50.01, 0, 45, 10), 0.600405, 0.599352, False, (0.599352, 0), (0.6, 0), 0),
    "far longitude": ((40, -70, 0, 10), (40.1, -70, 180, 10), 6.004046, 5.993521, True, (0.0, 17.980562), (4.716777, 0.3), 18.0),
}
RISK = {"head-on": 0.831405, "crossing": 0.910983, "diverging": 0.433333, "same velocity": 0.433333, "far longitude": 0.430333}
HEAT = {"head-on": 0.996786, "crossing": 0.937918}
FIELDS = ("latitude", "longitude", "cog", "sog")


@pytest.fixture(scope="module")
def golden(spark):
    def row(name, a, b):
        return (name, *map(float, a), *map(float, b))

    schema = "name string, " + ", ".join(f"{f}_{s} double" for s in "ab" for f in FIELDS)
    pairs = spark.createDataFrame([row(n, v[0], v[1]) for n, v in GOLDEN.items()], schema)
    swapped = pairs.select("name", *[F.col(f"{f}_{'ba'['ab'.index(s)]}").alias(f"{f}_{s}") for s in "ab" for f in FIELDS])
    a, b = geo.motion("_a"), geo.motion("_b")

    def evaluate(df):
        out = df.select(
            "*",
            geo.haversine_nm(a.lat, a.lon, b.lat, b.lon).alias("f1"),
            geo.planar_distance_nm(a, b).alias("f2"),
            geo.is_approaching(a, b).alias("f3"),
            geo.cpa_tcpa_local(a, b).alias("f4"),
            geo.cpa_tcpa_flat(a, b).alias("f5"),
            geo.cpa_tcpa_flat_min(a, b).alias("f6"),
        ).withColumn("f9", R.risk_factors(F.col("f5.cpa"), F.col("f5.tcpa"), a.sog, b.sog, a.cog, b.cog))
        out = out.withColumn("f10", R.overall_risk(F.col("f9"))).withColumn("f15", R.heat_weight(F.col("f5.cpa"), F.col("f5.tcpa")))
        return {r["name"]: r for r in out.collect()}

    return evaluate(pairs), evaluate(swapped)


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(golden, name):
    _, _, f1, f2, f3, f4, f5, f6 = GOLDEN[name]
    for r in (golden[0][name], golden[1][name]):
        if name == "far longitude" or r is golden[0][name]:
            assert r.f1 == pytest.approx(f1, abs=1e-6) and r.f2 == pytest.approx(f2, abs=1e-6)
        assert r.f3 is f3
        assert tuple(r.f4) == pytest.approx(f4, abs=1e-6)
        assert tuple(r.f5) == pytest.approx(f5, abs=1e-6)
        assert r.f6.tcpa == pytest.approx(f6, abs=1e-6)
        assert r.f10 == pytest.approx(RISK[name], abs=1e-6)
        if name in HEAT:
            assert r.f15 == pytest.approx(HEAT[name], abs=1e-6)


def test_unknown_course(spark):
    df = spark.createDataFrame(
        [(50.0, 0.0, None, 10.0, 50.0, 0.1, 270.0, 10.0)],
        ", ".join(f"{f}_{s} double" for s in "ab" for f in FIELDS),
    )
    a, b = geo.motion("_a"), geo.motion("_b")
    r = df.select(geo.cpa_tcpa_local(a, b).alias("l"), geo.cpa_tcpa_flat(a, b).alias("f"), geo.is_approaching(a, b).alias("n")).first()
    assert tuple(r.l) == (9999.0, -1.0) and tuple(r.f) == (None, None) and r.n is True


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lits(*values):
    return [F.lit(v).cast("double") for v in values]


def test_antipodes(spark):
    assert one(spark, geo.haversine_nm(*lits(0, 0, 0, 180))) == pytest.approx(math.pi * 3440.065)


def test_hull(spark):
    corners = one(spark, geo.hull_polygon(*lits(50, 0, 90), tuple(lits(100, 50, 10, 10))))
    assert len(corners) == 5
    bow = corners[3]
    assert bow.lat == pytest.approx(50) and bow.lon == pytest.approx(100 / (111320 * math.cos(math.radians(50))))
    for zero in ((0, 50, 10, 10), (100, 50, None, 10)):
        assert one(spark, geo.hull_polygon(*lits(50, 0, 90), tuple(lits(*zero)))) == []
    assert one(spark, geo.metres_to_deg_lon(*lits(10, 90))) == 0.0


def test_course_vector(spark):
    north = one(spark, geo.course_vector(geo.Motion(*lits(50, 0, 0, 12))))  # course 0 is a course
    assert north.lat == pytest.approx(50.05) and north.lon == 0
    assert one(spark, geo.course_vector(geo.Motion(*lits(50, 0, None, 12)))) is None
    assert one(spark, geo.course_vector(geo.Motion(*lits(50, 0, 10, 0)))) is None
    assert [one(spark, geo.encounter_vector_minutes(F.lit(t))) for t in (0.2, 2.5, 7.4)] == [1.0, 3.0, 7.0]


def test_classes(spark):
    by_length = [one(spark, D.length_class(F.lit(v).cast("double"))) for v in (None, float("nan"), 0, 50, 150, 250)]
    assert by_length == ["gray", "gray", "green", "yellow", "orange", "red"]
    assert one(spark, D.length_class_from_dims(*lits(0, 20))) == "gray"
    scales = [one(spark, D.length_scale(F.lit(c))) for c in ("green", "yellow", "orange", "red", "gray")]
    assert scales == [0.8, 1.0, 1.2, 1.4, 1.0]


def test_texts(spark):
    assert [one(spark, D.age_text(F.lit(100), F.lit(n))) for n in (90, 142, 300)] == ["0s ago", "42s ago", "3m 20s ago"]
    assert one(spark, D.age_text(F.lit(None).cast("long"), F.lit(1))) == ""
    title = one(spark, D.replay_title(F.lit("A"), F.lit("B"), F.lit(0.12345)))
    assert title == "A – B, realMinDist=0.123 nm"
    numbers = (0.125, 1.005, -0.375, 1234567.0, 0.0, float("nan"), float("inf"), -float("inf"))
    assert [one(spark, D.fixed(F.lit(v), 2)) for v in numbers] == ["%.2f" % v for v in numbers]
    assert one(spark, D.fixed(F.lit(None).cast("double"), 2)) is None
    assert one(spark, D.replay_title(F.lit("A"), F.lit("B"), F.lit(0.0625))) == "A – B, realMinDist=0.062 nm"
    f = R.risk_factors(*lits(0.1, 12, 10, 8, 90, 200))
    assert one(spark, R.risk_explanation(f, *lits(1.005, 12.125, 18, 110))).tcpa_factor == "TCPA of 12.12 min contributes 0.60 to risk"
    e = one(spark, R.risk_explanation(f, *lits(0.1, 12, 18, 110)))
    assert e.cpa_factor == "CPA of 0.10 nm contributes 0.80 to risk"
    assert e.tcpa_factor == "TCPA of 12.00 min contributes 0.60 to risk"
    assert e.speed_factor == "Combined speed of 18.00 knots contributes 0.60 to risk"
    assert e.angle_factor == "Approach angle of 110.00° contributes 0.94 to risk"
