"""Registry of queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seawake.fixtures import VESSEL_POSITIONS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, rounded: tuple[str, ...] = ()):
    """Registers a query; ``sql`` starts after the shared ``vp`` table.

    ``rounded`` columns are compared to six decimals: sines and cosines may differ
    between the engines in the last bit, and so do positions derived with them.
    """

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.round(c, 6) for c in rounded}) if rounded else df

        QUERIES[name] = run
        if sql is not None:
            text = f"WITH RECURSIVE vp AS MATERIALIZED ({VESSEL_POSITIONS_SQL}){sql}"
            if rounded:
                text = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in rounded)}) FROM ({text})"
            ORACLES[name] = text
        return fn

    return add


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def epoch(name: str = "timestamp", alias: str = "epoch_s") -> Column:
    return F.unix_timestamp(name).alias(alias)


# Table expressions of the oracles, each opening with a comma.
UNDER_WAY = ", uw AS MATERIALIZED (SELECT * FROM vp WHERE sog >= 2)"
LATEST = """, latest AS MATERIALIZED (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY epoch_s DESC) AS rn FROM vp) WHERE rn = 1)"""
IN_WINDOW = UNDER_WAY + """, win AS MATERIALIZED (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, epoch_s // 10 AS w, row_number() OVER (PARTITION BY epoch_s // 10, mmsi ORDER BY epoch_s DESC) AS rn
    FROM uw WHERE dim_a + dim_b > 50) WHERE rn = 1)"""


def local_relative(left: str, right: str, on: str) -> str:
    """Pairs with offset in metres and relative speed in metres per minute."""
    return f"""
  SELECT a.mmsi AS mmsi_a, b.mmsi AS mmsi_b, a.ship_name AS ship_name_a, b.ship_name AS ship_name_b,
    a.latitude AS latitude_a, a.longitude AS longitude_a, b.latitude AS latitude_b, b.longitude AS longitude_b,
    a.cog AS cog_a, a.sog AS sog_a, b.cog AS cog_b, b.sog AS sog_b,
    greatest(a.epoch_s, b.epoch_s) AS epoch_s,
    (a.longitude - b.longitude) * (cos(radians((a.latitude + b.latitude) / 2e0)) * 111e3) AS dx,
    (a.latitude - b.latitude) * 111e3 AS dy,
    (a.sog * sin(radians(a.cog)) - b.sog * sin(radians(b.cog))) * (1852e0 / 60e0) AS ux,
    (a.sog * cos(radians(a.cog)) - b.sog * cos(radians(b.cog))) * (1852e0 / 60e0) AS uy
  FROM {left} a JOIN {right} b ON {on}"""


def flat_relative(left: str, right: str, on: str) -> str:
    """Pairs with offset in nautical miles and relative speed in knots."""
    return f"""
  SELECT a.mmsi AS mmsi_a, b.mmsi AS mmsi_b, a.ship_name AS ship_name_a, b.ship_name AS ship_name_b,
    a.latitude AS latitude_a, a.longitude AS longitude_a, b.latitude AS latitude_b, b.longitude AS longitude_b,
    a.cog AS cog_a, a.sog AS sog_a, b.cog AS cog_b, b.sog AS sog_b,
    greatest(a.epoch_s, b.epoch_s) AS epoch_s,
    a.longitude * 6e1 * cos(radians(a.latitude)) - b.longitude * 6e1 * cos(radians(b.latitude)) AS dx,
    a.latitude * 6e1 - b.latitude * 6e1 AS dy,
    a.sog * sin(radians(a.cog)) - b.sog * sin(radians(b.cog)) AS ux,
    a.sog * cos(radians(a.cog)) - b.sog * cos(radians(b.cog)) AS uy
  FROM {left} a JOIN {right} b ON {on}"""


TIMED = "CASE WHEN ux * ux + uy * uy = 0 THEN 0e0 ELSE -(dx * ux + dy * uy) / (ux * ux + uy * uy) END"
ENCOUNTERS = IN_WINDOW + f""", pw AS MATERIALIZED ({local_relative("win", "win", "a.w = b.w AND a.mmsi < b.mmsi")})
, pt AS MATERIALIZED (SELECT *, {TIMED} AS tcpa FROM pw WHERE dx * ux + dy * uy < 0)
, enc AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, sqrt((dx + ux * tcpa) * (dx + ux * tcpa) + (dy + uy * tcpa) * (dy + uy * tcpa)) / 1852e0 AS cpa,
      sqrt(dx * dx + dy * dy) / 1852e0 AS distance
    FROM pt WHERE tcpa BETWEEN 0 AND 10)
  WHERE cpa < 5e-1)"""
LIVE = LATEST + f""", pl AS MATERIALIZED ({flat_relative("latest", "latest", "a.mmsi < b.mmsi")})
, pl2 AS MATERIALIZED (SELECT *, greatest({TIMED}, 0e0) AS hours FROM pl)
, pl3 AS MATERIALIZED (SELECT *, sqrt((dx + ux * hours) * (dx + ux * hours) + (dy + uy * hours) * (dy + uy * hours)) AS cpa FROM pl2)
, live AS MATERIALIZED (
  SELECT *, concat('coll-', mmsi_a, '-', mmsi_b) AS id, hours * 6e1 AS tcpa FROM pl3 WHERE cpa < 5e-1 AND hours * 6e1 < 30)"""
LIVE_HOURS = LIVE + """, live_h AS MATERIALIZED (
  SELECT *, concat('coll-', mmsi_a, '-', mmsi_b) AS id, hours AS tcpa FROM pl3 WHERE cpa < 5e-1 AND hours < 30)"""
TURN = "CASE WHEN abs(cog_a - cog_b) > 180 THEN 360 - abs(cog_a - cog_b) ELSE abs(cog_a - cog_b) END"
RISK = LIVE + f""", risk AS MATERIALIZED (
  SELECT *, 4e-1 * cpa_risk + 3e-1 * tcpa_risk + 2e-1 * speed_risk + 1e-1 * angle_risk AS overall_risk FROM (
    SELECT *, 1 - least(cpa / 5e-1, 1e0) AS cpa_risk,
      CASE WHEN tcpa > 0 THEN 1 - least(tcpa / 3e1, 1e0) ELSE 1e0 END AS tcpa_risk,
      least((sog_a + sog_b) / 3e1, 1e0) AS speed_risk, sin(radians({TURN})) AS angle_risk,
      least(1e0, (1 - cpa / 5e-1 * 5e-1) * CASE WHEN tcpa > 0 THEN 1 - tcpa / 3e1 * 5e-1 ELSE 1e0 END) AS heat
    FROM live))"""
HAVERSINE = """2 * 3440.065e0 * atan2(sqrt({a}), sqrt(1 - ({a})))"""


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    return HAVERSINE.format(a=a)
