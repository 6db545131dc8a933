"""Ship-shaped tables derived from the ``events`` table with plain expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VESSEL_POSITIONS_SQL = """
SELECT
  200000000 + user_id AS mmsi,
  CASE WHEN user_id % 7 = 0 THEN 'Unknown'
       ELSE concat('SHIP_', CAST(user_id AS VARCHAR(20))) END AS ship_name,
  50e0 + (user_id % 15) * 2e-2
     + (event_id % 3600) * ((user_id * 13) % 20)
       * cos(radians(CAST((user_id * 37) % 360 AS DOUBLE))) / 216e3 AS latitude,
  (user_id % 10) * 3e-2
     + (event_id % 3600) * ((user_id * 13) % 20)
       * sin(radians(CAST((user_id * 37) % 360 AS DOUBLE))) / 216e3 AS longitude,
  CAST((user_id * 37) % 360 AS DOUBLE) AS cog,
  CAST((user_id * 13) % 20 AS DOUBLE) AS sog,
  CASE WHEN event_id % 11 = 0 THEN 511e0
       WHEN event_id % 13 = 0 THEN NULL
       ELSE CAST((user_id * 37) % 360 AS DOUBLE) END AS heading,
  1704067200 + event_id AS epoch_s,
  CASE WHEN user_id % 5 = 0 THEN NULL
       ELSE CAST(20 + user_id % 180 AS DOUBLE) END AS dim_a,
  CAST(10 + user_id % 40 AS DOUBLE) AS dim_b,
  CAST(user_id % 25 AS DOUBLE) AS dim_c,
  CAST(5 + user_id % 20 AS DOUBLE) AS dim_d,
  event_id
FROM events
"""


def vessel_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with dimensions, ``epoch_s`` and ``event_id``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    return spark.sql(
        VESSEL_POSITIONS_SQL.replace("FROM events", "FROM {events}"), events=events
    ).withColumn("timestamp", F.timestamp_seconds("epoch_s"))


VESSEL_STATIC_SQL = """
SELECT mmsi, ship_name, dim_a, dim_b, dim_c, dim_d, 1704067200 + mmsi % 1800 AS epoch_s
FROM (SELECT DISTINCT mmsi, ship_name, dim_a, dim_b, dim_c, dim_d FROM positions)
WHERE mmsi % 8 <> 1
UNION ALL
SELECT mmsi, concat(ship_name, '_NEW'), dim_a, dim_b, dim_c, dim_d, 1704070800 + mmsi % 1800 AS epoch_s
FROM (SELECT DISTINCT mmsi, ship_name, dim_a, dim_b, dim_c, dim_d FROM positions)
WHERE mmsi % 3 = 0
"""


def vessel_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static messages: most ships once, every third ship again under a new name."""
    return spark.sql(
        VESSEL_STATIC_SQL.replace("FROM positions", "FROM {positions}"), positions=vessel_positions(spark, sf_dir)
    ).withColumn("timestamp", F.timestamp_seconds("epoch_s"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as JSON text, with faults by event number:

    of every 17th one loses a key, one has a null and one is cut short; every 19th has a
    heading in words, every 23rd its ship number as text, every 29th no name key, every
    31st a null name and every 37th the name ``" UNKNOWN "``.
    """
    n = F.col("event_id")
    fault = F.when(n % 17 == 0, F.floor(n / 17) % 3)
    quoted = F.lit('"')

    def text(column: str):
        return F.coalesce(F.col(column).cast("string"), F.lit("null"))

    def key(name: str, value):
        return F.concat(F.lit(f'"{name}":'), value)

    name = F.concat(quoted, F.col("ship_name"), quoted)
    pieces = [
        key("mmsi", F.when(n % 23 == 2, F.concat(quoted, text("mmsi"), quoted)).otherwise(text("mmsi"))),
        F.when(
            n % 29 != 3,
            key(
                "ship_name",
                F.when(n % 31 == 4, F.lit("null")).when(n % 37 == 5, F.lit('" UNKNOWN "')).otherwise(name),
            ),
        ),
        key("latitude", F.when(fault == 1, F.lit("null")).otherwise(text("latitude"))),
        key("longitude", text("longitude")),
        F.when(fault.isNull() | (fault != 0), key("sog", text("sog"))),
        key("cog", text("cog")),
        key("heading", F.when(n % 19 == 1, F.lit('"north"')).otherwise(text("heading"))),
        key("timestamp", F.concat(quoted, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"), quoted)),
        *[key(d, text(d)) for d in ("dim_a", "dim_b", "dim_c", "dim_d")],
    ]
    whole = F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))
    cut = F.substring(whole, 1, 40)
    return vessel_positions(spark, sf_dir).select("event_id", F.when(fault == 2, cut).otherwise(whole).alias("value"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed envelopes: a position report per event, a static report for every 5th, with
    gaps by event number. JSON text in ``value``."""
    vp = vessel_positions(spark, sf_dir)
    n = F.col("event_id")
    meta = F.struct(
        F.when(n % 41 == 0, F.lit(0).cast("long")).otherwise(F.col("mmsi")).alias("MMSI"),
        F.when(n % 43 == 0, F.lit("")).otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).alias("TimeReceived"),
    )
    report = F.struct(
        F.when(n % 47 == 0, F.lit(180.5)).otherwise(F.col("latitude")).alias("Latitude"),
        F.col("longitude").alias("Longitude"),
        F.col("cog").alias("Cog"),
        F.col("sog").alias("Sog"),
        F.when(n % 19 == 1, F.lit("north")).otherwise(F.col("heading").cast("string")).alias("TrueHeading"),
    )
    static = F.struct(
        F.when(n % 3 == 0, F.lit("")).otherwise(F.col("ship_name")).alias("ShipName"),
        F.when(n % 2 == 0, F.concat(F.lit("ALT_"), F.col("mmsi").cast("string"))).alias("Name"),
        F.struct(*[F.col(f"dim_{k.lower()}").alias(k) for k in "ABCD"]).alias("Dimension"),
    )

    def envelope(kind, **message):
        return F.to_json(
            F.struct(F.lit(kind).alias("MessageType"), meta.alias("MetaData"), F.struct(*[v.alias(k) for k, v in message.items()]).alias("Message"))
        ).alias("value")

    return (
        vp.select(envelope("PositionReport", PositionReport=report))
        .unionAll(vp.where("event_id % 5 = 0").select(envelope("ShipStaticData", ShipStaticData=static)))
        .unionAll(vp.where("event_id % 53 = 0").select(envelope("BaseStationReport", Other=F.struct("mmsi"))))
        .unionAll(vp.where("event_id % 59 = 0").select(F.lit('{"MessageType": "Posi').alias("value")))
    )
