"""Parsing, validity rules and projections. Narrow transformations only: no shuffle."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seawake import config as C
from seawake import schema as S
from seawake.functions.display import present
from seawake.session import broadcast_if_small

REQUIRED = ("mmsi", "latitude", "longitude", "cog", "sog", "timestamp")


# --- flat messages -----------------------------------------------------------
def _json_columns(text: DataFrame, schema: T.StructType) -> DataFrame:
    """Fields of the JSON text as columns beside it. The one-element ``inline_outer``
    has the text parsed once per row; without it every later mention of a field, in
    projections and filters alike, would parse the text again for that field."""
    return text.select("_text", F.inline_outer(F.array(F.from_json("_text", schema))))


def _read_text(messages: DataFrame, value: str) -> DataFrame:
    raw = _json_columns(messages.select(F.col(value).cast("string").alias("_text")), S.MESSAGE_TEXT)
    return raw.select("_text", *[F.col(k).alias(f"_m_{k}") for k in S.MESSAGE_KEYS])


def _whole(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def _name_or_default(name: Column, raw: Column) -> Column:
    """The default stands in for an absent key only; an explicit null stays null.
    The keys are looked up only for the rows that have no name."""
    absent = ~F.array_contains(F.json_object_keys(raw), "ship_name")
    return F.when(name.isNotNull(), name).when(absent, F.lit(C.UNKNOWN_NAME))


def _position_columns() -> list[Column]:
    m = {key: F.col(f"_m_{key}") for key in S.MESSAGE_KEYS}
    return [
        _whole(m["mmsi"]).alias("mmsi"),
        _name_or_default(m["ship_name"], F.col("_text")).alias("ship_name"),
        *[m[k].try_cast("double").alias(k) for k in ("latitude", "longitude", "cog", "sog", "heading")],
        m["timestamp"].try_cast("timestamp").alias("timestamp"),
    ]


def _split(parsed: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    valid = F.coalesce(valid, F.lit(False))
    return parsed.where(valid), parsed.where(~valid).select(F.col("_text").alias("value"))


def _all_present(names) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])


def _raw_dims() -> list[str]:
    return [f"_m_{d}" for d in S.DIMS]


def _parsed_messages(messages: DataFrame, value: str) -> tuple[DataFrame, Column]:
    """Positions with dimensions and cell name. A dimension that is given but is
    no number rejects the row, as any failed cast but that of the heading does."""
    dims = [F.col(f"_m_{d}").try_cast("double").alias(d) for d in S.DIMS]
    geohash = F.coalesce(F.col("_m_geohash"), F.lit(C.NO_GEOHASH)).alias("geohash")
    parsed = _read_text(messages, value).select("_text", *_raw_dims(), *_position_columns(), *dims, geohash)
    valid = _all_present(REQUIRED)
    for d in S.DIMS:
        valid = valid & (F.col(f"_m_{d}").isNull() | F.col(d).isNotNull())
    return parsed, valid


def parse_message(messages: DataFrame, value: str = "value") -> DataFrame:
    parsed, valid = _parsed_messages(messages, value)
    return _split(parsed, valid)[0].drop("_text", *_raw_dims())


def parse_message_rejects(messages: DataFrame, value: str = "value") -> DataFrame:
    """Text of the messages that :func:`parse_message` leaves out."""
    return _split(*_parsed_messages(messages, value))[1]


def parse_positions(messages: DataFrame, value: str = "value") -> DataFrame:
    parsed = _read_text(messages, value).select("_text", *_position_columns())
    return _split(parsed, _all_present(REQUIRED))[0].drop("_text")


def parse_static(messages: DataFrame, value: str = "value") -> DataFrame:
    """Complete static rows of ships that have a name. ``timestamp`` rides along for windows."""
    parsed = _read_text(messages, value).select(
        "_text",
        _whole(F.col("_m_mmsi")).alias("mmsi"),
        F.col("_m_ship_name").alias("ship_name"),
        *[F.col(f"_m_{d}").try_cast("double").alias(d) for d in S.DIMS],
        F.col("_m_timestamp").try_cast("timestamp").alias("timestamp"),
    )
    named = F.lower(F.trim("ship_name")) != C.UNKNOWN_NAME.lower()
    return _split(parsed, _all_present(S.STATIC_FIELDS) & named)[0].drop("_text")


def drop_rejects(df: DataFrame, required=REQUIRED) -> DataFrame:
    return df.where(_all_present(required))


# --- feed envelopes ----------------------------------------------------------
POSITION_REPORT, SHIP_STATIC = "PositionReport", "ShipStaticData"


def read_envelopes(raw: DataFrame, value: str = "value") -> DataFrame:
    """Envelope columns from JSON text; text that is no JSON object is skipped."""
    envelopes = _json_columns(raw.select(F.col(value).cast("string").alias("_text")), S.ENVELOPE)
    return envelopes.drop("_text").where(F.col("MessageType").isNotNull())


def route_by_type(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positions, statics); other message types belong to neither."""
    kind = F.col("MessageType")
    return envelopes.where(kind == POSITION_REPORT), envelopes.where(kind == SHIP_STATIC)


def normalise_time(text: Column, ingest_time: Column) -> Column:
    return F.coalesce(present(text).try_cast("timestamp"), ingest_time)


def clean_heading(heading: Column, cog: Column) -> Column:
    degrees = heading.try_cast("double")
    return F.when(degrees == C.HEADING_NOT_AVAILABLE, cog).otherwise(degrees)


def flatten_position(envelopes: DataFrame, ingest_time: Column | None = None) -> DataFrame:
    """Flat position of every envelope that has a report and a ship number."""
    now = F.current_timestamp() if ingest_time is None else ingest_time
    report, mmsi = F.col("Message.PositionReport"), F.col("MetaData.MMSI")
    filled = reduce(or_, [report[f].isNotNull() for f in ("Latitude", "Longitude", "Cog", "Sog", "TrueHeading")])
    return envelopes.where(report.isNotNull() & filled & (mmsi != 0)).select(
        mmsi.alias("mmsi"),
        report["Latitude"].alias("latitude"),
        report["Longitude"].alias("longitude"),
        report["Sog"].alias("sog"),
        report["Cog"].alias("cog"),
        clean_heading(report["TrueHeading"], report["Cog"]).alias("heading"),
        normalise_time(F.col("MetaData.TimeReceived"), now).alias("timestamp"),
    )


def flatten_static(envelopes: DataFrame, ingest_time: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if ingest_time is None else ingest_time
    static, mmsi = F.col("Message.ShipStaticData"), F.col("MetaData.MMSI")
    name = F.coalesce(present(static["ShipName"]), present(static["Name"]), F.lit(C.UNKNOWN_NAME))
    dims = [static["Dimension"][k].alias(d) for k, d in zip("ABCD", S.DIMS)]
    return envelopes.where(mmsi != 0).select(
        mmsi.alias("mmsi"),
        name.alias("ship_name"),
        *dims,
        normalise_time(F.col("MetaData.TimeReceived"), now).alias("timestamp"),
    )


# --- predicates and projections ----------------------------------------------
def valid_coordinate(df: DataFrame, max_latitude: float = C.COORDINATE_LIMIT) -> DataFrame:
    """Both coordinates within ±180; pass ``max_latitude=90`` for the strict rule."""
    limit = C.COORDINATE_LIMIT
    return df.where(
        F.col("latitude").between(-max_latitude, max_latitude) & F.col("longitude").between(-limit, limit)
    )


def under_way(df: DataFrame, min_sog: float = C.MIN_SOG) -> DataFrame:
    return df.where(F.col("sog") >= min_sog)


def project_positions(df: DataFrame) -> DataFrame:
    return df.drop("geohash", *S.DIMS)


def project_static(df: DataFrame, update_time: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if update_time is None else update_time
    return df.select(*S.STATIC_FIELDS, now.alias("update_time"))


def has_dimensions(df: DataFrame) -> DataFrame:
    """At least one dimension that is neither null nor zero."""
    return df.where(reduce(or_, [F.coalesce(F.col(d), F.lit(0.0)) != 0 for d in S.DIMS]))


def long_enough(df: DataFrame, min_length: float = C.MIN_LENGTH_M) -> DataFrame:
    return df.where(F.col("dim_a") + F.col("dim_b") > min_length)


def in_boxes(df: DataFrame, boxes=None) -> DataFrame:
    """Rows in any ``[[lat, lon], [lat, lon]]`` box, edges included.

    A literal list becomes one predicate. A DataFrame of boxes (``lat_min, lat_max,
    lon_min, lon_max``) becomes an equi-join on one-degree cells, a semi join, so
    overlapping boxes do not repeat a row.
    """
    if not isinstance(boxes, DataFrame):
        def inside(box) -> Column:
            (lat1, lon1), (lat2, lon2) = box
            return F.col("latitude").between(min(lat1, lat2), max(lat1, lat2)) & F.col("longitude").between(
                min(lon1, lon2), max(lon1, lon2)
            )

        return df.where(reduce(or_, [inside(b) for b in (boxes or C.FEED_BOXES)]))

    def degree(column) -> Column:
        return F.floor(F.col(column)).cast("long")

    def degrees(low: str, high: str) -> Column:
        """Whole degrees a box touches; bounds beyond the globe add none."""
        from_, to = (F.greatest(F.lit(-181), F.least(F.lit(181), degree(c))) for c in (low, high))
        return F.explode(F.when(from_ <= to, F.sequence(from_, to)))

    cells = boxes.withColumn("_by", degrees("lat_min", "lat_max")).withColumn("_bx", degrees("lon_min", "lon_max"))
    cells = broadcast_if_small(cells)
    inside = (
        (degree("latitude") == F.col("_by"))
        & (degree("longitude") == F.col("_bx"))
        & F.col("latitude").between(F.col("lat_min"), F.col("lat_max"))
        & F.col("longitude").between(F.col("lon_min"), F.col("lon_max"))
    )
    return df.join(cells, inside, "left_semi")

