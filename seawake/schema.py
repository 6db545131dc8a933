"""Schemas of tables and messages."""

from pyspark.sql import types as T


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_L, _S, _D, _T, _B = T.LongType(), T.StringType(), T.DoubleType(), T.TimestampType(), T.BooleanType()

POSITIONS = _struct(
    ("mmsi", _L, False),
    ("ship_name", _S, True),
    ("latitude", _D, False),
    ("longitude", _D, False),
    ("cog", _D, False),
    ("sog", _D, False),
    ("heading", _D, True),
    ("timestamp", _T, False),
)

DIMS = ("dim_a", "dim_b", "dim_c", "dim_d")
STATIC_FIELDS = ("mmsi", "ship_name", *DIMS)

STATIC = _struct(
    ("mmsi", _L, False),
    ("ship_name", _S, True),
    *[(d, _D, True) for d in DIMS],
    ("update_time", _T, False),
)

SNAPSHOT = _struct(("mmsi", _L, True), ("ship_name", _S, True), *[(d, _D, True) for d in DIMS])

ENCOUNTERS = _struct(
    ("mmsi_a", _L, False),
    ("ship_name_a", _S, True),
    ("mmsi_b", _L, False),
    ("ship_name_b", _S, True),
    ("timestamp", _T, False),
    ("cpa", _D, False),
    ("tcpa", _D, False),
    ("distance", _D, False),
    ("is_active", _B, False),
    ("latitude_a", _D, False),
    ("longitude_a", _D, False),
    ("latitude_b", _D, False),
    ("longitude_b", _D, False),
)

# Feed envelope. The heading may arrive as text; coordinates and dimensions
# that are not numbers read as null, which the validity rules then drop.
ENVELOPE = _struct(
    ("MessageType", _S, True),
    ("MetaData", _struct(("MMSI", _L, True), ("TimeReceived", _S, True)), True),
    (
        "Message",
        _struct(
            (
                "PositionReport",
                _struct(
                    ("Latitude", _D, True),
                    ("Longitude", _D, True),
                    ("Cog", _D, True),
                    ("Sog", _D, True),
                    ("TrueHeading", _S, True),
                ),
                True,
            ),
            (
                "ShipStaticData",
                _struct(
                    ("ShipName", _S, True),
                    ("Name", _S, True),
                    ("Dimension", _struct(*[(k, _D, True) for k in "ABCD"]), True),
                ),
                True,
            ),
        ),
        True,
    ),
)

# Flat position message, read as text first so that each value can be cast on
# its own and a bad one does not take the row's other values with it.
MESSAGE_KEYS = (
    "mmsi", "ship_name", "latitude", "longitude", "sog", "cog",
    "heading", "timestamp", *DIMS, "geohash",
)
MESSAGE_TEXT = _struct(*[(k, _S, True) for k in MESSAGE_KEYS])

MESSAGE = _struct(
    ("mmsi", _L, True),
    ("ship_name", _S, True),
    ("latitude", _D, True),
    ("longitude", _D, True),
    ("sog", _D, True),
    ("cog", _D, True),
    ("heading", _D, True),
    ("timestamp", _T, True),
    *[(d, _D, True) for d in DIMS],
)
