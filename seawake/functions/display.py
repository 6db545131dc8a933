"""Labels, classes and short texts derived from ship and encounter columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seawake import config as C

# Upper length bound in metres, class, drawing scale.
LENGTH_CLASSES = ((50.0, "green", 0.8), (150.0, "yellow", 1.0), (250.0, "orange", 1.2), (None, "red", 1.4))
NO_LENGTH_CLASS, NO_LENGTH_SCALE = "gray", 1.0


def length_class(length: Column) -> Column:
    label = F.when(length.isNull() | F.isnan(length), F.lit(NO_LENGTH_CLASS))
    for bound, name, _ in LENGTH_CLASSES:
        label = label.otherwise(F.lit(name)) if bound is None else label.when(length < bound, F.lit(name))
    return label


def length_class_from_dims(dim_a: Column, dim_b: Column) -> Column:
    """By dimensions, where a zero counts as missing."""
    known = (dim_a != 0) & (dim_b != 0)
    return length_class(F.when(known, dim_a + dim_b))


def length_scale(label: Column) -> Column:
    scale = F.when(label == LENGTH_CLASSES[0][1], F.lit(LENGTH_CLASSES[0][2]))
    for _, name, value in LENGTH_CLASSES[1:]:
        scale = scale.when(label == name, F.lit(value))
    return scale.otherwise(F.lit(NO_LENGTH_SCALE))


def present(text: Column) -> Column:
    """Null unless the text has at least one character."""
    return F.when(text != "", text)


def fixed(value: Column, places: int) -> Column:
    """A number as text with ``places`` decimals, rounded by its exact binary value and ties to
    even, as Python and C print it. ``format_string`` rounds the shortest decimal form instead:
    1.005 would become 1.01, and 0.125 become 0.13."""
    text = F.call_function("format_number", value, F.lit("0." + "0" * places))
    return F.when(F.abs(value) < float("inf"), text).when(F.isnan(value), F.lit("nan")).otherwise(
        F.when(value > 0, F.lit("inf")).when(value < 0, F.lit("-inf"))
    )


def is_unknown_name(name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(name)) == C.UNKNOWN_NAME.lower(), F.lit(True)) | (name == "")


def age_text(then_s: Column, now_s: Column) -> Column:
    """Age from epoch seconds: ``42s ago`` or ``3m 20s ago``."""
    age = F.greatest(F.lit(0), F.floor(now_s - then_s)).cast("long")
    minutes, seconds = F.floor(age / 60).cast("long"), age % 60
    text = F.when(age < 60, F.concat(age.cast("string"), F.lit("s ago"))).otherwise(
        F.concat(minutes.cast("string"), F.lit("m "), seconds.cast("string"), F.lit("s ago"))
    )
    return F.when(then_s.isNull(), F.lit("")).otherwise(text)


def pair_key(mmsi_a: Column, mmsi_b: Column) -> Column:
    return F.concat_ws("_", F.least(mmsi_a, mmsi_b).cast("string"), F.greatest(mmsi_a, mmsi_b).cast("string"))


def pair_id(mmsi_a: Column, mmsi_b: Column) -> Column:
    return F.concat(F.lit("coll-"), mmsi_a.cast("string"), F.lit("-"), mmsi_b.cast("string"))


def collision_id(mmsi_a: Column, mmsi_b: Column, ts: Column) -> Column:
    return F.concat_ws("_", mmsi_a.cast("string"), mmsi_b.cast("string"), F.date_format(ts, "yyyyMMddHHmmss"))


def replay_title(name_a: Column, name_b: Column, distance: Column) -> Column:
    return F.format_string(C.REPLAY_TITLE, name_a, name_b, fixed(distance, 3))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
