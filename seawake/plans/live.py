"""Batch forms of the live jobs: feed to messages, messages to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from seawake import config as C
from seawake.operators import encounters as E
from seawake.operators import enrich as N
from seawake.operators import parse as P


def ingest(envelopes: DataFrame, ingest_time: Column | None = None, boxes=None) -> DataFrame:
    """Feed envelopes → enriched flat messages of ships under way."""
    reports, statics = P.route_by_type(envelopes)
    positions = P.valid_coordinate(P.under_way(P.flatten_position(reports, ingest_time)))
    if boxes is not None:
        positions = P.in_boxes(positions, boxes)
    return N.enrich_asof(positions, P.flatten_static(statics, ingest_time))


def positions_table(messages: DataFrame, snapshot: DataFrame) -> DataFrame:
    """JSON messages → named positions."""
    return N.fill_names(P.parse_positions(messages), snapshot)


def static_table(parsed: DataFrame, update_time: Column | None = None, seconds: int = C.STATIC_WINDOW_S) -> DataFrame:
    """Parsed messages → first known static row of every ship."""
    latest = N.latest_static(P.has_dimensions(parsed), seconds)
    return P.project_static(N.first_per_ship(latest.drop("window_start", "window_end")), update_time)


def encounters_table(parsed: DataFrame, statics: DataFrame | None = None, **limits) -> DataFrame:
    """Parsed messages → encounter rows; unknown names are filled from ``statics``."""
    named = parsed if statics is None else N.fill_names(parsed, statics)
    return E.detect_encounters_windowed(named, **limits)
