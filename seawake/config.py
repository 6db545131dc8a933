"""Thresholds and fixed values shared by every operator.

Fixed values that results depend on are stated here once, in plain form.
Everything a caller may want to change is a parameter default.
"""

# --- geometry (fixed values) -------------------------------------------------
EARTH_RADIUS_NM = 3440.065
METRES_PER_NM = 1852.0
METRES_PER_DEGREE = 111000.0          # local plane used for encounter geometry
NM_PER_DEGREE = 60.0                  # flat plane used by the serving view
HULL_METRES_PER_DEGREE = 111320.0     # drawing of hull outlines
HULL_MIN_COS = 1e-8
VECTOR_MIN_COS = 1e-6
NO_CPA = 9999.0                       # sentinel pair returned when there is no
NO_TCPA = -1.0                        # closest approach ahead
NO_DISTANCE = 999999.0                # closest distance when a pair never meets

# --- message rules (fixed values) -----------------------------------------------------------
UNKNOWN_NAME = "Unknown"
NO_GEOHASH = "none"
HEADING_NOT_AVAILABLE = 511.0
COORDINATE_LIMIT = 180.0
MIN_SOG = 2.0
MIN_LENGTH_M = 50.0
DEFAULT_LENGTH_M = 100.0
DEFAULT_WIDTH_M = 20.0
FEED_BOXES = [[[49.0, -2.0], [51.0, 2.0]]]
SERVING_BOXES = [
    [[49.0, -8.0], [55.0, 8.0]],
    [[35.0, -10.0], [45.0, 5.0]],
    [[20.0, -80.0], [40.0, -60.0]],
]

# --- encounters (default values) --------------------------------------------------------------
MAX_CPA_NM = 0.5
MAX_TCPA_MIN = 10.0
LIVE_MAX_TCPA = 30.0
HISTORY_MAX_CPA_NM = 0.3
HISTORY_TCPA_MIN = (0.0, 10.0)
ENCOUNTER_WINDOW_S = 10

# --- risk (fixed values) -----------------------------------------------------
RISK_CPA_NM = 0.5
RISK_TCPA = 30.0
RISK_SPEED_KN = 30.0
RISK_WEIGHTS = {"cpa_risk": 0.4, "tcpa_risk": 0.3, "speed_risk": 0.2, "approach_angle_risk": 0.1}
RISK_UNCERTAINTY = 0.2
DEFAULT_RISK = 0.5
SHIP_HEAT = 0.3

# --- texts (fixed values) ----------------------------------------------------
RISK_SENTENCES = {
    "cpa_factor": "CPA of %s nm contributes %s to risk",
    "tcpa_factor": "TCPA of %s min contributes %s to risk",
    "speed_factor": "Combined speed of %s knots contributes %s to risk",
    "angle_factor": "Approach angle of %s° contributes %s to risk",
}
REPLAY_TITLE = "%s – %s, realMinDist=%s nm"

# --- tracks (fixed values) ---------------------------------------------------
PREDICTION_HORIZON_MIN = 30
PREDICTION_STEPS = 10
DEGREES_PER_KNOT_HOUR = 0.0166
UNCERTAINTY_LEVELS = (0.1, 0.3, 0.5)
UNCERTAINTY_RATE = 0.02
HISTORY_MINUTES = 60
SHIPS_HELD = 100
VECTOR_MINUTES = 15

# --- replay (fixed values) ------------------------------------------------------------------
FRAME_STEP_S = 60
WIDE_BEFORE_S, WIDE_AFTER_S = 20 * 60, 10 * 60
FINAL_BEFORE_S, FINAL_AFTER_S = 15 * 60, 5 * 60

# --- retention and cadence, seconds ------------------------------------------
POSITIONS_TTL_S = 3600
ENCOUNTERS_TTL_S = 600
STATIC_WINDOW_S = 300
SNAPSHOT_WINDOW_S = 600
REFRESH_S = 15

# --- physical design ---------------------------------------------------------
SLICE_S = 3600            # a ship's series is cut into slices of this length
SLICE_ROWS = 1_000_000                # rows of a ship that one task puts in order
JOIN_BUCKET_S = 300       # time bucket of the position range join
HOT_CELL_SHIPS = 2000     # ships per grid cell beyond which the cell is salted
BLOCK_SHIPS = 64          # ships of like place and motion that are compared as one
BROADCAST_ROWS = 200_000  # rows up to which a dimension is broadcast
BROADCAST_IDS = 2_000_000             # the same for ship numbers alone
COMPONENT_SALTS = 16
STORED_BUCKETS = 256                  # buckets of a stored table that is joined with what is made of it

# --- versioned tables (default values) ---------------------------------------
SMALL_SEGMENT_ROWS = 5_000_000        # segments of fewer rows are merged
STATE_BUCKETS = 64                    # buckets by ship of the tables that streams change
BUCKET_SEGMENTS = 8                   # segments of a bucket of encounters that are written as one
FACTS_KEPT_S = 24 * 3600              # older static data than this are kept as the last one per ship
VERSION_KEPT_S = 3600                 # old versions stay this long for those who read them
