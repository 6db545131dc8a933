"""Encounter detection: pairs of ships about to pass close to each other.

All-pairs comparison is replaced by an equi-join on grid cells that finds the same
pairs. Over the look-ahead time T a ship sweeps a box; two ships can only come
within ``max_cpa`` of each other when their boxes, grown by half of ``max_cpa``,
overlap. Boxes differ in size with speed, so ships fall into tiers of doubling box
size. A ship *visits* one cell (that of its box centre) in its own tier and in each
coarser one that a ship of the same group is of, and *hosts* the few cells of its own tier that a visitor's centre could
lie in. Slow, dense traffic therefore meets in small cells, and one fast ship or one
bad speed value does not widen the cells of the others. Each pair meets exactly once.

A cell that holds more ships than ``hot_cell_ships`` is salted, however many such cells
there are: its visitors and its hosts are cut into ``k`` parts each, for ``k * k`` tasks, so
that a row is repeated ``k`` times only.

In the flat plane not ships but blocks of ships of like place and motion visit and host. Pairs of
blocks that stay apart are dropped, and only the ships of the others are compared one by one.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seawake import config as C
from seawake.functions import geo
from seawake.functions.display import collision_id, pair_id
from seawake.operators.parse import long_enough
from seawake.operators.series import newest, tumbling
from seawake.session import broadcast_if_small

STATE = ("mmsi", "ship_name", "latitude", "longitude", "cog", "sog", "timestamp")
LOCAL_NM_PER_DEGREE = C.METRES_PER_DEGREE / C.METRES_PER_NM
MOVE = ("_x", "_y", "_vx", "_vy")  # place and velocity of a ship in the flat plane, worked out once per ship
POLAR_LATITUDE = 89.0
SLACK = 1 + 1e-9  # box growth that absorbs rounding


def _usable(states: DataFrame) -> DataFrame:
    """A ship without position, course or speed is in no encounter."""
    finite = [F.abs(F.col(c)) < float("inf") for c in ("latitude", "longitude", "cog", "sog")]
    return states.where(reduce(and_, finite))


def _boxes(states: DataFrame, plane: str, max_cpa: float, hours: float) -> DataFrame:
    """Swept box of each ship: centre and half extents in nautical miles, and its tier."""
    vx, vy = geo.velocity(F.col("cog"), F.col("sog"))
    if plane == "flat":
        x, y = geo.flat_xy(F.col("latitude"), F.col("longitude"))
    else:  # x is scaled per grid row, see _row_scale
        x, y = F.col("longitude"), F.col("latitude") * LOCAL_NM_PER_DEGREE
    boxes = geo.computed(states, {"_vx": vx, "_vy": vy, "_x": x, "_y": y})
    extents = {
        "_yc": F.col("_y") + F.col("_vy") * (hours / 2),
        "_hx": (F.abs("_vx") * (hours / 2) + max_cpa / 2) * SLACK,
        "_hy": (F.abs("_vy") * (hours / 2) + max_cpa / 2) * SLACK,
    }
    return boxes.withColumns({**extents, "_tier": _tier(extents["_hx"], extents["_hy"], max_cpa)})


def _tier(hx: Column, hy: Column, max_cpa: float) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(hx, hy) / max_cpa))).cast("int")


def _blocks(boxes: DataFrame, by: list[str], max_cpa: float, hours: float, block_ships: int = C.BLOCK_SHIPS) -> DataFrame:
    """Ships of like place and motion as one row ``_block``: the box around their boxes, the middle
    of their ``MOVE``, where it is at the end of the look-ahead (``_ex``, ``_ey``), how far from it ships
    with half of ``max_cpa`` around them may be until then (``_w``), and the ships. Where there are more
    than ``block_ships`` of them, they are dealt to several blocks."""
    side = 2 * max_cpa  # so that what velocities differ by grows to no more than places do
    like = {f"_b{c}": F.floor(F.col(c) * (hours if c.startswith("_v") else 1) / side) for c in MOVE}
    ships, keys = boxes.withColumns(like), [*by, *like]
    crowded = ships.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > block_ships)
    parts = crowded.select(*keys, F.ceil(F.col("_n") / block_ships).alias("_parts"))
    # rows without keys have been dropped, and no key is null
    dealt = ships.join(parts, keys, "left").withColumn("_part", F.pmod(F.xxhash64("mmsi"), F.coalesce("_parts", F.lit(1))))
    member = F.struct(*STATE, *MOVE, *[c for c in ("_new",) if c in boxes.columns])
    xc = F.col("_x") + F.col("_vx") * (hours / 2)
    spans = {**{c: (F.col(c), F.col(c)) for c in MOVE}, "_xc": (xc - F.col("_hx"), xc + F.col("_hx")), "_yc": (F.col("_yc") - F.col("_hy"), F.col("_yc") + F.col("_hy"))}
    ends = [f.alias(f"{c}_{end}") for c, (low, high) in spans.items() for end, f in (("low", F.min(low)), ("high", F.max(high)))]
    found = dealt.groupBy(*keys, "_part").agg(F.collect_list(member).alias("_members"), F.count("*").alias("_ships"), *ends)

    middles = {c: (F.col(f"{c}_low") + F.col(f"{c}_high")) / 2 for c in spans}
    # the last term absorbs the rounding of the middle
    halves = {f"{c}_half": (F.col(f"{c}_high") - F.col(f"{c}_low")) / 2 * SLACK + F.abs(m) * 1e-15 for c, m in middles.items()}
    found = geo.computed(found, {**middles, **halves})

    def both(x: str, y: str) -> Column:
        return F.sqrt(F.col(f"{x}_half") * F.col(f"{x}_half") + F.col(f"{y}_half") * F.col(f"{y}_half"))

    around = both("_x", "_y") + both("_vx", "_vy") * hours + max_cpa / 2
    far = F.abs("_x") + F.abs("_y") + (F.abs("_vx") + F.abs("_vy")) * hours + F.col("_around")
    found = geo.computed(geo.computed(found, {"_around": around}), {"_far": far})
    return found.select(
        *by,
        F.struct(*like, "_part").alias("_block"),
        "_members",
        "_ships",
        *spans,
        F.col("_xc_half").alias("_wx"),
        F.col("_yc_half").alias("_hy"),
        *[(F.col(f"_{c}") + F.col(f"_v{c}") * hours).alias(f"_e{c}") for c in "xy"],
        # what differs too much for numbers to be squared is near all, and left to the exact test
        F.when(F.col("_far") < 1e70, F.col("_around") * (1 + 1e-6) + F.col("_far") * 1e-9).otherwise(F.lit(float("nan"))).alias("_w"),
        _tier(F.col("_xc_half"), F.col("_yc_half"), max_cpa).alias("_tier"),
        *[F.exists("_members", lambda m: m["_new"]).alias("_new") for c in ("_new",) if c in boxes.columns],
    )


def _bound(max_cpa: float) -> Column:
    """Twice the half extent that no box of tier ``_g`` exceeds. Cells are two bounds wide."""
    return F.pow(F.lit(2.0), F.col("_g")) * (2 * max_cpa)


def _cell(value: Column) -> Column:
    return F.floor(value / (F.col("_bound") * 2)).cast("long")


def _span(centre: Column, half: Column) -> Column:
    """Cells in which the centre of a visitor that touches the box can lie."""
    reach = (half + F.col("_bound") / 2) * SLACK
    return F.explode_outer(F.sequence(_cell(centre - reach), _cell(centre + reach)))


def _row_scale() -> Column:
    """Nautical miles per unit of ``_x`` in grid row ``_cy``.

    In the local plane a degree of longitude is scaled by the cosine of the pair's
    mean latitude. The row uses the smallest cosine that any pair meeting in it can
    have, so distances are only ever underestimated. A row that reaches a pole has
    scale 0: all its ships share one cell.
    """
    cy, bound = F.col("_cy"), F.col("_bound")
    reach = F.greatest(F.abs((cy - 1) * 2 * bound), F.abs((cy + 2) * 2 * bound)) / LOCAL_NM_PER_DEGREE
    return F.when(reach < POLAR_LATITUDE, F.cos(F.radians(reach)) * LOCAL_NM_PER_DEGREE).otherwise(F.lit(0.0))


def _across(df: DataFrame, plane: str, hours: float) -> DataFrame:
    """Box centre and half extent across grid row ``_cy``; in the flat plane blocks come with them."""
    if plane == "flat":
        return df
    scaled = geo.computed(df, {"_scale": _row_scale()})
    polar = F.col("_scale") == 0
    centre = F.col("_x") * F.col("_scale") + F.col("_vx") * (hours / 2)
    return geo.computed(
        scaled,
        {
            "_xc": F.when(polar, F.lit(0.0)).otherwise(centre),
            "_wx": F.when(polar, F.lit(0.0)).otherwise(F.col("_hx")),
        },
    )


def _hosted(boxes: DataFrame, by: list[str]) -> DataFrame:
    """The tiers of the ships of each group, and their number ``_ships``. There are few tiers, as
    each doubles the box size."""
    return boxes.groupBy(*by).agg(F.collect_set("_tier").alias("_hosted"), F.count("*").alias("_ships"))


def _visited(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Each ship with the tiers ``_g`` it visits: those of ships of its own group that are not
    finer than its own. Groups that come with their tiers in ``_hosted`` keep them."""
    if "_hosted" in boxes.columns:
        both = boxes
    elif by:
        both = boxes.join(_hosted(boxes, by).drop("_ships"), by)
    else:
        both = boxes.withColumn("_hosted", _hosted(boxes, by).select("_hosted").scalar())
    coarser = F.filter("_hosted", lambda t: t >= F.col("_tier"))
    return both.withColumn("_g", F.explode(coarser)).drop("_hosted")


def _visitors(boxes: DataFrame, by: list[str], plane: str, max_cpa: float, hours: float) -> DataFrame:
    rows = geo.computed(_visited(boxes, by), {"_bound": _bound(max_cpa)})
    rows = geo.computed(rows, {"_cy": _cell(F.col("_yc"))})
    return _across(rows, plane, hours).withColumn("_cx", _cell(F.col("_xc")))


def _hosts(boxes: DataFrame, plane: str, max_cpa: float, hours: float) -> DataFrame:
    if "_hosted" in boxes.columns:  # asked here too, so that both sides share what made it
        boxes = boxes.where(F.array_contains("_hosted", F.col("_tier"))).drop("_hosted")
    own = geo.computed(boxes.withColumn("_g", F.col("_tier")), {"_bound": _bound(max_cpa)})
    rows = own.withColumn("_cy", _span(F.col("_yc"), F.col("_hy")))
    return _across(rows, plane, hours).withColumn("_cx", _span(F.col("_xc"), F.col("_wx")))


def _paths_near(v: dict[str, Column], h: dict[str, Column], max_cpa: float) -> Column:
    """Whether the lines of two ships' paths relative to each other come near: a bound without
    roots that is never tighter than the exact test. The last term absorbs rounding."""
    dx, dy, ux, uy = (v[c] - h[c] for c in MOVE)
    reach = F.lit(max_cpa * (1 + 1e-6)) + (F.abs(dx) + F.abs(dy)) * 1e-9
    return F.abs(dx * uy - dy * ux) <= (F.abs(ux) + F.abs(uy)) * reach


def _blocks_near(v: dict[str, Column], h: dict[str, Column]) -> Column:
    """Whether ships of two blocks may come near each other during the look-ahead: the line of the
    middles' relative path passes within reach, and they are within reach at its start or
    approach each other then, and at its end or have not drawn apart before. All is true of a
    reach that is no number."""
    dx, dy, ux, uy = (v[c] - h[c] for c in MOVE)
    ex, ey, reach = v["_ex"] - h["_ex"], v["_ey"] - h["_ey"], v["_w"] + h["_w"]
    passes = F.abs(dx * uy - dy * ux) <= F.sqrt(ux * ux + uy * uy) * reach
    starts = (dx * ux + dy * uy <= 0) | (dx * dx + dy * dy <= reach * reach)
    ends = (ex * ux + ey * uy >= 0) | (ex * ex + ey * ey <= reach * reach)
    return passes & starts & ends


def candidate_pairs(
    states: DataFrame,
    by: list[str],
    plane: str,
    max_cpa: float,
    max_tcpa_min: float,
    hot_cell_ships: int | None = C.HOT_CELL_SHIPS,
    changed: DataFrame | None = None,
) -> DataFrame:
    """Pairs of ships of the same group ``by`` that could meet: structs ``a`` and ``b``
    of the state columns with ``a.mmsi < b.mmsi``, and of ``MOVE`` in the flat plane, where pairs
    whose paths stay apart are dropped as well. ``states`` has one row per ship and group.
    With ``changed`` (mmsi, no repeats) only pairs of a ship in it: other ships are dropped
    before they are shuffled unless a changed one is in their cell."""
    hours = max_tcpa_min / 60
    # rows without keys meet nobody; dropped here, not by the joins, all branches below share one shuffle of the states
    keyed = states.select(*by, *STATE).where(reduce(and_, [F.col(k).isNotNull() for k in (*by, "mmsi")]))
    boxes = _boxes(_usable(keyed), plane, max_cpa, hours)
    if changed is not None:
        boxes = _marked(boxes, changed)
    if plane == "flat":
        boxes = _blocks(boxes, by, max_cpa, hours)
    if plane == "flat" or not (hot_cell_ships and by):
        return _in_order(_meeting(boxes, by, plane, max_cpa, hours, hot_cell_ships), by)
    # A cell has no more visitors than its group has ships, so only large groups can have hot cells. Where there is no
    # large group, which one number says, cells are neither counted nor dealt out a second time.
    groups = _hosted(boxes, by)
    marked, is_large = boxes.join(groups, by), F.col("_ships") > hot_cell_ships
    most = F.max(F.when(F.size("_hosted") > 0, F.col("_ships")))  # of the same rows as the join, so that both share their shuffle
    some = groups.agg(F.coalesce(most > hot_cell_ships, F.lit(False))).scalar()
    few, many = marked.where(~is_large).drop("_ships"), marked.where(some).where(is_large).drop("_ships")
    met = _meeting(few, by, plane, max_cpa, hours, None).union(_meeting(many, by, plane, max_cpa, hours, hot_cell_ships))
    return _in_order(met, by)


def _marked(boxes: DataFrame, changed: DataFrame) -> DataFrame:
    new = broadcast_if_small(changed.select("mmsi"), C.BROADCAST_IDS).withColumn("_new", F.lit(True))
    return boxes.join(new, "mmsi", "left").withColumn("_new", F.coalesce("_new", F.lit(False)))


def _in_order(met: DataFrame, by: list[str]) -> DataFrame:
    forward = F.col("v.mmsi") < F.col("h.mmsi")
    return met.select(*by, F.when(forward, F.col("v")).otherwise(F.col("h")).alias("a"), F.when(forward, F.col("h")).otherwise(F.col("v")).alias("b"))


def _meeting(boxes: DataFrame, by: list[str], plane: str, max_cpa: float, hours: float, hot_cell_ships: int | None) -> DataFrame:
    """The pairs of ``candidate_pairs`` among boxes, or the blocks of the flat plane, as visitor ``v`` and
    host ``h``, with the cell in which they meet; cells of more than ``hot_cell_ships`` are salted.
    Of marked ones only pairs of a ``_new`` one."""
    cell, flat, marked = [*by, "_g", "_cy", "_cx"], plane == "flat", "_new" in boxes.columns
    unit = "_block" if flat else "mmsi"  # what visits and hosts
    visitors = _visitors(boxes, by, plane, max_cpa, hours)
    hosts = _hosts(boxes, plane, max_cpa, hours)
    if marked:
        touched = [rows.where("_new").select(*cell) for rows in (visitors, hosts)]
        cells = broadcast_if_small(touched[0].union(touched[1]).distinct())
        visitors, hosts = (rows.join(cells, cell, "left_semi") for rows in (visitors, hosts))
    keys = cell
    if hot_cell_ships:
        hot = (
            visitors.groupBy(*cell)
            .agg(F.sum("_ships" if flat else F.lit(1)).alias("_n"))
            .where(F.col("_n") > hot_cell_ships)
            .select(*cell, F.ceil(F.sqrt(F.col("_n") / hot_cell_ships)).cast("int").alias("_parts"))
        )
        parts = F.coalesce("_parts", F.lit(1))
        part, every = F.pmod(F.xxhash64(unit), parts).cast("int"), F.explode(F.sequence(F.lit(0), parts - 1))
        visitors = visitors.join(hot, cell, "left").withColumn("_part_v", part).withColumn("_part_h", every)
        hosts = hosts.join(hot, cell, "left").withColumn("_part_h", part).withColumn("_part_v", every)
        keys = [*cell, "_part_v", "_part_h"]

    held = F.col("_members") if flat else F.struct(*STATE)
    tested = [unit, "_tier", "_yc", "_hy", "_xc", "_wx", *((*MOVE, "_ex", "_ey", "_w") if flat else ()), *(["_new"] if marked else [])]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, held.alias(name), *[F.col(c).alias(f"_{name}{c}") for c in tested])

    v, h = ({c: F.col(f"_{name}{c}") for c in tested} for name in "vh")
    touch = (F.abs(v["_yc"] - h["_yc"]) <= v["_hy"] + h["_hy"]) & (
        F.abs(v["_xc"] - h["_xc"]) <= v["_wx"] + h["_wx"]
    )
    if marked:
        touch &= v["_new"] | h["_new"]
    if not flat:
        once = (v["_tier"] < h["_tier"]) | (v["mmsi"] < h["mmsi"])
        return side(visitors, "v").join(side(hosts, "h"), keys).where((v["mmsi"] != h["mmsi"]) & once & touch).select(*cell, "v", "h")
    # few bytes but very many pairs: a broadcast would leave them to the few tasks that have the ships
    once = (v["_tier"] < h["_tier"]) | ((v["_tier"] == h["_tier"]) & (v["_block"] <= h["_block"]))
    met = side(visitors, "v").join(side(hosts, "h").hint("merge"), keys).where(touch & _blocks_near(v, h) & once)
    alone = (v["_block"] == h["_block"]).alias("_alone")
    pairs = met.select(*cell, alone, F.explode("v").alias("v"), "h").select(*cell, "_alone", "v", F.explode("h").alias("h"))
    v, h = ({c: F.col(f"{name}.{c}") for c in ("mmsi", *MOVE, *(["_new"] if marked else []))} for name in "vh")
    wanted = (v["mmsi"] != h["mmsi"]) & (~F.col("_alone") | (v["mmsi"] < h["mmsi"]))
    if marked:
        wanted &= v["_new"] | h["_new"]
    return pairs.where(_paths_near(v, h, max_cpa) & wanted).select(*cell, "v", "h")


def _sides(pairs: DataFrame, by: list[str], columns: tuple[str, ...] = STATE) -> DataFrame:
    return pairs.select(
        *by,
        *[F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in "ab" for c in columns],
    )


def latest_in_window(positions: DataFrame, seconds: int = C.ENCOUNTER_WINDOW_S) -> DataFrame:
    """Newest row of each ship in each window; equal times go to the greater position."""
    cols = [c for c in STATE if c not in ("mmsi", "timestamp", "latitude", "longitude")]
    wide = tumbling(positions, seconds).select(
        "window_start", "window_end", "mmsi", "timestamp", "latitude", "longitude", *cols
    )
    return newest(wide, ["window_start", "window_end", "mmsi"], ["timestamp", "latitude", "longitude"])


def detect_encounters_windowed(
    positions: DataFrame,
    seconds: int = C.ENCOUNTER_WINDOW_S,
    max_cpa: float = C.MAX_CPA_NM,
    max_tcpa: float = C.MAX_TCPA_MIN,
    min_length: float = C.MIN_LENGTH_M,
    hot_cell_ships: int | None = C.HOT_CELL_SHIPS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Encounter rows per window among ships longer than ``min_length``."""
    states = latest_in_window(long_enough(positions, min_length), seconds)
    return encounters_among(states, ["window_start", "window_end"], max_cpa, max_tcpa, hot_cell_ships, carry)


def encounters_among(
    states: DataFrame,
    by: list[str],
    max_cpa: float = C.MAX_CPA_NM,
    max_tcpa: float = C.MAX_TCPA_MIN,
    hot_cell_ships: int | None = C.HOT_CELL_SHIPS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Encounters in the local plane among ``states``, one row per ship and group ``by``.
    ``carry`` names more state columns that both ships keep, such as course and speed."""
    pairs = _sides(candidate_pairs(states, by, "local", max_cpa, max_tcpa, hot_cell_ships), by)
    a, b = geo.motion("_a"), geo.motion("_b")
    moving = geo.computed(pairs, geo.relative_local(a, b))
    r = {n: F.col(n) for n in ("dx", "dy", "ux", "uy")}
    scored = geo.computed(moving.where(r["dx"] * r["ux"] + r["dy"] * r["uy"] < 0), {"tcpa": geo.time_to_closest(r)})
    scored = geo.computed(
        scored.where(F.col("tcpa").between(0, max_tcpa)),
        {"cpa": geo.separation_at(r, F.col("tcpa")) / C.METRES_PER_NM},
    )
    return scored.where(F.col("cpa") < max_cpa).select(
        *by,
        "mmsi_a",
        "ship_name_a",
        "mmsi_b",
        "ship_name_b",
        F.greatest("timestamp_a", "timestamp_b").alias("timestamp"),
        "cpa",
        "tcpa",
        geo.planar_distance_nm(a, b).alias("distance"),
        F.lit(True).alias("is_active"),
        "latitude_a",
        "longitude_a",
        "latitude_b",
        "longitude_b",
        *[f"{c}_{side}" for side in "ab" for c in carry],
    )


def detect_encounters_live(
    ships: DataFrame,
    max_cpa: float = C.MAX_CPA_NM,
    max_tcpa: float = C.LIVE_MAX_TCPA,
    tcpa_unit: str = "minutes",
    hot_cell_ships: int | None = C.HOT_CELL_SHIPS,
    changed: DataFrame | None = None,
) -> DataFrame:
    """Encounters among the latest ship states, one row per ship, in the flat plane; with
    ``changed`` (mmsi, no repeats) those of the ships in it.

    ``tcpa_unit="hours"`` applies the threshold to hours, as older clients expect. It is for
    compatibility alone: with hours of look-ahead cells are hundreds of miles wide, and
    candidates come near to all pairs.
    """
    minutes = max_tcpa * 60 if tcpa_unit == "hours" else max_tcpa
    pairs = _sides(candidate_pairs(ships, [], "flat", max_cpa, minutes, hot_cell_ships, changed), [], (*STATE, *MOVE))
    return _live_rows(_closest(pairs, "ab", tcpa_unit).where((F.col("cpa") < max_cpa) & (F.col("tcpa") < max_tcpa)))


def _closest(pairs: DataFrame, sides: str, tcpa_unit: str = "minutes") -> DataFrame:
    """Adds ``cpa`` and ``tcpa`` to pairs of ships with their ``MOVE``; which side is which does not matter."""
    moving = geo.computed(pairs, {n: F.col(f"{c}_{sides[0]}") - F.col(f"{c}_{sides[1]}") for n, c in zip(("dx", "dy", "ux", "uy"), MOVE, strict=True)})
    r = {n: F.col(n) for n in ("dx", "dy", "ux", "uy")}
    timed = geo.computed(moving, {"_hours": geo.not_negative(geo.time_to_closest(r))})
    return geo.computed(timed, {"cpa": geo.separation_at(r, F.col("_hours")), "tcpa": geo.in_unit(F.col("_hours"), tcpa_unit)})


def _live_rows(scored: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    return scored.select(
        *carry,
        pair_id(F.col("mmsi_a"), F.col("mmsi_b")).alias("id"),
        *[f"{c}_{side}" for side in "ab" for c in ("mmsi", "ship_name", "latitude", "longitude", "cog", "sog")],
        "cpa",
        "tcpa",
        F.greatest("timestamp_a", "timestamp_b").alias("timestamp"),
    )


#: The cell in which two ships meet.
CELL = ("_g", "_cy", "_cx")


def meetings_live(
    ships: DataFrame,
    max_cpa: float = C.MAX_CPA_NM,
    max_tcpa: float = C.LIVE_MAX_TCPA,
    hot_cell_ships: int | None = C.HOT_CELL_SHIPS,
    changed: DataFrame | None = None,
) -> DataFrame:
    """The encounters of :func:`detect_encounters_live` in the form in which they are kept: the cell
    and the states of visitor (``_v``) and host (``_h``), from which all else follows.

    Rows come as the join finds them, a visitor's hosts in a run, and hold nothing that is the
    pair's own: in columns a pair takes little more than its host's number.
    """
    return meetings_of(blocks_live(ships, max_cpa, max_tcpa, changed), max_cpa, max_tcpa, hot_cell_ships)


def blocks_live(ships: DataFrame, max_cpa: float = C.MAX_CPA_NM, max_tcpa: float = C.LIVE_MAX_TCPA, changed: DataFrame | None = None) -> DataFrame:
    """The ships of :func:`meetings_live` in blocks, for those who keep them while they are compared."""
    boxes = _boxes(_usable(ships.select(*STATE).where("mmsi IS NOT NULL")), "flat", max_cpa, max_tcpa / 60)
    return _blocks(boxes if changed is None else _marked(boxes, changed), [], max_cpa, max_tcpa / 60)


def meetings_of(
    blocks: DataFrame, max_cpa: float = C.MAX_CPA_NM, max_tcpa: float = C.LIVE_MAX_TCPA, hot_cell_ships: int | None = C.HOT_CELL_SHIPS
) -> DataFrame:
    """The rows of :func:`meetings_live` from its blocks."""
    met = _meeting(blocks, [], "flat", max_cpa, max_tcpa / 60, hot_cell_ships)
    sides = {f"{c}_{side}": F.col(f"{side}.{c}") for side in "vh" for c in (*STATE, *MOVE)}
    scored = _closest(met.select(*CELL, *[c.alias(name) for name, c in sides.items()]), "vh")
    near = scored.where((F.col("cpa") < max_cpa) & (F.col("tcpa") < max_tcpa))
    return near.select(*CELL, *[f"{c}_{side}" for side in "vh" for c in STATE])


def encounters_of(meetings: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows of :func:`detect_encounters_live` from kept meetings; ``carry`` names columns to keep."""
    forward = F.col("mmsi_v") < F.col("mmsi_h")
    first, last = ({c: F.when(forward, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")) for c in STATE} for x, y in ("vh", "hv"))
    pairs = meetings.select(*carry, *[c.alias(f"{name}_a") for name, c in first.items()], *[c.alias(f"{name}_b") for name, c in last.items()])
    moves = {}
    for side in "ab":
        ship = geo.motion(f"_{side}")
        values = (*geo.flat_xy(ship.lat, ship.lon), *geo.velocity(ship.cog, ship.sog))
        moves |= {f"{c}_{side}": value for c, value in zip(MOVE, values, strict=True)}
    return _live_rows(_closest(geo.computed(pairs, moves), "ab"), carry)


def with_collision_id(encounters: DataFrame) -> DataFrame:
    return encounters.withColumn(
        "collision_id", collision_id(F.col("mmsi_a"), F.col("mmsi_b"), F.col("timestamp"))
    )


def filter_encounters(encounters: DataFrame, max_cpa: float = C.MAX_CPA_NM, max_tcpa: float = C.LIVE_MAX_TCPA) -> DataFrame:
    return encounters.where((F.col("cpa") <= max_cpa) & (F.col("tcpa") <= max_tcpa))


def dedupe_pairs(encounters: DataFrame) -> DataFrame:
    """Newest encounter of each unordered pair."""
    keyed = encounters.withColumn("_lo", F.least("mmsi_a", "mmsi_b")).withColumn("_hi", F.greatest("mmsi_a", "mmsi_b"))
    return newest(keyed, ["_lo", "_hi"], ["timestamp"]).drop("_lo", "_hi")


def rank_encounters(encounters: DataFrame) -> DataFrame:
    """Most urgent first, by a distributed sort."""
    return encounters.orderBy("tcpa", "cpa", "mmsi_a", "mmsi_b", "timestamp")


def with_urgency(encounters: DataFrame) -> DataFrame:
    """Rank ``urgency`` of every encounter in the order of ``rank_encounters``.

    Ranks are taken within millisecond steps of TCPA and shifted by the counts of the steps
    before, so no task sees more than one step and the small table of counts.
    """
    step = F.floor(F.col("tcpa") * 60_000).cast("long")
    rows = encounters.withColumn("_step", step)
    counts = rows.groupBy("_step").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_step", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    in_step = Window.partitionBy("_step").orderBy("tcpa", "cpa", "mmsi_a", "mmsi_b", "timestamp")
    ranked = rows.join(counts, "_step").withColumn("urgency", F.row_number().over(in_step) + F.col("_before"))
    return ranked.drop("_step", "_before")


def most_urgent(encounters: DataFrame, n: int) -> DataFrame:
    """Top ``n`` by TCPA with their rank; a top-n, so only ``n`` rows reach the window."""
    order = ["tcpa", "cpa", "mmsi_a", "mmsi_b", "timestamp"]
    top = encounters.orderBy(*order).limit(n)
    return top.withColumn("urgency", F.row_number().over(Window.orderBy(*order)))
