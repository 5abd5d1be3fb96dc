"""Object-level labelling: relevance, pool, firing engine, risk factors, per-anchor labels.

Objects are in the frame of the ego at the anchor's time (x ahead, y left). ``vx`` and ``vy`` are an object's own velocity in that frame: an object
that stands still has none, however fast the ego drives. Only what asks how the gap to the ego changes uses the velocity relative to the ego,
which moves ahead with ``ego_speed``: the corridor engine. Sideways the ego does not move, so the lateral velocity is both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryframe.contracts.parser import strict_text
from quarryframe.functions import columns as c
from quarryframe.functions.python_rules import py_round

# Ego size, corridor and risk thresholds (metres, seconds, metres per second).
EGO_LENGTH, EGO_WIDTH, MARGIN = 4.1, 1.87, 0.5
HORIZON_STEPS, STEP_S, BASE_M = 12, 0.25, 2.0
NEAR_M, ONCOMING_M, Y_BRAKE, Y_STATIONARY, SLOW = 5.5, 20.0, 1.185, 3.0, 0.5
SPEED_DROP, TRACK_FRAMES, EVIDENCE_S = 0.5, 6, 3.0
FACTORS = ("vru_crossing", "vehicle_crossing", "lead_vehicle_braking", "stationary_obstacle", "object_near", "oncoming_traffic")
TWO_WHEELERS = ("bicycle", "motorcycle")


def config_invariants() -> dict[str, Column]:
    """What a rule config (y_brake, y_still, ego_width, margin, drop) must not be: each condition with its name."""
    keys = ("y_brake", "y_still", "ego_width", "margin", "drop")
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return {
        "stationary_narrower": F.col("y_still") < F.col("y_brake"),
        "band_width": F.abs(F.lit(Y_BRAKE) - (F.col("ego_width") + F.col("margin")) / 2) > 1e-9,
        "not_positive": (F.col("y_brake") <= 0) | (F.col("y_still") <= 0),
        "missing_key": missing,
    }


def with_geometry(objects: DataFrame) -> DataFrame:
    """distance, azimuth, group and motion state of each object."""
    x, y = F.col("x_c"), F.col("y_c")
    return objects.withColumns(
        {"distance": c.norm(x, y), "azimuth": c.azimuth_deg(x, y), "grp": c.group_of(F.col("category")), "state": c.motion_state(F.col("vx"), F.col("vy"))}
    )


def relevant(cone_deg: float = 30.0, disc_m: float = 15.0, scale: float = 1.0) -> Column:
    """Inside the forward cone within the class's range, or inside the disc around the ego."""
    return ((F.abs("azimuth") <= cone_deg) & (F.col("distance") < c.cone_range(F.col("category")) * scale)) | (F.col("distance") < disc_m)


def pool_rank() -> Column:
    """Rank inside the anchor by distance to the millimetre, then by object."""
    return F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.round("distance", 3), "ann_no"))


def relative_vx() -> Column:
    """Velocity ahead, relative to the ego."""
    return F.col("vx") - F.col("ego_speed")


@F.arrow_udf(T.DoubleType())
def _least_clearance(x: pa.Array, y: pa.Array, vx: pa.Array, vy: pa.Array, length: pa.Array, width: pa.Array, yaw_deg: pa.Array, inside: pa.Array) -> pa.Array:
    """The clearance of rows whose velocity is relative to the ego: null where place or velocity is null, and where the box is and no sample lies inside the band."""
    half_length, half_width = EGO_LENGTH / 2, (EGO_WIDTH + MARGIN) / 2
    whole = lambda *columns: np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
    placed, sized = whole(x, y, vx, vy), whole(length, width, yaw_deg)
    x, y, vx, vy, length, width, yaw_deg, inside = (c.to_numpy(zero_copy_only=False).astype(float) for c in (x, y, vx, vy, length, width, yaw_deg, inside))
    yaw, least, hit = np.radians(yaw_deg), np.full(len(x), np.nan), np.zeros(len(x), bool)
    for k in range(HORIZON_STEPS + 1):
        px, py = x + vx * (k * STEP_S), y + vy * (k * STEP_S)
        dx, dy = px - np.clip(px, -half_length, half_length), py - np.clip(py, -half_width, half_width)
        within = (dx == 0) & (dy == 0)
        turn = yaw - np.arctan2(dy, dx)
        extent = np.abs(np.cos(turn)) * length / 2 + np.abs(np.sin(turn)) * width / 2
        # the least that is a number, as SQL has it
        least = np.fmin(least, np.where(within, inside, np.sqrt(dx * dx + dy * dy) - extent))
        hit |= within
    return pa.array(least, mask=~(placed & (sized | hit)))


def clearance_samples(inside: float = -1e9) -> Column:
    """Least gap between the ego's swept band and the object's extent toward it over the constant-velocity samples.

    Ego and object go on with their velocities. The extent counts in the direction from the band's nearest point to the
    centre; a centre inside the band is a gap of ``inside``. The samples are taken over whole batches of rows: unrolled into one
    expression they are too long a method for the JVM to compile.
    """
    told = ("x_c", "y_c", relative_vx(), "vy", "box_length_m", "box_width_m", "box_yaw_deg")
    return _least_clearance(*((F.col(v) if isinstance(v, str) else v).cast("double") for v in told), F.lit(float(inside)))


def gap_samples(steps: int = HORIZON_STEPS) -> Column:
    """Least distance from the ego's swept band to the object's centre over the constant-velocity samples; 0 inside."""
    half_length, half_width = EGO_LENGTH / 2, (EGO_WIDTH + MARGIN) / 2
    at = lambda k: (F.col("x_c") + relative_vx() * (k * STEP_S), F.col("y_c") + F.col("vy") * (k * STEP_S))
    return F.least(*(c.rectangle_gap(*at(k), half_length, half_width) for k in range(steps + 1)))


def track_windows(objects: DataFrame, anchors: DataFrame, window_s: float = EVIDENCE_S) -> DataFrame:
    """(anchor_id, instance_id, n_future, n_evidence, slowest, fastest) of each instance sighted at an anchor.

    Its track are its sightings in the next ``TRACK_FRAMES`` frames of the scene (``n_future``); speeds, to three digits, count up to ``window_s`` after the anchor and are null
    where there is none. A window over each instance's sightings, with at most as many rows in it as there are frames, so the work is linear; only
    keys, times and speeds pass through it.
    """
    speed = F.round(c.norm("vx", "vy"), 3)
    seen = objects.groupBy("anchor_id", "instance_id").agg(F.count(F.lit(1)).alias("n"), F.min(speed).alias("low"), F.max(speed).alias("high"))
    frames = anchors.select("anchor_id", "scene_token", F.col("walk_idx").cast("int").alias("walk_idx"), "timestamp_us")
    w = Window.partitionBy("scene_token", "instance_id").orderBy("walk_idx").rangeBetween(1, TRACK_FRAMES)
    ahead = seen.join(frames, "anchor_id").withColumn("track", F.collect_list(F.struct("timestamp_us", "n", "low", "high")).over(w))
    inside = F.filter("track", lambda s: s["timestamp_us"] - F.col("timestamp_us") <= int(window_s * 1e6))
    count = lambda track: F.aggregate(track, F.lit(0).cast("long"), lambda acc, s: acc + s["n"])
    return ahead.withColumn("inside", inside).select(
        "anchor_id", "instance_id", count(F.col("track")).alias("n_future"), count(F.col("inside")).alias("n_evidence"), F.array_min("inside.low").alias("slowest"), F.array_max("inside.high").alias("fastest")
    )


def with_tracks(objects: DataFrame, tracks: DataFrame) -> DataFrame:
    """``objects`` with what ``track_windows`` found for their instances; join what is left of them, not all.

    The tracks of an anchor, as many as it has instances, meet its objects by the anchor alone: objects that a window over the anchors has left in place are not shuffled again.
    """
    told = [k for k in tracks.columns if k not in ("anchor_id", "instance_id")]
    listed = tracks.where("instance_id is not null").groupBy("anchor_id").agg(F.collect_list(F.struct("instance_id", *told)).alias("__tracks"))
    both = objects.join(listed, "anchor_id", "left")
    own = both.select("*", F.explode_outer(F.filter("__tracks", lambda t: t["instance_id"] == F.col("instance_id"))).alias("__track"))
    return own.select(*objects.columns, *(F.col(f"__track.{k}").alias(k) for k in told)).na.fill(0, ["n_future", "n_evidence"])


def centred_velocity(sightings: DataFrame, x: str = "x", y: str = "y", max_gap_s: float = 1.5) -> DataFrame:
    """``sightings`` (scene_token, instance_id, timestamp_us and a place in the global frame) with their velocity ``vx``, ``vy`` in that frame.

    It is the difference of the places before and after; at an end of the track the sighting itself takes the place of the missing one. A single sighting, and neighbours
    further apart than ``max_gap_s`` (twice that if both are there) have the velocity 0: nothing is known of them.
    """
    w = Window.partitionBy("scene_token", "instance_id").orderBy("timestamp_us")
    place = F.struct("timestamp_us", F.col(x).alias("x"), F.col(y).alias("y"))
    before, after = F.lag(place).over(w), F.lead(place).over(w)
    both = before.isNotNull() & after.isNotNull()
    first, last = F.coalesce(before, place), F.coalesce(after, place)
    seconds = (last["timestamp_us"] - first["timestamp_us"]) / 1e6
    known = (seconds > 0) & (seconds <= F.when(both, 2 * max_gap_s).otherwise(max_gap_s))
    along = lambda k: F.when(known, (last[k] - first[k]) / seconds).otherwise(F.lit(0.0))
    return sightings.withColumns({"vx": along("x"), "vy": along("y")})


def risk_columns(objects: DataFrame) -> DataFrame:
    """One boolean column per risk factor, and ``fires`` of the corridor engine; needs the columns of ``with_geometry``, ``with_tracks`` and ``ego_speed``.

    A braking lead needs evidence from its track; an object that stands still now is an obstacle unless its track shows that it moves off.
    """
    grp, x, y = F.col("grp"), F.col("x_c"), F.col("y_c")
    crossing = c.crossing_hit(y, F.col("vy"))
    speed = c.norm("vx", "vy")
    moving = (grp == "vehicle") | F.col("category").isin(*TWO_WHEELERS)
    return objects.withColumn("clearance", clearance_samples()).withColumns(
        {
            "fires": F.col("clearance") < BASE_M,
            "vru_crossing": (grp == "vru") & crossing,
            "vehicle_crossing": (grp == "vehicle") & crossing,
            "lead_vehicle_braking": moving & c.in_path(x, y, Y_BRAKE) & (speed > SLOW) & F.coalesce(F.col("slowest") <= speed - SPEED_DROP, F.lit(False)),
            "stationary_obstacle": (speed <= SLOW) & F.coalesce(F.col("fastest") <= SLOW, F.lit(True)) & c.in_path(x, y, Y_STATIONARY),
            "object_near": F.col("distance") <= NEAR_M,
            "oncoming_traffic": moving & (F.col("state") == "oncoming") & (F.col("distance") < ONCOMING_M),
        }
    )


def pool_features(pool: DataFrame) -> DataFrame:
    """What threshold sweeps and rule rebuilds read of each pool object: place, lateral speed, least gaps with and without its extent, and its track's speeds.

    A least clearance counts a centre inside the band as 0; the speeds of a track without evidence are null.
    """
    return pool.select(
        "anchor_id", (F.col("rank") - 1).alias("pool_idx"), "ann_no", "category", "grp", "x_c", "y_c", F.col("vy").alias("v_lat"), c.norm("vx", "vy").alias("speed"), "distance", "state",
        gap_samples().alias("min_d_raw"), clearance_samples(0.0).alias("min_clearance"), (F.col("n_future") > 0).alias("has_track"), (F.col("n_evidence") > 0).alias("win_nonempty"), F.col("slowest").alias("min_win_speed"), F.col("fastest").alias("max_win_speed"),
    )


def pool_of(objects: DataFrame, cap: int = 8) -> DataFrame:
    """The nearest relevant objects of each anchor with their rank; labels are taken from these only."""
    return objects.where(relevant()).withColumn("rank", pool_rank()).where(F.col("rank") <= cap)


def anchor_labels(pool: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per anchor: pool size, yield, and how many pool objects carry each factor. An anchor without pool objects has none of them and does not yield."""
    told = pool.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n_pool"), F.bool_or("fires").alias("yield_required"), *(c.total(F.col(f)).alias(f) for f in FACTORS))
    return anchors.select("anchor_id").join(told, "anchor_id", "left").na.fill(0, ["n_pool", *FACTORS]).na.fill(False, ["yield_required"])


def expected_outputs(pool: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor_id, expected_output): the output text that a model should give at each anchor, an anchor without pool objects included.

    ``pool`` has rank, category, state, image box (``bx1`` to ``by2``), box geometry and the risk columns; ``anchors`` has ``speed_action``. An object's id is its place in the pool; its
    place is the point of its footprint nearest to the ego. Boxes and places have one decimal, by Python's rounding. The text is canonical and
    has passed the contract's own schema; one that does not stops the job.
    """
    px, py = c.nearest_point(F.col("x_c"), F.col("y_c"), F.col("box_length_m"), F.col("box_width_m"), F.col("box_yaw_deg"))
    tenth = lambda v: py_round(v, 1)
    number = (F.col("rank") - 1).cast("int")
    rows = pool.select(
        "anchor_id",
        F.struct(number.alias("id"), "category", F.array(*(tenth(F.col(k)) for k in ("bx1", "by1", "bx2", "by2"))).alias("bbox_2d"), F.col("state").alias("motion_state"), tenth(px).alias("bev_x"), tenth(py).alias("bev_y")).alias("object"),
        "fires",
        *(F.when(F.col(f), number).alias(f) for f in FACTORS),
    )
    # a pool has eight objects at most
    told = rows.groupBy("anchor_id").agg(F.array_sort(F.collect_list("object")).alias("critical_objects"), F.bool_or("fires").alias("yield_required"), *(F.array_sort(F.collect_list(f)).alias(f) for f in FACTORS))
    factors = F.filter(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).alias("objects")) for f in FACTORS)), lambda r: F.size(r["objects"]) > 0)
    none = lambda of: F.expr(f"cast(array() as {told.schema[of].dataType.simpleString()})")
    whole = anchors.select("anchor_id", "speed_action").join(told.withColumn("risk_factors", factors).drop(*FACTORS), "anchor_id", "left")
    risks = F.coalesce("risk_factors", F.expr("cast(array() as array<struct<factor: string, objects: array<int>>>)"))
    output = F.to_json(F.struct(F.coalesce("critical_objects", none("critical_objects")).alias("critical_objects"), risks.alias("risk_factors"), F.coalesce("yield_required", F.lit(False)).alias("yield_required"), "speed_action"))
    read = whole.select("anchor_id", output.alias("output")).withColumn("text", strict_text(size=None)("output"))
    text = F.coalesce("text", F.raise_error(F.concat(F.lit("not an output of the contract: "), F.col("output"))))
    return read.select("anchor_id", text.alias("expected_output"))
