"""Column expressions: geometry, rounding rules, vocabularies, metrics. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category groups, cone ranges in metres, label vocabularies.
GROUPS = {
    "vru": ("pedestrian", "bicycle", "motorcycle"),
    "vehicle": ("car", "truck", "construction_vehicle", "bus", "trailer"),
    "static": ("barrier", "traffic_cone"),
}
GROUP_RANGE = {"vehicle": 45.0, "vru": 30.0, "static": 15.0}
CLASS_RANGE = {"bicycle": 45.0, "motorcycle": 45.0}
# Annotation class to detection class; classes that are not named here have none.
DETECTION_CLASS = {
    "human.pedestrian.adult": "pedestrian",
    "human.pedestrian.child": "pedestrian",
    "human.pedestrian.construction_worker": "pedestrian",
    "human.pedestrian.police_officer": "pedestrian",
    "movable_object.barrier": "barrier",
    "movable_object.trafficcone": "traffic_cone",
    "vehicle.bicycle": "bicycle",
    "vehicle.bus.bendy": "bus",
    "vehicle.bus.rigid": "bus",
    "vehicle.car": "car",
    "vehicle.construction": "construction_vehicle",
    "vehicle.motorcycle": "motorcycle",
    "vehicle.trailer": "trailer",
    "vehicle.truck": "truck",
}
NO_DETECTION_CLASS = (
    "human.pedestrian.wheelchair",
    "human.pedestrian.stroller",
    "human.pedestrian.personal_mobility",
    "movable_object.pushable_pullable",
    "movable_object.debris",
    "static_object.bicycle_rack",
    "vehicle.emergency.ambulance",
    "vehicle.emergency.police",
)
# Stop words of keyword statistics.
STOP_WORDS = "a an and are as at be by for from has have in into is it its of on or that the their there this to with with-area without".split()
ACTIONS = ("ACCELERATE", "DECELERATE", "KEEP_SPEED", "STOP")
MOTIONS = ("crossing", "oncoming", "same_direction", "stationary")


def norm(x: Column | str, y: Column | str) -> Column:
    """Length of a vector as SQL writes it; ``hypot`` may differ in the last bit, and then on a threshold."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    return F.sqrt(x * x + y * y)


def number(x: float) -> Column:
    return F.lit(float(x))


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(v) for kv in values.items() for v in kv))


def group_of(category: Column) -> Column:
    return literal_map({c: g for g, cs in GROUPS.items() for c in cs})[category]


def cone_range(category: Column) -> Column:
    return literal_map({c: CLASS_RANGE.get(c, GROUP_RANGE[g]) for g, cs in GROUPS.items() for c in cs})[category]


# -- geometry ---------------------------------------------------------------------------------------------------


def to_ego(x: Column, y: Column, ego_x: Column, ego_y: Column, yaw: Column) -> tuple[Column, Column]:
    """A point in the frame of an ego pose: translate, then rotate by -yaw (radians)."""
    dx, dy, c, s = x - ego_x, y - ego_y, F.cos(yaw), F.sin(yaw)
    return dx * c + dy * s, dy * c - dx * s


def azimuth_deg(forward: Column, side: Column) -> Column:
    return F.degrees(F.atan2(side, forward))


def folded_angle_deg(angle: Column) -> Column:
    """An angle difference in degrees folded to [0, 180]."""
    return F.abs(F.pmod(angle + 180.0, F.lit(360.0)) - 180.0)


def quaternion_yaw(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def nearest_point(x: Column, y: Column, length: Column, width: Column, yaw_deg: Column) -> tuple[Column, Column]:
    """Point of a rotated rectangle nearest to the origin."""
    c, s = F.cos(F.radians(yaw_deg)), F.sin(F.radians(yaw_deg))
    along, across = -(x * c + y * s), x * s - y * c
    u = F.greatest(-length / 2, F.least(length / 2, along))
    v = F.greatest(-width / 2, F.least(width / 2, across))
    return x + u * c - v * s + 0.0, y + u * s + v * c + 0.0


def rectangle_gap(x: Column, y: Column, half_length: float, half_width: float) -> Column:
    """Distance from a point to an axis-parallel rectangle around the origin; 0 inside."""
    return norm(F.greatest(F.abs(x) - half_length, F.lit(0.0)), F.greatest(F.abs(y) - half_width, F.lit(0.0)))


def support_half_extent(length: Column, width: Column, relative_rad: Column) -> Column:
    """Half extent of a rectangle in a direction at ``relative_rad`` to its long side."""
    return F.abs(F.cos(relative_rad)) * length / 2 + F.abs(F.sin(relative_rad)) * width / 2


def iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def grid_position(cx: Column, cy: Column, width: Column, height: Column) -> Column:
    """Coarse place of a point in a 3 x 3 grid."""
    col = F.least(F.lit(2), F.floor(cx / (width / 3)).cast("int"))
    row = F.least(F.lit(2), F.floor(cy / (height / 3)).cast("int"))
    return F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ("top", "middle", "bottom"))), row + 1), F.element_at(F.array(*map(F.lit, ("left", "center", "right"))), col + 1))


# -- labels ----------------------------------------------------------------------------------------------------


def motion_state(vx: Column, vy: Column, still: float = 0.5, theta: float = 45.0) -> Column:
    """stationary below ``still`` m/s, else by the heading folded to [0, 180]: crossing, oncoming or same_direction."""
    angle = F.when((vx == 0) & (vy == 0), F.lit(0.0)).otherwise(folded_angle_deg(azimuth_deg(vx, vy)))
    return (
        F.when(norm(vx, vy) < still, "stationary")
        .when((angle >= theta) & (angle <= 180 - theta), "crossing")
        .when(angle > 180 - theta, "oncoming")
        .otherwise("same_direction")
    )


def speed_action(v0: Column, speeds: Column, delta: float = 0.15, stop: float = 0.5) -> Column:
    """STOP over DECELERATE over ACCELERATE over KEEP_SPEED from the speeds ahead; none keep the speed."""
    low, high = F.array_min(speeds), F.array_max(speeds)
    return (
        F.when(F.size(speeds) == 0, "KEEP_SPEED")
        .when(low < stop, "STOP")
        .when(low < v0 * (1 - delta), "DECELERATE")
        .when(high > v0 * (1 + delta), "ACCELERATE")
        .otherwise("KEEP_SPEED")
    )


def toward_speed(y: Column, vy: Column, band: float) -> Column:
    """Lateral speed toward the lane; inside its band any lateral speed counts."""
    return F.when(F.abs(y) <= band, F.abs(vy)).otherwise(-F.signum(y) * vy)


def crossing_hit(y: Column, vy: Column, threshold: float = 0.8, band: float = 1.185, arrive: float = 5.0) -> Column:
    """Moves toward the lane fast enough and reaches its band in time; inside the band any lateral speed counts."""
    toward = toward_speed(y, vy, band)
    when = F.when(F.abs(y) <= band, F.lit(0.0)).otherwise((F.abs(y) - band) / toward)
    return (toward > threshold) & (when <= arrive)


def in_path(x: Column, y: Column, half_width: float) -> Column:
    return (x > 0) & (F.abs(y) <= half_width)


# -- text ------------------------------------------------------------------------------------------------------


def normal_term(x: Column) -> Column:
    """Lower case, with runs of white space as one underscore."""
    return F.replace(F.lower(F.trim(F.regexp_replace(x, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))), F.lit(" "), F.lit("_"))


def singular_term(x: Column) -> Column:
    strip = lambda w: F.when((F.length(w) > 2) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.array_join(F.transform(F.split(x, "_"), strip), "_")


def keywords(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"[a-z][a-z'-]*"), F.lit(0))


def fenced_body(x: Column) -> Column:
    """What a text that is one fence holds; null for any other text.

    Its first line opens a fence, plain or of json, and its last line closes it.
    """
    bare = lambda v: F.regexp_replace(v, r"^\s+|\s+$", "")
    lines = F.split(bare(x), "\n")
    fence = (F.size(lines) > 2) & bare(F.get(lines, F.lit(0))).isin("```", "```json") & (bare(F.element_at(lines, -1)) == "```")
    return F.when(fence, F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n"))


# -- metrics ---------------------------------------------------------------------------------------------------


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp == 0, F.lit(0.0)).otherwise(2 * tp / (2 * tp + fp + fn))


def total(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0)).cast("long")


def hash_draw(seed: str, replicate: Column, index: Column, n: Column) -> Column:
    """A reproducible draw in [0, n) from md5; the same in any SQL engine."""
    text = F.concat_ws(":", F.lit(seed), replicate.cast("string"), index.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n
