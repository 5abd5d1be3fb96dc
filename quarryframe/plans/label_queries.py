"""Queries over annotated objects: geometry, gates, pool, risks, sweeps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryframe.functions import columns as c
from quarryframe.functions.python_rules import py_round
from quarryframe.operators import labels as lb
from quarryframe.operators import windows as w
from quarryframe.plans.fixtures import Fixtures, duck
from quarryframe.plans.registry import query

_GRP = """CASE WHEN category IN ('pedestrian', 'bicycle', 'motorcycle') THEN 'vru' WHEN category IN ('barrier', 'traffic_cone') THEN 'static' ELSE 'vehicle' END"""
_ANGLE = "CASE WHEN vx = 0 AND vy = 0 THEN 0 ELSE abs(degrees(atan2(vy, vx))) END"
_STATE = f"CASE WHEN sqrt(vx * vx + vy * vy) < 0.5 THEN 'stationary' WHEN {_ANGLE} BETWEEN 45 AND 135 THEN 'crossing' WHEN {_ANGLE} > 135 THEN 'oncoming' ELSE 'same_direction' END"
_RANGE = "CASE category WHEN 'pedestrian' THEN 30 WHEN 'barrier' THEN 15 WHEN 'traffic_cone' THEN 15 ELSE 45 END"
_GEO = f"""o AS (SELECT *, sqrt(x_c * x_c + y_c * y_c) AS distance, degrees(atan2(y_c, x_c)) AS azimuth, {_GRP} AS grp, {_STATE} AS state FROM fx_object)"""
_REL = f"(abs(azimuth) <= 30 AND distance < {_RANGE}) OR distance < 15"
_CLEAR = f"""{_GEO}, s AS (SELECT o.*, k, x_c + (vx - ego_speed) * k * 0.25 AS px, y_c + vy * k * 0.25 AS py FROM o, range(0, 13) r(k)),
q AS (SELECT *, px - greatest(-2.05, least(2.05, px)) AS ex, py - greatest(-1.185, least(1.185, py)) AS ey FROM s),
m AS (SELECT anchor_id, ann_no, min(CASE WHEN ex = 0 AND ey = 0 THEN -1e9 ELSE sqrt(ex * ex + ey * ey) - (abs(cos(radians(box_yaw_deg) - atan2(ey, ex))) * box_length_m / 2 + abs(sin(radians(box_yaw_deg) - atan2(ey, ex))) * box_width_m / 2) END) AS clearance, min(sqrt(ex * ex + ey * ey)) AS raw FROM q GROUP BY 1, 2),
t AS (SELECT o.*, clearance, raw, clearance < 2 AS fires, CASE WHEN abs(y_c) <= 1.185 THEN abs(vy) ELSE -sign(y_c) * vy END AS toward, sqrt(vx * vx + vy * vy) AS speed, grp = 'vehicle' OR category IN ('bicycle', 'motorcycle') AS moving FROM o JOIN m USING (anchor_id, ann_no)),
h AS (SELECT *, toward > 0.8 AND CASE WHEN abs(y_c) <= 1.185 THEN 0 WHEN toward = 0 THEN 1e18 ELSE (abs(y_c) - 1.185) / toward END <= 5 AS hit FROM t)"""
_RISK = f"""{_CLEAR}, sg AS (SELECT o.*, scene_token, walk_idx, timestamp_us FROM o JOIN fx_anchor USING (anchor_id)),
tr AS (SELECT p.anchor_id, p.ann_no, count(l.vx) AS n_future, min(round(sqrt(l.vx * l.vx + l.vy * l.vy), 3)) AS slowest, max(round(sqrt(l.vx * l.vx + l.vy * l.vy), 3)) AS fastest
  FROM sg p LEFT JOIN sg l ON l.scene_token = p.scene_token AND l.instance_id = p.instance_id AND l.walk_idx BETWEEN p.walk_idx + 1 AND p.walk_idx + 6 AND l.timestamp_us - p.timestamp_us <= 3000000 GROUP BY 1, 2),
u AS (SELECT h.*, slowest, fastest FROM h JOIN tr USING (anchor_id, ann_no)),
x AS (SELECT *, grp = 'vru' AND hit AS vru_crossing, grp = 'vehicle' AND hit AS vehicle_crossing, moving AND x_c > 0 AND abs(y_c) <= 1.185 AND speed > 0.5 AND coalesce(slowest <= speed - 0.5, false) AS lead_vehicle_braking,
  speed <= 0.5 AND coalesce(fastest, speed) <= 0.5 AND x_c > 0 AND abs(y_c) <= 3 AS stationary_obstacle, distance <= 5.5 AS object_near, moving AND state = 'oncoming' AND distance < 20 AS oncoming_traffic FROM u)"""
_POOL = f"{_RISK}, r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY round(distance, 3), ann_no) AS rank FROM x WHERE {_REL})"


def geo(fx: Fixtures) -> DataFrame:
    return lb.with_geometry(fx.view("fx_object"))


def tracks(fx: Fixtures) -> DataFrame:
    return lb.track_windows(fx.view("fx_object"), fx.view("fx_anchor"))


def risks(fx: Fixtures) -> DataFrame:
    return lb.risk_columns(lb.with_tracks(geo(fx), tracks(fx)))


def pool(fx: Fixtures) -> DataFrame:
    return lb.risk_columns(lb.with_tracks(lb.pool_of(geo(fx)), tracks(fx)))


def ranked(fx: Fixtures) -> DataFrame:
    return risks(fx).where(lb.relevant()).withColumn("rank", lb.pool_rank())


@query("p8_ego_transform", duck("SELECT anchor_id, ann_no, round((x_c - 3) * cos(a) + (y_c + 1) * sin(a), 6) + 0.0 AS x, round((y_c + 1) * cos(a) - (x_c - 3) * sin(a), 6) + 0.0 AS y FROM (SELECT *, radians(box_yaw_deg) AS a FROM fx_object)", "fx_object"))
def ego_transform(fx: Fixtures) -> DataFrame:
    x, y = c.to_ego(F.col("x_c"), F.col("y_c"), F.lit(3.0), F.lit(-1.0), F.radians("box_yaw_deg"))
    return fx.view("fx_object").select("anchor_id", "ann_no", (F.round(x, 6) + 0.0).alias("x"), (F.round(y, 6) + 0.0).alias("y"))


@query("p9_azimuth", duck("SELECT anchor_id, ann_no, round(degrees(atan2(y_c, x_c)), 6) + 0.0 AS azimuth FROM fx_object", "fx_object"))
def azimuth(fx: Fixtures) -> DataFrame:
    return geo(fx).select("anchor_id", "ann_no", (F.round("azimuth", 6) + 0.0).alias("azimuth"))


@query("p10_folded_angle", duck("SELECT anchor_id, ann_no, CASE WHEN box_yaw_deg - 90 > 180 THEN 360 - (box_yaw_deg - 90) ELSE abs(box_yaw_deg - 90) END AS angle FROM fx_object", "fx_object"))
def folded_angle(fx: Fixtures) -> DataFrame:
    return fx.view("fx_object").select("anchor_id", "ann_no", c.folded_angle_deg(F.col("box_yaw_deg") - 90).alias("angle"))


_CORNERS = """p AS (SELECT anchor_id, ann_no, i, x_c + box_length_m / 2 * (CASE WHEN i & 1 = 1 THEN 1 ELSE -1 END) AS d, 400 + 500 * (y_c + box_width_m / 2 * (CASE WHEN i & 2 = 2 THEN 1 ELSE -1 END)) / (x_c + box_length_m / 2 * (CASE WHEN i & 1 = 1 THEN 1 ELSE -1 END)) AS u,
  300 + 500 * (CASE WHEN i & 4 = 4 THEN 0.75 ELSE -0.75 END) / (x_c + box_length_m / 2 * (CASE WHEN i & 1 = 1 THEN 1 ELSE -1 END)) AS v FROM fx_object, range(0, 8) r(i))"""


def projected(fx: Fixtures) -> DataFrame:
    """8 box corners through a pinhole camera (500 px, 800 x 600) as arrays: depth, u, v."""

    def corner(i: F.Column) -> F.Column:
        sign = lambda bit: F.when(i.bitwiseAND(bit) == bit, 1.0).otherwise(-1.0)
        d = F.col("x_c") + F.col("box_length_m") / 2 * sign(1)
        return F.struct(d.alias("d"), (400 + F.try_divide(500 * (F.col("y_c") + F.col("box_width_m") / 2 * sign(2)), d)).alias("u"), (300 + F.try_divide(500 * (0.75 * sign(4)), d)).alias("v"))

    return fx.view("fx_object").withColumn("corners", F.transform(F.sequence(F.lit(0), F.lit(7)), corner))


@query("p11_corner_projection", duck(f"WITH {_CORNERS} SELECT anchor_id, ann_no, round(min(u), 7) + 0.0 AS u_min, round(max(v), 7) + 0.0 AS v_max FROM p GROUP BY 1, 2 HAVING min(d) > 0.1", "fx_object"))
def corner_projection(fx: Fixtures) -> DataFrame:
    return projected(fx).where(F.array_min("corners.d") > 0.1).select("anchor_id", "ann_no", (F.round(F.array_min("corners.u"), 7) + 0.0).alias("u_min"), (F.round(F.array_max("corners.v"), 7) + 0.0).alias("v_max"))


_BOX = f"""{_CORNERS}, b AS (SELECT anchor_id, ann_no, min(d) AS d, round(min(u), 6) AS x1, round(min(v), 6) AS y1, round(max(u), 6) AS x2, round(max(v), 6) AS y2 FROM p GROUP BY 1, 2)"""
_OBS = """CASE WHEN d <= 0.1 THEN 'behind' WHEN least(x2, 800) <= greatest(x1, 0) OR least(y2, 600) <= greatest(y1, 0) THEN 'no_overlap' WHEN x1 >= 0 AND y1 >= 0 AND x2 <= 800 AND y2 <= 600 THEN 'observable' ELSE 'inferable' END"""


@F.arrow_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in ("d", "x1", "y1", "x2", "y2")]))
def image_box(x: pa.Array, y: pa.Array, length: pa.Array, width: pa.Array) -> pa.Array:
    """The least depth and the ends of u and v over the corners of ``projected``, for whole batches; a corner at depth 0 has no place."""
    along, across = (np.logical_and(a.is_valid().to_numpy(zero_copy_only=False), b.is_valid().to_numpy(zero_copy_only=False)) for a, b in ((x, length), (y, width)))
    x, y, length, width = (v.to_numpy(zero_copy_only=False).astype(float) for v in (x, y, length, width))
    depth = np.stack([x + length / 2 * sign for sign in (1.0, -1.0)])
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.stack([400 + 500 * (y + width / 2 * sign) / d for d in depth for sign in (1.0, -1.0)])
        v = np.stack([300 + 500 * (0.75 * sign) / d for d in depth for sign in (1.0, -1.0)])
    place = np.repeat(along & (depth != 0), 2, axis=0)
    cells = [pa.array(np.fmin.reduce(depth), mask=~along)]
    for end, beyond in ((np.fmin.reduce, np.inf), (np.max, -np.inf)):
        for side, told in ((u, place & across), (v, place)):
            cells.append(pa.array(end(np.where(told, side, beyond), axis=0), mask=~told.any(axis=0)))
    return pa.StructArray.from_arrays(cells, ["d", "x1", "y1", "x2", "y2"])


def observed(fx: Fixtures) -> DataFrame:
    """Observability state of each object's image box, and the box clipped to the image."""
    b = fx.view("fx_object").withColumn("__box", image_box(*(F.col(k).cast("double") for k in ("x_c", "y_c", "box_length_m", "box_width_m"))))
    b = b.withColumns({"d": F.col("__box.d")} | {k: F.round(f"__box.{k}", 6) for k in ("x1", "y1", "x2", "y2")}).drop("__box")
    clipped = {"cx1": F.greatest("x1", F.lit(0.0)), "cy1": F.greatest("y1", F.lit(0.0)), "cx2": F.least("x2", F.lit(800.0)), "cy2": F.least("y2", F.lit(600.0))}
    inside = (F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x2") <= 800) & (F.col("y2") <= 600)
    state = F.when(F.col("d") <= 0.1, "behind").when((F.col("cx2") <= F.col("cx1")) | (F.col("cy2") <= F.col("cy1")), "no_overlap").when(inside, "observable").otherwise("inferable")
    return b.withColumns(clipped).withColumn("obs", state)


@query("f2_observability", duck(f"WITH {_BOX} SELECT {_OBS} AS obs, count(*) AS n FROM b GROUP BY 1", "fx_object"))
def observability(fx: Fixtures) -> DataFrame:
    return observed(fx).groupBy("obs").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p12_visibility_class",
    duck(f"WITH {_CORNERS} SELECT anchor_id, ann_no, CASE WHEN max(d) <= 0.1 THEN 'behind' WHEN bool_and(d > 0.1 AND u BETWEEN 0 AND 800 AND v BETWEEN 0 AND 600) THEN 'visible' WHEN bool_or(d > 0.1 AND u BETWEEN 0 AND 800 AND v BETWEEN 0 AND 600) THEN 'clipped' ELSE 'out' END AS cls FROM p GROUP BY 1, 2", "fx_object"),
)
def visibility_class(fx: Fixtures) -> DataFrame:
    seen = lambda k: (k["d"] > 0.1) & k["u"].between(0, 800) & k["v"].between(0, 600)
    cls = F.when(F.forall("corners", lambda k: k["d"] <= 0.1), "behind").when(F.forall("corners", seen), "visible").when(F.exists("corners", seen), "clipped").otherwise("out")
    return projected(fx).select("anchor_id", "ann_no", cls.alias("cls"))


@query(
    "p13_nearest_point",
    duck(
        """WITH k AS (SELECT *, cos(radians(box_yaw_deg)) AS a, sin(radians(box_yaw_deg)) AS b FROM fx_object), q AS (SELECT *, greatest(-box_length_m / 2, least(box_length_m / 2, -(x_c * a + y_c * b))) AS u,
greatest(-box_width_m / 2, least(box_width_m / 2, x_c * b - y_c * a)) AS v FROM k) SELECT anchor_id, ann_no, CAST(printf('%.1f', x_c + u * a - v * b) AS DOUBLE) + 0.0 AS px, CAST(printf('%.1f', y_c + u * b + v * a) AS DOUBLE) + 0.0 AS py FROM q""",
        "fx_object",
    ),
)
def nearest_point(fx: Fixtures) -> DataFrame:
    """The point of an object's footprint nearest to the ego, on the 0.1 m grid of the outputs."""
    px, py = c.nearest_point(F.col("x_c"), F.col("y_c"), F.col("box_length_m"), F.col("box_width_m"), F.col("box_yaw_deg"))
    return fx.view("fx_object").select("anchor_id", "ann_no", py_round(px, 1).alias("px"), py_round(py, 1).alias("py"))


@query("p14_rescale_box", duck("SELECT anchor_id, obj_idx, round((x1 / 448.0::DOUBLE) * 1600, 6) AS x1, round((y2 / 252.0::DOUBLE) * 900, 6) AS y2 FROM fx_box", "fx_box"))
def rescale_box(fx: Fixtures) -> DataFrame:
    """Source to original image space, division first."""
    return fx.view("fx_box").select("anchor_id", "obj_idx", F.round((F.col("x1") / c.number(448)) * 1600, 6).alias("x1"), F.round((F.col("y2") / c.number(252)) * 900, 6).alias("y2"))


@query(
    "p15_grid_position",
    duck(
        """SELECT pos, count(*) AS n FROM (SELECT concat_ws(' ', ['top', 'middle', 'bottom'][CAST(least(2, floor((y1 + y2) / 2.0::DOUBLE / 25)) AS INT) + 1], ['left', 'center', 'right'][CAST(least(2, floor((x1 + x2) / 2.0::DOUBLE / 30)) AS INT) + 1]) AS pos FROM fx_box) GROUP BY 1""",
        "fx_box",
    ),
)
def grid_position(fx: Fixtures) -> DataFrame:
    pos = c.grid_position((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, c.number(90), c.number(75))
    return fx.view("fx_box").groupBy(pos.alias("pos")).agg(F.count(F.lit(1)).alias("n"))


_RAW = sorted([*c.DETECTION_CLASS, *c.NO_DETECTION_CLASS])
_RAW_SQL = ", ".join(f"'{k}'" for k in _RAW)
_MAP_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in c.DETECTION_CLASS.items())


@query("f1_category_map", f"SELECT * FROM (SELECT p_partkey, CASE [{_RAW_SQL}][CAST(p_partkey % {len(_RAW)} AS INT) + 1] {_MAP_SQL} END AS category FROM part) WHERE category IS NOT NULL")
def category_map(fx: Fixtures) -> DataFrame:
    """Annotation classes to detection classes by a literal map; classes without one drop out."""
    raw = F.element_at(F.array(*map(F.lit, _RAW)), (F.col("p_partkey") % len(_RAW)).cast("int") + 1)
    return fx.table("part").select("p_partkey", c.literal_map(c.DETECTION_CLASS)[raw].alias("category")).where("category is not null")


@query("f3_relevance", duck(f"WITH {_GEO} SELECT anchor_id, ann_no FROM o WHERE {_REL}", "fx_object"))
def relevance(fx: Fixtures) -> DataFrame:
    return geo(fx).where(lb.relevant()).select("anchor_id", "ann_no")


@query("f4_in_path", duck("SELECT anchor_id, ann_no FROM fx_object WHERE x_c > 0 AND abs(y_c) <= 1.185", "fx_object"))
def in_path(fx: Fixtures) -> DataFrame:
    return fx.view("fx_object").where(c.in_path(F.col("x_c"), F.col("y_c"), 1.185)).select("anchor_id", "ann_no")


@query("f5_crossing", duck(f"WITH {_CLEAR} SELECT anchor_id, ann_no FROM h WHERE hit", "fx_object"))
def crossing(fx: Fixtures) -> DataFrame:
    return fx.view("fx_object").where(c.crossing_hit(F.col("y_c"), F.col("vy"))).select("anchor_id", "ann_no")


@query(
    "d4_centred_velocity",
    duck(
        """WITH s AS (SELECT anchor_id, instance_id, scene_token, timestamp_us, ego_x + arg_min(x_c, ann_no) AS x, ego_y + arg_min(y_c, ann_no) AS y FROM fx_object JOIN fx_anchor USING (anchor_id) GROUP BY 1, 2, 3, 4, ego_x, ego_y),
f AS (SELECT *, row_number() OVER (PARTITION BY scene_token, instance_id, timestamp_us ORDER BY anchor_id) AS k FROM s),
n AS (SELECT *, lag(timestamp_us) OVER q AS t0, lag(x) OVER q AS x0, lag(y) OVER q AS y0, lead(timestamp_us) OVER q AS t1, lead(x) OVER q AS x1, lead(y) OVER q AS y1 FROM f WHERE k = 1 WINDOW q AS (PARTITION BY scene_token, instance_id ORDER BY timestamp_us)),
d AS (SELECT *, (coalesce(t1, timestamp_us) - coalesce(t0, timestamp_us)) / 1e6 AS dt, CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN 3.0 ELSE 1.5 END AS bound FROM n)
SELECT anchor_id, instance_id, CASE WHEN dt > 0 AND dt <= bound THEN round((coalesce(x1, x) - coalesce(x0, x)) / dt, 6) + 0.0 ELSE 0 END AS vx, CASE WHEN dt > 0 AND dt <= bound THEN round((coalesce(y1, y) - coalesce(y0, y)) / dt, 6) + 0.0 ELSE 0 END AS vy FROM d""",
        "fx_object",
        "fx_anchor",
    ),
)
def centred_velocity(fx: Fixtures) -> DataFrame:
    """Global velocities of instances from their sightings, one for each instance and time."""
    frames = fx.view("fx_anchor").select("anchor_id", "scene_token", "timestamp_us", "ego_x", "ego_y")
    place = fx.view("fx_object").groupBy("anchor_id", "instance_id").agg(F.min_by("x_c", "ann_no").alias("x_c"), F.min_by("y_c", "ann_no").alias("y_c")).join(frames, "anchor_id")
    one = place.withColumn("k", F.row_number().over(Window.partitionBy("scene_token", "instance_id", "timestamp_us").orderBy("anchor_id"))).where("k = 1")
    seen = lb.centred_velocity(one.withColumns({"x": F.col("ego_x") + F.col("x_c"), "y": F.col("ego_y") + F.col("y_c")}))
    return seen.select("anchor_id", "instance_id", *((F.round(v, 6) + 0.0).alias(v) for v in ("vx", "vy")))


@query("d4_motion_state", duck(f"WITH {_GEO} SELECT state, grp, count(*) AS n FROM o GROUP BY 1, 2", "fx_object"))
def motion_state(fx: Fixtures) -> DataFrame:
    return geo(fx).groupBy("state", "grp").agg(F.count(F.lit(1)).alias("n"))


@query("d7_firing_engine", duck(f"WITH {_CLEAR} SELECT anchor_id, ann_no, fires, round(clearance, 6) AS clearance FROM t", "fx_object"))
def firing_engine(fx: Fixtures) -> DataFrame:
    """Object by object: neither tracks nor anchors are joined."""
    clear = fx.view("fx_object").withColumn("clearance", lb.clearance_samples())
    return clear.select("anchor_id", "ann_no", (F.col("clearance") < lb.BASE_M).alias("fires"), F.round("clearance", 6).alias("clearance"))


@query("d6_yield", duck(f"WITH {_POOL} SELECT a.anchor_id, coalesce(bool_or(fires), false) AS yield_required FROM fx_anchor a LEFT JOIN r ON r.anchor_id = a.anchor_id AND rank <= 8 GROUP BY 1", "fx_object", "fx_anchor"))
def yield_required(fx: Fixtures) -> DataFrame:
    """Over the pool: what lies beyond it does not make the ego yield, and neither does an empty pool."""
    near = lb.pool_of(geo(fx)).withColumn("fires", lb.clearance_samples() < lb.BASE_M)
    told = near.groupBy("anchor_id").agg(F.bool_or("fires").alias("yield_required"))
    return fx.view("fx_anchor").select("anchor_id").join(told, "anchor_id", "left").na.fill(False, ["yield_required"])


_CASES = ", ".join(f"CASE WHEN {f} THEN '{f}' END" for f in lb.FACTORS)


@query(
    "d8_risk_factors",
    duck(f"WITH {_POOL} SELECT anchor_id, factor, string_agg(ann_no, ',' ORDER BY rank) AS objects FROM (SELECT anchor_id, ann_no, rank, unnest([{_CASES}]) AS factor FROM r WHERE rank <= 8) WHERE factor IS NOT NULL GROUP BY 1, 2", "fx_object", "fx_anchor"),
)
def risk_factors(fx: Fixtures) -> DataFrame:
    """The factors of each anchor with all pool objects that give them, nearest first."""
    rows = pool(fx).select("anchor_id", "ann_no", "rank", F.explode(F.array_compact(F.array(*(F.when(F.col(f), f) for f in lb.FACTORS)))).alias("factor"))
    # a pool has eight objects at most
    objects = F.array_sort(F.collect_list(F.struct("rank", "ann_no")))["ann_no"]
    return rows.groupBy("anchor_id", "factor").agg(F.array_join(objects, ",").alias("objects"))


_SUMS = ", ".join(f"CAST(coalesce(sum(CAST({f} AS INT)), 0) AS BIGINT) AS {f}" for f in lb.FACTORS)


@query("d3_anchor_labels", duck(f"WITH {_POOL} SELECT a.anchor_id, count(r.rank) AS n_pool, coalesce(bool_or(fires), false) AS yield_required, {_SUMS} FROM fx_anchor a LEFT JOIN r ON r.anchor_id = a.anchor_id AND rank <= 8 GROUP BY 1", "fx_object", "fx_anchor"))
def anchor_labels(fx: Fixtures) -> DataFrame:
    """Pool size, yield and factors of every anchor, without the camera's view."""
    return lb.anchor_labels(pool(fx), fx.view("fx_anchor"))


def camera_pool(fx: Fixtures) -> DataFrame:
    """The pool of objects that the camera can see, with their boxes clipped to the image."""
    seen = observed(fx).where("obs in ('observable', 'inferable')").withColumnsRenamed({f"c{k}": f"b{k}" for k in ("x1", "y1", "x2", "y2")}).drop("d", "x1", "y1", "x2", "y2")
    return lb.risk_columns(lb.with_tracks(lb.pool_of(lb.with_geometry(seen)), tracks(fx)))


def with_actions(anchors: DataFrame) -> DataFrame:
    """Anchors with the action that the ego's own future shows: its speeds between the next poses within the evidence window."""
    frames = w.future_window(anchors.withColumn("sample_id", F.col("anchor_id")), lb.TRACK_FRAMES).withColumn("speeds", F.transform(w.future_speeds(int(lb.EVIDENCE_S * 1e6)), lambda v: F.round(v, 3)))
    return frames.withColumn("speed_action", c.speed_action(F.col("ego_speed"), F.col("speeds")))


def outputs(fx: Fixtures) -> DataFrame:
    return lb.expected_outputs(camera_pool(fx), with_actions(fx.view("fx_anchor")))


_TENTH = lambda v: f"printf('%.1f', CAST(printf('%.1f', {v}) AS DOUBLE) + 0.0)"
_SEEN = f"""{_RISK}, {_BOX}, v AS (SELECT *, greatest(x1, 0) AS bx1, greatest(y1, 0) AS by1, least(x2, 800) AS bx2, least(y2, 600) AS by2, {_OBS} AS obs FROM b),
n AS (SELECT anchor_id, ann_no, x_c + u * a - v * b AS px, y_c + u * b + v * a AS py FROM (SELECT *, greatest(-box_length_m / 2, least(box_length_m / 2, -(x_c * a + y_c * b))) AS u,
  greatest(-box_width_m / 2, least(box_width_m / 2, x_c * b - y_c * a)) AS v FROM (SELECT *, cos(radians(box_yaw_deg)) AS a, sin(radians(box_yaw_deg)) AS b FROM fx_object))),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY round(distance, 3), ann_no) AS rank FROM x JOIN v USING (anchor_id, ann_no) JOIN n USING (anchor_id, ann_no) WHERE obs IN ('observable', 'inferable') AND ({_REL})),
fr AS (SELECT *, row_number() OVER (PARTITION BY scene_token ORDER BY timestamp_us, anchor_id) AS i FROM fx_anchor),
ahead AS (SELECT f.anchor_id, f.ego_speed AS v0, list(struct_pack(t := g.timestamp_us, x := g.ego_x, y := g.ego_y) ORDER BY g.i) FILTER (g.i IS NOT NULL AND g.timestamp_us - f.timestamp_us <= 3000000) AS ps, any_value(struct_pack(t := f.timestamp_us, x := f.ego_x, y := f.ego_y)) AS p0
  FROM fr f LEFT JOIN fr g ON g.scene_token = f.scene_token AND g.i BETWEEN f.i + 1 AND f.i + 6 GROUP BY 1, 2),
-- a pose at the time of the pose before it is skipped: only the first of each time counts
poses AS (SELECT anchor_id, v0, list_prepend(p0, list_filter(coalesce(ps, []), lambda p, k: p.t > p0.t AND (k = 1 OR p.t > ps[k - 1].t))) AS q FROM ahead),
sp AS (SELECT anchor_id, v0, list_transform(range(2, len(q) + 1), lambda k: round(sqrt((q[k].x - q[k - 1].x) * (q[k].x - q[k - 1].x) + (q[k].y - q[k - 1].y) * (q[k].y - q[k - 1].y)) / ((q[k].t - q[k - 1].t) / 1e6), 3)) AS speeds FROM poses),
act AS (SELECT anchor_id, CASE WHEN len(speeds) = 0 THEN 'KEEP_SPEED' WHEN list_min(speeds) < 0.5 THEN 'STOP' WHEN list_min(speeds) < v0 * 0.85 THEN 'DECELERATE' WHEN list_max(speeds) > v0 * 1.15 THEN 'ACCELERATE' ELSE 'KEEP_SPEED' END AS speed_action FROM sp)"""
_THING = f"category || ':' || state || ':' || {_TENTH('bx1')} || ',' || {_TENTH('by1')} || ',' || {_TENTH('bx2')} || ',' || {_TENTH('by2')} || ':' || {_TENTH('px')} || ',' || {_TENTH('py')}"
_REFS = ", ".join(f"coalesce(string_agg(CASE WHEN {f} THEN rank - 1 END, ',' ORDER BY rank), '') AS {f}" for f in lb.FACTORS)


@query(
    "d3_expected_output",
    duck(
        f"""WITH {_SEEN} SELECT a.anchor_id, speed_action, coalesce(bool_or(fires), false) AS yield_required, coalesce(string_agg({_THING}, ';' ORDER BY rank), '') AS objects, {_REFS}
FROM fx_anchor a JOIN act USING (anchor_id) LEFT JOIN r ON r.anchor_id = a.anchor_id AND rank <= 8 GROUP BY 1, 2""",
        "fx_object",
        "fx_anchor",
    ),
)
def expected_output(fx: Fixtures) -> DataFrame:
    """The expected output text of every anchor, read back by its fields: objects in the order of their ids, and the ids of each factor."""
    kind = "struct<critical_objects: array<struct<id: int, category: string, bbox_2d: array<double>, motion_state: string, bev_x: double, bev_y: double>>, risk_factors: array<struct<factor: string, objects: array<int>>>, yield_required: boolean, speed_action: string>"
    read = outputs(fx).select("anchor_id", F.from_json("expected_output", kind).alias("o"))
    tenths = lambda *vs: F.concat_ws(",", *(F.format_string("%.1f", v) for v in vs))
    thing = lambda t: F.concat_ws(":", t["category"], t["motion_state"], tenths(*(t["bbox_2d"][i] for i in range(4))), tenths(t["bev_x"], t["bev_y"]))
    refs = lambda f: F.coalesce(F.array_join(F.get(F.filter("o.risk_factors", lambda r: r["factor"] == f), F.lit(0))["objects"], ","), F.lit(""))
    return read.select("anchor_id", "o.speed_action", "o.yield_required", F.array_join(F.transform("o.critical_objects", thing), ";").alias("objects"), *(refs(f).alias(f) for f in lb.FACTORS))


@query("o1_top8_pool", duck(f"WITH {_POOL} SELECT anchor_id, ann_no, rank FROM r WHERE rank <= 8", "fx_object", "fx_anchor"))
def top8_pool(fx: Fixtures) -> DataFrame:
    return geo(fx).where(lb.relevant()).withColumn("rank", lb.pool_rank()).where("rank <= 8").select("anchor_id", "ann_no", "rank")


@query("o2_beyond_cap", duck(f"WITH {_POOL} SELECT anchor_id, count(*) AS n_cut FROM r WHERE rank > 8 GROUP BY 1", "fx_object", "fx_anchor"))
def beyond_cap(fx: Fixtures) -> DataFrame:
    return geo(fx).where(lb.relevant()).withColumn("rank", lb.pool_rank()).where("rank > 8").groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n_cut"))


@query("d13_truncation_risk", duck(f"WITH {_POOL} SELECT count(*) FILTER (late AND NOT early) AS missed, count(*) AS n FROM (SELECT anchor_id, bool_or(fires AND rank > 8) AS late, bool_or(fires AND rank <= 8) AS early FROM r GROUP BY 1)", "fx_object", "fx_anchor"))
def truncation_risk(fx: Fixtures) -> DataFrame:
    """Anchors with a conflict beyond the cap while the pool itself is silent."""
    flags = ranked(fx).groupBy("anchor_id").agg(F.bool_or(F.col("fires") & (F.col("rank") > 8)).alias("late"), F.bool_or(F.col("fires") & (F.col("rank") <= 8)).alias("early"))
    return flags.agg(c.total(F.col("late") & ~F.col("early")).alias("missed"), F.count(F.lit(1)).alias("n"))


@query(
    "d10_feature_table",
    duck(f"WITH {_RISK} SELECT anchor_id, ann_no, category, grp, state, round(distance, 6) AS distance, round(clearance, 6) AS clearance, abs(y_c) AS abs_y, round(sqrt(vx * vx + vy * vy), 6) AS speed FROM x", "fx_object", "fx_anchor"),
)
def feature_table(fx: Fixtures) -> DataFrame:
    return geo(fx).select(
        "anchor_id", "ann_no", "category", "grp", "state", F.round("distance", 6).alias("distance"), F.round(lb.clearance_samples(), 6).alias("clearance"), F.abs("y_c").alias("abs_y"), F.round(c.norm("vx", "vy"), 6).alias("speed")
    )


@query("j14_parameter_grid", duck("SELECT k / 2.0::DOUBLE AS radius, count(*) AS n FROM fx_object, range(6, 15) r(k) WHERE round(sqrt(x_c * x_c + y_c * y_c), 6) <= k / 2.0::DOUBLE GROUP BY 1", "fx_object"))
def parameter_grid(fx: Fixtures) -> DataFrame:
    """A small literal grid: each object is counted in the least cell that holds it, and cells are then summed up."""
    distance = F.round(c.norm("x_c", "y_c"), 6)
    cell = F.greatest(F.lit(6), F.ceil(distance * 2)).cast("int")
    cells = fx.view("fx_object").where(distance <= 7).groupBy(cell.alias("k")).agg(F.count(F.lit(1)).alias("m"))
    grid = fx.spark.range(6, 15).withColumnRenamed("id", "g")
    return grid.join(F.broadcast(cells), F.col("k") <= F.col("g")).groupBy((F.col("g") / 2).alias("radius")).agg(F.sum("m").alias("n"))


@query("w9_extrapolation", duck("SELECT anchor_id, ann_no, round(max(sqrt((x_c + (vx - ego_speed) * k * 0.25) * (x_c + (vx - ego_speed) * k * 0.25) + (y_c + vy * k * 0.25) * (y_c + vy * k * 0.25))), 6) AS farthest FROM fx_object, range(0, 13) r(k) GROUP BY 1, 2", "fx_object"))
def extrapolation(fx: Fixtures) -> DataFrame:
    at = lambda k: c.norm(F.col("x_c") + lb.relative_vx() * k * 0.25, F.col("y_c") + F.col("vy") * k * 0.25)
    return fx.view("fx_object").select("anchor_id", "ann_no", F.round(F.array_max(F.transform(F.sequence(F.lit(0), F.lit(12)), at)), 6).alias("farthest"))


@query("a22_any_per_anchor", duck(f"WITH {_RISK} SELECT count(*) FILTER (a) AS near_anchors, count(*) FILTER (b) AS oncoming_anchors FROM (SELECT anchor_id, bool_or(object_near) AS a, bool_or(oncoming_traffic) AS b FROM x GROUP BY 1)", "fx_object", "fx_anchor"))
def any_per_anchor(fx: Fixtures) -> DataFrame:
    flags = risks(fx).groupBy("anchor_id").agg(F.bool_or("object_near").alias("a"), F.bool_or("oncoming_traffic").alias("b"))
    return flags.agg(c.total(F.col("a")).alias("near_anchors"), c.total(F.col("b")).alias("oncoming_anchors"))


@query("a23_family_minimum", duck(f"WITH {_GEO} SELECT anchor_id, round(coalesce(min(distance) FILTER (grp = 'vru'), 1e9), 6) AS vru, round(coalesce(min(distance) FILTER (grp = 'vehicle'), 1e9), 6) AS vehicle FROM o GROUP BY 1", "fx_object"))
def family_minimum(fx: Fixtures) -> DataFrame:
    least = lambda g: F.round(F.coalesce(F.min(F.when(F.col("grp") == g, F.col("distance"))), F.lit(1e9)), 6).alias(g)
    return geo(fx).groupBy("anchor_id").agg(least("vru"), least("vehicle"))


@query("a24_histogram", duck("SELECT CAST(least(9, floor((l_quantity - 0) / 5)) AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1"))
def histogram(fx: Fixtures) -> DataFrame:
    """Ten bins over [0, 50]; the last one holds its right edge."""
    q = F.col("l_quantity")
    return fx.table("lineitem").where(q.between(0, 50)).groupBy(F.least(F.lit(9), F.floor(q / 5)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("a25_cooccurrence", duck(f"WITH {_RISK}, f AS (SELECT anchor_id, bool_or(object_near) AS a, bool_or(fires) AS b FROM x GROUP BY 1) SELECT a, b, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY a), 6) AS rate FROM f GROUP BY 1, 2", "fx_object", "fx_anchor"))
def cooccurrence(fx: Fixtures) -> DataFrame:
    flags = risks(fx).groupBy("anchor_id").agg(F.bool_or("object_near").alias("a"), F.bool_or("fires").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return flags.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("a")), 6))


@query(
    "j5_future_track",
    duck(
        """SELECT o.anchor_id, o.ann_no, count(*) AS n_future FROM fx_object o JOIN fx_anchor a ON a.anchor_id = o.anchor_id JOIN fx_anchor b ON b.scene_token = a.scene_token AND b.walk_idx BETWEEN a.walk_idx + 1 AND a.walk_idx + 6
JOIN fx_object p ON p.anchor_id = b.anchor_id AND p.instance_id = o.instance_id GROUP BY 1, 2""",
        "fx_object",
        "fx_anchor",
    ),
)
def future_track(fx: Fixtures) -> DataFrame:
    """Sightings of an instance in the next six frames, by a range window over the scene's frames."""
    return lb.with_tracks(fx.view("fx_object"), tracks(fx)).where("n_future > 0").select("anchor_id", "ann_no", "n_future")


@query("j4_box_annotation", duck("SELECT b.anchor_id, b.obj_idx, o.instance_id FROM fx_box b JOIN fx_object o ON o.anchor_id = b.anchor_id AND o.ann_no = b.obj_idx + 1", "fx_box", "fx_object"))
def box_annotation(fx: Fixtures) -> DataFrame:
    objects = fx.view("fx_object").select("anchor_id", (F.col("ann_no") - 1).alias("obj_idx"), "instance_id")
    return fx.view("fx_box").select("anchor_id", "obj_idx").join(objects, ["anchor_id", "obj_idx"])


@query("j13_residual_membership", duck(f"WITH {_GEO} SELECT anchor_id FROM fx_anchor WHERE anchor_id IN (SELECT anchor_id FROM o WHERE distance < 3)", "fx_anchor", "fx_object"))
def residual_membership(fx: Fixtures) -> DataFrame:
    return fx.view("fx_anchor").join(geo(fx).where("distance < 3"), "anchor_id", "left_semi").select("anchor_id")


@query("t12_quaternion_yaw", duck("SELECT anchor_id, ann_no, round((degrees(atan2(2 * (w * z), 1 - 2 * (z * z))) + 360) % 360, 6) + 0.0 AS yaw FROM (SELECT *, cos(radians(box_yaw_deg) / 2) AS w, sin(radians(box_yaw_deg) / 2) AS z FROM fx_object)", "fx_object"))
def quaternion_yaw(fx: Fixtures) -> DataFrame:
    half = F.radians("box_yaw_deg") / 2
    yaw = c.quaternion_yaw(F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half))
    return fx.view("fx_object").select("anchor_id", "ann_no", (F.round((F.degrees(yaw) + 360) % 360, 6) + 0.0).alias("yaw"))


@query("p2_python_round", duck("SELECT anchor_id, ann_no, CAST(printf('%.3f', sqrt(x_c * x_c + y_c * y_c)) AS DOUBLE) + 0.0 AS distance FROM fx_object", "fx_object"))
def python_round(fx: Fixtures) -> DataFrame:
    """Record rounding by exact binary value: three decimals, ties to even."""
    return fx.view("fx_object").select("anchor_id", "ann_no", py_round(c.norm("x_c", "y_c"), 3).alias("distance"))
