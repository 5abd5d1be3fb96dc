"""Queries of the older rules, the threshold sweeps and the calibration grids; their SQL tests every threshold row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryframe.functions import columns as c
from quarryframe.operators import labels as lb
from quarryframe.operators import sweeps as sw
from quarryframe.plans.fixtures import Fixtures, duck
from quarryframe.plans.label_queries import _GEO, _POOL, _SEEN, camera_pool, geo, pool
from quarryframe.plans.registry import query
from quarryframe.sources import io

_OLD = f"""{_POOL}, p AS (SELECT r.*, coalesce(fastest, speed) AS top, raw < CASE WHEN category = 'pedestrian' THEN 2 ELSE 3 END AS old_fires, category NOT IN ('pedestrian', 'barrier', 'traffic_cone') AS old_vehicle,
  x_c > 0 AND abs(y_c) <= 1.185 AS in_lane, category IN ('barrier', 'traffic_cone') AS is_static FROM r WHERE rank <= 8),
old AS (SELECT anchor_id, bool_or(old_fires) AS corridor_conflict, bool_or(old_fires AND category = 'pedestrian') AS pedestrian_crossing, bool_or(old_fires AND old_vehicle) AS vehicle_merging,
  bool_or(old_vehicle AND in_lane AND slowest IS NOT NULL AND speed > 0.5 AND coalesce(slowest <= speed - 0.5, false)) AS lead_vehicle_braking, bool_or(in_lane AND speed <= 0.5 AND top <= 0.5) AS stationary_obstacle,
  count(*) FILTER (old_vehicle AND in_lane) >= 3 AND coalesce(arg_min(round(top, 9), (round(distance, 3), ann_no)) FILTER (old_vehicle AND in_lane), 99) <= 2 AS congestion,
  bool_or(old_vehicle AND state = 'oncoming' AND distance < 20) AS oncoming_traffic, bool_or(old_fires) AS old_yield,
  bool_or(old_fires) AND bool_and(is_static OR NOT old_fires) AND NOT bool_or(in_lane AND speed <= 0.5 AND top <= 0.5) AS static_only FROM p GROUP BY 1)"""


_OLD_ROW = ", ".join(f"coalesce({f}, false) AS {f}" for f in (*sw.OLD_FACTORS, "old_yield", "static_only"))


@query("d9_old_rules", duck(f"WITH {_OLD} SELECT a.anchor_id, {_OLD_ROW} FROM fx_anchor a LEFT JOIN old USING (anchor_id)", "fx_object", "fx_anchor"))
def old_rules(fx: Fixtures) -> DataFrame:
    """The seven factors and the yield of the older rules for every anchor; one without pool objects has none of them."""
    return stored_labels(fx, pool(fx))


def stored_labels(fx: Fixtures, objects: DataFrame) -> DataFrame:
    return fx.view("fx_anchor").select("anchor_id").join(sw.old_factors(objects), "anchor_id", "left").na.fill(False)


_FEATURES = f"""{_SEEN}, z AS (SELECT anchor_id, ann_no, min(CASE WHEN ex = 0 AND ey = 0 THEN 0 ELSE sqrt(ex * ex + ey * ey) - (abs(cos(radians(box_yaw_deg) - atan2(ey, ex))) * box_length_m / 2 + abs(sin(radians(box_yaw_deg) - atan2(ey, ex))) * box_width_m / 2) END) AS least FROM q GROUP BY 1, 2),
far AS (SELECT p.anchor_id, p.ann_no, count(l.vx) AS n FROM sg p LEFT JOIN sg l ON l.scene_token = p.scene_token AND l.instance_id = p.instance_id AND l.walk_idx BETWEEN p.walk_idx + 1 AND p.walk_idx + 6 GROUP BY 1, 2)
SELECT anchor_id, rank - 1 AS pool_idx, ann_no, category, grp, x_c, y_c, vy AS v_lat, round(speed, 6) AS speed, round(distance, 6) AS distance, state, round(raw, 6) AS min_d_raw, round(least, 6) AS min_clearance, far.n > 0 AS has_track, slowest IS NOT NULL AS win_nonempty, slowest AS min_win_speed, fastest AS max_win_speed
FROM r JOIN z USING (anchor_id, ann_no) JOIN far USING (anchor_id, ann_no) WHERE rank <= 8"""


@query("d10_pool_features", duck(f"WITH {_FEATURES}", "fx_object", "fx_anchor"))
def pool_features(fx: Fixtures) -> DataFrame:
    """The seventeen columns of each pool object that the camera sees."""
    return lb.pool_features(camera_pool(fx)).withColumns({k: F.round(k, 6) for k in ("speed", "distance", "min_d_raw", "min_clearance")})


_HISTOGRAM = lambda kind, rows, value, low, high, n: f"SELECT '{kind}' AS histogram, e.name, e.bin, count(v.b) AS n FROM (SELECT name, CAST(unnest(range({n})) AS INT) AS bin FROM (SELECT DISTINCT name FROM {rows})) e LEFT JOIN (SELECT name, CAST(least({n - 1}, floor(round(({value} - ({low}e0)) / {high - low}e0 * {n}, 9))) AS INT) AS b FROM {rows} WHERE {value} BETWEEN {low} AND {high}) v ON v.name = e.name AND v.b = e.bin GROUP BY 1, 2, 3"


@query(
    "d11_histograms",
    duck(
        f"""WITH {_POOL}, z AS (SELECT anchor_id, ann_no, min(CASE WHEN ex = 0 AND ey = 0 THEN 0 ELSE sqrt(ex * ex + ey * ey) - (abs(cos(radians(box_yaw_deg) - atan2(ey, ex))) * box_length_m / 2 + abs(sin(radians(box_yaw_deg) - atan2(ey, ex))) * box_width_m / 2) END) AS least FROM q GROUP BY 1, 2),
f AS (SELECT r.*, z.least AS clear FROM r JOIN z USING (anchor_id, ann_no) WHERE rank <= 8),
h1 AS (SELECT CASE WHEN grp = 'vru' THEN 'vru' ELSE 'vehicle_static' END AS name, clear FROM f UNION ALL SELECT 'static_only', clear FROM f WHERE grp = 'static'), h2 AS (SELECT grp AS name, toward FROM f WHERE clear < {max(sw.BASE_GRID)})
{_HISTOGRAM('clearance', 'h1', 'clear', -5, 15, 200)} UNION ALL {_HISTOGRAM('toward_speed', 'h2', 'toward', 0, 8, 80)}""",
        "fx_object",
        "fx_anchor",
    ),
)
def sweep_histograms(fx: Fixtures) -> DataFrame:
    """The distributions beside the sweeps, from the written feature table."""
    return sw.sweep_histograms(io.written(lb.pool_features(pool(fx)), "features"))


@query("d10_self_check", duck(f"WITH {_OLD} SELECT a.anchor_id, 'old_yield' AS \"column\", NOT coalesce(old_yield, false) AS stored, coalesce(old_yield, false) AS rebuilt FROM fx_anchor a LEFT JOIN old USING (anchor_id) WHERE a.anchor_id % 41 = 0", "fx_object", "fx_anchor"))
def self_check(fx: Fixtures) -> DataFrame:
    """Labels rebuilt from the written feature table against stored ones, of which every 41st anchor's yield was turned over."""
    # the pool is built once: features and stored labels are taken from it
    objects = io.written(pool(fx).select("anchor_id", "rank", "ann_no", "category", "grp", "x_c", "y_c", "vx", "vy", "ego_speed", "box_length_m", "box_width_m", "box_yaw_deg", "distance", "state", "n_future", "n_evidence", "slowest", "fastest"), "pool")
    features = io.written(lb.pool_features(objects), "features")
    turned = F.when(F.col("anchor_id") % 41 == 0, ~F.col("old_yield")).otherwise(F.col("old_yield"))
    return sw.rebuild_mismatches(features, stored_labels(fx, objects).withColumn("old_yield", turned))


@query("o7_nearest_lead", duck(f"WITH {_GEO} SELECT anchor_id, arg_min(ann_no, (round(distance, 3), ann_no)) AS lead FROM o WHERE category NOT IN ('pedestrian', 'barrier', 'traffic_cone') AND x_c > 0 AND abs(y_c) <= 1.185 GROUP BY 1", "fx_object"))
def nearest_lead(fx: Fixtures) -> DataFrame:
    leads = geo(fx).where(sw.old_vehicle() & (F.col("x_c") > 0) & (F.abs("y_c") <= sw.BAND_M))
    return leads.groupBy("anchor_id").agg(F.min_by("ann_no", F.struct(F.round("distance", 3), "ann_no")).alias("lead"))


def _values(grid: tuple[float, ...], name: str) -> str:
    return f"(SELECT unnest([{', '.join(f'{g}e0' for g in grid)}]) AS {name})"


_BASE, _SPEED, _RADIUS, _BRAKE, _STILL = (_values(g, n) for g, n in ((sw.BASE_GRID, "b"), (sw.SPEED_GRID, "t"), (sw.RADIUS_GRID, "rd"), (sw.BRAKE_GRID, "yb"), (sw.STILL_GRID, "ys")))
_B0 = " UNION ALL ".join(f"SELECT 'b0_{f}' AS sweep, NULL::DOUBLE AS x, NULL::DOUBLE AS y, count(*) FILTER ({f}) AS hits, count(*) FILTER ({f}) / (SELECT n FROM total) AS rate FROM old" for f in (*sw.OLD_FACTORS, "old_yield", "static_only"))
_N = "(SELECT n FROM total)"
_SWEEPS = f"""WITH {_OLD}, total AS (SELECT count(*) AS n FROM fx_anchor),
f AS (SELECT *, x_c > 0 AND speed <= 0.5 AND top <= 0.5 AS still, moving AND x_c > 0 AND speed > 0.5 AND coalesce(slowest <= speed - 0.5, false) AS brakes, round(distance, 6) AS d6 FROM p),
g1 AS (SELECT b, b2, anchor_id, bool_or(grp = 'vru' AND clearance < b) AS vru, bool_or(grp <> 'vru' AND clearance < b2) AS vehicle FROM f, {_BASE}, (SELECT b AS b2 FROM {_BASE}) GROUP BY 1, 2, 3),
g2 AS (SELECT b, t, anchor_id, bool_or(grp = 'vru' AND clearance < b AND toward > t) AS vru, bool_or(grp = 'vehicle' AND clearance < b AND toward > t) AS vehicle,
  count(*) FILTER (clearance < b AND toward > t) AS gated, count(*) FILTER (clearance < b AND toward > t AND state = 'crossing') AS agree FROM f, {_BASE}, {_SPEED} GROUP BY 1, 2, 3),
g3 AS (SELECT rd, ys, anchor_id, bool_or(d6 <= rd) AS near, bool_or(still AND abs(y_c) <= ys) AS still FROM f, {_RADIUS}, {_STILL} GROUP BY 1, 2, 3),
g4 AS (SELECT yb, anchor_id, count(*) FILTER (brakes AND abs(y_c) <= yb) AS objects, count(*) FILTER (brakes AND abs(y_c) <= yb AND y_c > 0) AS l, count(*) FILTER (brakes AND abs(y_c) <= yb AND y_c < 0) AS rt FROM f, {_BRAKE} GROUP BY 1, 2),
g5 AS (SELECT ys, anchor_id, bool_or(still AND abs(y_c) <= ys) AS still, bool_or(is_static AND raw < 3 AND abs(y_c) <= ys) AS residual FROM f, {_STILL} GROUP BY 1, 2)
SELECT 'anchors' AS sweep, NULL::DOUBLE AS x, NULL::DOUBLE AS y, n AS hits, 1.0::DOUBLE AS rate FROM total UNION ALL {_B0}
UNION ALL SELECT 'b1_vru', b, b2, count(*) FILTER (vru), count(*) FILTER (vru) / {_N} FROM g1 GROUP BY b, b2
UNION ALL SELECT 'b1_vehicle', b, b2, count(*) FILTER (vehicle), count(*) FILTER (vehicle) / {_N} FROM g1 GROUP BY b, b2
UNION ALL SELECT 'b1_any', b, b2, count(*) FILTER (vru OR vehicle), count(*) FILTER (vru OR vehicle) / {_N} FROM g1 GROUP BY b, b2
UNION ALL SELECT 'b2_vru', b, t, count(*) FILTER (vru), count(*) FILTER (vru) / {_N} FROM g2 GROUP BY b, t
UNION ALL SELECT 'b2_vehicle', b, t, count(*) FILTER (vehicle), count(*) FILTER (vehicle) / {_N} FROM g2 GROUP BY b, t
UNION ALL SELECT 'b2_gated', b, t, sum(gated)::BIGINT, NULL FROM g2 GROUP BY b, t
UNION ALL SELECT 'b2_agree', b, t, sum(agree)::BIGINT, CASE WHEN sum(gated) = 0 THEN 0 ELSE sum(agree) / sum(gated) END FROM g2 GROUP BY b, t
UNION ALL SELECT 'b3_near', rd, NULL, count(*) FILTER (near), count(*) FILTER (near) / {_N} FROM g3 WHERE ys = 1.185 GROUP BY rd
UNION ALL SELECT 'b3_both', rd, ys, count(*) FILTER (near AND still), count(*) FILTER (near AND still) / {_N} FROM g3 GROUP BY rd, ys
UNION ALL SELECT 'b3_given_near', rd, ys, count(*) FILTER (near AND still), CASE WHEN count(*) FILTER (near) = 0 THEN 0 ELSE count(*) FILTER (near AND still) / count(*) FILTER (near) END FROM g3 GROUP BY rd, ys
UNION ALL SELECT 'b4_brake', yb, NULL, count(*) FILTER (objects > 0), count(*) FILTER (objects > 0) / {_N} FROM g4 GROUP BY yb
UNION ALL SELECT 'b4_objects', yb, NULL, sum(objects)::BIGINT, NULL FROM g4 GROUP BY yb
UNION ALL SELECT 'b4_left', yb, NULL, sum(l)::BIGINT, CASE WHEN sum(objects) = 0 THEN 0 ELSE sum(l) / sum(objects) END FROM g4 GROUP BY yb
UNION ALL SELECT 'b4_right', yb, NULL, sum(rt)::BIGINT, CASE WHEN sum(objects) = 0 THEN 0 ELSE sum(rt) / sum(objects) END FROM g4 GROUP BY yb
UNION ALL SELECT 'b5_stationary', ys, NULL, count(*) FILTER (still), count(*) FILTER (still) / {_N} FROM g5 GROUP BY ys
UNION ALL SELECT 'b5_over_old', ys, NULL, count(*) FILTER (still) - (SELECT count(*) FILTER (stationary_obstacle) FROM old), (count(*) FILTER (still) - (SELECT count(*) FILTER (stationary_obstacle) FROM old)) / {_N} FROM g5 GROUP BY ys
UNION ALL SELECT 'b5_residual', ys, NULL, count(*) FILTER (residual AND static_only), CASE WHEN count(*) FILTER (static_only) = 0 THEN 0 ELSE count(*) FILTER (residual AND static_only) / count(*) FILTER (static_only) END FROM g5 JOIN old USING (anchor_id) GROUP BY ys"""


@query("d11_threshold_sweep", duck(f"SELECT sweep, x, y, hits, round(rate, 9) AS rate FROM ({duck(_SWEEPS, 'fx_object', 'fx_anchor')})"))
def threshold_sweep(fx: Fixtures) -> DataFrame:
    return sw.sweeps(pool(fx), fx.view("fx_anchor")).withColumn("rate", F.round("rate", 9))


@query(
    "w7_newly_absorbed",
    duck(
        f"""WITH {_OLD}, f AS (SELECT *, [{', '.join(f'{y}e0' for y in sw.BRAKE_GRID)}] AS grid FROM p WHERE moving AND x_c > 0 AND speed > 0.5 AND coalesce(slowest <= speed - 0.5, false)),
firsts AS (SELECT list_min(list_filter(grid, lambda y: abs(y_c) <= y)) AS half_width, y_c, category FROM f)
SELECT half_width, category, count(*) AS n_new, count(*) FILTER (y_c > 0) AS n_left, count(*) FILTER (y_c < 0) AS n_right FROM firsts WHERE half_width IS NOT NULL GROUP BY 1, 2""",
        "fx_object",
        "fx_anchor",
    ),
)
def newly_absorbed(fx: Fixtures) -> DataFrame:
    """Braking leads by the first half-width that takes them in, with their class and side."""
    speed, y = c.norm("vx", "vy"), F.col("y_c")
    moving = (F.col("grp") == "vehicle") | F.col("category").isin(*lb.TWO_WHEELERS)
    leads = pool(fx).where(moving & (F.col("x_c") > 0) & (speed > lb.SLOW) & (F.col("slowest") <= speed - lb.SPEED_DROP))
    first = F.element_at(F.array(*map(F.lit, sw.BRAKE_GRID)), sw.step_of(F.abs(y), sw.BRAKE_GRID, strict=False) + 1)
    rows = leads.where(F.abs(y) <= sw.BRAKE_GRID[-1]).groupBy(first.alias("half_width"), "category")
    return rows.agg(F.count(F.lit(1)).alias("n_new"), F.count_if(y > 0).alias("n_left"), F.count_if(y < 0).alias("n_right"))


_RANGE_OF = "CASE category WHEN 'pedestrian' THEN 30 WHEN 'barrier' THEN 15 WHEN 'traffic_cone' THEN 15 ELSE 45 END"
_FOLDED = "CASE WHEN vx = 0 AND vy = 0 THEN 0 ELSE abs(degrees(atan2(vy, vx))) END"
_GRIDS = f"""WITH {_POOL}, p AS (SELECT * FROM r WHERE rank <= 8),
c1 AS (SELECT a, b, s, anchor_id, count(*) FILTER ((abs(azimuth) <= a AND distance / ({_RANGE_OF}) < s) OR distance < b) AS n FROM o, {_values(sw.CONES, 'a')}, {_values(sw.DISCS, 'b')}, {_values(sw.SCALES, 's')} GROUP BY 1, 2, 3, 4),
c2 AS (SELECT a, b, s AS c, coalesce(n, 0) AS n FROM fx_anchor CROSS JOIN {_values(sw.CONES, 'a')} CROSS JOIN {_values(sw.DISCS, 'b')} CROSS JOIN {_values(sw.SCALES, 's')} LEFT JOIN c1 USING (a, b, s, anchor_id)),
w1 AS (SELECT anchor_id, ann_no, category, k, greatest(abs(x_c + (vx - ego_speed) * k * 0.25) - 2.05, 0) AS ex, greatest(abs(y_c + vy * k * 0.25) - 1.185, 0) AS ey FROM o, range(0, 25) r(k)),
w2 AS (SELECT anchor_id, ann_no, category = 'pedestrian' AS ped, a, min(sqrt(ex * ex + ey * ey)) AS d FROM w1, {_values(sw.REACHES_S, 'a')} WHERE k * 0.25 <= a GROUP BY 1, 2, 3, 4),
w3 AS (SELECT a, b, c, anchor_id, bool_or(ped AND d < c) AS p, bool_or(NOT ped AND d < b) AS v FROM w2, {_values(sw.VEHICLE_GAPS, 'b')}, {_values(sw.PEDESTRIAN_GAPS, 'c')} GROUP BY 1, 2, 3, 4),
m1 AS (SELECT a, b, CASE WHEN sqrt(vx * vx + vy * vy) < b THEN 'stationary' WHEN {_FOLDED} BETWEEN a AND 180 - a THEN 'crossing' WHEN {_FOLDED} > 180 - a THEN 'oncoming' ELSE 'same_direction' END AS name FROM p, {_values(sw.ANGLES, 'a')}, {_values(sw.STILL_SPEEDS, 'b')}),
v1 AS (SELECT l_orderkey AS anchor_id, list((l_quantity - 1) / 5 ORDER BY l_linenumber, l_quantity) AS v FROM lineitem GROUP BY 1),
v2 AS (SELECT a, b, (o_orderkey % 20) / 2.0::DOUBLE AS v0, coalesce(v, [])[1:CAST(a * 2 AS INT)] AS v FROM orders LEFT JOIN v1 ON v1.anchor_id = o_orderkey, {_values(sw.WINDOWS_S, 'a')}, {_values(sw.DELTAS, 'b')}),
v3 AS (SELECT a, b, CASE WHEN len(v) = 0 THEN 'KEEP_SPEED' WHEN list_min(v) < 0.5 THEN 'STOP' WHEN list_min(v) < v0 * (1 - b) THEN 'DECELERATE' WHEN list_max(v) > v0 * (1 + b) THEN 'ACCELERATE' ELSE 'KEEP_SPEED' END AS name FROM v2)
SELECT 'pool' AS grid, a, b, c, 'frames' AS name, count(*) AS n FROM c2 GROUP BY 2, 3, 4 UNION ALL SELECT 'pool', a, b, c, 'truncated', count(*) FILTER (n > 8) FROM c2 GROUP BY 2, 3, 4 UNION ALL SELECT 'pool', a, b, c, 'kept', sum(least(n, 8))::BIGINT FROM c2 GROUP BY 2, 3, 4
UNION ALL SELECT 'corridor', a, b, c, 'corridor_conflict', count(*) FILTER (p OR v) FROM w3 GROUP BY 2, 3, 4 UNION ALL SELECT 'corridor', a, b, c, 'pedestrian_crossing', count(*) FILTER (p) FROM w3 GROUP BY 2, 3, 4 UNION ALL SELECT 'corridor', a, b, c, 'vehicle_merging', count(*) FILTER (v) FROM w3 GROUP BY 2, 3, 4
UNION ALL SELECT 'motion', a, b, NULL, name, count(*) FROM m1 GROUP BY a, b, name UNION ALL SELECT 'action', a, b, NULL, name, count(*) FROM v3 GROUP BY a, b, name"""


@query("d12_four_grids", duck(_GRIDS, "fx_object", "fx_anchor"))
def four_grids(fx: Fixtures) -> DataFrame:
    """Counts at all points of the pool (80), corridor (64), motion (9) and action (9) grids."""
    objects, anchors = fx.view("fx_object"), fx.view("fx_anchor")
    ahead = fx.table("lineitem").groupBy(F.col("l_orderkey").alias("anchor_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", ((F.col("l_quantity") - 1) / 5).alias("q")))).alias("s"))
    speeds = fx.table("orders").select(F.col("o_orderkey").alias("anchor_id"), ((F.col("o_orderkey") % 20) / 2).alias("v0")).join(ahead, "anchor_id", "left")
    speeds = speeds.select("v0", F.coalesce("s.q", F.expr("cast(array() as array<double>)")).alias("v"))
    grids = [sw.pool_grid(objects, anchors), sw.corridor_grid(objects), sw.motion_grid(pool(fx)), sw.action_grid(speeds)]
    return grids[0].unionByName(grids[1]).unionByName(grids[2]).unionByName(grids[3])
