"""Threshold sweeps and calibration grids by critical steps.

A row meets all thresholds from its first step on, so each row is one cell of the grid and not a row for each threshold. Cells are
counted in one pass, with partial sums before the shuffle, and the few hundred cells that are left are summed up for every grid point.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryframe.functions import columns as c
from quarryframe.operators import labels as lb

# The grids of the sweeps, in metres and metres per second.
BASE_GRID = tuple(round(1.7 + 0.1 * i, 1) for i in range(9))
SPEED_GRID = tuple(round(0.3 + 0.1 * i, 1) for i in range(13))
RADIUS_GRID = tuple(round(3.0 + 0.5 * i, 1) for i in range(9))
BRAKE_GRID = (1.185, *(round(1.3 + 0.1 * i, 1) for i in range(10)))
STILL_GRID = (1.185, *(round(1.3 + 0.1 * i, 1) for i in range(18)))
# The four grids of the first calibration.
CONES, DISCS, SCALES = (20.0, 25.0, 30.0, 35.0, 40.0), (8.0, 10.0, 12.0, 15.0), (0.5, 0.75, 1.0, 1.5)
REACHES_S, VEHICLE_GAPS, PEDESTRIAN_GAPS = (2.0, 3.0, 4.0, 6.0), (1.0, 1.5, 2.0, 3.0), (0.75, 1.0, 1.5, 2.0)
ANGLES, STILL_SPEEDS = (30.0, 45.0, 60.0), (0.3, 0.5, 0.8)
WINDOWS_S, DELTAS = (2.0, 3.0, 4.0), (0.1, 0.15, 0.2)
# The older rules, with one gap for pedestrians and one for all others.
OLD_FACTORS = ("corridor_conflict", "pedestrian_crossing", "vehicle_merging", "lead_vehicle_braking", "stationary_obstacle", "congestion", "oncoming_traffic")
BAND_M, GAP_PEDESTRIAN_M, GAP_M, QUEUE, QUEUE_SPEED = 1.185, 2.0, 3.0, 3, 2.0
POOL_CAP = 8


def step_of(value: Column, grid: Sequence[float], strict: bool = True) -> Column:
    """Place of the first grid value above ``value`` (or, not strict, at least it); the size of the grid if there is none or for null."""
    outside = ((value >= g) if strict else (value > g) for g in grid)
    return reduce(add, (F.coalesce(o, F.lit(True)).cast("int") for o in outside))


def cell(name: str, i: Column | int, j: Column | int = 0, weight: Column | int = 1) -> Column:
    as_int = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    return F.struct(F.lit(name).alias("sweep"), as_int(i).alias("i"), as_int(j).alias("j"), as_int(weight).alias("w"))


def count_cells(rows: DataFrame, cells: Column) -> DataFrame:
    """(sweep, i, j, w): the summed weights of all cells; as many rows as the grids have cells, whatever the input."""
    flat = rows.select(F.explode(cells).alias("c")).select("c.*").where("w <> 0")
    return flat.groupBy("sweep", "i", "j").agg(F.sum("w").alias("w"))


def cumulated(cells: DataFrame, grid: list[tuple]) -> DataFrame:
    """For each grid point (sweep, gi, gj, x, y, of, oi, oj) the weight of all its sweep's cells with i <= gi and j <= gj.

    Gives (sweep, x, y, hits, total), where total is the weight of the point (of, oi, oj), or null without one. Both sides are bounded by
    the grids; a point and its denominator are summed up in the same join.
    """
    wanted = [(k, True, *p[:3]) for k, p in enumerate(grid)] + [(k, False, *p[5:]) for k, p in enumerate(grid) if p[5] is not None]
    spark = cells.sparkSession
    points = spark.createDataFrame(pa.table({n: list(v) for n, v in zip(("k", "own", "sweep", "gi", "gj"), zip(*wanted))}))
    names = spark.createDataFrame(pa.table({"k": range(len(grid)), "name": [p[0] for p in grid], **{n: pa.array([p[i] for p in grid], pa.float64()) for i, n in ((3, "x"), (4, "y"))}}))
    inside = (F.col("p.sweep") == F.col("c.sweep")) & (F.col("i") <= F.col("gi")) & (F.col("j") <= F.col("gj"))
    sums = points.alias("p").join(F.broadcast(cells.alias("c")), inside, "left").groupBy("k").agg(
        F.coalesce(F.sum(F.when(F.col("own"), F.col("w"))), F.lit(0)).alias("hits"), F.when(F.bool_or(~F.col("own")), F.coalesce(F.sum(F.when(~F.col("own"), F.col("w"))), F.lit(0))).alias("total")
    )
    return sums.join(F.broadcast(names), "k").select(F.col("name").alias("sweep"), "x", "y", "hits", "total")


# -- the older rules --------------------------------------------------------------------------------------------


def old_vehicle() -> Column:
    return ~F.col("category").isin("pedestrian", *c.GROUPS["static"])


def old_rule_columns(pool: DataFrame) -> DataFrame:
    """``raw_gap`` (to the centre, without extent), ``old_fires``, ``is_lead``, ``is_static`` and ``top_speed`` of each pool object."""
    return _old_columns(pool.withColumn("raw_gap", lb.gap_samples()).withColumn("speed", c.norm("vx", "vy")))


def _old_columns(out: DataFrame) -> DataFrame:
    gap = F.when(F.col("category") == "pedestrian", F.lit(GAP_PEDESTRIAN_M)).otherwise(F.lit(GAP_M))
    return out.withColumns(
        {
            "old_fires": F.col("raw_gap") < gap,
            "in_lane": c.in_path(F.col("x_c"), F.col("y_c"), BAND_M),
            "old_vehicle": old_vehicle(),
            "is_static": F.col("category").isin(*c.GROUPS["static"]),
            "top_speed": F.round(F.coalesce("fastest", "speed"), 9),
        }
    ).withColumn("is_lead", F.col("old_vehicle") & F.col("in_lane"))


def old_rule_aggregates() -> dict[str, Column]:
    """Aggregates of an anchor's pool: the seven factors of the older rules, ``old_yield`` and ``static_only``.

    A queue is slow if its nearest lead stays slow. ``static_only`` marks anchors whose firing objects are all static, without a stationary
    obstacle.
    """
    yes = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    fires, lead, speed = F.col("old_fires"), F.col("is_lead"), F.col("speed")
    braking = lead & (F.col("n_future") > 0) & (speed > lb.SLOW) & F.coalesce(F.col("slowest") <= speed - lb.SPEED_DROP, F.lit(False))
    still = F.col("in_lane") & (speed <= lb.SLOW) & (F.col("top_speed") <= lb.SLOW)
    nearest = F.min_by(F.when(lead, F.col("top_speed")), F.when(lead, F.struct(F.round("distance", 3), "ann_no")))
    return {
        "corridor_conflict": yes(fires),
        "pedestrian_crossing": yes(fires & (F.col("category") == "pedestrian")),
        "vehicle_merging": yes(fires & F.col("old_vehicle")),
        "lead_vehicle_braking": yes(braking),
        "stationary_obstacle": yes(still),
        "congestion": F.coalesce((c.total(lead) >= QUEUE) & (nearest <= QUEUE_SPEED), F.lit(False)),
        "oncoming_traffic": yes(F.col("old_vehicle") & (F.col("state") == "oncoming") & (F.col("distance") < lb.ONCOMING_M)),
        "old_yield": yes(fires),
        "static_only": yes(fires) & ~yes(fires & ~F.col("is_static")) & ~yes(still),
    }


def old_factors(pool: DataFrame) -> DataFrame:
    """Per anchor the older factors and yield, from its pool."""
    return old_rule_columns(pool).groupBy("anchor_id").agg(*(v.alias(k) for k, v in old_rule_aggregates().items()))


def histograms(rows: DataFrame, group: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(group, bin, n): values of each group in equal bins over [low, high], with zeros; the last bin holds its right edge, and values outside count in none.

    Places in the bins are rounded to nine digits, so that a value on an edge falls to its right whatever its last bits are.
    """
    place = F.floor(F.round((F.col(value) - low) / (high - low) * bins, 9))
    inside = rows.where(F.col(value).between(low, high)).select(group, F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
    counts = inside.groupBy(group, "bin").agg(F.count(F.lit(1)).alias("n"))
    every = rows.select(group).distinct().crossJoin(F.broadcast(rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))))
    return every.join(counts, [group, "bin"], "left").na.fill(0, ["n"])


def sweep_histograms(features: DataFrame) -> DataFrame:
    """(histogram, name, bin, n): least clearances from -5 to 15 m of three families, and speeds toward the lane from 0 to 8 m/s of the objects that fire at the widest base, in tenths."""
    vru, static = F.col("category").isin(*c.GROUPS["vru"]), F.col("category").isin(*c.GROUPS["static"])
    toward = c.toward_speed(F.col("y_c"), F.col("v_lat"), BAND_M)
    families = F.array_compact(F.array(F.when(vru, "vru").otherwise("vehicle_static"), F.when(static, "static_only")))
    clear = histograms(features.select(F.explode(families).alias("name"), "min_clearance"), "name", "min_clearance", -5.0, 15.0, 200)
    fired = features.where(F.col("min_clearance") < max(BASE_GRID)).select(F.when(vru, "vru").when(static, "static").otherwise("vehicle").alias("name"), toward.alias("toward"))
    speeds = histograms(fired, "name", "toward", 0.0, 8.0, 80)
    return clear.withColumn("histogram", F.lit("clearance")).unionByName(speeds.withColumn("histogram", F.lit("toward_speed")))


def rebuilt_factors(features: DataFrame) -> DataFrame:
    """The older factors and yield from a table of ``pool_features`` alone."""
    names = {"raw_gap": "min_d_raw", "slowest": "min_win_speed", "fastest": "max_win_speed"}
    rows = features.withColumns({k: F.col(v) for k, v in names.items()}).withColumn("n_future", F.col("has_track").cast("long"))
    return _old_columns(rows).groupBy("anchor_id").agg(*(v.alias(k) for k, v in old_rule_aggregates().items()))


def rebuild_mismatches(features: DataFrame, stored: DataFrame) -> DataFrame:
    """(anchor_id, column, stored, rebuilt) where a stored label is not what the features give; an anchor without features has no factor."""
    names = [*OLD_FACTORS, "old_yield"]
    rebuilt = rebuilt_factors(features).select("anchor_id", *(F.col(k).alias(f"r_{k}") for k in names))
    both = stored.select("anchor_id", *names).join(rebuilt, "anchor_id", "left").na.fill(False)
    cells = F.array(*(F.struct(F.lit(k).alias("column"), F.col(k).alias("stored"), F.col(f"r_{k}").alias("rebuilt")) for k in names))
    return both.select("anchor_id", F.inline(cells)).where("stored <> rebuilt")


# -- sweeps -----------------------------------------------------------------------------------------------------


def _sweep_grid() -> list[tuple]:
    alone = ("anchors", 0, 0)
    out = [("anchors", 0, 0, None, None, *alone)]
    out += [(f"b0_{f}", 0, 0, None, None, *alone) for f in (*OLD_FACTORS, "old_yield", "static_only")]
    for i, a in enumerate(BASE_GRID):
        out += [(f"b1_{f}", i, j, a, b, *alone) for f in ("vru", "vehicle", "any") for j, b in enumerate(BASE_GRID)]
        for t, v in enumerate(SPEED_GRID):
            j = len(SPEED_GRID) - 1 - t
            out += [(f"b2_{f}", i, j, a, v, *alone) for f in ("vru", "vehicle")]
            out += [("b2_gated", i, j, a, v, None, None, None), ("b2_agree", i, j, a, v, "b2_gated", i, j)]
    for i, r in enumerate(RADIUS_GRID):
        out.append(("b3_near", i, 0, r, None, *alone))
        for j, y in enumerate(STILL_GRID):
            out += [("b3_both", i, j, r, y, *alone), ("b3_given_near", i, j, r, y, "b3_near", i, 0)]
    for i, y in enumerate(BRAKE_GRID):
        out += [("b4_brake", i, 0, y, None, *alone), ("b4_objects", i, 0, y, None, None, None, None)]
        out += [(f"b4_{s}", i, 0, y, None, "b4_objects", i, 0) for s in ("left", "right")]
    for i, y in enumerate(STILL_GRID):
        out += [("b5_stationary", i, 0, y, None, *alone), ("b5_over_old", i, 0, y, None, *alone), ("b5_residual", i, 0, y, None, "b0_static_only", 0, 0)]
    return out


def sweep_features(pool: DataFrame) -> DataFrame:
    """One row per anchor: its critical steps under every sweep, and the steps of its pool objects (at most ``POOL_CAP``)."""
    y, toward = F.abs("y_c"), c.toward_speed(F.col("y_c"), F.col("vy"), BAND_M)
    rows = old_rule_columns(pool).withColumns(
        {
            "base": step_of(F.col("clearance"), BASE_GRID),
            # how many speeds of the grid the object exceeds
            "gate": reduce(add, ((toward > t).cast("int") for t in SPEED_GRID)),
            "near": step_of(F.round("distance", 6), RADIUS_GRID, strict=False),
            "lane": step_of(y, STILL_GRID, strict=False),
            "still": (F.col("x_c") > 0) & (F.col("speed") <= lb.SLOW) & (F.col("top_speed") <= lb.SLOW),
            "brakes": ((F.col("grp") == "vehicle") | F.col("category").isin(*lb.TWO_WHEELERS))
            & (F.col("x_c") > 0)
            & (F.col("speed") > lb.SLOW)
            & F.coalesce(F.col("slowest") <= F.col("speed") - lb.SPEED_DROP, F.lit(False)),
        }
    )
    rows = rows.withColumn("brake", F.when(F.col("brakes"), step_of(y, BRAKE_GRID, strict=False)).otherwise(len(BRAKE_GRID)))
    vru, vehicle = F.col("grp") == "vru", F.col("grp") == "vehicle"
    least = lambda cond, col, grid: F.coalesce(F.min(F.when(cond, F.col(col))), F.lit(len(grid)))
    gates = lambda cond, b: F.coalesce(F.max(F.when(cond & (F.col("base") <= b), F.col("gate"))), F.lit(0))
    return rows.groupBy("anchor_id").agg(
        *(v.alias(k) for k, v in old_rule_aggregates().items()),
        least(vru, "base", BASE_GRID).alias("vru"),
        least(~vru, "base", BASE_GRID).alias("vehicle"),
        F.array(*(gates(vru, b) for b in range(len(BASE_GRID)))).alias("vru_gates"),
        F.array(*(gates(vehicle, b) for b in range(len(BASE_GRID)))).alias("vehicle_gates"),
        F.min("near").alias("near"),
        least(F.col("still"), "lane", STILL_GRID).alias("still"),
        F.min("brake").alias("brake"),
        least(F.col("is_static") & (F.col("raw_gap") < GAP_M), "lane", STILL_GRID).alias("residual"),
        F.collect_list(F.struct("base", "gate", "brake", (F.col("state") == "crossing").cast("int").alias("crosses"), F.signum("y_c").cast("int").alias("side"))).alias("objects"),
    )


def sweeps(pool: DataFrame, anchors: DataFrame) -> DataFrame:
    """(sweep, x, y, hits, rate) of all sweeps over the pool objects, in one pass.

    b0: anchors with each older factor. b1: anchors that fire, by the bases of the two groups. b2: anchors whose object fires and moves toward
    the lane, by base and speed, and the crossing share of such objects. b3: near objects by radius, and with a stationary obstacle by
    half-width. b4: braking leads by half-width, with the side of the objects. b5: stationary obstacles by half-width, also less the older
    rule's, and the share of anchors with only static firing that it takes in. A null half, group or track never counts.
    """
    top = len(SPEED_GRID)

    def stairs(name: str, gates: str) -> Column:
        # an anchor's region of (base, speed) is a staircase: each rise is one cell more and one less
        rise = lambda g, b: F.when(b > 0, F.element_at(gates, b)).otherwise(0)
        return F.flatten(
            F.transform(
                gates,
                lambda g, b: F.when(g == rise(g, b), F.array(cell(name, b, 0, 0))).otherwise(F.array(cell(name, b, top - g), cell(name, b, top - rise(g, b), -1))),
            )
        )

    own = [cell(f"b0_{f}", 0, 0, F.col(f)) for f in (*OLD_FACTORS, "old_yield", "static_only")]
    own += [cell("b1_vru", F.col("vru")), cell("b1_vehicle", 0, F.col("vehicle"))]
    own += [cell("b1_any", F.col("vru")), cell("b1_any", 0, F.col("vehicle")), cell("b1_any", F.col("vru"), F.col("vehicle"), -1)]
    own += [cell("b3_near", F.col("near"))] + [cell(f"b3_{k}", F.col("near"), F.col("still")) for k in ("both", "given_near")]
    own += [cell("b4_brake", F.col("brake")), cell("b5_stationary", F.col("still"))]
    own += [cell("b5_over_old", F.col("still")), cell("b5_over_old", 0, 0, -F.col("stationary_obstacle").cast("int"))]
    own += [cell("b5_residual", F.col("residual"), 0, F.col("static_only"))]
    of_objects = F.flatten(
        F.transform(
            "objects",
            lambda o: F.array(
                cell("b2_gated", o["base"], top - o["gate"]),
                cell("b2_agree", o["base"], top - o["gate"], o["crosses"]),
                cell("b4_objects", o["brake"]),
                cell("b4_left", o["brake"], 0, (o["side"] > 0)),
                cell("b4_right", o["brake"], 0, (o["side"] < 0)),
            ),
        )
    )
    cells = count_cells(sweep_features(pool), F.concat(F.array(*own), stairs("b2_vru", "vru_gates"), stairs("b2_vehicle", "vehicle_gates"), of_objects))
    total = anchors.agg(F.count(F.lit(1)).alias("w")).select(F.lit("anchors").alias("sweep"), F.lit(0).alias("i"), F.lit(0).alias("j"), "w")
    hits = cumulated(cells.unionByName(total), _sweep_grid())
    return hits.select("sweep", "x", "y", "hits", c.ratio(F.col("hits"), F.col("total")).alias("rate"))


# -- the four grids ---------------------------------------------------------------------------------------------


def pool_grid(objects: DataFrame, anchors: DataFrame) -> DataFrame:
    """Pool geometry: for each cone, disc and scale of the ranges the anchors, those with more objects than the cap, and the objects kept."""
    distance = F.col("distance")
    rows = lb.with_geometry(objects).withColumns(
        {"in_cone": step_of(F.abs("azimuth"), CONES, strict=False), "in_disc": step_of(distance, DISCS), "in_range": step_of(distance / c.cone_range(F.col("category")), SCALES)}
    )
    points = [(a, b, s) for a in range(len(CONES)) for b in range(len(DISCS)) for s in range(len(SCALES))]
    inside = lambda a, b, s: (F.col("in_disc") <= b) | ((F.col("in_cone") <= a) & (F.col("in_range") <= s))
    sizes = rows.groupBy("anchor_id").agg(*(c.total(inside(*p)).alias(f"n{k}") for k, p in enumerate(points)))
    sizes = anchors.select("anchor_id").join(sizes, "anchor_id", "left")
    n = lambda k: F.coalesce(F.col(f"n{k}"), F.lit(0))
    point = lambda p, k: F.struct(F.lit(CONES[p[0]]).alias("a"), F.lit(DISCS[p[1]]).alias("b"), F.lit(SCALES[p[2]]).alias("c"), n(k).alias("size"))
    flat = sizes.select(F.inline(F.array(*(point(p, k) for k, p in enumerate(points)))))
    counts = flat.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("frames"), c.total(F.col("size") > POOL_CAP).alias("truncated"), F.sum(F.least("size", F.lit(POOL_CAP))).alias("kept"))
    return _long(counts, "pool", ("frames", "truncated", "kept"))


def corridor_grid(objects: DataFrame) -> DataFrame:
    """Anchors in conflict within each reach, by the gaps for pedestrians and for all others, over all objects."""
    steps = [round(t / lb.STEP_S) for t in REACHES_S]
    rows = objects.withColumns({f"g{k}": lb.gap_samples(s) for k, s in enumerate(steps)})
    ped = F.col("category") == "pedestrian"
    minima = rows.groupBy("anchor_id").agg(
        *(F.min(F.when(ped, F.col(f"g{k}"))).alias(f"p{k}") for k in range(len(steps))), *(F.min(F.when(~ped, F.col(f"g{k}"))).alias(f"v{k}") for k in range(len(steps)))
    )
    cells = []
    for k in range(len(steps)):
        i, j = step_of(F.col(f"v{k}"), VEHICLE_GAPS), step_of(F.col(f"p{k}"), PEDESTRIAN_GAPS)
        cells += [cell(f"vehicle_merging {k}", i), cell(f"pedestrian_crossing {k}", 0, j)]
        cells += [cell(f"corridor_conflict {k}", i), cell(f"corridor_conflict {k}", 0, j), cell(f"corridor_conflict {k}", i, j, -1)]
    grid = [
        (f"{name} {k}", i, j, v, p, None, None, None)
        for name in ("corridor_conflict", "pedestrian_crossing", "vehicle_merging")
        for k in range(len(steps))
        for i, v in enumerate(VEHICLE_GAPS)
        for j, p in enumerate(PEDESTRIAN_GAPS)
    ]
    hits = cumulated(count_cells(minima, F.array(*cells)), grid)
    name = F.split("sweep", " ")
    reach = F.element_at(F.array(*map(F.lit, REACHES_S)), name[1].cast("int") + 1)
    return hits.select(F.lit("corridor").alias("grid"), reach.alias("a"), F.col("x").alias("b"), F.col("y").alias("c"), name[0].alias("name"), F.col("hits").alias("n"))


def motion_grid(pool: DataFrame) -> DataFrame:
    """Motion states of the pool objects for each half angle and standstill speed."""
    states = F.array(
        *(F.struct(F.lit("motion").alias("grid"), F.lit(t).alias("a"), F.lit(s).alias("b"), F.lit(None).cast("double").alias("c"), c.motion_state(F.col("vx"), F.col("vy"), s, t).alias("name")) for t in ANGLES for s in STILL_SPEEDS)
    )
    return pool.select(F.inline(states)).groupBy("grid", "a", "b", "c", "name").agg(F.count(F.lit(1)).alias("n"))


def action_grid(speeds: DataFrame, per_second: int = 2) -> DataFrame:
    """Actions for each window and relative change; ``speeds`` has v0 and the speeds ahead in order, ``per_second`` of them a second."""
    ahead = lambda w: F.slice("v", 1, int(w * per_second))
    rows = F.array(
        *(F.struct(F.lit("action").alias("grid"), F.lit(w).alias("a"), F.lit(d).alias("b"), F.lit(None).cast("double").alias("c"), c.speed_action(F.col("v0"), ahead(w), d).alias("name")) for w in WINDOWS_S for d in DELTAS)
    )
    return speeds.select(F.inline(rows)).groupBy("grid", "a", "b", "c", "name").agg(F.count(F.lit(1)).alias("n"))


def _long(counts: DataFrame, grid: str, names: tuple[str, ...]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).cast("long").alias("n")) for k in names))
    return counts.select(F.lit(grid).alias("grid"), "a", "b", "c", F.inline(rows))
