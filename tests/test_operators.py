"""Single operators on small rows with known answers."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from quarryframe.functions import columns as c
from quarryframe.functions.python_rules import py_round
from quarryframe.operators import labels, matching, metrics, statistics, validation, windows
from quarryframe.plans import label_queries
from quarryframe.sources import io


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_geometry(spark):
    x, y = c.nearest_point(*(F.lit(v) for v in (20.0, 0.0, 4.5, 2.0, 0.0)))
    r = one(spark, F.round(x, 6), F.round(y, 6), F.round(c.azimuth_deg(F.lit(1.0), F.lit(1.0)), 6), c.folded_angle_deg(F.lit(-190.0)), F.round(c.quaternion_yaw(F.lit(math.cos(0.5)), F.lit(0.0), F.lit(0.0), F.lit(math.sin(0.5))), 6))
    assert tuple(r) == (17.75, 0.0, 45.0, 170.0, 1.0)


def test_clearance_on_the_bound_does_not_fire(spark):
    row = spark.sql("SELECT 1L anchor_id, 1 ann_no, 'car' category, 6.3D x_c, 0.0D y_c, 0.0D vx, 0.0D vy, 0.0D ego_speed, 4.5D box_length_m, 2.0D box_width_m, 0.0D box_yaw_deg, cast(null as double) slowest, cast(null as double) fastest")
    got = labels.risk_columns(labels.with_geometry(row)).select(F.round(labels.clearance_samples(), 9), "fires").first()
    assert got[0] == 2.0
    assert labels.risk_columns(labels.with_geometry(row.withColumn("x_c", F.lit(6.2)))).first()["fires"]


@pytest.mark.parametrize(
    "changes,want",
    [
        ({"x_c": 15.0, "vx": 5.0, "slowest": 4.5}, {"lead_vehicle_braking"}),
        ({"x_c": 15.0, "vx": 5.0, "slowest": 4.6}, set()),
        ({"x_c": 15.0, "vx": 5.0}, set()),
        ({"x_c": 15.0, "vx": 5.0, "slowest": 0.1, "category": "bicycle"}, {"lead_vehicle_braking"}),
        ({"x_c": 15.0, "vx": 5.0, "slowest": 0.1, "category": "pedestrian"}, set()),
        ({"x_c": 20.0}, {"stationary_obstacle"}),
        ({"x_c": 20.0, "fastest": 0.5}, {"stationary_obstacle"}),
        ({"x_c": 20.0, "fastest": 0.6}, set()),
        ({"x_c": 19.5, "vx": -3.0, "y_c": 4.0, "category": "motorcycle"}, {"oncoming_traffic"}),
        ({"x_c": 20.0, "vx": -3.0, "y_c": 4.0, "category": "motorcycle"}, set()),
        ({"x_c": 0.0, "y_c": 5.5, "vx": 3.0}, {"object_near"}),
    ],
)
def test_risk_factors(spark, changes, want):
    plain = {"anchor_id": 1, "ann_no": 1, "category": "car", "x_c": 0.0, "y_c": 0.0, "vx": 0.0, "vy": 0.0, "ego_speed": 0.0, "box_length_m": 4.0, "box_width_m": 1.8, "box_yaw_deg": 0.0, "slowest": None, "fastest": None}
    schema = "anchor_id long, ann_no int, category string, " + ", ".join(f"{k} double" for k in list(plain)[3:])
    got = labels.risk_columns(labels.with_geometry(spark.createDataFrame([tuple((plain | changes).values())], schema))).first()
    assert {f for f in labels.FACTORS if got[f]} == want


def test_the_band_is_half_the_ego_and_the_margin(spark):
    """1.1 m to the side is inside the band; the extent counts from the band's nearest point."""
    row = "SELECT 1L anchor_id, 1 ann_no, 'car' category, 0.0D x_c, %sD y_c, 0.0D vx, 0.0D vy, 0.0D ego_speed, 4.5D box_length_m, 2.0D box_width_m, 0.0D box_yaw_deg"
    gap = lambda y: spark.sql(row % y).select(F.round(labels.clearance_samples(), 9)).first()[0]
    assert gap("1.1") == -1e9 and gap("4.185") == 2.0


def test_reasons_in_order(spark):
    """A step back in time comes before a missing image, and a missing image after a gap."""
    day = 86_400_000_000
    times = {"a": [0, 1, 2, 3], "b": [0, 2, 2, 3], "c": [0, 1, 2, 3 + 2 * day], "d": [0, 1, 2, 3], "e": [0, 1, 2, 3]}
    frames = [(s, i, t, s != "d" or i != 1, False if s in "abc" else True, True, 0.0, 0.0, 0.0 if s != "e" else float("nan")) for s, ts in times.items() for i, t in enumerate(ts)]
    rows = spark.createDataFrame(frames, "scene_token string, sample_id long, timestamp_us long, has_camera boolean, has_image boolean, has_calibration boolean, ego_x double, ego_y double, ego_yaw double")
    got = windows.history_window(rows).withColumn("r", windows.quarantine_reason(max_gap_us=day)).where("size(window) = 4").collect()
    assert {r.scene_token: r.r for r in got} == {"a": "MISSING_IMAGE", "b": "NON_INCREASING_TIME", "c": "BAD_GAP", "d": "NO_CAM_FRONT", "e": "NUMERIC_ANOMALY"}


@pytest.mark.parametrize("v,want", [((0.1, 0.1), "stationary"), ((0.0, 2.0), "crossing"), ((-3.0, 0.1), "oncoming"), ((3.0, 0.1), "same_direction"), ((0.0, 0.0), "stationary")])
def test_motion_state(spark, v, want):
    assert one(spark, c.motion_state(F.lit(v[0]), F.lit(v[1])))[0] == want


@pytest.mark.parametrize("v0,ahead,want", [(5.0, [0.2, 3.0], "STOP"), (5.0, [4.0], "DECELERATE"), (5.0, [6.0], "ACCELERATE"), (5.0, [5.1], "KEEP_SPEED"), (5.0, [], "KEEP_SPEED"), (0.2, [0.1], "STOP"), (5.0, [0.5], "DECELERATE")])
def test_speed_action(spark, v0, ahead, want):
    speeds = F.array(*map(F.lit, ahead)) if ahead else F.expr("cast(array() as array<double>)")
    assert one(spark, c.speed_action(F.lit(v0), speeds))[0] == want


def test_f1_of_nothing_is_zero(spark):
    assert one(spark, c.f1(F.lit(0), F.lit(0), F.lit(0)), c.ratio(F.lit(1), F.lit(0)))[:] == (0.0, 0.0)
    assert round(one(spark, c.f1(F.lit(10091), F.lit(4728), F.lit(8369)))[0], 6) == 0.606449


def test_python_rounding(spark):
    data = spark.createDataFrame([(2.675,), (0.25,), (-0.001,), (None,)], "v double")
    assert [r[0] for r in data.select(py_round(F.col("v"), 2)).collect()] == [2.67, 0.25, 0.0, None]


def test_greedy_match_takes_each_side_once(spark):
    rows = [(1, "a", 0, 0, 0, 10, 10, 0), (1, "a", 1, 0, 0, 10, 10, 0), (1, "a", 2, 100, 0, 110, 10, 3)]
    boxes = spark.createDataFrame(rows, "anchor_id long, category string, obj_idx long, x1 int, y1 int, x2 int, y2 int, pred_dx int")
    got = sorted((r.gi, r.pi) for r in matching.greedy_match(matching.candidate_pairs(boxes)).collect())
    assert got == [(0, 0), (1, 1), (2, 2)]


def test_future_speeds_stop_at_the_window(spark):
    frames = spark.createDataFrame([("s", i, t * 1_000_000, float(x), 0.0) for i, (t, x) in enumerate([(0, 0), (1, 2), (1, 2), (2, 5), (9, 6), (10, 9)])], "scene_token string, sample_id long, timestamp_us long, ego_x double, ego_y double")
    got = windows.future_window(frames).withColumn("v", windows.future_speeds(3_000_000)).orderBy("sample_id").first()
    assert got["v"] == [2.0, 3.0]


def test_dense_index_and_splits(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1), ("c", 1)], "g string, k int")
    assert [(r.g, r.k, r.global_idx) for r in windows.dense_index(rows, "g", ["k"]).orderBy("global_idx").collect()] == [("a", 1, 0), ("a", 2, 1), ("b", 1, 2), ("c", 1, 3)]
    scenes = spark.range(25).selectExpr("'x' AS city", "format_string('s%02d', id) AS token")
    assert [r.token for r in statistics.tail_split(scenes, ["city"], "token", 0.1).where("split = 'val'").orderBy("token").collect()] == ["s22", "s23", "s24"]


def test_bootstrap_weights_equal_drawn_rows(spark):
    scenes = spark.range(7).selectExpr("concat('s', id) AS scene", "id AS n")
    weights = statistics.resample_weights(scenes, "scene", 20, "x")
    assert {r[0] for r in weights.groupBy("replicate").agg(F.sum("weight")).select("sum(weight)").collect()} == {7}
    totals = statistics.resampled_totals(scenes, "scene", ["n"], 20, "x")
    naive = weights.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))).join(scenes, "scene").groupBy("replicate").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, naive.collect()))


def test_bootstrap_in_blocks_and_joined(spark, monkeypatch):
    scenes = spark.range(11).selectExpr("concat('s', id) AS scene", "id AS n")
    want = sorted(map(tuple, statistics.resampled_totals(scenes, "scene", ["n"], 9, "x").collect()))
    monkeypatch.setattr(statistics, "DRAW_BLOCK", 4)
    monkeypatch.setattr(statistics, "MAX_BROADCAST_SCENES", 0)
    assert sorted(map(tuple, statistics.resampled_totals(scenes, "scene", ["n"], 9, "x").collect())) == want
    assert statistics.resampled_totals(scenes.limit(0), "scene", ["n"], 9, "x").collect() == []


def test_majority_and_nearest_rank(spark):
    rows = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "a")], "g string, k string")
    assert sorted(map(tuple, metrics.majority(rows, "g", "k").collect())) == [("g", "b", 0.5), ("h", "a", 1.0)]
    assert metrics.nearest_rank(spark.range(1, 11).withColumnRenamed("id", "v"), "v", 0.9).first()[0] == 9


def test_compare_generations(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k long, v string")
    assert sorted(map(tuple, validation.compare_generations(a, b, "k", ["v"]).collect())) == [(1, "missing", ""), (2, "changed", "v"), (3, "same", ""), (4, "extra", "")]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text('{"k":1}\n\n{"k":2}\n')
    assert sorted(r.k for r in io.read_json_lines(spark, str(path), "k int").collect()) == [1, 2]
    path.write_text('{"k":1}\nnonsense\n')
    with pytest.raises(Exception, match="not a record"):
        io.read_json_lines(spark, str(path), "k int").collect()
    with pytest.raises(Exception, match="duplicate"):
        io.unique_by(spark.createDataFrame([(1,), (1,)], "k int"), "k").collect()


def test_manifest_and_config():
    sealed = io.seal_manifest({"b": 1, "a": [1]})
    assert io.open_manifest(json.dumps(sealed)) == sealed
    with pytest.raises(ValueError, match="hash"):
        io.open_manifest(json.dumps(sealed | {"b": 2}))
    with pytest.raises(ValueError, match="frozen"):
        io.open_config('{"status": "draft"}')


def test_steps_of_a_grid(spark):
    from quarryframe.operators import sweeps

    rows = spark.createDataFrame([(0.5,), (1.0,), (2.5,), (None,)], "v double")
    at = lambda strict: [r[0] for r in rows.select(sweeps.step_of(F.col("v"), (1.0, 2.0), strict)).collect()]
    assert at(True) == [0, 1, 2, 2]
    assert at(False) == [0, 0, 2, 2]


def test_attribution_goes_through_matched_pairs(spark):
    from quarryframe.operators import evaluation

    refs = "anchor_id long, factor string, ref long"
    truth = spark.createDataFrame([(1, "a", 0), (1, "a", 0), (1, "a", 1), (1, "b", None), (1, "c", 2)], refs)
    guess = spark.createDataFrame([(1, "a", 7), (1, "a", 8), (1, "b", None), (1, "d", 7)], refs)
    pairs = spark.createDataFrame([(1, 7, 1), (1, 8, 5)], "anchor_id long, pi long, gi long")
    counts = evaluation.attribution_counts(truth, guess, pairs)
    # b has no objects on either side, c and d stand on one side only
    assert sorted(map(tuple, counts.collect())) == [(1, "a", 1, 1, 1)]
    report = {r.factor: r.f1 for r in evaluation.attribution_report(counts).collect()}
    assert report == {"*": 0.5, "a": 0.5, "macro": 0.5}
    empty = {r.factor: r.f1 for r in evaluation.attribution_report(counts.limit(0)).collect()}
    assert empty == {"macro": 0.0}


def test_many_scenes_are_drawn_without_a_broadcast(spark, monkeypatch):
    scenes = spark.range(300).selectExpr("concat('s', id) AS scene", "id AS n", "cast(id % 7 AS double) / 4 AS x", "9007199254740993 + id AS large")
    columns = ["n", "x", "large"]
    want = sorted(map(tuple, statistics.resampled_totals(scenes, "scene", columns, 9, "x").collect()))
    weights = statistics.resample_weights(scenes, "scene", 9, "x")
    for draws in (weights, statistics.mersenne_draws(spark, 300, 9, 1).hint("merge").join(scenes.selectExpr("n AS no", "scene"), "no")):
        # the plan's size of the draws is that of the list of replicates, so only a hint keeps them from being broadcast
        assert "SortMergeJoin [no" in draws._jdf.queryExecution().executedPlan().toString()
    naive = weights.join(scenes, "scene").groupBy("replicate").agg(*(F.sum(F.col("weight") * F.col(c)).alias(c) for c in columns))
    monkeypatch.setattr(statistics, "DRAW_BLOCK", 64)
    monkeypatch.setattr(statistics, "MAX_BROADCAST_SCENES", 0)
    totals = statistics.resampled_totals(scenes, "scene", columns, 9, "x")
    assert "BroadcastHashJoin [no" not in totals._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, naive.collect())) == want


def test_draws_equal_md5():
    for head, low, high in ((b"seed:0:", 0, 10), (b"seed:1999:", 99_990, 100_000), (b"", 1000, 1100), (b"x" * 46, 10**8, 10**8 + 9), (b"x" * 60, 5, 9), (b"s:1:", 2**32, 2**32 + 3)):
        want = [int(hashlib.md5(head + str(i).encode()).hexdigest()[:8], 16) for i in range(low, high)]
        assert statistics.md5_starts(head, low, high).tolist() == want
    got = dict(statistics._weights(1234, [0, 7], "seed"))
    for b in (0, 7):
        want = [0] * 1234
        for i in range(1234):
            want[int(hashlib.md5(f"seed:{b}:{i}".encode()).hexdigest()[:8], 16) % 1234] += 1
        assert got[b].tolist() == want


def test_lengths_and_projections_follow_the_sql(spark):
    near = spark.createDataFrame([(9.6, 7.2), (-3.3, 4.4), (7.0, 2.4)], "x double, y double")
    got = [r[0] for r in near.select(c.norm("x", F.col("y"))).collect()]
    assert got == [math.sqrt(x * x + y * y) for x, y in ((9.6, 7.2), (-3.3, 4.4), (7.0, 2.4))]
    # the product comes before the division, which decides at the edges of the image
    objects = spark.range(40_000).selectExpr("id AS anchor_id", "id AS ann_no", "cast(id % 600 AS double) / 10 - 10 AS x_c", "cast(id * 7 % 200 AS double) / 10 - 10 AS y_c", "0.5d + cast(id % 40 AS double) / 10 AS box_length_m", "0.4d + cast(id % 20 AS double) / 10 AS box_width_m")
    corners = label_queries.projected(type("Rows", (), {"view": lambda self, name: objects})()).collect()
    for r in corners:
        for i, k in enumerate(r.corners):
            d = r.x_c + r.box_length_m / 2 * (1 if i & 1 else -1)
            if d:
                assert k["u"] == 400 + 500 * (r.y_c + r.box_width_m / 2 * (1 if i & 2 else -1)) / d and k["v"] == 300 + 500 * (0.75 if i & 4 else -0.75) / d
