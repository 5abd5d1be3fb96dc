"""Dataset builds over files, records and their rules, expected outputs and velocities."""

import json
import math

import pytest
from pyspark.sql import functions as F

from quarryframe.contracts.parser import canonical_text, parse
from quarryframe.operators import dataset as ds
from quarryframe.operators import labels as lb
from quarryframe.operators import records as rc
from quarryframe.plans import registry
from quarryframe.sources import io

FRAME = "scene_token string, sample_id long, timestamp_us long, walk_idx long, ego_x double, ego_y double, ego_yaw double, image string, has_camera boolean, has_image boolean, has_calibration boolean"


def frames(spark, *changes, n=14, scene="s"):
    rows = {i: {"t": i * 500_000, "x": float(i), "y": 0.0, "yaw": 0.1, "cam": True, "img": True, "cal": True} for i in range(n)}
    for i, change in changes:
        rows[i] |= change
    return spark.createDataFrame([(scene, 100 + i, r["t"], i, r["x"], r["y"], r["yaw"], f"img/{i}.jpg", r["cam"], r["img"], r["cal"]) for i, r in rows.items()], FRAME)


def built_records(spark, *changes, **options):
    registry.on_workers(spark)
    return rc.build_records(frames(spark, *changes, **options), "b1", "mini", max_gap_us=900_000)


def candidates(spark, n=40, scenes=3, target='{"a":1}'):
    parts = [built_records(spark, n=n, scene=f"s{k}").withColumn("sample_id", F.col("sample_id") + 1000 * k) for k in range(scenes)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    token = F.col("sample_id").cast("string")
    record = F.col("record").withField("sample_token", token).withField("training_targets.expected_output", F.lit(target).cast("string"))
    return whole.withColumns({"record": F.when(F.col("record").isNotNull(), record), "split": F.when(F.col("scene_token") == "s2", "val").otherwise("train")})


def reasons(rows):
    return {r["walk_idx"]: r["reason"] for r in rows.collect()}


def test_records_hold_history_speed_and_future(spark):
    r = built_records(spark).where("walk_idx = 5").first()["record"]
    assert [f["time_offset_s"] for f in r["model_inputs"]["frames"]] == [-1.5, -1.0, -0.5, 0.0] and r["model_inputs"]["ego_speed_mps"] == 2.0
    assert [p["sample_token"] for p in r["oracle_only"]["future_ego_poses"]] == [str(100 + i) for i in range(6, 12)]
    last = built_records(spark).where("walk_idx = 13").first()
    assert last["reason"] is None and last["record"]["oracle_only"]["future_ego_poses"] == []


@pytest.mark.parametrize(
    "frame,change,want",
    [
        (4, {"cam": False}, {3: "NO_CAM_FRONT", 4: "NO_CAM_FRONT", 7: "NO_CAM_FRONT", 8: None}),
        (13, {"t": 13 * 500_000 + 450_000}, {3: None, 12: None, 13: "BAD_GAP"}),
        (4, {"img": False}, {3: None, 4: "MISSING_IMAGE", 7: "MISSING_IMAGE", 8: None}),
        (10, {"cal": False}, {3: None, 4: "MISSING_CALIBRATION", 10: "MISSING_CALIBRATION", 13: "MISSING_CALIBRATION"}),
        (10, {"yaw": math.nan}, {3: None, 4: "NUMERIC_ANOMALY", 9: "NUMERIC_ANOMALY", 10: "NUMERIC_ANOMALY", 11: None}),
        (10, {"x": None}, {3: None, 9: "NUMERIC_ANOMALY", 11: "NUMERIC_ANOMALY", 12: None}),
    ],
)
def test_reasons_of_history_and_future(spark, frame, change, want):
    got = reasons(built_records(spark, (frame, change)))
    assert {k: got[k] for k in want} == want


def test_times_that_do_not_rise_in_the_future(spark):
    got = reasons(built_records(spark, (8, {"t": 7 * 500_000})))
    assert got[3] == "NON_INCREASING_TIME" and got[6] == "NON_INCREASING_TIME" and got[8] == "NON_INCREASING_TIME"


def test_record_rules(spark):
    good = built_records(spark).where("walk_idx = 5")
    r = F.col("record")
    broken = {
        "": r,
        "record_version": r.withField("record_version", F.lit("v2")),
        "scene_token": r.withField("scene_token", F.lit(None).cast("string")),
        "frame_count": r.withField("model_inputs.frames", F.slice(r["model_inputs"]["frames"], 2, 3)),
        "speed_finite": r.withField("model_inputs.ego_speed_mps", F.lit(math.nan)),
        "speed_negative": r.withField("model_inputs.ego_speed_mps", F.lit(-0.5)),
        "frame_offset": r.withField("model_inputs.frames", F.transform(r["model_inputs"]["frames"], lambda f: f.withField("time_offset_s", f["time_offset_s"] * 2))),
        "frame_image": r.withField("model_inputs.frames", F.transform(r["model_inputs"]["frames"], lambda f: f.withField("image_relpath", F.lit("")))),
        "pose_finite": r.withField("oracle_only.future_ego_poses", F.transform(r["oracle_only"]["future_ego_poses"], lambda p: p.withField("yaw", F.lit(math.inf)))),
        "pose_time": r.withField("oracle_only.future_ego_poses", F.reverse(r["oracle_only"]["future_ego_poses"])),
        "temporal_policy": r.withField("provenance.temporal_policy_version", F.lit("v0")),
        "source_version": r.withField("provenance.nuscenes_version", F.lit("")),
    }
    for rule, record in broken.items():
        got = good.select(record.alias("record")).select(rc.record_violations().alias("v")).first()["v"]
        assert got == ([rule] if rule else []), rule


def test_requests_see_no_future(spark):
    rows = rc.with_requests(built_records(spark).where("walk_idx = 5"), "Say.", one_frame=False)
    one = rc.with_requests(built_records(spark).where("walk_idx = 5"), "Say.", one_frame=True).first()["request"]
    four = rows.first()["request"]
    assert four["prompt"] == one["prompt"] == "Say.\n2.00 m/s (backward difference from the previous keyframe)"
    assert one["frame_tokens"] == ["105"] and four["frame_tokens"] == ["102", "103", "104", "105"] and four["contract_version"] == "v7"
    leaks = rows.select(rc.leaking({"b": F.col("request.prompt"), "a": F.lit("x 107 y"), "n": F.lit(None).cast("string")}, rc.future_fingerprints()).alias("v")).first()["v"]
    assert leaks == ["a"]


def test_build_writes_shards_index_and_manifest(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    made = ds.build_dataset(candidates(spark), path, ["train", "val"], ds.BuildConfig(shard_size=10), {"note": "x"})
    assert ds.open_dataset(spark, path) == made and made["config"]["note"] == "x"
    assert made["counts"]["candidates"] == 3 * 37 and made["counts"]["valid"] == 3 * 37 and made["splits"] == {"train": {"records": 74, "shards": 8}, "val": {"records": 37, "shards": 4}}
    lines = ds.read_shard_lines(spark, f"{path}/records")
    assert sorted(r["count"] for r in lines.groupBy("split", "shard").count().collect()) == [4, 7, *[10] * 10]
    first = lines.where("split = 'val' and shard = 1 and line = 0").first()["text"]
    assert json.loads(first)["sample_token"] == "2113" and first == canonical_text(json.loads(first)) and json.loads(first)["training_targets"]["expected_output"] == {"a": 1}
    index = spark.read.schema(ds.INDEX).parquet(f"{path}/index")
    assert ds.check_shards(lines, index).where(F.size("problems") > 0).count() == 0


def test_positional_reads_open_only_their_shards_and_refuse_other_lines(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    ds.build_dataset(candidates(spark), path, ["train", "val"], ds.BuildConfig(shard_size=10))
    index = spark.read.schema(ds.INDEX).parquet(f"{path}/index")
    wanted = index.where("split = 'train' and shard = 3 and line < 4")
    got = ds.read_placed(spark, f"{path}/records", wanted)
    assert sorted(json.loads(r["text"])["sample_token"] for r in got.collect()) == sorted(r["sample_token"] for r in wanted.collect())
    for other, what in ((wanted.withColumn("record_hash", F.lit("0")), "another line at train/3/"), (wanted.withColumn("line", F.col("line") + 90), "no line at train/3/9")):
        with pytest.raises(Exception, match=what):
            ds.read_placed(spark, f"{path}/records", other).collect()


def test_damage_is_told_apart(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    ds.build_dataset(candidates(spark, scenes=1, n=15), path, ["train"], ds.BuildConfig(shard_size=6))
    index = spark.read.schema(ds.INDEX).parquet(f"{path}/index")
    for sums in (tmp_path / "d" / "records").rglob(".*.crc"):
        sums.unlink()
    file = next((tmp_path / "d" / "records" / "split=train" / "shard=0").glob("*.txt"))
    lines = file.read_text().split("\n")
    lines[0], lines[1] = lines[1], lines[0]
    lines[2] = lines[2].replace('"x":', '"x": ', 1)
    lines[3] = lines[3].replace("img/", "pic/", 1)
    lines[4] = "{broken"
    lines[5] = canonical_text(json.loads(lines[5]) | {"more": 1})
    file.write_text("\n".join(lines))
    other = next((tmp_path / "d" / "records" / "split=train" / "shard=1").glob("*.txt"))
    more = other.read_text().split("\n")
    other.write_text("\n".join(["", *more[1:3], more[3].replace('"sample_token":"112"', '"sample_token":"zz"'), *more[4:], more[-2]]))
    got = {(r["shard"], r["line"], r["sample_token"]): ",".join(r["problems"]) for r in ds.check_shards(ds.read_shard_lines(spark, f"{path}/records"), index).collect() if r["problems"]}
    token = lambda shard, line: index.where(f"shard = {shard} and line = {line}").first()["sample_token"]
    assert got == {
        (0, 0, token(0, 1)): "moved",
        (0, 1, token(0, 0)): "moved",
        (0, 2, token(0, 2)): "changed,not_canonical",
        (0, 3, token(0, 3)): "changed",
        (0, 4, None): "unreadable",
        (0, 4, token(0, 4)): "missing",
        (0, 5, token(0, 5)): "changed,shape",
        (1, 0, None): "blank",
        (1, 0, token(1, 0)): "missing",
        (1, 3, "zz"): "extra",
        (1, 3, token(1, 3)): "missing",
        (1, 6, None): "blank",
        (1, 7, token(1, 5)): "moved",
    }


@pytest.mark.parametrize("fault,gate", [("label", "labels_complete"), ("reason", "reasons_known"), ("split", "splits_known"), ("token", "round_trip")])
def test_a_failed_gate_leaves_no_manifest(spark, tmp_path, fault, gate):
    rows = candidates(spark, n=8, scenes=2, target=None if fault == "label" else "{}")
    if fault == "reason":
        rows = rows.withColumns({"record": F.when(F.col("walk_idx") > 4, F.col("record")), "reason": F.when(F.col("walk_idx") <= 4, "TIRED")})
    if fault == "token":  # one token in two records
        rows = rows.withColumn("sample_id", F.lit(7)).withColumn("record", F.col("record").withField("sample_token", F.lit("7")))
    path = f"file://{tmp_path}/d"
    with pytest.raises(ValueError, match=gate):
        ds.build_dataset(rows, path, ["val"] if fault == "split" else ["train", "val"], ds.BuildConfig(shard_size=3))
    with pytest.raises(Exception):
        ds.open_dataset(spark, path)


def test_empty_builds_and_unlabelled_ones(spark, tmp_path):
    none = candidates(spark, n=5, scenes=1).where("false")
    made = ds.build_dataset(none, f"file://{tmp_path}/a", ["train"])
    assert made["splits"] == {} and made["counts"]["candidates"] == 0
    made = ds.build_dataset(candidates(spark, n=5, scenes=1, target=None), f"file://{tmp_path}/b", ["train"], ds.BuildConfig(labelled=False))
    assert made["counts"]["valid"] == 2 and made["counts"]["labelled"] == 0


def test_hash_roots_by_levels(spark):
    rows = spark.range(2500).select(F.col("id").alias("no"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    root, levels = ds.hash_root(rows, "no", "h")
    assert levels == 2 and root == ds.hash_root(rows.repartition(5), "no", "h")[0]
    assert root != ds.hash_root(rows.withColumn("h", F.when(F.col("no") == 7, "0").otherwise(F.col("h"))), "no", "h")[0]
    assert ds.hash_root(rows.where("no < 1"), "no", "h")[1] == 1 and ds.hash_root(rows.where("false"), "no", "h")[0] == ""


def test_shared_folders(spark):
    assert io.shared_folder(spark, "x") != io.shared_folder(spark, "x")


# -- velocities and outputs ------------------------------------------------------------------------------------------


def test_a_parked_car_stands_still_for_a_moving_ego(spark):
    """The ego drives at 10 m/s past a car at (30, 2) of the world; a second car drives ahead of it at its speed."""
    rows = [("s", k, int(t * 1e6), x, y) for t in (0.0, 0.5, 1.0, 1.5) for k, x, y in ((1, 30.0, 2.0), (2, 12.0 + 10 * t, 0.0))]
    seen = lb.centred_velocity(spark.createDataFrame(rows, "scene_token string, instance_id int, timestamp_us long, x double, y double"))
    assert {(r["instance_id"], r["vx"], r["vy"]) for r in seen.collect()} == {(1, 0.0, 0.0), (2, 10.0, 0.0)}
    t0 = seen.where("timestamp_us = 0").withColumns({"category": F.lit("car"), "x_c": F.col("x"), "y_c": F.col("y"), "anchor_id": F.lit(1), "ann_no": F.col("instance_id"), "ego_speed": F.lit(10.0), "box_length_m": F.lit(4.0), "box_width_m": F.lit(2.0), "box_yaw_deg": F.lit(0.0), "slowest": F.lit(None).cast("double"), "fastest": F.lit(None).cast("double")})
    got = {r["instance_id"]: r for r in lb.risk_columns(lb.with_geometry(t0)).collect()}
    assert got[1]["state"] == "stationary" and got[1]["fires"] and got[1]["stationary_obstacle"]
    assert got[2]["state"] == "same_direction" and not got[2]["fires"]  # as fast as the ego: the gap stays


def test_velocities_need_near_sightings(spark):
    rows = [("s", 1, 0, 0.0), ("s", 1, 1_600_000, 8.0), ("s", 2, 0, 0.0), ("s", 2, 1_400_000, 7.0), ("s", 2, 2_900_000, 14.5), ("s", 3, 5, 1.0)]
    got = lb.centred_velocity(spark.createDataFrame(rows, "scene_token string, instance_id int, timestamp_us long, x double").withColumn("y", F.lit(0.0)))
    assert [(r["instance_id"], round(r["vx"], 6)) for r in got.orderBy("instance_id", "timestamp_us").collect()] == [(1, 0.0), (1, 0.0), (2, 5.0), (2, 5.0), (2, 5.0), (3, 0.0)]


def test_evidence_ends_after_its_window(spark):
    anchors = spark.createDataFrame([(i, "s", i, t) for i, t in enumerate((0, 1_000_000, 3_000_000, 3_100_000))], "anchor_id long, scene_token string, walk_idx long, timestamp_us long")
    objects = spark.createDataFrame([(0, 5, 4.0), (1, 5, 3.0), (2, 5, 2.0), (3, 5, 1.0)], "anchor_id long, instance_id int, vx double").withColumn("vy", F.lit(0.0))
    got = lb.track_windows(objects, anchors).where("anchor_id = 0").first()
    assert (got["n_future"], got["n_evidence"], got["slowest"], got["fastest"]) == (3, 2, 2.0, 3.0)
    last = lb.track_windows(objects, anchors).where("anchor_id = 3").first()
    assert (last["n_future"], last["slowest"]) == (0, None)


def test_expected_outputs_of_full_and_empty_anchors(spark):
    registry.on_workers(spark)
    anchors = spark.createDataFrame([(1, "STOP"), (2, "KEEP_SPEED")], "anchor_id long, speed_action string")
    row = {"anchor_id": 1, "ann_no": 3, "category": "car", "x_c": 4.25, "y_c": 0.0, "vx": 0.0, "vy": 0.0, "ego_speed": 0.0, "box_length_m": 4.0, "box_width_m": 2.0, "box_yaw_deg": 0.0, "slowest": None, "fastest": None, "rank": 1.0, "bx1": 0.25, "by1": 1.0, "bx2": 2.0, "by2": 3.35}
    schema = ", ".join(f"{k} {'string' if k == 'category' else 'long' if k in ('anchor_id', 'ann_no') else 'double'}" for k in row)
    pool = lb.risk_columns(lb.with_geometry(spark.createDataFrame([tuple(row.values())], schema).withColumn("rank", F.col("rank").cast("int"))))
    got = {r["anchor_id"]: json.loads(r["expected_output"]) for r in lb.expected_outputs(pool, anchors).collect()}
    assert got[2] == {"critical_objects": [], "risk_factors": [], "speed_action": "KEEP_SPEED", "yield_required": False}
    assert got[1]["critical_objects"] == [{"id": 0, "category": "car", "bbox_2d": [0.2, 1.0, 2.0, 3.4], "motion_state": "stationary", "bev_x": 2.2, "bev_y": 0.0}]
    assert got[1]["risk_factors"] == [{"factor": "stationary_obstacle", "objects": [0]}, {"factor": "object_near", "objects": [0]}] and got[1]["yield_required"]
    assert parse(json.dumps(got[1]), size=None).status == "ok"
    with pytest.raises(Exception, match="not an output of the contract"):
        lb.expected_outputs(pool, anchors.withColumn("speed_action", F.lit("FLY"))).collect()


def test_links_into_another_scene(spark):
    from quarryframe.operators import windows as w

    rows = [("a", i, i * 500_000, i - 1 if i else None) for i in range(6)] + [("b", 10, 2_000_000, 3), ("b", 11, 2_500_000, 10), ("b", 12, 3_000_000, 99)]
    frames = spark.createDataFrame(rows, "scene_token string, sample_id long, timestamp_us long, prev_id long").selectExpr("*", "true AS has_camera", "true AS has_image", "true AS has_calibration", "0D AS ego_x", "0D AS ego_y", "0D AS ego_yaw")
    got = {r["sample_id"]: (r["r"], r["n"]) for r in w.linked_history(frames).select("sample_id", w.quarantine_reason(max_gap_us=900_000).alias("r"), F.size("window").alias("n")).collect()}
    assert got == {0: ("INSUFFICIENT_HISTORY", 1), 1: ("INSUFFICIENT_HISTORY", 2), 2: ("INSUFFICIENT_HISTORY", 3), 3: (None, 4), 4: (None, 4), 5: (None, 4), 10: ("CROSS_SCENE", 4), 11: ("CROSS_SCENE", 4), 12: ("INSUFFICIENT_HISTORY", 1)}


def test_training_targets_keep_the_contract(spark):
    registry.on_workers(spark)
    good = '{"speed_action":"STOP","yield_required":false,"risk_factors":[{"objects":[0],"factor":"object_near"}],"critical_objects":[{"id":0,"category":"car","bbox_2d":[1,2,3,4],"motion_state":"stationary","bev_x":1.0,"bev_y":2.0}]}'
    frame = lambda text: spark.createDataFrame([(text,)], "t string").select(rc.training_target(F.col("t")).alias("x"))
    assert frame(good).first()["x"] == '{"critical_objects":[{"id":0,"category":"car","bbox_2d":[1.0,2.0,3.0,4.0],"motion_state":"stationary","bev_x":1.0,"bev_y":2.0}],"risk_factors":[{"factor":"object_near","objects":[0]}],"yield_required":false,"speed_action":"STOP"}'
    for bad in (good.replace("STOP", "FLY"), good.replace('"yield_required":false,', ""), good.replace('"speed_action"', '"more":1,"speed_action"'), None):
        with pytest.raises(Exception, match="not an output of the contract"):
            frame(bad).collect()


def test_anchors_that_are_asked_for(spark):
    from quarryframe.operators import windows as w

    frames = spark.createDataFrame([("b", i, i) for i in range(5)] + [("c", 10 + i, i) for i in range(3)], "scene_token string, sample_id long, timestamp_us long")
    asked = spark.createDataFrame([(1, 2, None), (2, 2, "c"), (3, 99, "b"), (4, None, "b"), (5, None, "c"), (6, None, "z"), (7, None, None)], "request int, token long, scene string")
    got = {r["request"]: (r["anchor"], r["why"]) for r in w.resolve_anchors(asked, frames).collect()}
    assert got == {1: (2, "token"), 2: (2, "token"), 3: (None, "NO_TOKEN"), 4: (3, "scene"), 5: (None, "TOO_SHORT"), 6: (None, "NO_SCENE"), 7: (3, "first")}
    short = w.resolve_anchors(asked, frames.where("scene_token = 'c'")).where("request = 7").first()
    assert (short["anchor"], short["why"]) == (None, "TOO_SHORT")
