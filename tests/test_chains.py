"""Rotations and the sensor chain against numpy; differences of documents."""

import json


import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryframe.operators import sensors as sn
from quarryframe.operators import trees as tr
from quarryframe.plans import registry


def matrix(q):
    w, x, y, z = np.array(q) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def test_corners_equal_numpy(spark):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for i in range(40):
        box, pose, cam = (rng.normal(size=4) for _ in range(3))
        centre, size, tp, ts = rng.normal(size=3) * 20, rng.uniform(0.5, 5, 3), rng.normal(size=3) * 5, rng.normal(size=3)
        rows.append((i, *centre.tolist(), *size.tolist(), box.tolist(), tp.tolist(), pose.tolist(), ts.tolist(), cam.tolist(), 800.0, 700.0, 640.0, 360.0))
        corners = []
        for k in range(8):
            local = size / 2 * np.array([1 if k >> n & 1 else -1 for n in range(3)])
            world = centre + matrix(box) @ local
            x, y, d = matrix(cam).T @ (matrix(pose).T @ (world - tp) - ts)
            corners.append((d, 640 + 800 * x / d, 360 + 700 * y / d))
        want.append(corners)
    schema = "id int, x double, y double, z double, length double, width double, height double, rotation array<double>, pose_translation array<double>, pose_rotation array<double>, sensor_translation array<double>, sensor_rotation array<double>, fx double, fy double, cx double, cy double"
    frame = spark.createDataFrame(rows, schema)
    got = [[tuple(c) for c in r["corners"]] for r in sn.projected_corners(frame).orderBy("id").collect()]
    assert np.allclose(np.array(got), np.array(want), rtol=1e-9)
    # the single steps are the same as the whole
    col = F.col
    corner = sn.box_corners((col("x"), col("y"), col("z")), (col("length"), col("width"), col("height")), col("rotation"))[5]
    x, y, d = sn.into_frame(sn.into_frame(corner, col("pose_translation"), col("pose_rotation")), col("sensor_translation"), col("sensor_rotation"))
    steps = [tuple(r) for r in frame.orderBy("id").select(d, col("cx") + col("fx") * x / d, col("cy") + col("fy") * y / d).collect()]
    assert np.allclose(np.array(steps), np.array(want)[:, 5], rtol=1e-9)


def test_missing_links_have_reasons(spark):
    frames = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False), (5, None)], "sample_id long, has_camera boolean")
    data = spark.createDataFrame([(1, "p1", "c1"), (2, "p9", "c1"), (3, "p3", "c9"), (4, "p1", "c1")], "sample_id long, pose_token string, calibration_token string")
    poses = spark.createDataFrame([("p1", [0.0] * 3, [1.0, 0.0, 0.0, 0.0]), ("p3", [0.0] * 3, [1.0, 0.0, 0.0, 0.0])], "pose_token string, pose_translation array<double>, pose_rotation array<double>")
    cals = spark.createDataFrame([("c1", [0.0] * 3)], "calibration_token string, sensor_translation array<double>")
    got = {r["sample_id"]: r["link"] for r in sn.linked_cameras(frames, data, poses, cals).collect()}
    assert got == {1: None, 2: "MISSING_POSE", 3: "MISSING_CALIBRATION", 4: "NO_CAM_FRONT", 5: "NO_CAM_FRONT"}


@pytest.mark.parametrize(
    "a,b,want",
    [
        ({"a": 1}, {"a": 1.0}, []),
        ({"a": [1, {"b": 2}]}, {"a": [1, {"b": 3}]}, [(".a[1].b", "value")]),
        ({"a": [1, 2]}, {"a": [1]}, [(".a", "length")]),
        ({"b": 1, "a": 1}, {"c": 1, "a": 2}, [(".a", "value"), (".b", "missing_new"), (".c", "missing_old")]),
        ({"a": {"x": {}}}, {"a": [1]}, [(".a", "value")]),
        ({"a": {"x": 1}}, {"a": None}, [(".a", "value")]),
        ([], {}, [("", "value")]),
        ("x", "x", []),
        ({"a": [[[1]], [[2, 3]]]}, {"a": [[[1]], [[2, 4]]]}, [(".a[1][0][1]", "value")]),
        ({"a": {"b": {"c": 1}}}, {}, [(".a", "missing_new")]),
    ],
)
def test_paths_of_differences(a, b, want):
    assert [d[:2] for d in tr.tree_differences(a, b)] == want


def test_documents_of_both_sides(spark):
    registry.on_workers(spark)
    old = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":1}'), (3, "{no"), (4, None), (5, "[" * 9000)], "k int, t string")
    new = spark.createDataFrame([(1, '{"a":2}'), (3, "{no"), (4, None), (5, "[1]"), (6, "{}")], "k int, t string")
    got = {r["k"]: [(d["path"], d["kind"]) for d in r["differences"]] for r in tr.compare_documents(old, new, "k", "t").collect()}
    assert got == {1: [(".a", "value")], 2: [("", "missing_new")], 3: [], 4: [], 5: [("", "value")], 6: [("", "missing_old")]}


def test_checks_of_generations(spark):
    registry.on_workers(spark)
    base = {"in": {"x": [1, 2]}, "stamp": "a", "more": 1}
    docs = {1: base | {"stamp": "b"}, 2: base | {"in": {"x": [1, 3]}}, 3: base | {"more": 2}, 4: base, 5: base | {"inner": 1}}
    old = spark.createDataFrame([(k, json.dumps(base), "h") for k in docs] + [(9, "{}", "h")], "k int, t string, h string")
    new = spark.createDataFrame([(k, json.dumps(d), "h" if k == 4 else "i") for k, d in docs.items()], "k int, t string, h2 string")
    compared = tr.compare_documents(old, new, "k", "t").join(old.select("k", "h"), "k", "left").join(new.select("k", "h2"), "k", "left")
    got = {r["k"]: (r["kept"], r["changed"], r["unexpected"]) for r in tr.generation_checks(compared, {"kept": [".in"]}, [".stamp"], [("changed", "h", "h2")]).collect()}
    assert got == {1: (True, True, []), 2: (False, True, []), 3: (True, True, [".more"]), 4: (True, False, []), 5: (True, True, [".inner"]), 9: (None, None, None)}
