"""Expressions over objects that have to stay short: a method of more than 8,000 bytes is never compiled by the JVM."""

import math
import re

import pytest
from pyspark.sql import functions as F

from quarryframe.operators import labels as lb
from quarryframe.operators import sensors as sn

LIMIT = 8000
BOX = "x_c double, y_c double, vx double, vy double, ego_speed double, box_length_m double, box_width_m double, box_yaw_deg double"


def methods(frame):
    """Bytes of the longest method of each generated stage."""
    text = frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "codegen")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]


def clearance(x, y, vx, vy, ego, length, width, yaw):
    gaps = []
    for k in range(13):
        px, py = x + (vx - ego) * k * 0.25, y + vy * k * 0.25
        dx, dy = px - max(-2.05, min(2.05, px)), py - max(-1.185, min(1.185, py))
        turn = math.radians(yaw) - math.atan2(dy, dx)
        gaps.append(-1e9 if dx == dy == 0 else math.hypot(dx, dy) - abs(math.cos(turn)) * length / 2 - abs(math.sin(turn)) * width / 2)
    return min(gaps)


def test_clearance_is_compiled(spark):
    rows = spark.createDataFrame([], BOX + ", anchor_id long").coalesce(1)
    sizes = methods(rows.withColumn("clearance", lb.clearance_samples()).where(F.col("clearance") < 2).selectExpr("clearance + 1"))
    assert sizes and max(sizes) <= LIMIT


def test_clearance_of_every_row(spark):
    rows = [((i * 7 % 90) - 30.0, (i * 11 % 50) - 25.0, (i % 9) - 4.0, (i % 7) - 3.0, float(i % 10), 0.5 + i % 4, 0.4 + i % 3, float(i * 13 % 360)) for i in range(400)]
    got = spark.createDataFrame(rows, BOX).select(*BOX.replace(" double", "").split(", "), lb.clearance_samples().alias("c")).collect()
    assert len(got) == 400
    assert [r["c"] for r in got] == pytest.approx([clearance(*r[:8]) for r in got], abs=1e-9)


def test_clearance_without_numbers(spark):
    rows = [
        (None, 0.0, 1.0, 0.0, 0.0, 4.0, 2.0, 0.0),  # no place
        (30.0, 0.0, 1.0, 0.0, None, 4.0, 2.0, 0.0),  # no speed
        (30.0, 0.0, 1.0, 0.0, 0.0, None, 2.0, 0.0),  # no length, and never inside the band
        (0.0, 0.0, 0.0, 0.0, 0.0, None, 2.0, 0.0),  # inside, where the box does not count
        (0.0, 0.0, 0.0, 0.0, 0.0, 4.0, 2.0, 0.0),
    ]
    frame = spark.createDataFrame(rows, BOX).coalesce(1)
    assert [r[0] for r in frame.select(lb.clearance_samples()).collect()] == [None, None, None, -1e9, -1e9]
    assert [r[0] for r in frame.select(lb.clearance_samples(0.0)).collect()] == [None, None, None, 0.0, 0.0]


CHAIN = "x double, y double, z double, length double, width double, height double, rotation array<double>, pose_translation array<double>, pose_rotation array<double>, sensor_translation array<double>, sensor_rotation array<double>, fx double, fy double, cx double, cy double"


def test_corners_are_no_expression_of_columns(spark):
    one, none = [1.0, 0.0, 0.0, 0.0], [0.0] * 3
    rows = [(0.0, 0.0, 5.0, 2.0, 2.0, 2.0, one, none, one, none, one, 800.0, 800.0, 0.0, 0.0), (0.0, 0.0, 1.0, 2.0, 2.0, 2.0, one, none, one, none, one, 800.0, 800.0, 0.0, 0.0), (None, 0.0, 1.0, 2.0, 2.0, 2.0, one, none, one, none, one, 800.0, 800.0, 0.0, 0.0)]
    found = sn.projected_corners(spark.createDataFrame(rows, CHAIN).coalesce(1))
    # one projection of a batch, and no transform that repeats the rotations for each of their cells
    assert found._jdf.queryExecution().optimizedPlan().toString().count("transform(") == 0
    near, flat, lost = (r["corners"] for r in found.collect())
    assert tuple(near[7]) == pytest.approx((6.0, 800.0 / 6, 800.0 / 6)) and tuple(near[0]) == pytest.approx((4.0, -200.0, -200.0))
    assert [c["depth"] for c in flat] == [0.0] * 4 + [2.0] * 4 and [c["u"] for c in flat][:4] == [None] * 4
    assert all(c["depth"] is None and c["u"] is None for c in lost)


def test_a_rotation_of_length_0_stops_the_job(spark):
    one, none = [1.0, 0.0, 0.0, 0.0], [0.0] * 3
    frame = spark.createDataFrame([(0.0, 0.0, 5.0, 2.0, 2.0, 2.0, [0.0] * 4, none, one, none, one, 800.0, 800.0, 0.0, 0.0)], CHAIN)
    with pytest.raises(Exception, match="length 0"):
        sn.projected_corners(frame).collect()
