"""Intervals and gates match boxes where they are numbered, and shuffle a box once and a draw as a part of a byte."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryframe.operators import matching as mt
from quarryframe.operators import statistics as st
from quarryframe.plans import gate_queries as gq
from quarryframe.plans import interval_queries as iq
from quarryframe.plans.fixtures import Fixtures


def test_sides_with_other_boxes_match_as_the_join(spark, monkeypatch):
    monkeypatch.setattr(mt, "_BLOCK", 50)
    rng = random.Random(8)
    rows = []
    for a in range(200):
        for n in range(rng.randint(1, 8)):
            x, y = rng.randint(0, 4) * 5, rng.randint(0, 2) * 5
            rows.append((a, n, rng.choice("ab"), x, y, x + rng.choice((10, 20)), y + 15, rng.randint(0, 4) * 3, rng.choice((True, True, False, None)), rng.choice((True, True, False, None))))
    boxes = spark.createDataFrame(rows, "anchor_id long, n int, category string, x1 int, y1 int, x2 int, y2 int, pred_dx int, here boolean, told boolean")
    boxes = boxes.withColumn("obj_idx", F.row_number().over(Window.partitionBy("anchor_id").orderBy("n")) - 1).cache()
    want = mt.greedy_match(mt.candidate_pairs(boxes.where("here"), 0.3, boxes.where("told"))).select("anchor_id", "category", "gi", "pi", "iou")
    got = mt.matched_boxes(boxes, 0.3, (), ("here", "told")).where("pi is not null").select("anchor_id", "category", "obj_idx", "pi", "iou")
    assert 0 < want.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("lineitem.parquet"), plan.count("Exchange hashpartitioning") + plan.count("BroadcastExchange")


def test_interval_counts_shuffle_lines_once(spark):
    # lines by anchor, their words and the anchors by anchor, and both by scene
    assert shuffles(iq.scene_counts(Fixtures(spark, "/root/testdata/sf0.001"))) == (1, 4)


def test_packed_weights():
    rng = np.random.default_rng(3)
    for weights in (np.bincount(rng.integers(0, 16_384, 16_384), minlength=16_384), np.array([0, 300, 70_000]), np.zeros(1, np.int64), np.array([255])):
        packed = st.pack_weights(weights)
        assert st.unpack_weights(packed, len(weights)).tolist() == weights.tolist()
        # a draw took a byte
        assert len(weights) < 1000 or len(packed) < 0.3 * len(weights)


def test_gate_counts_shuffle_lines_once(spark):
    assert shuffles(gq.scene_counts(Fixtures(spark, "/root/testdata/sf0.001"))) == (1, 4)
