"""Exact percentiles against Spark's own aggregate."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarryframe.operators.percentiles import exact_percentiles

PROBS = [0.0, 0.1, 0.5, 0.9, 0.975, 1.0]


def both(frame, by):
    want = frame.groupBy(*by).agg(F.percentile("v", F.array(*map(F.lit, PROBS))).alias("p")).where("p is not null").collect()
    got = {}
    for r in exact_percentiles(frame, "v", PROBS, by, ranges=16).collect():
        got.setdefault(tuple(r[k] for k in by), {})[r["probability"]] = r["value"]
    assert {k: [v[p] for p in PROBS] for k, v in got.items()} == {tuple(r[k] for k in by): r["p"] for r in want}


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_as_the_aggregate_has_them(spark, by):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(2), rng.gauss(0, 100)) for _ in range(20_000)]
    rows += [("a", 0, 5.0)] * 8000 + [("hot", 1, -1.0)] * 3000 + [("hot", 1, 2.0), ("none", 0, None), ("one", 1, 4.5)] + [("b", 1, None)] * 50
    both(spark.createDataFrame(rows, "g string, h int, v double"), by)


def test_few_values_of_many_rows(spark):
    both(spark.range(300_000).select(F.when(F.col("id") % 3 == 0, 1.5).when(F.col("id") == 7, 9.0).otherwise(2.0).alias("v")), [])


def test_infinite_values_and_nothing(spark):
    frame = spark.createDataFrame([(v,) for v in (1.0, math.inf, -math.inf, 3.0, math.nan)], "v double")
    got = [r["value"] for r in exact_percentiles(frame, "v", [0.0, 0.25, 0.5, 1.0]).collect()]
    assert got[:3] == [-math.inf, 1.0, 3.0] and math.isnan(got[3])
    assert exact_percentiles(frame.where("false"), "v", [0.5]).collect() == []


def test_no_task_sees_all_values(spark):
    frame = spark.range(400_000).select(F.rand(3).alias("v"), (F.col("id") % 2).cast("string").alias("g"))
    got = exact_percentiles(frame, "v", [0.5], ["g"]).collect()
    want = {r["g"]: r["p"] for r in frame.groupBy("g").agg(F.percentile("v", 0.5).alias("p")).collect()}
    assert {r["g"]: r["value"] for r in got} == want


def test_histograms_against_numpy(spark):
    import numpy as np

    from quarryframe.operators.sweeps import histograms

    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.uniform(-6, 16)) for _ in range(3000)] + [("a", v) for v in (-5.0, 15.0, 14.95, -5.01, 15.01)]
    got = {}
    for r in histograms(spark.createDataFrame(rows, "g string, v double"), "g", "v", -5.0, 15.0, 40).collect():
        got.setdefault(r["g"], {})[r["bin"]] = r["n"]
    for g in "ab":
        want = np.histogram([v for k, v in rows if k == g], bins=np.linspace(-5, 15, 41))[0].tolist()
        assert [got[g][i] for i in range(40)] == want
