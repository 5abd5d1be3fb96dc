"""Objects meet their tracks by the anchor alone, and the self check builds its pool once."""

from pyspark.sql import functions as F

from quarryframe.operators import labels as lb
from quarryframe.plans import label_queries as lq
from quarryframe.plans import sweep_queries as sq
from quarryframe.plans.fixtures import Fixtures


def test_tracks_meet_objects_by_anchor(spark):
    objects = spark.createDataFrame([(1, 7, "a"), (1, 7, "b"), (1, 8, "c"), (2, 7, "d"), (3, None, "e"), (None, 7, "f")], "anchor_id long, instance_id long, name string")
    told = "n_future long, n_evidence long, slowest double, fastest double"
    tracks = spark.createDataFrame([(1, 7, 3, 2, 0.5, 1.5), (1, 9, 1, 1, 1.0, 1.0), (3, None, 4, 4, 2.0, 2.0), (None, 7, 5, 5, 2.0, 2.0)], f"anchor_id long, instance_id long, {told}")
    got = lb.with_tracks(objects, tracks)
    want = objects.join(tracks, ["anchor_id", "instance_id"], "left").na.fill(0, ["n_future", "n_evidence"])
    rows = lambda df: sorted(map(str, df.select("name", "anchor_id", "instance_id", "n_future", "n_evidence", "slowest", "fastest").collect()))
    assert rows(got) == rows(want)
    assert [r["n_future"] for r in got.where(F.col("name").isin("a", "b", "c", "d")).orderBy("name").collect()] == [3, 3, 0, 0]
    # the wide side is not dealt out by anchor and instance
    plan = lq.pool(Fixtures(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("[anchor_id") and "LeftOuter" in plan and not any("LeftOuter" in line and "instance_id" in line for line in plan.splitlines())


def test_the_self_check_builds_its_pool_once(spark, monkeypatch):
    calls, build = [], sq.pool
    monkeypatch.setattr(sq, "pool", lambda fx: calls.append(1) or build(fx))
    out = sq.self_check(Fixtures(spark, "/root/testdata/sf0.001"))
    assert len(calls) == 1
    assert "lineitem.parquet" not in out._jdf.queryExecution().executedPlan().toString()
