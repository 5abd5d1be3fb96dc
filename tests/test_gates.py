"""Gates in three-valued logic, the generator's draws, and statistics of one's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryframe.operators import gates as gt
from quarryframe.operators import statistics as st
from quarryframe.plans import registry

ALL = [gt.PARSE, gt.PRIMARY, gt.SECONDARY, *(g.metric for g in gt.GUARDS)]


def cells(spark, missing=(), **changes):
    """A run that passes everything; ``changes`` are (point_a, point_b, low, high) of a metric."""
    good = {gt.PARSE: (0.995, 0.99, 0.0, 0.01), gt.PRIMARY: (0.6, 0.5, 0.05, 0.15), gt.SECONDARY: (0.5, 0.5, -0.1, 0.1)}
    good |= {g.metric: (0.3, 0.3, -0.05, 0.05) for g in gt.GUARDS}
    rows = [(k, a, b, a - b, lo, hi) for k, (a, b, lo, hi) in (good | changes).items() if k not in missing]
    return spark.createDataFrame(rows, gt.CELLS)


def share(spark, value=0.5):
    return spark.createDataFrame([(value,)], "share double")


@pytest.mark.parametrize(
    "missing,changes,want",
    [
        ((), {}, True),
        ((), {gt.PARSE: (0.98, 0.9, 0.0, 0.0)}, False),
        ((), {gt.PARSE: (0.991, 0.992, 0.0, 0.0)}, False),
        ((), {gt.PRIMARY: (0.6, 0.5, 0.0, 0.2)}, False),
        ((), {gt.PRIMARY: (0.5, 0.5, -1.0, 0.2), gt.SECONDARY: (0.6, 0.5, 0.01, 0.2)}, True),
        *[((m,), {}, None) for m in (gt.PARSE, gt.PRIMARY, gt.SECONDARY)],
    ],
)
def test_main_gate(spark, missing, changes, want):
    got = gt.main_gate(cells(spark, missing, **changes)).first()
    assert (got["passed"], got["evaluated"]) == (want, want is not None)


@pytest.mark.parametrize("missing", [(), *[(g.metric,) for g in gt.GUARDS]])
def test_guards_with_each_input_missing(spark, missing):
    rows = gt.guard_rows(spark, cells(spark, missing), share(spark))
    got = gt.fold(rows).first()
    assert (got["passed"], got["evaluated"]) == ((True, True) if not missing else (None, False))
    unknown = {r["metric"] for r in rows.where("not evaluated").collect()}
    assert unknown == set(missing) | ({"constant_answer"} if missing and missing[0].startswith("action_flip") else set())


@pytest.mark.parametrize(
    "changes,majority,triggered",
    [
        ({"overconservative_yield_rate": (0.5, 0.3, 0.001, 0.3)}, 0.5, {"overconservative_yield_rate"}),
        ({"overconservative_stop_rate": (0.1, 0.3, -0.3, -0.1)}, 0.5, set()),
        ({"output_change_blank": (0.1, 0.3, -0.3, -0.001)}, 0.5, {"output_change_blank"}),
        ({"action_flip_shuffled": (0.29, 0.3, -0.1, 0.1)}, 0.5, {"constant_answer"}),
        ({}, 0.867, set()),
        ({}, 0.868, {"constant_answer"}),
    ],
)
def test_guards_that_are_triggered(spark, changes, majority, triggered):
    rows = gt.guard_rows(spark, cells(spark, **changes), share(spark, majority))
    assert {r["metric"] for r in rows.where("triggered").collect()} == triggered
    assert gt.fold(rows).first()["passed"] is (not triggered)


def test_guards_without_a_majority_share_or_anything(spark):
    assert gt.fold(gt.guard_rows(spark, cells(spark))).first()["passed"] is None
    none = cells(spark, ALL)
    assert gt.fold(gt.guard_rows(spark, none, share(spark))).first()["passed"] is None and gt.main_gate(none).first()["passed"] is None


def test_three_valued_and(spark):
    for values, want in (((True, True), True), ((True, None), None), ((False, None), False)):
        rows = spark.createDataFrame([(v,) for v in values], "passed boolean")
        assert rows.agg(gt.all_of(rows).alias("v")).first()["v"] is want


def test_paired_cells_leave_out_what_was_not_measured(spark):
    point = spark.createDataFrame([(0.5, 0.25, None, 1.0)], "a_x double, b_x double, a_y double, b_y double")
    reps = spark.createDataFrame([(0.5 + i / 100, 0.25, 1.0, 1.0) for i in range(41)], point.schema)
    got = gt.paired_cells(point, reps, ["x", "y"]).collect()
    assert [(r["metric"], r["delta"], round(r["delta_low"], 6), round(r["delta_high"], 6)) for r in got] == [("x", 0.25, 0.26, 0.64)]


def test_draws_of_the_generator(spark, monkeypatch):
    registry.on_workers(spark)
    monkeypatch.setattr(st, "STATE_EVERY", 35)  # several blocks
    for n, replicates, seed in ((10, 2, 0), (7, 23, 20260101), (1, 3, 5), (150, 4, 2**31)):
        want = np.random.RandomState(seed).randint(0, n, size=(replicates, n))
        got = {(r["replicate"], r["no"]): r["weight"] for r in st.mersenne_draws(spark, n, replicates, seed).collect()}
        assert got == {(b, k): int((row == k).sum()) for b, row in enumerate(want) for k in set(row.tolist())}
    stored = [5, 0, 3, 3, 7, 9, 3, 5, 2, 4]  # the first ten numbers below ten of seed 0
    first = {r["no"]: r["weight"] for r in st.mersenne_draws(spark, 10, 2, 0).where("replicate = 0").collect()}
    assert first == {k: stored.count(k) for k in set(stored)}
    assert st.mersenne_draws(spark, 0, 5, 1).collect() == []


def test_a_median_is_bootstrapped(spark):
    registry.on_workers(spark)
    rows = spark.createDataFrame([(f"s{i % 9}", float((i * 37) % 101)) for i in range(200)], "scene string, v double")
    draws = st.mersenne_draws(spark, 9, 12, 3)
    got = {r["replicate"]: r["value"] for r in st.plug_in_bootstrap(rows, "scene", lambda p: {"median": st.drawn_rows(p)["v"].median()}, draws).collect()}
    data = {}
    for i in range(200):
        data.setdefault(f"s{i % 9}", []).append(float((i * 37) % 101))
    matrix = np.random.RandomState(3).randint(0, 9, size=(12, 9))
    assert got == {b: float(np.median([v for k in row for v in data[f"s{k}"]])) for b, row in enumerate(matrix)}
    with pytest.raises(Exception, match="a replicate has the metrics"):
        st.plug_in_bootstrap(rows, "scene", lambda p: {f"v{int(p['weight'].max())}": 1.0}, draws, ["v1"]).collect()
    with pytest.raises(ValueError, match="at most"):
        st.MAX_PLUG_IN_ROWS, kept = 10, st.MAX_PLUG_IN_ROWS
        try:
            st.plug_in_bootstrap(rows, "scene", len, draws)
        finally:
            st.MAX_PLUG_IN_ROWS = kept
    assert st.plug_in_bootstrap(rows.where(F.lit(False)), "scene", len, draws).collect() == []


def test_plug_in_statistic_sees_equal_rows_once(spark, monkeypatch):
    monkeypatch.setattr(st, "MAX_PLUG_IN_ROWS", 10)
    # 300 rows, but seven distinct values
    rows = spark.range(300).selectExpr("concat('s', id % 9) AS scene", "cast(id % 7 AS double) AS v")
    draws = st.scene_weights(spark, 9, 12, "x")
    tell = lambda p: {"rows": len(p), "drawn": float(p["weight"].sum()), **{f"q{q}": st.weighted_quantile(p, "v", q) - st.drawn_rows(p)["v"].quantile(q) for q in (0, 0.1, 0.5, 0.77, 1)}}
    got = {(r["replicate"], r["metric"]): r["value"] for r in st.plug_in_bootstrap(rows, "scene", tell, draws).collect()}
    size = {f"s{k}": len(range(k, 300, 9)) for k in range(9)}
    want = {}
    for r in draws.collect():
        want[r["replicate"]] = want.get(r["replicate"], 0) + r["weight"] * size[f"s{r['no']}"]
    assert {b: v for (b, m), v in got.items() if m == "drawn"} == want
    assert {v for (_, m), v in got.items() if m == "rows"} == {7} and all(abs(v) < 1e-9 for (_, m), v in got.items() if m[0] == "q")


@pytest.mark.parametrize("bound", [1000, 3])
def test_packed_weights_give_the_plug_in_of_their_rows(spark, monkeypatch, bound):
    registry.on_workers(spark)
    monkeypatch.setattr(st, "DRAW_BLOCK", 4)  # three blocks
    monkeypatch.setattr(st, "MAX_BLOCK_ROWS", bound)
    rows = spark.range(300).selectExpr("concat('s', id % 9) AS scene", "CASE WHEN id % 7 > 0 THEN cast(id % 7 AS double) END AS v", "id % 2 = 0 AS even")
    tell = lambda p: {"rows": len(p), "drawn": float(p["weight"].sum()), "none": float(p["weight"][p["v"].isna()].sum()), "even": float(p["weight"][p["even"]].sum()), "median": st.weighted_quantile(p, "v", 0.5)}
    told = lambda draws: sorted(map(tuple, st.plug_in_bootstrap(rows, "scene", tell, draws).collect()))
    assert told(st.block_weights(spark, 9, 12, "x", 4)) == told(st.scene_weights(spark, 9, 12, "x"))
    assert st.plug_in_bootstrap(rows.where(F.lit(False)), "scene", tell, st.block_weights(spark, 0, 12, "x", 4)).collect() == []


def test_the_median_has_all_replicates(spark):
    got = registry.queries()["r1_plug_in_bootstrap"](spark, "/root/testdata/sf0.001").collect()
    assert {r["metric"]: r["n"] for r in got} == {"median": 2000, "spread": 2000}
