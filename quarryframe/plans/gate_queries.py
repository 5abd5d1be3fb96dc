"""Two systems on the same anchors: paired differences, the main gate and the guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryframe.functions import columns as c
from quarryframe.operators import evaluation as ev
from quarryframe.operators import gates as gt
from quarryframe.operators import matching as mt
from quarryframe.operators import metrics as me
from quarryframe.operators import statistics as st
from quarryframe.plans.fixtures import Fixtures, duck
from quarryframe.plans.metric_queries import _MATCH, _PAIRS
from quarryframe.plans.registry import query
from quarryframe.plans.sequence_queries import _B, _WEIGHTS
from quarryframe.sources import io

# The second system's answers, and both systems' answers to changed images, as text for both engines.
_ACTION = "CASE {} % 4 WHEN 0 THEN 'STOP' WHEN 1 THEN 'DECELERATE' WHEN 2 THEN 'KEEP_SPEED' ELSE 'ACCELERATE' END"
_SYSTEMS = {
    "act_a": "pred_action", "act_b": _ACTION.format("(anchor_id * 3)"), "yield_a": "pred_yield", "yield_b": "anchor_id % 10 < 4", "ok_a": "parse_ok", "ok_b": "anchor_id % 19 <> 0",
    "blank_a": _ACTION.format("(anchor_id * 11 + anchor_id % 3)"), "blank_b": _ACTION.format("(anchor_id * 3 + anchor_id % 2)"), "shuffled_a": _ACTION.format("(anchor_id * 11 + anchor_id % 5)"), "shuffled_b": _ACTION.format("(anchor_id * 3 + anchor_id % 7)"),
    "yblank_a": "(anchor_id * 7) % 10 < 4", "yblank_b": "anchor_id % 10 < 4", "yshuffled_a": "(anchor_id * 7) % 10 < 3", "yshuffled_b": "anchor_id % 10 < 6",
}
_ROWS = f"SELECT anchor_id, scene_token, gt_action, gt_yield, {', '.join(f'{v} AS {k}' for k, v in _SYSTEMS.items())} FROM fx_anchor"
_COUNTS = ["n"]
for _s in "ab":
    _COUNTS += [f"ok_{_s}", f"tp_{_s}", f"boxes_{_s}", f"yneg_{_s}", f"yover_{_s}", f"go_{_s}", f"gostop_{_s}"] + [f"{k}{i}_{_s}" for i in range(4) for k in ("atp", "afp", "afn")] + [f"{k}_{t}_{_s}" for t in gt.TRANSFORMS for k in ("flip", "change")]
METRICS = [gt.PARSE, gt.PRIMARY, gt.SECONDARY, *(g.metric for g in gt.GUARDS)]


def systems(fx: Fixtures) -> DataFrame:
    fx.view("fx_anchor").createOrReplaceTempView("fx_anchor")
    return fx.spark.sql(_ROWS)


def scene_counts(fx: Fixtures) -> DataFrame:
    """Additive counts of both systems for each scene."""
    boxes = mt.matched_boxes(fx.view("fx_box").withColumn("category", F.lower(F.trim("category"))), ev.TAUS[0])
    hits = boxes.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("boxes"), c.total(F.col("iou") >= 0.5).alias("hit_a"), c.total(F.col("iou") >= 0.7).alias("hit_b"))
    # what the answers are made from is shuffled, and not the counts of each anchor
    rows = fx.view("fx_anchor").select("anchor_id", "scene_token", "gt_action", "gt_yield", "pred_action", "pred_yield", "parse_ok").join(hits, "anchor_id", "left").repartition("scene_token")
    rows = rows.selectExpr("anchor_id", "scene_token", "gt_action", "gt_yield", *(f"{v} AS {k}" for k, v in _SYSTEMS.items()), *(f"CASE WHEN parse_ok THEN coalesce({k}, 0) ELSE 0 END AS {k}" for k in ("boxes", "hit_a", "hit_b")))
    counts = {"n": F.count(F.lit(1))}
    for s in "ab":
        ok, act, yields = F.col(f"ok_{s}"), F.col(f"act_{s}"), F.col(f"yield_{s}")
        count = lambda cond, ok=ok: c.total(ok & cond)
        go = F.col("gt_action").isin(*ev.GO)
        counts |= {f"ok_{s}": c.total(ok), f"tp_{s}": F.sum(f"hit_{s}"), f"boxes_{s}": F.sum("boxes"), f"yneg_{s}": count(~F.col("gt_yield")), f"yover_{s}": count(~F.col("gt_yield") & yields), f"go_{s}": count(go), f"gostop_{s}": count(go & (act == "STOP"))}
        for i, a in enumerate(c.ACTIONS):
            counts |= {f"atp{i}_{s}": count((F.col("gt_action") == a) & (act == a)), f"afp{i}_{s}": count((F.col("gt_action") != a) & (act == a)), f"afn{i}_{s}": count((F.col("gt_action") == a) & (act != a))}
        for t in gt.TRANSFORMS:
            flips = act != F.col(f"{t}_{s}")
            counts |= {f"flip_{t}_{s}": count(flips), f"change_{t}_{s}": count(flips | (yields != F.col(f"y{t}_{s}")))}
    return rows.groupBy("scene_token").agg(*(v.alias(k) for k, v in counts.items()))


def metric_columns(totals: DataFrame) -> DataFrame:
    """``a_<metric>`` and ``b_<metric>`` of summed counts."""
    out = {}
    for s in "ab":
        n = lambda k, s=s: F.col(f"{k}_{s}")
        scores = [c.f1(n(f"atp{i}"), n(f"afp{i}"), n(f"afn{i}")) for i in range(4)]
        missed = n("boxes") - n("tp")
        out |= {f"{s}_{gt.PARSE}": c.ratio(n("ok"), F.col("n")), f"{s}_{gt.PRIMARY}": c.f1(n("tp"), missed, missed), f"{s}_{gt.SECONDARY}": ev.mean_of(scores)}
        out |= {f"{s}_overconservative_yield_rate": c.ratio(n("yover"), n("yneg")), f"{s}_overconservative_stop_rate": c.ratio(n("gostop"), n("go"))}
        out |= {f"{s}_{change}_{t}": c.ratio(n(f"{k}_{t}"), n("ok")) for k, change in zip(("flip", "change"), gt.CHANGES, strict=True) for t in gt.TRANSFORMS}
    return totals.select(*(v.alias(k) for k, v in out.items()))


def cells(fx: Fixtures) -> DataFrame:
    counts = io.written(scene_counts(fx), "scene-counts")
    totals = st.resampled_totals(counts, "scene_token", _COUNTS, _B, "seed")
    # a row for each metric
    return io.written(gt.paired_cells(metric_columns(counts.agg(*(F.sum(k).alias(k) for k in _COUNTS))), metric_columns(totals), METRICS), "cells")


_F = lambda s, i: f"CASE WHEN atp{i}_{s} = 0 THEN 0 ELSE 2 * atp{i}_{s} / (2 * atp{i}_{s} + afp{i}_{s} + afn{i}_{s}) END"
_R = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE {a} / {b} END"


def _sql_metrics(s: str) -> dict[str, str]:
    out = {gt.PARSE: _R(f"ok_{s}", "n"), gt.PRIMARY: _R(f"tp_{s}", f"boxes_{s}"), gt.SECONDARY: f"({' + '.join(_F(s, i) for i in range(4))}) / 4"}
    out |= {"overconservative_yield_rate": _R(f"yover_{s}", f"yneg_{s}"), "overconservative_stop_rate": _R(f"gostop_{s}", f"go_{s}")}
    return out | {f"{change}_{t}": _R(f"{k}_{t}_{s}", f"ok_{s}") for k, change in zip(("flip", "change"), gt.CHANGES, strict=True) for t in gt.TRANSFORMS}


def _sql_counts() -> str:
    parts = ["count(*) AS n"]
    for s in "ab":
        on = lambda cond, s=s: f"count(*) FILTER (ok_{s} AND ({cond}))"
        go = "gt_action IN ('KEEP_SPEED', 'ACCELERATE')"
        parts += [f"count(*) FILTER (ok_{s}) AS ok_{s}", f"sum(coalesce(hit_{s}, 0)) AS tp_{s}", f"sum(coalesce(boxes, 0)) AS boxes_{s}", f"{on('NOT gt_yield')} AS yneg_{s}", f"{on(f'NOT gt_yield AND yield_{s}')} AS yover_{s}", f"{on(go)} AS go_{s}", f"{on(f'{go} AND act_{s} = ' + repr('STOP'))} AS gostop_{s}"]
        for i, a in enumerate(c.ACTIONS):
            parts += [f"{on(f'gt_action = {a!r} AND act_{s} = {a!r}')} AS atp{i}_{s}", f"{on(f'gt_action <> {a!r} AND act_{s} = {a!r}')} AS afp{i}_{s}", f"{on(f'gt_action = {a!r} AND act_{s} <> {a!r}')} AS afn{i}_{s}"]
        for t in gt.TRANSFORMS:
            parts += [f"{on(f'act_{s} <> {t}_{s}')} AS flip_{t}_{s}", f"{on(f'act_{s} <> {t}_{s} OR yield_{s} <> y{t}_{s}')} AS change_{t}_{s}"]
    return ", ".join(parts)


_VALUES = ", ".join(f"{v} AS {s}_{k}" for s in "ab" for k, v in _sql_metrics(s).items())
_CELLS = f"""bx AS (SELECT b.* FROM fx_box b JOIN fx_anchor a USING (anchor_id) WHERE parse_ok), {_PAIRS.replace('{tau}', '0.3').replace('fx_box', 'bx')}{_MATCH}, sy AS ({_ROWS}),
ct AS (SELECT scene_token, {_sql_counts()} FROM sy LEFT JOIN (SELECT anchor_id, count(*) AS boxes FROM bx GROUP BY 1) USING (anchor_id) LEFT JOIN (SELECT anchor_id, count(*) FILTER (iou >= 0.5) AS hit_a, count(*) FILTER (iou >= 0.7) AS hit_b FROM m GROUP BY 1) USING (anchor_id) GROUP BY 1),
{(_WEIGHTS % _B).replace(' WHERE parse_ok', '')}, pt AS (SELECT {_VALUES} FROM (SELECT {', '.join(f'sum({k}) AS {k}' for k in _COUNTS)} FROM ct)), rp AS (SELECT {_VALUES} FROM (SELECT replicate, {', '.join(f'sum(weight * {k}) AS {k}' for k in _COUNTS)} FROM wt JOIN ct USING (scene_token) GROUP BY 1)),
cl AS ({' UNION ALL '.join(f"SELECT '{k}' AS metric, any_value(pt.a_{k}) AS point_a, any_value(pt.b_{k}) AS point_b, any_value(pt.a_{k} - pt.b_{k}) AS delta, quantile_cont(rp.a_{k} - rp.b_{k}, 0.025) AS delta_low, quantile_cont(rp.a_{k} - rp.b_{k}, 0.975) AS delta_high FROM pt, rp" for k in METRICS)})"""


def gate_sql(text: str) -> str:
    return duck(f"WITH RECURSIVE {_CELLS}{text}", "fx_anchor", "fx_box")


@query("r3_paired_cells", gate_sql(" SELECT metric, round(point_a, 6) AS point_a, round(point_b, 6) AS point_b, round(delta, 6) AS delta, round(delta_low, 6) AS delta_low, round(delta_high, 6) AS delta_high FROM cl"))
def paired_cells(fx: Fixtures) -> DataFrame:
    """Nine metrics of two systems with their difference and its interval, under the same draws of scenes."""
    return cells(fx).select("metric", *(F.round(k, 6).alias(k) for k in ("point_a", "point_b", "delta", "delta_low", "delta_high")))


_SHARE = "(SELECT max(n) / sum(n) AS share FROM (SELECT count(*) AS n FROM sy WHERE ok_a GROUP BY act_a))"
_GUARD_ROWS = ", ".join(f"('{g.metric}', '{g.direction}')" for g in gt.GUARDS)
_FLIPS = ", ".join(f"'{gt.CHANGES[0]}_{t}'" for t in gt.TRANSFORMS)
# once with all metrics, and once without the shuffled images
_GUARDS = f""", cs AS (SELECT 'whole' AS run, * FROM cl UNION ALL SELECT 'no_shuffled', * FROM cl WHERE metric NOT LIKE '%shuffled'), runs AS (SELECT unnest(['whole', 'no_shuffled']) AS run),
gr AS (SELECT run, g.metric, delta IS NOT NULL AS evaluated, CASE WHEN direction = 'higher_is_worse' THEN delta_low > 0 ELSE delta_high < 0 END AS triggered FROM runs CROSS JOIN (VALUES {_GUARD_ROWS}) g(metric, direction) LEFT JOIN cs USING (run, metric)
UNION ALL SELECT run, 'constant_answer', count(*) FILTER (metric IN ({_FLIPS})) = {len(gt.TRANSFORMS)}, CASE WHEN count(*) FILTER (metric IN ({_FLIPS})) = {len(gt.TRANSFORMS)} THEN NOT ((SELECT share FROM {_SHARE}) <= {gt.MAJORITY_CEILING} AND bool_and(point_a >= point_b) FILTER (metric IN ({_FLIPS}))) END FROM cs GROUP BY 1)"""


def both_runs(fx: Fixtures) -> list[tuple[str, DataFrame]]:
    told = cells(fx)
    return [("whole", told), ("no_shuffled", told.where("metric not like '%shuffled'"))]


def guards(fx: Fixtures, told: DataFrame) -> DataFrame:
    share = me.majority(systems(fx).where("ok_a").withColumn("all", F.lit(1)), "all", "act_a")
    return gt.guard_rows(fx.spark, told, share)


@query("d20_guard_rows", gate_sql(f"{_GUARDS} SELECT run, metric, evaluated, triggered FROM gr"))
def guard_rows(fx: Fixtures) -> DataFrame:
    """Each guard over the paired differences, with all inputs and without those of one transform."""
    parts = [guards(fx, told).select(F.lit(run).alias("run"), "metric", "evaluated", "triggered") for run, told in both_runs(fx)]
    return parts[0].unionByName(parts[1])


@query(
    "d20_verdicts",
    gate_sql(
        f"""{_GUARDS} SELECT run, 'guards' AS gate, bool_and(evaluated) AS evaluated, CASE WHEN bool_and(evaluated) THEN NOT coalesce(bool_or(triggered), false) END AS passed FROM gr GROUP BY 1
UNION ALL SELECT run, 'main', true, max(point_a) FILTER (metric = '{gt.PARSE}') >= greatest({gt.PARSE_FLOOR}, max(point_b) FILTER (metric = '{gt.PARSE}')) AND (max(delta_low) FILTER (metric = '{gt.PRIMARY}') > 0 OR max(delta_low) FILTER (metric = '{gt.SECONDARY}') > 0) FROM cs GROUP BY 1"""
    ),
)
def verdicts(fx: Fixtures) -> DataFrame:
    """The main gate and the folded guards: a missing input leaves the guards undecided."""
    parts = [gt.fold(guards(fx, told)).unionByName(gt.main_gate(told)).select(F.lit(run).alias("run"), "gate", "evaluated", "passed") for run, told in both_runs(fx)]
    return parts[0].unionByName(parts[1])


@query(
    "d19_change_rates",
    duck(
        f"""WITH sy AS ({_ROWS}) SELECT transform, count(*) AS n_compared, round(count(*) FILTER (act_a <> act) / count(*), 9) AS action_flip, round(count(*) FILTER (act_a <> act OR yield_a <> y) / count(*), 9) AS output_change
FROM (SELECT 'blank' AS transform, act_a, yield_a, blank_a AS act, yblank_a AS y FROM sy WHERE ok_a AND anchor_id % 29 <> 0 UNION ALL SELECT 'shuffled', act_a, yield_a, shuffled_a, yshuffled_a FROM sy WHERE ok_a AND anchor_id % 31 <> 0) GROUP BY 1""",
        "fx_anchor",
    ),
)
def change_rates(fx: Fixtures) -> DataFrame:
    """Shares of actions and of whole outputs that change with the image, where both runs parsed."""
    rows = systems(fx)
    runs = []
    for t, skipped in zip(gt.TRANSFORMS, (29, 31), strict=True):
        other = rows.where(F.col("anchor_id") % skipped != 0).select("anchor_id", F.col(f"{t}_a").alias("act"), F.col(f"y{t}_a").alias("y"))
        runs.append(rows.where("ok_a").select("anchor_id", "act_a", "yield_a").join(other, "anchor_id").withColumn("transform", F.lit(t)))
    flip, change = F.col("act_a") != F.col("act"), F.col("yield_a") != F.col("y")
    n = F.count(F.lit(1))
    return runs[0].unionByName(runs[1]).groupBy("transform").agg(n.alias("n_compared"), F.round(c.ratio(c.total(flip), n), 9).alias("action_flip"), F.round(c.ratio(c.total(flip | change), n), 9).alias("output_change"))
