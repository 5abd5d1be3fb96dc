"""Queries over predictions and references: matching, confusion, rates, distributions, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryframe.functions import columns as c
from quarryframe.operators import matching as mt
from quarryframe.operators import metrics as me
from quarryframe.operators.percentiles import exact_percentiles
from quarryframe.plans.fixtures import Fixtures, duck
from quarryframe.plans.registry import query

_PAIRS = """cand AS (SELECT * FROM (SELECT [g.x1, g.y1, g.x2, g.y2] AS gb, [p.x1 + p.pred_dx, p.y1, p.x2 + p.pred_dx, p.y2] AS pb, g.anchor_id, g.category, g.obj_idx AS gi, p.obj_idx AS pi,
  greatest(0, least(g.x2, p.x2 + p.pred_dx) - greatest(g.x1, p.x1 + p.pred_dx)) * greatest(0, least(g.y2, p.y2) - greatest(g.y1, p.y1))::DOUBLE AS inter,
  (g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) AS areas, inter / (areas - inter) AS iou FROM fx_box g JOIN fx_box p ON g.anchor_id = p.anchor_id AND g.category = p.category) WHERE iou >= {tau})"""
# the recursive part takes the candidates of each (frame, category) in order
_MATCH = """, ord AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, category ORDER BY -iou, gb, pb, gi, pi) AS k FROM cand),
fold AS (SELECT anchor_id, category, k, [gi] AS gs, [pi] AS ps, [iou] AS ious FROM ord WHERE k = 1 UNION ALL
  SELECT anchor_id, category, ok, CASE WHEN t THEN list_append(gs, gi) ELSE gs END, CASE WHEN t THEN list_append(ps, pi) ELSE ps END, CASE WHEN t THEN list_append(ious, iou) ELSE ious END
  FROM (SELECT f.*, o.gi, o.pi, o.iou, o.k AS ok, NOT list_contains(f.gs, o.gi) AND NOT list_contains(f.ps, o.pi) AS t FROM fold f JOIN ord o ON o.anchor_id = f.anchor_id AND o.category = f.category AND o.k = f.k + 1)),
last AS (SELECT anchor_id, category, arg_max(gs, k) AS gs, arg_max(ps, k) AS ps, arg_max(ious, k) AS ious FROM fold GROUP BY 1, 2),
m AS (SELECT anchor_id, category, unnest(gs) AS gi, unnest(ps) AS pi, unnest(ious) AS iou FROM last)"""


def matched_sql(final: str, tau: float = 0.5) -> str:
    return duck(f"WITH RECURSIVE {_PAIRS.replace('{tau}', str(tau))}{_MATCH} {final}", "fx_box")


def matches(fx: Fixtures, tau: float = 0.5) -> DataFrame:
    return mt.greedy_match(mt.candidate_pairs(fx.view("fx_box"), tau))


@query("j6_candidate_pairs", duck(f"WITH {_PAIRS.replace('{tau}', '0.5')} SELECT anchor_id, category, gi, pi, round(iou, 9) AS iou FROM cand", "fx_box"))
def candidate_pairs(fx: Fixtures) -> DataFrame:
    return mt.candidate_pairs(fx.view("fx_box")).select("anchor_id", "category", "gi", "pi", F.round("iou", 9).alias("iou"))


@query("d15_greedy_matching", matched_sql("SELECT anchor_id, category, CAST(gi AS BIGINT) AS gi, CAST(pi AS BIGINT) AS pi, round(iou, 9) AS iou FROM m"))
def greedy_matching(fx: Fixtures) -> DataFrame:
    return matches(fx).withColumn("iou", F.round("iou", 9))


@query("o3_greedy_order", duck(f"WITH {_PAIRS.replace('{tau}', '0.5')} SELECT anchor_id, category, string_agg(gi || '-' || pi, ',' ORDER BY -iou, gb, pb, gi, pi) AS pairs FROM cand GROUP BY 1, 2", "fx_box"))
def greedy_order(fx: Fixtures) -> DataFrame:
    pairs = mt.candidate_pairs(fx.view("fx_box")).groupBy("anchor_id", "category")
    ordered = pairs.agg(mt.greedy_order().alias("p"))
    return ordered.select("anchor_id", "category", F.array_join(F.transform("p", lambda x: F.concat_ws("-", x["gi"].cast("string"), x["pi"].cast("string"))), ",").alias("pairs"))


def micro(fx: Fixtures, tau: float) -> DataFrame:
    n = fx.view("fx_box").agg(F.count(F.lit(1)).alias("n"))
    tp = matches(fx, tau).agg(F.count(F.lit(1)).alias("tp"))
    out = tp.crossJoin(n).select(F.lit(tau).alias("tau"), "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("n") - F.col("tp")).alias("fn"))
    return out.withColumn("f1", F.round(c.f1(F.col("tp"), F.col("fp"), F.col("fn")), 9))


@query("a1_micro_counts", matched_sql("SELECT 0.5::DOUBLE AS tau, tp, n - tp AS fp, n - tp AS fn, round(2 * tp / (2 * tp + (n - tp) * 2), 9) AS f1 FROM (SELECT count(*) AS n FROM fx_box), (SELECT count(*) AS tp FROM m)"))
def micro_counts(fx: Fixtures) -> DataFrame:
    return micro(fx, 0.5)


@query("a2_category_counts", matched_sql("SELECT category, coalesce(t, 0) AS tp, n - coalesce(t, 0) AS fp, n - coalesce(t, 0) AS fn FROM (SELECT category, count(*) AS n FROM fx_box GROUP BY 1) LEFT JOIN (SELECT category, count(*) AS t FROM m GROUP BY 1) USING (category)"))
def category_counts(fx: Fixtures) -> DataFrame:
    tp = matches(fx).groupBy("category").agg(F.count(F.lit(1)).alias("t"))
    n = fx.view("fx_box").groupBy("category").agg(F.count(F.lit(1)).alias("n")).join(tp, "category", "left")
    rest = (F.col("n") - F.coalesce("t", F.lit(0)))
    return n.select("category", F.coalesce("t", F.lit(0)).alias("tp"), rest.alias("fp"), rest.alias("fn"))


@query("a14_iou_percentiles", matched_sql("SELECT count(*) AS n, round(avg(iou), 6) AS mean, round(quantile_cont(iou, 0.5), 6) AS median, round(quantile_cont(iou, 0.9), 6) AS p90 FROM m"))
def iou_percentiles(fx: Fixtures) -> DataFrame:
    rows = matches(fx).select("iou")
    told = exact_percentiles(rows, "iou", [0.5, 0.9])
    p = lambda q: F.round(F.coalesce(F.max(F.when(F.col("probability") == q, F.col("value"))), F.lit(0.0)), 6)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("iou"), 6).alias("mean")).crossJoin(told.agg(p(0.5).alias("median"), p(0.9).alias("p90")))


# -- actions and yields ------------------------------------------------------------------------------------------


def parsed(fx: Fixtures) -> DataFrame:
    return fx.view("fx_anchor").where("parse_ok")


@query("f6_parse_ok", duck("SELECT count(*) AS expected, count(*) FILTER (parse_ok) AS ok, round(count(*) FILTER (parse_ok) / count(*), 9) AS parse_rate FROM fx_anchor", "fx_anchor"))
def parse_ok(fx: Fixtures) -> DataFrame:
    ok = c.total(F.col("parse_ok"))
    return fx.view("fx_anchor").agg(F.count(F.lit(1)).alias("expected"), ok.alias("ok"), F.round(c.ratio(ok, F.count(F.lit(1))), 9).alias("parse_rate"))


@query("a4_confusion", duck("SELECT gt_action AS gt, pred_action AS pred, count(*) AS n FROM fx_anchor WHERE parse_ok GROUP BY 1, 2", "fx_anchor"))
def confusion(fx: Fixtures) -> DataFrame:
    return me.confusion(parsed(fx), "gt_action", "pred_action")


_FOUR = "(VALUES ('ACCELERATE'), ('DECELERATE'), ('KEEP_SPEED'), ('STOP'))"


@query("a5_full_confusion", duck(f"SELECT a AS gt, b AS pred, (SELECT count(*) FROM fx_anchor WHERE parse_ok AND gt_yield AND gt_action = a AND pred_action = b) AS n FROM {_FOUR} v(a), {_FOUR} w(b)", "fx_anchor"))
def full_confusion(fx: Fixtures) -> DataFrame:
    return me.full_confusion(me.confusion(parsed(fx).where("gt_yield"), "gt_action", "pred_action"), c.ACTIONS)


_OVR = f"""SELECT a AS cls, count(*) FILTER (gt_action = a AND pred_action = a) AS tp, count(*) FILTER (gt_action <> a AND pred_action = a) AS fp, count(*) FILTER (gt_action = a AND pred_action <> a) AS fn FROM fx_anchor, {_FOUR} v(a) WHERE parse_ok GROUP BY 1"""


@query("a6_class_f1", duck(f"SELECT *, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM ({_OVR})", "fx_anchor"))
def class_f1(fx: Fixtures) -> DataFrame:
    return me.one_versus_rest(me.confusion(parsed(fx), "gt_action", "pred_action")).withColumn("f1", F.round("f1", 9))


@query("a3_macro_f1", duck(f"SELECT round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END), 9) AS macro_f1 FROM ({_OVR})", "fx_anchor"))
def macro_f1(fx: Fixtures) -> DataFrame:
    return me.one_versus_rest(me.confusion(parsed(fx), "gt_action", "pred_action")).agg(F.round(F.avg("f1"), 9).alias("macro_f1"))


_BIN = "SELECT count(*) FILTER (gt_yield AND pred_yield) AS tp, count(*) FILTER (NOT gt_yield AND pred_yield) AS fp, count(*) FILTER (gt_yield AND NOT pred_yield) AS fn, count(*) FILTER (NOT gt_yield AND NOT pred_yield) AS tn FROM fx_anchor WHERE parse_ok"


def yields(fx: Fixtures) -> DataFrame:
    return parsed(fx).agg(*me.binary_counts(F.col("gt_yield"), F.col("pred_yield")))


@query("a7_binary_counts", duck(_BIN, "fx_anchor"))
def binary_counts(fx: Fixtures) -> DataFrame:
    return yields(fx)


@query("a10_direction_rates", duck(f"SELECT round(fn / (tp + fn), 9) AS miss_rate, round(fp / (fp + tn), 9) AS over_rate FROM ({_BIN})", "fx_anchor"))
def direction_rates(fx: Fixtures) -> DataFrame:
    return me.direction_rates(yields(fx)).select(F.round("miss_rate", 9).alias("miss_rate"), F.round("over_rate", 9).alias("over_rate"))


@query("a9_overconservative", duck("SELECT count(*) FILTER (NOT gt_yield AND pred_yield) AS over_yield, count(*) FILTER (gt_action <> 'STOP' AND pred_action = 'STOP') AS over_stop, count(*) FILTER (gt_action = 'STOP' AND pred_action <> 'STOP') AS missed_stop FROM fx_anchor WHERE parse_ok", "fx_anchor"))
def overconservative(fx: Fixtures) -> DataFrame:
    g, p = F.col("gt_action") == "STOP", F.col("pred_action") == "STOP"
    return parsed(fx).agg(c.total(~F.col("gt_yield") & F.col("pred_yield")).alias("over_yield"), c.total(~g & p).alias("over_stop"), c.total(g & ~p).alias("missed_stop"))


_SETS = "SELECT anchor_id, list(DISTINCT category) AS gt, list(DISTINCT category) FILTER (obj_idx % 2 = 0) AS pred FROM fx_box GROUP BY 1"


@query("a8_multilabel_counts", duck(f"SELECT k, count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM (SELECT k, list_contains(gt, k) AS g, coalesce(list_contains(pred, k), false) AS p FROM ({_SETS}), (VALUES ('k0'), ('k1'), ('k2')) v(k)) GROUP BY 1", "fx_box"))
def multilabel_counts(fx: Fixtures) -> DataFrame:
    """Set-valued labels against a fixed vocabulary: one pass with conditional counts."""
    sets = fx.view("fx_box").groupBy("anchor_id").agg(F.collect_set("category").alias("gt"), F.collect_set(F.when(F.col("obj_idx") % 2 == 0, F.col("category"))).alias("pred"))
    labels = ("k0", "k1", "k2")
    has = lambda s, k: F.array_contains(s, k)
    cells = [(c.total(has("gt", k) & has("pred", k)).alias(f"tp{k}"), c.total(~has("gt", k) & has("pred", k)).alias(f"fp{k}"), c.total(has("gt", k) & ~has("pred", k)).alias(f"fn{k}")) for k in labels]
    flat = sets.agg(*(x for row in cells for x in row))
    return flat.select(F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"tp{k}").alias("tp"), F.col(f"fp{k}").alias("fp"), F.col(f"fn{k}").alias("fn")) for k in labels))))


@query("a11_empty_cells", duck("SELECT count(*) FILTER (g = 0 AND p = 0) AS both_empty, count(*) FILTER (g = 0 AND p > 0) AS hallucinated, count(*) FILTER (g > 0 AND p = 0) AS missed, count(*) FILTER (g > 0 AND p > 0) AS both_full FROM (SELECT count(*) FILTER (category = 'k0') AS g, count(*) FILTER (category = 'k1') AS p FROM fx_box GROUP BY anchor_id)", "fx_box"))
def empty_cells(fx: Fixtures) -> DataFrame:
    sides = fx.view("fx_box").groupBy("anchor_id").agg(c.total(F.col("category") == "k0").alias("g"), c.total(F.col("category") == "k1").alias("p"))
    g, p = F.col("g") > 0, F.col("p") > 0
    return sides.agg(c.total(~g & ~p).alias("both_empty"), c.total(~g & p).alias("hallucinated"), c.total(g & ~p).alias("missed"), c.total(g & p).alias("both_full"))


@query("a12_cardinality", duck("WITH n AS (SELECT least(count(*), 12) AS k FROM fx_box GROUP BY anchor_id) SELECT r.k, count(n.k) AS n FROM range(0, 13) r(k) LEFT JOIN n USING (k) GROUP BY 1", "fx_box"))
def cardinality(fx: Fixtures) -> DataFrame:
    return me.capped_histogram(fx.view("fx_box").groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n_obj")), "n_obj", 12)


@query("a15_nearest_rank", duck("WITH h AS (SELECT CAST(l_quantity AS BIGINT) AS v, count(*) AS c FROM lineitem GROUP BY 1), r AS (SELECT v, sum(c) OVER (ORDER BY v) AS run, sum(c) OVER () AS a FROM h) SELECT min(v) AS value FROM r WHERE run >= greatest(1, round_even(a * 0.9, 0))"))
def nearest_rank(fx: Fixtures) -> DataFrame:
    return me.nearest_rank(fx.table("lineitem").select(F.col("l_quantity").cast("long").alias("v")), "v", 0.9)


_COSTS = "count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(max(value), 6) AS largest, round(sum(value), 4) AS total, round(count(*) / sum(value), 9) AS per_unit"


@query("a19_cost_summary", f"SELECT event_type, {_COSTS} FROM events GROUP BY 1 UNION ALL SELECT '*', {_COSTS} FROM events")
def cost_summary(fx: Fixtures) -> DataFrame:
    """Median, 90th percentile, largest, sum and rows per unit of the costs of each kind and of all."""
    rows = fx.table("events").select(F.explode(F.array("event_type", F.lit("*"))).alias("event_type"), "value")
    n = F.count(F.lit(1))
    sums = rows.groupBy("event_type").agg(n.alias("n"), F.round(F.max("value"), 6).alias("largest"), F.round(F.sum("value"), 4).alias("total"), F.round(n / F.sum("value"), 9).alias("per_unit"))
    told = exact_percentiles(rows, "value", [0.5, 0.9], ["event_type"])
    p = lambda q: F.round(F.max(F.when(F.col("probability") == q, F.col("value"))), 6)
    return sums.join(F.broadcast(told.groupBy("event_type").agg(p(0.5).alias("p50"), p(0.9).alias("p90"))), "event_type")


@query("a20_label_distribution", duck("SELECT coalesce(split, '*') AS split, coalesce(gt_action, '*') AS gt_action, count(*) AS n, count(*) FILTER (gt_yield) AS n_yield FROM (SELECT *, CASE WHEN anchor_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM fx_anchor) GROUP BY CUBE (split, gt_action)", "fx_anchor"))
def label_distribution(fx: Fixtures) -> DataFrame:
    rows = fx.view("fx_anchor").withColumn("split", F.when(F.col("anchor_id") % 5 == 0, "val").otherwise("train"))
    out = rows.cube("split", "gt_action").agg(F.count(F.lit(1)).alias("n"), c.total(F.col("gt_yield")).alias("n_yield"))
    return out.withColumns({k: F.coalesce(k, F.lit("*")) for k in ("split", "gt_action")})


@query("a26_majority_class", duck("SELECT scene_token, arg_max(gt_action, (n, gt_action)) AS gt_action, round(max(n) / sum(n), 9) AS share FROM (SELECT scene_token, gt_action, count(*) AS n FROM fx_anchor GROUP BY 1, 2) GROUP BY 1", "fx_anchor"))
def majority_class(fx: Fixtures) -> DataFrame:
    return me.majority(fx.view("fx_anchor"), "scene_token", "gt_action").withColumn("share", F.round("share", 9))


@query("a30_status_counts", duck("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1"))
def status_counts(fx: Fixtures) -> DataFrame:
    return fx.table("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("d5_speed_action", duck(
    """WITH s AS (SELECT l_orderkey AS anchor_id, list((l_quantity - 1) / 5 ORDER BY l_quantity) AS v FROM lineitem GROUP BY 1), a AS (SELECT o_orderkey AS anchor_id, (o_orderkey % 20) / 2.0::DOUBLE AS v0, coalesce(v, []) AS v FROM orders LEFT JOIN s ON s.anchor_id = o_orderkey)
SELECT CASE WHEN len(v) = 0 THEN 'KEEP_SPEED' WHEN list_min(v) < 0.5 THEN 'STOP' WHEN list_min(v) < v0 * 0.85 THEN 'DECELERATE' WHEN list_max(v) > v0 * 1.15 THEN 'ACCELERATE' ELSE 'KEEP_SPEED' END AS action, count(*) AS n FROM a GROUP BY 1"""))
def speed_action(fx: Fixtures) -> DataFrame:
    speeds = fx.table("lineitem").groupBy(F.col("l_orderkey").alias("anchor_id")).agg(F.collect_list((F.col("l_quantity") - 1) / 5).alias("v"))
    rows = fx.table("orders").select(F.col("o_orderkey").alias("anchor_id"), ((F.col("o_orderkey") % 20) / 2).alias("v0")).join(speeds, "anchor_id", "left")
    v = F.coalesce("v", F.expr("cast(array() as array<double>)"))
    return rows.groupBy(c.speed_action(F.col("v0"), v).alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("d19_counterfactual_flips", duck("SELECT count(*) AS n_compared, round(count(*) FILTER (a.pred_action <> b.pred_action) / count(*), 9) AS action_flip FROM fx_anchor a JOIN fx_anchor b ON b.anchor_id = a.anchor_id + 1 WHERE a.parse_ok AND b.parse_ok", "fx_anchor"))
def counterfactual_flips(fx: Fixtures) -> DataFrame:
    """Main run against a counterfactual one (here: the neighbouring anchor), where both parsed."""
    a = parsed(fx).select("anchor_id", "pred_action")
    b = a.select((F.col("anchor_id") - 1).alias("anchor_id"), F.col("pred_action").alias("other"))
    return a.join(b, "anchor_id").agg(F.count(F.lit(1)).alias("n_compared"), F.round(c.ratio(c.total(F.col("pred_action") != F.col("other")), F.count(F.lit(1))), 9).alias("action_flip"))


@query("d21_self_diagnosis", duck("SELECT count(*) FILTER (parse_ok) / count(*) >= 0.99 AS parse_gate, count(*) FILTER (anchor_id % 97 = 0) / count(*) <= 0.01 AS truncation_gate FROM fx_anchor", "fx_anchor"))
def self_diagnosis(fx: Fixtures) -> DataFrame:
    n = F.count(F.lit(1))
    return fx.view("fx_anchor").agg((c.ratio(c.total(F.col("parse_ok")), n) >= 0.99).alias("parse_gate"), (c.ratio(c.total(F.col("anchor_id") % 97 == 0), n) <= 0.01).alias("truncation_gate"))
