"""Queries over keyframe sequences: walks, windows, records, splits, samples, bootstrap."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryframe.functions.columns import f1, total
from quarryframe.operators import statistics as st
from quarryframe.operators import windows as w
from quarryframe.operators.metrics import ci_gate
from quarryframe.plans.fixtures import Fixtures, duck
from quarryframe.plans.registry import query

_W = "PARTITION BY scene_token ORDER BY timestamp_us, sample_id"
_WINDOWED = f"""SELECT *, count(*) OVER h AS k, min(CAST(has_camera AS INT)) OVER h AS cam, min(CAST(has_image AS INT)) OVER h AS img,
  timestamp_us - lag(timestamp_us) OVER ({_W}) AS g1, lag(timestamp_us, 1) OVER ({_W}) - lag(timestamp_us, 2) OVER ({_W}) AS g2,
  lag(timestamp_us, 2) OVER ({_W}) - lag(timestamp_us, 3) OVER ({_W}) AS g3 FROM fx_keyframe WINDOW h AS ({_W} ROWS 3 PRECEDING)"""
_REASON = """CASE WHEN k < 4 THEN 'INSUFFICIENT_HISTORY' WHEN cam = 0 THEN 'NO_CAM_FRONT' WHEN least(g1, g2, g3) <= 0 THEN 'NON_INCREASING_TIME'
  WHEN greatest(g1, g2, g3) > 90000000000 THEN 'BAD_GAP' WHEN img = 0 THEN 'MISSING_IMAGE' WHEN NOT has_calibration THEN 'MISSING_CALIBRATION' WHEN ego_yaw IS NULL THEN 'NUMERIC_ANOMALY' END"""


_SPLIT = """SELECT *, CASE WHEN row_number() OVER (PARTITION BY location, time_of_day ORDER BY scene_token) > n - floor(n * 0.1 + 0.5) THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, count(*) OVER (PARTITION BY location, time_of_day) AS n FROM fx_scene)"""


def reasoned(fx: Fixtures) -> DataFrame:
    return w.history_window(fx.view("fx_keyframe")).withColumn("reason", w.quarantine_reason())


@query("w1_keyframe_walk", duck(f"SELECT scene_token, sample_id, row_number() OVER ({_W}) - 1 AS walk_idx FROM fx_keyframe", "fx_keyframe"))
def keyframe_walk(fx: Fixtures) -> DataFrame:
    return w.keyframe_walk(fx.view("fx_keyframe").drop("walk_idx")).select("scene_token", "sample_id", "walk_idx")


@query("w2_history_window", duck(f"SELECT scene_token, sample_id, coalesce({_REASON}, 'VALID') AS reason FROM ({_WINDOWED})", "fx_keyframe"))
def history_window(fx: Fixtures) -> DataFrame:
    return reasoned(fx).select("scene_token", "sample_id", F.coalesce("reason", F.lit("VALID")).alias("reason"))


@query(
    "w3_backward_speed",
    duck(
        f"""SELECT sample_id, CASE WHEN dt > 0 THEN round(sqrt(dx * dx + dy * dy) / dt, 9) END AS speed FROM (SELECT sample_id, ego_x - lag(ego_x) OVER ({_W}) AS dx,
  ego_y - lag(ego_y) OVER ({_W}) AS dy, (timestamp_us - lag(timestamp_us) OVER ({_W})) / 1e6 AS dt FROM fx_keyframe)""",
        "fx_keyframe",
    ),
)
def backward_speed(fx: Fixtures) -> DataFrame:
    return fx.view("fx_keyframe").select("sample_id", F.round(w.backward_speed(), 9).alias("speed"))


@query(
    "w4_future_window",
    duck(f"SELECT sample_id, count(*) OVER f AS n_future, coalesce(max(timestamp_us) OVER f, -1) AS last_us FROM fx_keyframe WINDOW f AS ({_W} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)", "fx_keyframe"),
)
def future_window(fx: Fixtures) -> DataFrame:
    frames = w.future_window(fx.view("fx_keyframe"))
    return frames.select("sample_id", F.size("future").cast("long").alias("n_future"), F.coalesce(F.array_max("future.timestamp_us"), F.lit(-1)).alias("last_us"))


# event times differ within a scene, so every step takes time; the window stops the walk
@query(
    "w5_future_speeds",
    duck(
        f"""WITH f AS (SELECT scene_token, sample_id, timestamp_us AS t, ego_x AS x, ego_y AS y, row_number() OVER ({_W}) AS i FROM fx_keyframe),
p AS (SELECT a.sample_id, b.t - a.t AS rel, b.t AS t, b.x, b.y, c.t AS t0, c.x AS x0, c.y AS y0 FROM f a JOIN f b ON a.scene_token = b.scene_token AND b.i BETWEEN a.i + 1 AND a.i + 6
  JOIN f c ON c.scene_token = b.scene_token AND c.i = b.i - 1 WHERE b.t - a.t <= 120000000000)
SELECT f.sample_id, count(p.t) AS n, round(max(sqrt((p.x - x0) * (p.x - x0) + (p.y - y0) * (p.y - y0)) / ((p.t - t0) / 1e6)), 9) AS fastest FROM f LEFT JOIN p ON p.sample_id = f.sample_id GROUP BY 1""",
        "fx_keyframe",
    ),
)
def future_speeds(fx: Fixtures) -> DataFrame:
    frames = w.future_window(fx.view("fx_keyframe")).withColumn("speeds", w.future_speeds(120_000_000_000))
    return frames.select("sample_id", F.size("speeds").cast("long").alias("n"), F.round(F.array_max("speeds"), 9).alias("fastest"))


@query(
    "w6_track_window",
    duck(
        f"""WITH f AS (SELECT *, row_number() OVER ({_W}) AS i FROM fx_keyframe) SELECT a.sample_id, count(b.sample_id) AS n_in_window FROM f a LEFT JOIN f b ON a.scene_token = b.scene_token
AND b.i BETWEEN a.i + 1 AND a.i + 6 AND b.timestamp_us - a.timestamp_us <= 60000000000 GROUP BY 1""",
        "fx_keyframe",
    ),
)
def track_window(fx: Fixtures) -> DataFrame:
    frames = w.future_window(fx.view("fx_keyframe"))
    inside = F.filter("future", lambda p: p["timestamp_us"] - F.col("timestamp_us") <= 60_000_000_000)
    return frames.select("sample_id", F.size(inside).cast("long").alias("n_in_window"))


@query("w8_disjoint_windows", duck("SELECT scene_token, sample_id, walk_idx FROM fx_keyframe WHERE walk_idx >= 3 AND (walk_idx - 3) % 10 = 0", "fx_keyframe"))
def disjoint_windows(fx: Fixtures) -> DataFrame:
    return fx.view("fx_keyframe").where("walk_idx >= 3 and (walk_idx - 3) % 10 = 0").select("scene_token", "sample_id", F.col("walk_idx").cast("long").alias("walk_idx"))


@query("f7_candidates", duck("SELECT scene_token, count(*) AS n FROM fx_keyframe WHERE walk_idx >= 3 GROUP BY 1", "fx_keyframe"))
def candidates(fx: Fixtures) -> DataFrame:
    return fx.view("fx_keyframe").where("walk_idx >= 3").groupBy("scene_token").agg(F.count(F.lit(1)).alias("n"))


@query("f8_quarantine_reasons", duck(f"SELECT coalesce(r, 'VALID') AS reason, count(*) AS n FROM (SELECT {_REASON} AS r FROM ({_WINDOWED})) GROUP BY 1", "fx_keyframe"))
def quarantine_reasons(fx: Fixtures) -> DataFrame:
    return reasoned(fx).groupBy(F.coalesce("reason", F.lit("VALID")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_LINKED = f"""WITH k AS (SELECT *, CASE WHEN sample_id % 53 = 0 THEN sample_id - 1 ELSE lag(sample_id) OVER ({_W}) END AS prev_id FROM fx_keyframe),
j AS (SELECT a.*, b.sample_id AS i1, c.sample_id AS i2, d.sample_id AS i3, b.scene_token <> a.scene_token OR c.scene_token <> a.scene_token OR d.scene_token <> a.scene_token AS crossed, a.has_camera AND b.has_camera AND c.has_camera AND d.has_camera AS cam, a.has_image AND b.has_image AND c.has_image AND d.has_image AS img,
  a.timestamp_us - b.timestamp_us AS g1, b.timestamp_us - c.timestamp_us AS g2, c.timestamp_us - d.timestamp_us AS g3 FROM k a LEFT JOIN k b ON b.sample_id = a.prev_id LEFT JOIN k c ON c.sample_id = b.prev_id LEFT JOIN k d ON d.sample_id = c.prev_id)
SELECT sample_id, CASE WHEN i3 IS NULL THEN 'INSUFFICIENT_HISTORY' WHEN crossed THEN 'CROSS_SCENE' WHEN NOT cam THEN 'NO_CAM_FRONT' WHEN least(g1, g2, g3) <= 0 THEN 'NON_INCREASING_TIME' WHEN greatest(g1, g2, g3) > 90000000000 THEN 'BAD_GAP' WHEN NOT img THEN 'MISSING_IMAGE'
  WHEN NOT has_calibration THEN 'MISSING_CALIBRATION' WHEN ego_yaw IS NULL THEN 'NUMERIC_ANOMALY' ELSE 'VALID' END AS reason FROM j"""


@query("f8_linked_reasons", duck(_LINKED, "fx_keyframe"))
def linked_reasons(fx: Fixtures) -> DataFrame:
    """Reasons of histories that follow the keyframes' own links, of which every 53rd leads to the sample before it, in whatever scene."""
    frames = fx.view("fx_keyframe").withColumn("prev_id", F.when(F.col("sample_id") % 53 == 0, F.col("sample_id") - 1).otherwise(F.lag("sample_id").over(w.scene_order())))
    seen = w.linked_history(frames)
    return seen.select("sample_id", F.coalesce(w.quarantine_reason(), F.lit("VALID")).alias("reason"))


@query(
    "d1_build_record",
    duck(
        f"""SELECT scene_token, sample_id, walk_idx, timestamp_us - g1 AS newest_before_us, round((timestamp_us - g1 - g2 - g3 - timestamp_us) / 1e6, 6) AS first_offset_s
FROM (SELECT *, {_REASON} AS r FROM ({_WINDOWED})) WHERE r IS NULL""",
        "fx_keyframe",
    ),
)
def build_record(fx: Fixtures) -> DataFrame:
    valid = reasoned(fx).where("reason is null")
    return valid.select(
        "scene_token",
        "sample_id",
        F.col("walk_idx").cast("long").alias("walk_idx"),
        F.element_at("window", -2)["timestamp_us"].alias("newest_before_us"),
        F.round((F.element_at("window", 1)["timestamp_us"] - F.col("timestamp_us")) / 1e6, 6).alias("first_offset_s"),
    )


@query(
    "k1_shard_index",
    duck("SELECT sample_id, (row_number() OVER (ORDER BY scene_token, walk_idx) - 1) // 1000 AS shard, (row_number() OVER (ORDER BY scene_token, walk_idx) - 1) % 1000 AS line FROM fx_keyframe", "fx_keyframe"),
)
def shard_index(fx: Fixtures) -> DataFrame:
    from quarryframe.sources.io import shard_index as index

    return index(fx.view("fx_keyframe").select("scene_token", "walk_idx", "sample_id"), "scene_token", ["walk_idx"]).select("sample_id", "shard", "line")


@query("k2_quarantine_rows", duck(f"SELECT scene_token, walk_idx, sample_id, r AS reason FROM (SELECT *, {_REASON} AS r FROM ({_WINDOWED})) WHERE r IS NOT NULL", "fx_keyframe"))
def quarantine_rows(fx: Fixtures) -> DataFrame:
    return reasoned(fx).where("reason is not null").select("scene_token", F.col("walk_idx").cast("long").alias("walk_idx"), "sample_id", "reason")


@query(
    "a21_quarantine_rollup",
    duck(
        f"""SELECT coalesce(split, '*') AS split, coalesce(reason, '*') AS reason, count(*) AS n FROM (SELECT CASE WHEN scene_token < 's3' THEN 'a' ELSE 'b' END AS split,
  coalesce({_REASON}, 'VALID') AS reason FROM ({_WINDOWED})) GROUP BY ROLLUP (split, reason)""",
        "fx_keyframe",
    ),
)
def quarantine_rollup(fx: Fixtures) -> DataFrame:
    rows = reasoned(fx).select(F.when(F.col("scene_token") < "s3", "a").otherwise("b").alias("split"), F.coalesce("reason", F.lit("VALID")).alias("reason"))
    out = rows.rollup("split", "reason").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce("split", F.lit("*")).alias("split"), F.coalesce("reason", F.lit("*")).alias("reason"), "n")


@query("s13_anchor_pick", duck("SELECT scene_token, min(sample_id) FILTER (walk_idx = 3) AS sample_id, count(*) AS n FROM fx_keyframe GROUP BY 1 HAVING count(*) > 3", "fx_keyframe"))
def anchor_pick(fx: Fixtures) -> DataFrame:
    """The first keyframe of each scene with a full history."""
    picked = fx.view("fx_keyframe").groupBy("scene_token").agg(F.min(F.when(F.col("walk_idx") == 3, F.col("sample_id"))).alias("sample_id"), F.count(F.lit(1)).alias("n"))
    return picked.where("n > 3")


_REQUESTS = "SELECT sample_id AS request, CASE WHEN sample_id % 5 = 0 THEN sample_id + CASE WHEN sample_id % 35 = 0 THEN 1000000000 ELSE 0 END END AS token, CASE WHEN sample_id % 5 IN (1, 2) THEN scene_token WHEN sample_id % 5 = 3 THEN concat(scene_token, 'x') END AS scene FROM {}"


@query(
    "s13_anchor_requests",
    duck(
        f"""WITH k AS (SELECT *, row_number() OVER ({_W}) - 1 AS i FROM fx_keyframe), s AS (SELECT scene_token, min(sample_id) FILTER (i = 3) AS start FROM k GROUP BY 1), f AS (SELECT start FROM s ORDER BY scene_token LIMIT 1), q AS ({_REQUESTS.format('fx_keyframe')})
SELECT request, CASE WHEN token IS NOT NULL THEN CASE WHEN token < 1000000000 THEN token END WHEN scene IS NOT NULL THEN s.start ELSE (SELECT start FROM f) END AS anchor,
CASE WHEN token IS NOT NULL THEN CASE WHEN token < 1000000000 THEN 'token' ELSE 'NO_TOKEN' END WHEN scene IS NOT NULL AND s.scene_token IS NULL THEN 'NO_SCENE' WHEN scene IS NOT NULL THEN CASE WHEN s.start IS NULL THEN 'TOO_SHORT' ELSE 'scene' END WHEN (SELECT start FROM f) IS NULL THEN 'TOO_SHORT' ELSE 'first' END AS why
FROM q LEFT JOIN s ON s.scene_token = q.scene""",
        "fx_keyframe",
    ),
)
def anchor_requests(fx: Fixtures) -> DataFrame:
    """Anchors asked for by token, by scene, or not at all; some tokens and scenes do not exist."""
    frames = fx.view("fx_keyframe")
    return w.resolve_anchors(fx.sql(_REQUESTS.format("{k}"), k=frames), frames)


@query("k8_sorted_subset", duck(f"SELECT sample_id FROM (SELECT sample_id FROM fx_keyframe JOIN ({_SPLIT}) USING (scene_token) WHERE split = 'train' ORDER BY CAST(sample_id AS VARCHAR) LIMIT 500)", "fx_keyframe", "fx_scene"))
def sorted_subset(fx: Fixtures) -> DataFrame:
    """The first 500 tokens of the training split in the order of their text."""
    train = fx.view("fx_keyframe").join(split_scenes(fx).where("split = 'train'").select("scene_token"), "scene_token")
    return train.select("sample_id").orderBy(F.col("sample_id").cast("string")).limit(500)


@query(
    "j1_frame_links",
    duck(
        """SELECT sample_id, CASE WHEN location IS NULL THEN 'MISSING_SCENE' WHEN NOT has_calibration THEN 'MISSING_CALIBRATION' ELSE 'LINKED' END AS status, location
FROM fx_keyframe LEFT JOIN (SELECT * FROM fx_scene WHERE n_keyframes > 60) USING (scene_token)""",
        "fx_keyframe",
        "fx_scene",
    ),
)
def frame_links(fx: Fixtures) -> DataFrame:
    """Linked tables by left joins; a dangling link gives a reason."""
    scenes = fx.view("fx_scene").where("n_keyframes > 60")
    status = F.when(F.col("location").isNull(), "MISSING_SCENE").when(~F.col("has_calibration"), "MISSING_CALIBRATION").otherwise("LINKED")
    return fx.view("fx_keyframe").join(scenes, "scene_token", "left").select("sample_id", status.alias("status"), "location")


@query("j2_linked_walk", duck(f"SELECT sample_id, lag(sample_id, 1, -1) OVER ({_W}) AS prev1, lag(sample_id, 3, -1) OVER ({_W}) AS prev3, lead(sample_id, 6, -1) OVER ({_W}) AS next6 FROM fx_keyframe", "fx_keyframe"))
def linked_walk(fx: Fixtures) -> DataFrame:
    o = w.scene_order()
    return fx.view("fx_keyframe").select("sample_id", F.lag("sample_id", 1, -1).over(o).alias("prev1"), F.lag("sample_id", 3, -1).over(o).alias("prev3"), F.lead("sample_id", 6, -1).over(o).alias("next6"))


@query("j3_scene_location", duck("SELECT location, time_of_day, count(*) AS n FROM fx_keyframe JOIN fx_scene USING (scene_token) GROUP BY 1, 2", "fx_keyframe", "fx_scene"))
def scene_location(fx: Fixtures) -> DataFrame:
    return fx.view("fx_keyframe").join(fx.view("fx_scene"), "scene_token").groupBy("location", "time_of_day").agg(F.count(F.lit(1)).alias("n"))


@query("f13_day_night", duck("SELECT time_of_day, count(*) AS n_scenes FROM fx_scene GROUP BY 1", "fx_scene"))
def day_night(fx: Fixtures) -> DataFrame:
    return fx.view("fx_scene").groupBy("time_of_day").agg(F.count(F.lit(1)).alias("n_scenes"))


def split_scenes(fx: Fixtures) -> DataFrame:
    return st.tail_split(fx.view("fx_scene"), ["location", "time_of_day"], "scene_token", 0.1)


@query("r5_stratified_split", duck(f"SELECT scene_token, location, time_of_day, split FROM ({_SPLIT})", "fx_scene"))
def stratified_split(fx: Fixtures) -> DataFrame:
    return split_scenes(fx).select("scene_token", "location", "time_of_day", "split")


@query("e1_split_disjoint", duck(f"WITH s AS ({_SPLIT}) SELECT (SELECT count(*) FROM (SELECT scene_token FROM s WHERE split = 'train' INTERSECT SELECT scene_token FROM s WHERE split = 'val')) AS shared, (SELECT count(*) FROM (SELECT scene_token FROM fx_scene EXCEPT SELECT scene_token FROM s)) AS missing", "fx_scene"))
def split_disjoint(fx: Fixtures) -> DataFrame:
    s = split_scenes(fx).select("scene_token", "split")
    train, val = (s.where(F.col("split") == k).select("scene_token") for k in ("train", "val"))
    shared = train.intersect(val).agg(F.count(F.lit(1)).alias("shared"))
    return shared.crossJoin(fx.view("fx_scene").select("scene_token").subtract(s.select("scene_token")).agg(F.count(F.lit(1)).alias("missing")))


@query("a28_scene_distribution", duck(f"SELECT split, location, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS percent FROM ({_SPLIT}) GROUP BY 1, 2", "fx_scene"))
def scene_distribution(fx: Fixtures) -> DataFrame:
    counts = split_scenes(fx).groupBy("split", "location").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("split")), 6))


@query(
    "r6_round_robin_sample",
    duck("SELECT scene_token, sample_id FROM (SELECT scene_token, sample_id, row_number() OVER (PARTITION BY scene_token ORDER BY md5(CAST(sample_id AS VARCHAR)), sample_id) AS turn FROM fx_keyframe) ORDER BY turn, scene_token LIMIT 200", "fx_keyframe"),
)
def round_robin_sample(fx: Fixtures) -> DataFrame:
    frames = fx.view("fx_keyframe").withColumn("h", F.md5(F.col("sample_id").cast("string")))
    return st.round_robin_sample(frames, "scene_token", ["h", "sample_id"], 200).select("scene_token", "sample_id")


@query("r7_modulo_shards", duck("SELECT scene_token, (dense_rank() OVER (ORDER BY scene_token) - 1) % 8 AS shard FROM (SELECT DISTINCT scene_token FROM fx_keyframe)", "fx_keyframe"))
def modulo_shards(fx: Fixtures) -> DataFrame:
    scenes = fx.view("fx_keyframe").select("scene_token").distinct()
    return w.numbered_names(scenes, "scene_token", "no").select("scene_token", (F.col("no") % 8).alias("shard"))


@query("r8_prefix_subset", duck("SELECT scene_token, sample_id FROM (SELECT scene_token, sample_id, row_number() OVER (PARTITION BY scene_token ORDER BY sample_id) AS r FROM fx_keyframe) WHERE r <= 5", "fx_keyframe"))
def prefix_subset(fx: Fixtures) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("scene_token").orderBy("sample_id"))
    return fx.view("fx_keyframe").withColumn("r", rank).where("r <= 5").select("scene_token", "sample_id")


@query("s11_token_filter", duck("SELECT sample_id FROM fx_keyframe WHERE sample_id % 7 = 3 ORDER BY sample_id LIMIT 100", "fx_keyframe"))
def token_filter(fx: Fixtures) -> DataFrame:
    wanted = fx.table("events").where("event_id % 7 = 3").select(F.col("event_id").alias("sample_id"))
    return fx.view("fx_keyframe").join(wanted, "sample_id", "left_semi").select("sample_id").orderBy("sample_id").limit(100)


@query(
    "k6_resume",
    duck("SELECT sample_id FROM fx_keyframe WHERE sample_id % 3 <> 0", "fx_keyframe"),
)
def resume(fx: Fixtures) -> DataFrame:
    from quarryframe.sources.io import resume as todo

    frames = fx.view("fx_keyframe").select("sample_id")
    return todo(frames, frames.where("sample_id % 3 = 0"), "sample_id")


# -- bootstrap: yields of anchors by customer ---------------------------------------------------------------------

_B = 2000
#: r4 returns the weights themselves.
_B_SHOWN = 50
_CELLS = """SELECT scene_token, sum(CAST(gt_yield AND pred_yield AS BIGINT)) AS tp, sum(CAST(NOT gt_yield AND pred_yield AS BIGINT)) AS fp, sum(CAST(gt_yield AND NOT pred_yield AS BIGINT)) AS fn,
  sum(CAST(gt_yield AND NOT (anchor_id % 10 < 4) AS BIGINT)) AS fn2, sum(CAST(gt_yield AND anchor_id % 10 < 4 AS BIGINT)) AS tp2, sum(CAST(NOT gt_yield AND anchor_id % 10 < 4 AS BIGINT)) AS fp2 FROM fx_anchor WHERE parse_ok GROUP BY 1"""
_WEIGHTS = """n AS (SELECT scene_token, row_number() OVER (ORDER BY scene_token) - 1 AS no, count(*) OVER () AS k FROM (SELECT DISTINCT scene_token FROM fx_anchor WHERE parse_ok)),
d AS (SELECT b, CAST(('0x' || substr(md5(concat('seed:', b, ':', no)), 1, 8)) AS BIGINT) %% k AS no FROM n, range(0, %d) r(b)),
wt AS (SELECT b AS replicate, scene_token, count(*) AS weight FROM d JOIN n USING (no) GROUP BY 1, 2)"""


def anchor_cells(fx: Fixtures) -> DataFrame:
    g, p, q = F.col("gt_yield"), F.col("pred_yield"), F.col("anchor_id") % 10 < 4
    cells = {"tp": g & p, "fp": ~g & p, "fn": g & ~p, "tp2": g & q, "fp2": ~g & q, "fn2": g & ~q}
    return fx.view("fx_anchor").where("parse_ok").groupBy("scene_token").agg(*(total(c).alias(k) for k, c in cells.items()))


def replicate_scores(fx: Fixtures) -> DataFrame:
    cells = anchor_cells(fx)
    totals = st.resampled_totals(cells, "scene_token", ["tp", "fp", "fn", "tp2", "fp2", "fn2"], _B, "seed")
    score = lambda s: f1(F.col(f"tp{s}"), F.col(f"fp{s}"), F.col(f"fn{s}"))
    return totals.select("replicate", score("").alias("f1"), score("2").alias("f1_other"))


_SCORES = f"""c AS ({_CELLS}), {_WEIGHTS % _B}, s AS (SELECT replicate, CASE WHEN sum(weight * tp) = 0 THEN 0 ELSE 2 * sum(weight * tp) / (2 * sum(weight * tp) + sum(weight * fp) + sum(weight * fn)) END AS f1,
  CASE WHEN sum(weight * tp2) = 0 THEN 0 ELSE 2 * sum(weight * tp2) / (2 * sum(weight * tp2) + sum(weight * fp2) + sum(weight * fn2)) END AS f1_other FROM wt JOIN c USING (scene_token) GROUP BY 1)"""


@query("r1_cluster_bootstrap", duck(f"WITH {_SCORES} SELECT round(quantile_cont(f1, 0.025), 6) AS lo, round(quantile_cont(f1, 0.975), 6) AS hi, count(*) AS n FROM s", "fx_anchor"))
def cluster_bootstrap(fx: Fixtures) -> DataFrame:
    ci = st.percentile_interval(replicate_scores(fx), "f1")
    return ci.select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@query("r3_paired_delta", duck(f"WITH {_SCORES} SELECT round(quantile_cont(f1_other - f1, 0.025), 6) AS lo, round(quantile_cont(f1_other - f1, 0.975), 6) AS hi, count(*) AS n FROM s", "fx_anchor"))
def paired_delta(fx: Fixtures) -> DataFrame:
    """Both systems under the same draws of scenes."""
    ci = st.percentile_interval(replicate_scores(fx).withColumn("delta", F.col("f1_other") - F.col("f1")), "delta")
    return ci.select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@query("r4_hash_draws", duck(f"WITH {_WEIGHTS % _B_SHOWN} SELECT replicate, scene_token, weight FROM wt", "fx_anchor"))
def hash_draws(fx: Fixtures) -> DataFrame:
    return st.resample_weights(fx.view("fx_anchor").where("parse_ok"), "scene_token", _B_SHOWN, "seed")


_CLASS_CELLS = """SELECT scene_token, a AS action, sum(CAST(gt_action = a AND pred_action = a AS BIGINT)) AS tp, sum(CAST(gt_action <> a AND pred_action = a AS BIGINT)) AS fp,
  sum(CAST(gt_action = a AND pred_action <> a AS BIGINT)) AS fn FROM fx_anchor, (VALUES ('ACCELERATE'), ('DECELERATE'), ('KEEP_SPEED'), ('STOP')) v(a) WHERE parse_ok GROUP BY 1, 2"""


@query(
    "r2_class_bootstrap",
    duck(
        f"""WITH c AS ({_CLASS_CELLS}), {_WEIGHTS % _B}, s AS (SELECT replicate, action, CASE WHEN sum(weight * tp) = 0 THEN 0 ELSE 2 * sum(weight * tp) / (2 * sum(weight * tp) + sum(weight * fp) + sum(weight * fn)) END AS f1
FROM wt JOIN c USING (scene_token) GROUP BY 1, 2) SELECT action, round(quantile_cont(f1, 0.025), 6) AS lo, round(quantile_cont(f1, 0.975), 6) AS hi FROM s GROUP BY 1""",
        "fx_anchor",
    ),
)
def class_bootstrap(fx: Fixtures) -> DataFrame:
    from quarryframe.functions.columns import ACTIONS

    g, p = F.col("gt_action"), F.col("pred_action")
    cells = {}
    for k, a in enumerate(ACTIONS):
        cells |= {f"tp{k}": (g == a) & (p == a), f"fp{k}": (g != a) & (p == a), f"fn{k}": (g == a) & (p != a)}
    counts = fx.view("fx_anchor").where("parse_ok").groupBy("scene_token").agg(*(total(v).alias(n) for n, v in cells.items()))
    wide = st.resampled_totals(counts, "scene_token", list(cells), _B, "seed")
    sums = wide.select(F.inline(F.array(*(F.struct(F.lit(a).alias("action"), *(F.col(f"{n}{k}").alias(n) for n in ("tp", "fp", "fn"))) for k, a in enumerate(ACTIONS)))))
    scores = sums.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))
    return scores.groupBy("action").agg(F.round(F.percentile("f1", 0.025), 6).alias("lo"), F.round(F.percentile("f1", 0.975), 6).alias("hi"))


@query("r4_mersenne_draws")
def mersenne_draws(fx: Fixtures) -> DataFrame:
    """The draws of scenes as numpy's generator gives them; tests compare them with a stored vector and with numpy."""
    scenes = w.numbered_names(fx.view("fx_anchor").where("parse_ok").select("scene_token").distinct(), "scene_token", "no")
    return st.mersenne_draws(fx.spark, scenes.count(), _B_SHOWN, 20260101).hint("merge").join(scenes, "no").select("replicate", "scene_token", "weight")


def _median(part: pd.DataFrame) -> dict[str, float]:
    low, middle, high = (st.weighted_quantile(part, "ego_speed", q) for q in (0.25, 0.5, 0.75))
    return {"median": middle, "spread": high - low}


@query(
    "r1_plug_in_bootstrap",
    duck(
        f"""WITH {_WEIGHTS % _B}, x AS (SELECT replicate, ego_speed FROM (SELECT replicate, ego_speed, unnest(range(weight)) AS k FROM wt JOIN fx_anchor USING (scene_token) WHERE parse_ok)),
s AS (SELECT replicate, quantile_cont(ego_speed, 0.5) AS median, quantile_cont(ego_speed, 0.75) - quantile_cont(ego_speed, 0.25) AS spread FROM x GROUP BY 1)
SELECT metric, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi, count(*) AS n FROM (UNPIVOT s ON median, spread INTO NAME metric VALUE value) GROUP BY 1""",
        "fx_anchor",
    ),
)
def plug_in_bootstrap(fx: Fixtures) -> DataFrame:
    """Intervals of a median and of a quartile range, which are no sums over scenes."""
    rows = fx.view("fx_anchor").where("parse_ok").select("scene_token", "ego_speed")
    n = rows.select("scene_token").distinct().count()
    draws = st.block_weights(fx.spark, n, _B, "seed")
    values = st.plug_in_bootstrap(rows, "scene_token", _median, draws)
    return values.groupBy("metric").agg(F.round(F.percentile("value", 0.025), 6).alias("lo"), F.round(F.percentile("value", 0.975), 6).alias("hi"), F.count(F.lit(1)).alias("n"))


_BOUNDS = (-0.05, 0.0, 0.05)


@query(
    "d20_gates",
    duck(
        f"""WITH {_SCORES}, i AS (SELECT quantile_cont(f1_other - f1, 0.025) AS lo, quantile_cont(f1_other - f1, 0.975) AS hi, count(*) AS n FROM s)
SELECT bound, CASE WHEN n = 0 THEN 'not_evaluated' WHEN lo > bound THEN 'true' WHEN hi < bound THEN 'false' ELSE 'undecided' END AS pass FROM i, (VALUES {', '.join(f'({b}::DOUBLE)' for b in _BOUNDS)}) v(bound)""",
        "fx_anchor",
    ),
)
def gates(fx: Fixtures) -> DataFrame:
    """Whether the paired difference of two systems lies above each bound, by its bootstrap interval; an interval that holds the bound does not decide."""
    ci = st.percentile_interval(replicate_scores(fx).withColumn("delta", F.col("f1_other") - F.col("f1")), "delta")
    rows = ci.select("lo", "hi", "n", F.explode(F.array(*map(F.lit, _BOUNDS))).alias("bound"))
    verdict = F.when(F.col("n") == 0, "not_evaluated").otherwise(F.coalesce(ci_gate(F.col("lo"), F.col("hi"), F.col("bound")).cast("string"), F.lit("undecided")))
    return rows.select("bound", verdict.alias("pass"))
