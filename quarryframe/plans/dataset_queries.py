"""Queries that build a dataset on shared storage from the keyframes, read it back, damage it and check it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryframe.functions import columns as c
from quarryframe.operators import dataset as ds
from quarryframe.operators import labels as lb
from quarryframe.operators import records as rc
from quarryframe.operators import windows as w
from quarryframe.plans.fixtures import Fixtures, duck
from quarryframe.plans.label_queries import _SEEN, with_actions
from quarryframe.plans.label_queries import outputs as expected_texts
from quarryframe.plans.registry import query
from quarryframe.plans.sequence_queries import _SPLIT, _W, split_scenes
from quarryframe.sources import io

SPLITS = ["train", "val"]
#: Lines of a shard here, so that the tables fill several.
LINES = 100

# The reason of each candidate: checks of the history, then its calibrations, the speed, and the future pose by pose.
_CANDIDATES = f"""WITH k AS (SELECT *, row_number() OVER ({_W}) AS i, timestamp_us - lag(timestamp_us) OVER ({_W}) AS gap, lag(ego_x) OVER ({_W}) AS x0 FROM fx_keyframe),
h AS (SELECT *, list(gap) OVER g AS gaps, count(*) OVER q AS n, min(CAST(has_camera AS INT)) OVER q AS cam, min(CAST(has_image AS INT)) OVER q AS img, min(CAST(has_calibration AS INT)) OVER q AS cal,
  CASE WHEN NOT has_camera THEN 'NO_CAM_FRONT' WHEN NOT has_calibration THEN 'MISSING_CALIBRATION' WHEN ego_yaw IS NULL THEN 'NUMERIC_ANOMALY' END AS first,
  CASE WHEN NOT has_camera THEN 'NO_CAM_FRONT' WHEN NOT has_calibration THEN 'MISSING_CALIBRATION' WHEN gap <= 0 THEN 'NON_INCREASING_TIME' WHEN ego_yaw IS NULL THEN 'NUMERIC_ANOMALY' END AS later
  FROM k WINDOW q AS ({_W} ROWS 3 PRECEDING), g AS ({_W} ROWS 2 PRECEDING)),
f AS (SELECT *, lead(first) OVER ({_W}) AS f1, list(later) FILTER (later IS NOT NULL) OVER ({_W} ROWS BETWEEN 2 FOLLOWING AND 6 FOLLOWING) AS fs, count(*) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS n_future FROM h),
c AS (SELECT *, CASE WHEN cam = 0 THEN 'NO_CAM_FRONT' WHEN list_min(gaps) <= 0 THEN 'NON_INCREASING_TIME' WHEN list_max(gaps) > 90000000000 THEN 'BAD_GAP' WHEN img = 0 THEN 'MISSING_IMAGE' WHEN cal = 0 THEN 'MISSING_CALIBRATION'
  WHEN ego_yaw IS NULL THEN 'NUMERIC_ANOMALY' WHEN f1 IS NOT NULL THEN f1 ELSE fs[1] END AS reason FROM f WHERE n = 4),
s AS ({_SPLIT})"""


def frames(fx: Fixtures) -> DataFrame:
    return fx.view("fx_keyframe").withColumn("image", F.concat(F.lit("img/"), F.col("sample_id").cast("string"), F.lit(".jpg")))


def records(fx: Fixtures) -> DataFrame:
    return rc.build_records(frames(fx), "builder", "tables")


def labels(fx: Fixtures, wanted: DataFrame | None = None) -> DataFrame:
    """Expected outputs of the keyframes, or of those ``wanted`` (sample_id): objects of the order with a keyframe's number stand around it.

    Tracks and speeds are taken from all keyframes, and only then are the wanted ones left.
    """
    frame = fx.view("fx_keyframe").select(F.col("sample_id").alias("anchor_id"), "scene_token", "walk_idx", "timestamp_us", "ego_x", "ego_y")
    anchors = frame.withColumn("ego_speed", F.coalesce(w.backward_speed_by("anchor_id"), F.lit(0.0)))
    objects = fx.view("fx_object").drop("ego_speed").join(anchors.select("anchor_id", "ego_speed"), "anchor_id")
    boxes = {f"b{k}": v for k, v in (("x1", F.col("ann_no") * 10.0), ("y1", F.lit(100.0)), ("x2", F.col("ann_no") * 10.0 + 25), ("y2", F.lit(180.0)))}
    only = lambda rows: rows if wanted is None else rows.join(wanted.select(F.col("sample_id").alias("anchor_id")), "anchor_id", "left_semi")
    pool = lb.risk_columns(lb.with_tracks(lb.pool_of(lb.with_geometry(only(objects).withColumns(boxes))), lb.track_windows(objects, anchors)))
    return lb.expected_outputs(pool, only(with_actions(anchors))).select(F.col("anchor_id").alias("sample_id"), "expected_output")


def candidates(fx: Fixtures) -> DataFrame:
    """Records with their expected outputs, and the split of their scenes."""
    made = io.written(records(fx), "records")
    told = made.join(labels(fx, made.where("reason is null")), "sample_id", "left").join(split_scenes(fx).select("scene_token", "split"), "scene_token")
    return told.withColumn("record", F.when(F.col("record").isNotNull(), F.col("record").withField("training_targets.expected_output", F.col("expected_output")))).drop("expected_output")


def built(fx: Fixtures) -> tuple[str, dict]:
    path = io.shared_folder(fx.spark, "dataset")
    return path, ds.build_dataset(candidates(fx), path, SPLITS, ds.BuildConfig(shard_size=LINES))


def index_of(fx: Fixtures, path: str) -> DataFrame:
    return fx.spark.read.schema(ds.INDEX).parquet(f"{path}/index")


_PLACED = f"{_CANDIDATES}, v AS (SELECT sample_id, split, row_number() OVER (PARTITION BY split ORDER BY scene_token, walk_idx, CAST(sample_id AS VARCHAR)) - 1 AS no FROM c JOIN s USING (scene_token) WHERE reason IS NULL)"


@query(
    "d1_record_fields",
    duck(
        f"""{_CANDIDATES} SELECT sample_id, coalesce(reason, 'VALID') AS reason, CASE WHEN reason IS NULL THEN n_future END AS n_future, CASE WHEN reason IS NULL THEN 'img/' || sample_id || '.jpg' END AS image,
CASE WHEN reason IS NULL THEN round(sqrt((ego_x - x0) * (ego_x - x0) + (ego_y - y0) * (ego_y - y0)) / (gap / 1e6), 9) END AS speed FROM (SELECT *, y0 FROM c JOIN (SELECT sample_id, lag(ego_y) OVER ({_W}) AS y0 FROM fx_keyframe) USING (sample_id))""",
        "fx_keyframe",
        "fx_scene",
    ),
)
def record_fields(fx: Fixtures) -> DataFrame:
    """Speed, newest image and length of the future of each record, and the reason of each anchor without one."""
    r = F.col("record")
    return records(fx).select(
        "sample_id", F.coalesce("reason", F.lit("VALID")).alias("reason"), F.size(r["oracle_only"]["future_ego_poses"]).cast("long").alias("n_future"), F.element_at(r["model_inputs"]["frames"], -1)["image_relpath"].alias("image"), F.round(r["model_inputs"]["ego_speed_mps"], 9).alias("speed")
    ).withColumn("n_future", F.when(F.col("reason") == "VALID", F.col("n_future")))


@query(
    "d2_build_counts",
    duck(
        f"""{_PLACED} SELECT 'candidates' AS metric, count(*) AS n FROM c UNION ALL SELECT coalesce('reason:' || reason, 'valid'), count(*) FROM c GROUP BY 1 UNION ALL SELECT 'labelled', count(*) FROM c WHERE reason IS NULL
UNION ALL SELECT 'records:' || split, count(*) FROM v GROUP BY 1 UNION ALL SELECT 'shards:' || split, max(no // {LINES}) + 1 FROM v GROUP BY split UNION ALL SELECT 'quarantine_lines', count(*) FROM c WHERE reason IS NOT NULL""",
        "fx_keyframe",
        "fx_scene",
    ),
)
def build_counts(fx: Fixtures) -> DataFrame:
    """What the build observed in its one pass, beside a recount of the files that it wrote."""
    path, _ = built(fx)
    counts = ds.open_dataset(fx.spark, path)["counts"]
    seen = [(k, v) for k, v in counts.items() if v and (k in ("candidates", "valid", "labelled") or k.startswith("reason:"))]
    observed = fx.spark.createDataFrame(seen, "metric string, n long")
    lines = ds.read_shard_lines(fx.spark, f"{path}/records")
    per_split = lines.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("shard").alias("shards"))
    files = per_split.select(F.inline(F.array(*(F.struct(F.concat(F.lit(f"{k}:"), "split").alias("metric"), F.col(k).alias("n")) for k in ("records", "shards")))))
    lost = fx.spark.read.text(f"{path}/quarantine").where("value <> ''").agg(F.lit("quarantine_lines").alias("metric"), F.count(F.lit(1)).alias("n"))
    return observed.unionByName(files).unionByName(lost)


@query("k1_shard_files", duck(f"{_PLACED} SELECT CAST(sample_id AS VARCHAR) AS sample_token, split, no // {LINES} AS shard, no % {LINES} AS line FROM v", "fx_keyframe", "fx_scene"))
def shard_files(fx: Fixtures) -> DataFrame:
    """The true place of every record in the shard files."""
    path, _ = built(fx)
    return ds.read_shard_lines(fx.spark, f"{path}/records").select(F.get_json_object("text", "$.sample_token").alias("sample_token"), "split", "shard", "line")


@query("k2_quarantine_file", duck(f"{_CANDIDATES} SELECT reason, CAST(sample_id AS VARCHAR) AS sample_token, scene_token, split, walk_idx FROM c JOIN s USING (scene_token) WHERE reason IS NOT NULL", "fx_keyframe", "fx_scene"))
def quarantine_file(fx: Fixtures) -> DataFrame:
    """The quarantine's JSON lines, read under their schema."""
    path, _ = built(fx)
    return io.unique_by(io.read_json_lines(fx.spark, f"{path}/quarantine", "reason string, sample_token string, scene_token string, split string, walk_idx long"), "sample_token")


@query("s4_hash_verified_read", duck(f"{_PLACED} SELECT CAST(v.sample_id AS VARCHAR) AS sample_token, scene_token, timestamp_us FROM v JOIN c USING (sample_id) WHERE no // {LINES} % 3 <> 1 AND v.sample_id % 4 = 1", "fx_keyframe", "fx_scene"))
def hash_verified_read(fx: Fixtures) -> DataFrame:
    """Records by their (shard, line), from the wanted shards only, each against the hash of the index."""
    path, _ = built(fx)
    wanted = index_of(fx, path).where("shard % 3 <> 1 and cast(sample_token as long) % 4 = 1")
    got = ds.read_placed(fx.spark, f"{path}/records", wanted)
    field = lambda at: F.get_json_object("text", at)
    return got.select("sample_token", field("$.scene_token").alias("scene_token"), field("$.model_inputs.frames[3].timestamp_us").cast("long").alias("timestamp_us"))


def damaged(fx: Fixtures, path: str) -> str:
    """The shards of a dataset written again with faults: lines 4 and 5 change places, line 7 has another scene, line 9 is blank, line 11 has spaces, and line 13 has another token."""
    lines = ds.read_shard_lines(fx.spark, f"{path}/records").withColumn("no", F.col("line") % 20)
    line = F.when(F.col("no") == 4, F.col("line") + 1).when(F.col("no") == 5, F.col("line") - 1).otherwise(F.col("line"))
    scene = F.regexp_replace("text", '"scene_token":"s', '"scene_token":"t')
    text = F.when(F.col("no") == 7, scene).when(F.col("no") == 9, "").when(F.col("no") == 11, F.regexp_replace("text", '"scene_token":', '"scene_token": ')).when(F.col("no") == 13, F.regexp_replace("text", '"sample_token":"(\\d+)","scene_token"', '"sample_token":"x$1","scene_token"')).otherwise(F.col("text"))
    out = io.shared_folder(fx.spark, "damaged")
    ds.write_shard_lines(lines.select("split", "shard", line.alias("line"), text.alias("text")), out)
    return out


# a line without a partner to change places with, at the end of a split, stays alone at its file's next line
_FAULT = f"""CASE WHEN no % 20 IN (4, 5) AND NOT (no % 20 = 4 AND no % {LINES} = last) THEN 'moved' WHEN no % 20 = 7 THEN 'changed' WHEN no % 20 IN (9, 13) THEN 'missing' WHEN no % 20 = 11 THEN 'changed,not_canonical' ELSE '' END"""


@query(
    "j10_index_lines",
    duck(
        f"""{_PLACED}, p AS (SELECT *, max(no % {LINES}) OVER (PARTITION BY split, no // {LINES}) AS last FROM v)
SELECT CAST(sample_id AS VARCHAR) AS sample_token, {_FAULT} AS problems FROM p UNION ALL SELECT NULL, 'blank' FROM p WHERE no % 20 = 9 UNION ALL SELECT 'x' || sample_id, 'extra' FROM p WHERE no % 20 = 13""",
        "fx_keyframe",
        "fx_scene",
    ),
)
def index_lines(fx: Fixtures) -> DataFrame:
    """Every line and index row of damaged shards with what is wrong with it: a line that moved is told apart from one that changed."""
    path, _ = built(fx)
    found = ds.check_shards(ds.read_shard_lines(fx.spark, damaged(fx, path)), index_of(fx, path))
    return found.select("sample_token", F.array_join("problems", ",").alias("problems"))


@query("f11_build_gates", duck(f"{_CANDIDATES} SELECT unnest(['full_coverage', 'reasons_known', 'labels_complete', 'splits_known', 'round_trip']) AS gate, count(*) > 0 AS passed FROM c", "fx_keyframe", "fx_scene"))
def build_gates(fx: Fixtures) -> DataFrame:
    """The gates that the build passed before its manifest was written; ``tests`` have a build for each that fails."""
    path, _ = built(fx)
    return fx.spark.createDataFrame(list(ds.open_dataset(fx.spark, path)["gates"].items()), "gate string, passed boolean")


_ROOT = """, a AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS no FROM {rows}), b AS (SELECT no // 1000 AS no, sha256(string_agg(h, ',' ORDER BY no)) AS h FROM a GROUP BY 1),
d AS (SELECT sha256(string_agg(h, ',' ORDER BY no)) AS h, count(*) AS n FROM b) SELECT {n} AS n, CASE WHEN d.n = 1 THEN (SELECT h FROM b) ELSE d.h END AS root, CASE WHEN d.n = 1 THEN 1 ELSE 2 END AS levels FROM d"""


@query("k3_split_manifest", duck(f"WITH e AS (SELECT scene_token, sha256(scene_token || ':' || split || ':' || n_keyframes) AS h FROM ({_SPLIT})){_ROOT.format(order='scene_token', rows='e', n='(SELECT count(*) FROM e)')}", "fx_scene"))
def split_manifest(fx: Fixtures) -> DataFrame:
    """The sealed manifest of the split: scenes in order, a thousand hashes to one, level by level."""
    entry = F.sha2(F.concat_ws(":", "scene_token", "split", F.col("n_keyframes").cast("string")), 256)
    numbered = w.numbered_names(split_scenes(fx).select("scene_token", entry.alias("h")), "scene_token", "no")
    root, levels = ds.hash_root(numbered, "no", "h")
    manifest = io.seal_manifest({"scenes": numbered.count(), "root": root, "levels": levels})
    path = f"{io.shared_folder(fx.spark, 'split')}/manifest"
    fx.spark.createDataFrame([(io.canonical_text(manifest),)], "value string").coalesce(1).write.text(path)
    read = io.open_manifest(fx.spark.read.text(path).where("value <> ''").first()["value"])
    return fx.spark.createDataFrame([(read["scenes"], read["root"], read["levels"])], "n long, root string, levels int")


#: Faults that are put into records by their sample's number, and the rules that they break.
_FAULTS = [
    (1, "record_version", ["record_version"]),
    (2, "scene_token", ["scene_token"]),
    (3, "provenance.builder_commit", ["builder"]),
    (4, "provenance.contract_version", ["contract_version"]),
    (5, "sample_token", ["frame_anchor"]),
    (6, "speed", ["speed_negative"]),
    (7, "frames", ["frame_time", "frame_repeated", "frame_anchor", "frame_offset"]),
    (8, "short", ["frame_count"]),
    (9, "pose", ["pose_in_history"]),
]


def faulty_records(fx: Fixtures) -> DataFrame:
    r, kind = F.col("record"), F.col("sample_id") % 10
    empty = {"record_version": "v0", "scene_token": "", "provenance.builder_commit": "", "provenance.contract_version": "v99", "sample_token": "other"}
    out = F.when(kind == 0, r)
    for k, what, _ in _FAULTS:
        if what in empty:
            made = r.withField(what, F.lit(empty[what]))
        elif what == "speed":
            made = r.withField("model_inputs.ego_speed_mps", F.lit(-1.0))
        elif what == "frames":
            frames_ = r["model_inputs"]["frames"]
            made = r.withField("model_inputs.frames", F.concat(F.slice(frames_, 1, 3), F.slice(frames_, 3, 1)))
        elif what == "short":
            made = r.withField("model_inputs.frames", F.slice(r["model_inputs"]["frames"], 2, 3))
        else:
            poses = r["oracle_only"]["future_ego_poses"]
            made = r.withField("oracle_only.future_ego_poses", F.transform(poses, lambda p, i: F.when(i == 0, p.withField("sample_token", r["sample_token"])).otherwise(p)))
        out = out.when(kind == k, made)
    return records(fx).where("reason is null").select("sample_id", out.alias("record"))


_BROKEN = " ".join(f"WHEN {k} THEN '{','.join(rules)}'" for k, what, rules in _FAULTS if what not in ("pose", "frames"))


@query(
    "f9_record_violations",
    duck(
        f"""{_CANDIDATES} SELECT sample_id, CASE sample_id % 10 {_BROKEN} WHEN 9 THEN CASE WHEN n_future > 0 THEN 'pose_in_history' ELSE '' END WHEN 7 THEN 'frame_time,frame_repeated,frame_anchor,frame_offset' ELSE '' END AS violations FROM c WHERE reason IS NULL""",
        "fx_keyframe",
        "fx_scene",
    ),
)
def record_violations(fx: Fixtures) -> DataFrame:
    """All rules that each record breaks, of records with faults of nine kinds."""
    return faulty_records(fx).select("sample_id", F.array_join(rc.record_violations(), ",").alias("violations"))


_PROMPT = "Describe the scene."


def requests(fx: Fixtures) -> DataFrame:
    return rc.with_requests(records(fx).where("reason is null"), _PROMPT, one_frame=False)


@query(
    "f10_leak_scan",
    duck(
        f"""{_CANDIDATES}, g AS (SELECT sample_id, CAST(lead(sample_id) OVER ({_W}) AS VARCHAR) AS next_token, CAST(lead(timestamp_us, 3) OVER ({_W}) AS VARCHAR) AS late FROM fx_keyframe)
SELECT sample_id, concat_ws(',', CASE WHEN sample_id % 5 = 1 AND next_token IS NOT NULL THEN 'metadata' END, CASE WHEN sample_id % 7 = 2 AND late IS NOT NULL THEN 'prompt' END) AS leaks FROM c JOIN g USING (sample_id) WHERE reason IS NULL""",
        "fx_keyframe",
        "fx_scene",
    ),
)
def leak_scan(fx: Fixtures) -> DataFrame:
    """Payloads that hold a token or a time of the record's own future; every fifth request is given the next token, every seventh a time three frames on."""
    poses = F.col("record")["oracle_only"]["future_ego_poses"]
    token = F.concat(F.lit("next="), F.get(poses, F.lit(0))["sample_token"])
    # the place of a sample among the numbers of its file name could hold a future token by chance, so tokens are told by their own mark
    meta = F.when(F.col("sample_id") % 5 == 1, token)
    prompt = F.when(F.col("sample_id") % 7 == 2, F.concat("request.prompt", F.get(poses, F.lit(2))["timestamp_us"].cast("string"))).otherwise(F.lit(""))
    found = rc.leaking({"metadata": meta, "prompt": prompt}, rc.future_fingerprints())
    return requests(fx).select("sample_id", F.array_join(found, ",").alias("leaks"))


@query("p6_request_prompt", duck(f"{_CANDIDATES} SELECT sample_id, 4 AS n_frames, '{_PROMPT}' || chr(10) || printf('%.2f', speed) || ' m/s (backward difference from the previous keyframe)' AS prompt FROM (SELECT *, sqrt((ego_x - x0) * (ego_x - x0) + (ego_y - y0) * (ego_y - y0)) / (gap / 1e6) AS speed FROM c JOIN (SELECT sample_id, lag(ego_y) OVER ({_W}) AS y0 FROM fx_keyframe) USING (sample_id)) WHERE reason IS NULL", "fx_keyframe", "fx_scene"))
def request_prompt(fx: Fixtures) -> DataFrame:
    """The prompt of each request, with the ego's speed to two digits; made of the model's inputs alone."""
    return requests(fx).select("sample_id", F.size("request.image_relpaths").alias("n_frames"), "request.prompt")


@query("v3_request_parity", duck(f"{_CANDIDATES} SELECT sample_id, concat_ws(',', CASE WHEN sample_id % 7 = 5 THEN 'prompt' END, CASE WHEN sample_id % 5 = 2 THEN 'image' END, CASE WHEN sample_id % 11 = 6 THEN 'frames' END) AS differences FROM c WHERE reason IS NULL", "fx_keyframe", "fx_scene"))
def request_parity(fx: Fixtures) -> DataFrame:
    """One-frame against four-frame requests, some of which were given another prompt, another image or a frame too few."""
    good = records(fx).where("reason is null")
    four = rc.with_requests(good, _PROMPT, one_frame=False).select("sample_id", F.col("request").alias("four"))
    one = rc.with_requests(good, _PROMPT, one_frame=True).select("sample_id", F.col("request").alias("one"))
    r, n = F.col("one"), F.col("sample_id")
    changed = r.withField("prompt", F.when(n % 7 == 5, F.concat(r["prompt"], F.lit("!"))).otherwise(r["prompt"])).withField("image_relpaths", F.when(n % 5 == 2, F.array(F.lit("other.jpg"))).otherwise(r["image_relpaths"]))
    short = F.when(n % 11 == 6, F.col("four").withField("frame_tokens", F.slice("four.frame_tokens", 2, 3))).otherwise(F.col("four"))
    both = one.withColumn("one", changed).join(four.withColumn("four", short), "sample_id")
    return both.select("sample_id", F.array_join(rc.policy_differences(), ",").alias("differences"))


@query(
    "p7_training_texts",
    duck(f"WITH {_SEEN} SELECT a.anchor_id, 'critical_objects,risk_factors,yield_required,speed_action' AS fields, count(r.rank) AS n_objects, CASE WHEN coalesce(bool_or(fires), false) THEN 'true' ELSE 'false' END AS yields, speed_action FROM fx_anchor a JOIN act USING (anchor_id) LEFT JOIN r ON r.anchor_id = a.anchor_id AND rank <= 8 GROUP BY 1, 5", "fx_object", "fx_anchor"),
)
def training_texts(fx: Fixtures) -> DataFrame:
    """Training targets of every anchor: their fields in the contract's order, with what they say."""
    texts = expected_texts(fx).select("anchor_id", rc.training_target(F.col("expected_output")).alias("t"))
    field = lambda at: F.get_json_object("t", at)
    return texts.select("anchor_id", F.array_join(F.json_object_keys("t"), ",").alias("fields"), F.coalesce(F.json_array_length(field("$.critical_objects")), F.lit(0)).cast("long").alias("n_objects"), field("$.yield_required").alias("yields"), field("$.speed_action").alias("speed_action"))


@query("j15_request_guard", duck(f"{_CANDIDATES} SELECT sample_id, CASE WHEN sample_id % 11 = 3 THEN 'missing' WHEN sample_id % 11 = 5 THEN 'changed' ELSE 'same' END AS status FROM c WHERE reason IS NULL", "fx_keyframe", "fx_scene"))
def request_guard(fx: Fixtures) -> DataFrame:
    """Requests against the hashes of a manifest that was written before: it lacks every eleventh, and another eleventh was hashed from one frame."""
    key = lambda rows: rows.select("sample_id", F.sha2(F.to_json("request"), 256).alias("h"))
    one = key(rc.with_requests(records(fx).where("reason is null"), _PROMPT, one_frame=True)).withColumnRenamed("h", "other")
    now = key(requests(fx))
    manifest = io.shared_folder(fx.spark, "requests")
    kept = now.join(one, "sample_id").where("sample_id % 11 <> 3").select("sample_id", F.when(F.col("sample_id") % 11 == 5, F.col("other")).otherwise(F.col("h")).alias("request_hash"))
    kept.write.parquet(manifest)
    told = fx.spark.read.schema(kept.schema).parquet(manifest)
    status = F.when(F.col("request_hash").isNull(), "missing").when(F.col("request_hash") != F.col("h"), "changed").otherwise("same")
    return now.join(told, "sample_id", "left").select("sample_id", status.alias("status"))
