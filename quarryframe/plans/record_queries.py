"""Queries over records and texts: parsing, projections, joins by key, set operations, validation, text functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryframe.contracts import assets, vocabulary
from quarryframe.contracts.parser import strict_parser
from quarryframe.functions import columns as c
from quarryframe.functions import python_rules as py
from quarryframe.operators import labels as lb
from quarryframe.operators import validation as va
from quarryframe.operators.windows import lag_in_ranges
from quarryframe.plans.fixtures import TABLES, Fixtures, duck
from quarryframe.plans.registry import query
from quarryframe.sources import io

# -- structured model output -------------------------------------------------------------------------------------

_GOOD = '{"critical_objects":[{"id":0,"category":"car","bbox_2d":[1,2,3,4],"motion_state":"stationary","bev_x":1.0,"bev_y":2.0}],"risk_factors":[{"factor":"object_near","objects":[0]}],"yield_required":true,"speed_action":"STOP"}'
#: Kinds of output texts: the change to a good text, its status, and the field and keyword of its first error.
_KINDS = {
    "good": (lambda t: t, "ok", None),
    "fenced": (lambda t: F.concat(F.lit("```json\n"), t, F.lit("\n```")), "ok", None),
    "fence_in_prose": (lambda t: F.concat(F.lit("Here it is:\n```json\n"), t, F.lit("\n```")), "json_parse_failure", ("$", "truncated")),
    "truncated": (lambda t: F.substring(t, 1, 60), "json_parse_failure", ("$", "truncated")),
    "bad_enum": (lambda t: F.replace(t, F.lit("STOP"), F.lit("HALT")), "schema_failure", ("$.speed_action", "enum")),
    "missing_key": (lambda t: F.replace(t, F.lit('"yield_required":true,'), F.lit("")), "schema_failure", ("$", "required")),
    "box_order": (lambda t: F.replace(t, F.lit("[1,2,3,4]"), F.lit("[3,2,1,4]")), "semantic_range_failure", ("$.critical_objects[0].bbox_2d", "corner_order")),
    "box_point": (lambda t: F.replace(t, F.lit("[1,2,3,4]"), F.lit("[1,2,1,2]")), "ok", None),
    "box_outside": (lambda t: F.replace(t, F.lit("[1,2,3,4]"), F.lit("[1,2,1601,4]")), "semantic_range_failure", ("$.critical_objects[0].bbox_2d", "image_bounds")),
    "unknown_ref": (lambda t: F.replace(t, F.lit('"objects":[0]'), F.lit('"objects":[5]')), "semantic_range_failure", ("$.risk_factors[0].objects", "unknown_ref")),
    "repeated_ref": (lambda t: F.replace(t, F.lit('"objects":[0]'), F.lit('"objects":[0,0]')), "schema_failure", ("$.risk_factors[0].objects", "uniqueItems")),
    "braking": (lambda t: F.replace(t, F.lit("object_near"), F.lit("lead_vehicle_braking")), "ok", None),
    "other_words": (lambda t: F.replace(F.replace(t, F.lit('"car"'), F.lit('" Cars"')), F.lit("object_near"), F.lit("Oncoming traffic")), "ok", None),
    "bad_category": (lambda t: F.replace(t, F.lit('"car"'), F.lit('"cart"')), "schema_failure", ("$.critical_objects[0].category", "enum")),
    "no_text": (lambda t: F.lit(None).cast("string"), "json_parse_failure", ("$", "invalid")),
    "no_refs": (lambda t: F.replace(t, F.lit('"objects":[0]'), F.lit('"objects":[]')), "schema_failure", ("$.risk_factors[0].objects", "minItems")),
    "risk_key": (lambda t: F.replace(t, F.lit('"objects":[0]'), F.lit('"objects":[0],"why":1')), "schema_failure", ("$.risk_factors[0]", "additionalProperties")),
    "big_id": (lambda t: F.replace(t, F.lit('"id":0'), F.lit('"id":99')), "schema_failure", ("$.critical_objects[0].id", "maximum")),
    "true_id": (lambda t: F.replace(t, F.lit('"id":0'), F.lit('"id":true')), "schema_failure", ("$.critical_objects[0].id", "type")),
    "whole_id": (lambda t: F.replace(t, F.lit('"id":0'), F.lit('"id":0.0')), "ok", None),
    "box_negative": (lambda t: F.replace(t, F.lit("[1,2,3,4]"), F.lit("[1,-2,3,4]")), "schema_failure", ("$.critical_objects[0].bbox_2d[1]", "minimum")),
    "box_short": (lambda t: F.replace(t, F.lit("[1,2,3,4]"), F.lit("[1,2,3]")), "schema_failure", ("$.critical_objects[0].bbox_2d", "minItems")),
    "synonym": (lambda t: F.replace(F.replace(t, F.lit('"car"'), F.lit('"Sedans"')), F.lit('"stationary"'), F.lit('"not  moving"')), "ok", None),
    "unmapped": (lambda t: F.replace(t, F.lit('"stationary"'), F.lit('"moving"')), "schema_failure", ("$.critical_objects[0].motion_state", "enum")),
    "list_as_ref": (lambda t: F.replace(t, F.lit('"objects":[0]'), F.lit('"objects":[[0]]')), "schema_failure", ("$.risk_factors[0].objects[0]", "type")),
    "too_deep": (lambda t: F.repeat(F.lit("["), F.lit(3000)), "json_parse_failure", ("$", "truncated")),
    "endless": (lambda t: F.replace(t, F.lit('"bev_x":1.0'), F.concat(F.lit('"bev_x":1'), F.repeat(F.lit("0"), F.lit(400)))), "semantic_range_failure", ("$.critical_objects[0].bev_x", "number_range")),
    "json_null": (lambda t: F.lit("null"), "json_parse_failure", ("$", "truncated")),
}


def outputs(fx: Fixtures) -> DataFrame:
    """Output texts by anchor: one kind for each residue of the anchor's number."""
    good = F.lit(_GOOD)
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("anchor_id") % len(_KINDS) + 1).cast("int"))
    text = F.coalesce(*(F.when(kind == name, change(good)) for name, (change, _, _) in _KINDS.items()))
    return fx.view("fx_anchor").select("anchor_id", kind.alias("kind"), text.alias("text"))


def _by_kind(value) -> str:
    """SQL: the value of each kind by the anchor's number."""
    return f"CASE anchor_id % {len(_KINDS)} {' '.join(f'WHEN {i} THEN {v}' for i, row in enumerate(_KINDS.items()) if (v := value(*row)))} END"


_STATUS = _by_kind(lambda _, row: f"'{row[1]}'")
_OK = f"({_STATUS} = 'ok')"


@query("d14_strict_parse", duck(f"SELECT anchor_id, {_STATUS} AS status, anchor_id % {len(_KINDS)} = 1 AS fenced FROM fx_anchor", "fx_anchor"))
def strict_parse(fx: Fixtures) -> DataFrame:
    return outputs(fx).select("anchor_id", strict_parser()("text").alias("p")).select("anchor_id", "p.status", "p.fenced")


@query("a13_parse_errors", duck(f"SELECT {_STATUS} AS category, count(*) AS n FROM fx_anchor WHERE NOT {_OK} GROUP BY 1", "fx_anchor"))
def parse_errors(fx: Fixtures) -> DataFrame:
    errors = outputs(fx).select(strict_parser()("text").alias("p"))
    return errors.select(F.explode(F.array_distinct("p.errors.category")).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


_FIELD, _KEYWORD = (_by_kind(lambda _, row, k=k: row[1] == "schema_failure" and f"'{re.sub(r'[0-9]+]', '*]', row[2][k])}'") for k in (0, 1))


@query("a29_schema_drilldown", duck(f"SELECT {_FIELD} AS field, {_KEYWORD} AS keyword, count(*) AS n FROM fx_anchor WHERE {_STATUS} = 'schema_failure' GROUP BY 1, 2", "fx_anchor"))
def schema_drilldown(fx: Fixtures) -> DataFrame:
    """Schema violations by field (list places made equal) and keyword."""
    errors = outputs(fx).select(F.inline(strict_parser()("text")["errors"])).where("category = 'schema_failure'")
    return errors.groupBy(F.regexp_replace("field", r"\[\d+\]", "[*]").alias("field"), "keyword").agg(F.count(F.lit(1)).alias("n"))


#: Characters by which a kind's text is longer than the good one.
_LONGER = {"bad_category": 1, "missing_key": -22, "repeated_ref": 2, "no_refs": -1, "risk_key": 8, "big_id": 1, "true_id": 3, "box_negative": 1, "box_short": -2, "unmapped": -4, "list_as_ref": 2}
_LENGTH = _by_kind(lambda name, row: str(len(_GOOD) + _LONGER.get(name, 0)))
_DETAILS = {"bad_enum": "HALT", "missing_key": "yield_required", "bad_category": "cart", "no_refs": "0", "risk_key": "why", "box_short": "3", "unmapped": "moving"}
_DETAIL = _by_kind(lambda name, row: f"'{_DETAILS[name]}'" if name in _DETAILS else "NULL")


@query("a29_failure_details", duck(f"SELECT {_FIELD} AS field, {_KEYWORD} AS keyword, {_DETAIL} AS detail, count(*) AS n, min({_LENGTH}) AS shortest, max({_LENGTH}) AS longest FROM fx_anchor WHERE {_STATUS} = 'schema_failure' GROUP BY 1, 2, 3", "fx_anchor"))
def failure_details(fx: Fixtures) -> DataFrame:
    """The second level of the drill-down: words that no vocabulary has, missing and unknown keys, sizes of lists, and the lengths of the texts they stand in."""
    found = outputs(fx).select(F.length("text").cast("long").alias("length"), F.explode(strict_parser()("text")["errors"]).alias("e")).where("e.category = 'schema_failure'")
    each = F.when(F.col("e.keyword") == "additionalProperties", F.from_json("e.detail", "array<string>")).otherwise(F.array("e.detail"))
    rows = found.select("length", F.regexp_replace("e.field", r"\[\d+\]", "[*]").alias("field"), "e.keyword", F.explode(each).alias("detail"))
    return rows.groupBy("field", "keyword", "detail").agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("shortest"), F.max("length").alias("longest"))


_BUCKET = _by_kind(lambda name, row: "'no_text'" if name == "no_text" else {"ok": "'valid'", "json_parse_failure": "'no_json'"}.get(row[1], "'contract'"))


@query("v6_reclassify", duck(f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM fx_anchor GROUP BY 1", "fx_anchor"))
def reclassify(fx: Fixtures) -> DataFrame:
    p = outputs(fx).select("text", strict_parser()("text").alias("p"))
    bucket = F.when(F.col("p.status") == "ok", "valid").when(F.col("text").isNull(), "no_text").when(F.col("p.status") == "json_parse_failure", "no_json").otherwise("contract")
    return p.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("d18_evaluation_run", duck(f"SELECT count(*) AS n, count(*) FILTER ({_OK}) AS parsed, round(count(*) FILTER ({_OK}) / count(*), 9) AS parse_rate FROM fx_anchor", "fx_anchor"))
def evaluation_run(fx: Fixtures) -> DataFrame:
    """Completeness first, then the content metrics of the parsed rows."""
    rows = outputs(fx)
    checked = va.require_complete(fx.view("fx_anchor"), rows, "anchor_id").where("missing = 0 and extra = 0")
    n, ok = F.count(F.lit(1)), c.total(F.col("p.status") == "ok")
    return rows.select(strict_parser()("text").alias("p")).agg(n.alias("n"), ok.alias("parsed"), F.round(c.ratio(ok, n), 9).alias("parse_rate")).crossJoin(checked).drop("missing", "extra")


# -- canonical text, records, requests ------------------------------------------------------------------------------


def order_json(fx: Fixtures) -> DataFrame:
    o = fx.table("orders")
    return o.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("z"), F.col("o_custkey").alias("a"), F.col("o_orderpriority").alias("m"))).alias("text"))


@query("t7_canonical_hash", "SELECT o_orderkey, sha256('{\"a\":' || o_custkey || ',\"m\":\"' || o_orderpriority || '\",\"z\":' || o_orderkey || '}') AS record_hash FROM orders")
def canonical_hash(fx: Fixtures) -> DataFrame:
    return order_json(fx).select("o_orderkey", F.sha2(py.canonical_json("text"), 256).alias("record_hash"))


@query("p1_record_roundtrip", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def record_roundtrip(fx: Fixtures) -> DataFrame:
    back = F.from_json("text", "struct<z: bigint, a: bigint, m: string>")
    return order_json(fx).select("o_orderkey", back.alias("r")).select("o_orderkey", F.col("r.a").alias("o_custkey"), F.col("r.m").alias("o_orderpriority"))


@query("p6_training_target", "SELECT o_orderkey, '{\"critical_objects\":[],\"speed_action\":\"' || o_orderpriority || '\",\"yield_required\":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || '}' AS target FROM orders")
def training_target(fx: Fixtures) -> DataFrame:
    """Fields in a fixed order as compact JSON; a reasoning field is not part of it."""
    fields = F.struct(F.expr("cast(array() as array<int>)").alias("critical_objects"), F.col("o_orderpriority").alias("speed_action"), (F.col("o_orderkey") % 2 == 0).alias("yield_required"))
    return fx.table("orders").select("o_orderkey", F.to_json(fields).alias("target"))


@query("p7_training_samples", "SELECT o_orderkey, sha256('p' || o_orderkey || ':' || o_orderpriority) AS sample_hash FROM orders WHERE o_orderkey % 3 = 0")
def training_samples(fx: Fixtures) -> DataFrame:
    """Records joined with a manifest of the same request hashes."""
    rows = fx.table("orders").select("o_orderkey", "o_orderpriority", F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("prompt"))
    manifest = rows.where("o_orderkey % 3 = 0").select("o_orderkey", F.sha2("prompt", 256).alias("request_hash"))
    joined = rows.join(manifest, "o_orderkey").withColumn("ok", F.when(F.sha2("prompt", 256) == F.col("request_hash"), True).otherwise(F.raise_error("a request differs from the manifest")))
    return joined.where("ok").select("o_orderkey", F.sha2(F.concat_ws(":", "prompt", "o_orderpriority"), 256).alias("sample_hash"))


_W = "PARTITION BY scene_token ORDER BY timestamp_us, sample_id"


@query("p3_request_projection", duck(f"SELECT sample_id, CAST(sample_id AS VARCHAR) AS one_frame, array_to_string(list(sample_id) OVER ({_W} ROWS 3 PRECEDING), ',') AS four_frames FROM fx_keyframe", "fx_keyframe"))
def request_projection(fx: Fixtures) -> DataFrame:
    """The newest frame alone, or the whole window."""
    from quarryframe.operators.windows import history_window

    w = history_window(fx.view("fx_keyframe"))
    return w.select("sample_id", F.element_at("window.sample_id", -1).cast("string").alias("one_frame"), F.array_join("window.sample_id", ",").alias("four_frames"))


@query("p4_collate", duck("SELECT scene_token, walk_idx // 16 AS batch_no, string_agg(CAST(sample_id AS VARCHAR), ',' ORDER BY walk_idx) AS batch FROM fx_keyframe GROUP BY 1, 2", "fx_keyframe"))
def collate(fx: Fixtures) -> DataFrame:
    """Batches of 16 keyframes of a scene, in order."""
    batch_no = F.floor(F.col("walk_idx") / 16).alias("batch_no")
    rows = fx.view("fx_keyframe").groupBy("scene_token", batch_no).agg(F.array_sort(F.collect_list(F.struct("walk_idx", "sample_id"))).alias("b"))
    return rows.select("scene_token", "batch_no", F.array_join("b.sample_id", ",").alias("batch"))


@query("p5_prompt", "SELECT conv_id, turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'Q' ELSE 'Speed: ' || role || chr(10) || 'Q' END AS prompt FROM conversations")
def prompt(fx: Fixtures) -> DataFrame:
    """A leading line only where there is something to say."""
    blank = F.trim(F.coalesce("role", F.lit(""))) == ""
    return fx.table("conversations").select("conv_id", "turn", F.when(blank, F.lit("Q")).otherwise(F.concat(F.lit("Speed: "), "role", F.lit("\nQ"))).alias("prompt"))


@query("p17_tags", duck("SELECT sample_id, 't-' || lpad(CAST((walk_idx * 500) % 10000 AS VARCHAR), 4, '0') || 'ms' AS tag, substr(md5(scene_token), 1, 6) AS colour FROM fx_keyframe", "fx_keyframe"))
def tags(fx: Fixtures) -> DataFrame:
    tag = F.format_string("t-%04dms", (F.col("walk_idx") * 500 % 10000).cast("long"))
    return fx.view("fx_keyframe").select("sample_id", tag.alias("tag"), F.substring(F.md5("scene_token"), 1, 6).alias("colour"))


@query("p18_expected_steps", "SELECT o_orderpriority, CAST(ceil(count(*) / 12.0::DOUBLE) * 3 AS BIGINT) AS steps FROM orders GROUP BY 1")
def expected_steps(fx: Fixtures) -> DataFrame:
    return fx.table("orders").groupBy("o_orderpriority").agg((F.ceil(F.count(F.lit(1)) / 12.0) * 3).cast("long").alias("steps"))


# -- sources and sinks ----------------------------------------------------------------------------------------------


@query("s1_table_scans", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def table_scans(fx: Fixtures) -> DataFrame:
    one = lambda t: fx.table(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
    return reduce(DataFrame.unionAll, map(one, TABLES))


@query("s2_unique_scan", "SELECT o_orderkey, o_custkey FROM orders")
def unique_scan(fx: Fixtures) -> DataFrame:
    return io.unique_by(fx.table("orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query("s6_feature_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'")
def feature_scan(fx: Fixtures) -> DataFrame:
    return fx.table("lineitem").where("l_shipdate >= timestamp_ntz '1998-01-01 00:00:00'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("s7_token_map", "SELECT user_id, min(event_id) AS first_event, max(event_id) AS last_event FROM events GROUP BY 1")
def token_map(fx: Fixtures) -> DataFrame:
    return fx.table("events").groupBy("user_id").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("s8_probe_scan", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def probe_scan(fx: Fixtures) -> DataFrame:
    return fx.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("s12_training_log", "SELECT event_id AS no, round(value, 4) AS loss, coalesce(round(value, 4) > lag(round(value, 4)) OVER (ORDER BY event_id), false) AS rises FROM events WHERE event_id % 3 <> 0")
def training_log(fx: Fixtures) -> DataFrame:
    """Losses from log lines, and where they rise; other lines are skipped."""
    value = F.concat(F.lit("{'loss': "), F.round("value", 4).cast("string"), F.lit(", 'epoch': 1}"))
    lines = fx.table("events").select(F.col("event_id").alias("no"), F.when(F.col("event_id") % 3 == 0, F.lit("saving")).otherwise(value).alias("value"))
    rows = lag_in_ranges(io.training_log(lines), "no", "loss", "before")
    return rows.select("no", "loss", F.coalesce(F.col("loss") > F.col("before"), F.lit(False)).alias("rises"))


@query("s5_manifest_seal", duck("SELECT location, count(*) AS n_scenes, location <> 'loc2' AS verified FROM fx_scene GROUP BY 1", "fx_scene"))
def manifest_seal(fx: Fixtures) -> DataFrame:
    """A sealed manifest for each location, written and read again; one whose count was changed on the way is no longer verified."""
    facts = fx.view("fx_scene").groupBy("location").agg(F.count(F.lit(1)).alias("n_scenes"), F.min("scene_token").alias("first"), F.max("scene_token").alias("last"))
    sealed = facts.select(io.sealed_text(F.struct("location", "n_scenes", "first", "last")).alias("value"))
    path = io.shared_folder(fx.spark, "manifests")
    changed = F.regexp_replace("value", '"n_scenes":', '"n_scenes":1')
    sealed.select(F.when(F.col("value").contains('"loc2"'), changed).otherwise(F.col("value")).alias("value")).write.text(path)
    read = fx.spark.read.text(path).where("value <> ''").select("value", io.seal_holds(F.col("value")).alias("verified"))
    return read.select(F.get_json_object("value", "$.location").alias("location"), "verified").join(facts.select("location", "n_scenes"), "location")


#: A rule config for each part, as text; every fifth is not frozen and every seventh is broken.
_CONFIG = "'{\"base_m\": ' || p_size || ', \"status\": \"' || CASE WHEN p_partkey % 5 = 0 THEN 'draft' ELSE 'frozen' END || CASE WHEN p_partkey % 7 = 0 THEN '\"' ELSE '\"}' END"


@query("s9_frozen_config", f"SELECT p_partkey, CASE WHEN ok THEN p_size END AS base_m, ok AS accepted, sha256(t) AS config_sha256 FROM (SELECT p_partkey, p_size, {_CONFIG} AS t, p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS ok FROM part)")
def frozen_config(fx: Fixtures) -> DataFrame:
    """Configs that are frozen are accepted with the hash of their bytes; a draft and a broken text are not."""
    texts = fx.table("part").select("p_partkey", F.expr(_CONFIG).alias("text"))
    return io.frozen_configs(texts, "text", "base_m int, status string").select("p_partkey", F.col("config.base_m").alias("base_m"), "accepted", "config_sha256")


@query("k4_markdown_report", "SELECT '| o_orderstatus | n |' AS line UNION ALL SELECT '|-|-|' UNION ALL SELECT '| ' || o_orderstatus || ' | ' || count(*) || ' |' FROM orders GROUP BY o_orderstatus")
def markdown_report(fx: Fixtures) -> DataFrame:
    table = fx.table("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).orderBy("o_orderstatus")
    return fx.spark.createDataFrame([(line,) for line in io.markdown_table(table).split("\n")], "line string")


@query("k8_token_subset", "SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 128")
def token_subset(fx: Fixtures) -> DataFrame:
    return fx.table("orders").orderBy(F.md5(F.col("o_orderkey").cast("string")), "o_orderkey").limit(128).select("o_orderkey")


# -- joins, sets, validation ------------------------------------------------------------------------------------------


@query("j7_prediction_join", duck("SELECT anchor_id, gt_action = pred_action AS agree FROM fx_anchor WHERE parse_ok", "fx_anchor"))
def prediction_join(fx: Fixtures) -> DataFrame:
    a = fx.view("fx_anchor")
    return a.select("anchor_id", "gt_action").join(a.where("parse_ok").select("anchor_id", "pred_action"), "anchor_id").select("anchor_id", (F.col("gt_action") == F.col("pred_action")).alias("agree"))


@query("j9_score_intersection", duck("SELECT scene_token, count(*) AS n FROM fx_anchor WHERE anchor_id % 2 = 0 AND anchor_id % 3 = 0 GROUP BY 1", "fx_anchor"))
def score_intersection(fx: Fixtures) -> DataFrame:
    a = fx.view("fx_anchor")
    return a.where("anchor_id % 2 = 0").join(a.where("anchor_id % 3 = 0").select("anchor_id"), "anchor_id").groupBy("scene_token").agg(F.count(F.lit(1)).alias("n"))


_GEN = """SELECT coalesce(a.o_orderkey, b.k) AS o_orderkey, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'extra' WHEN b.k % 10 = 3 THEN 'changed' ELSE 'same' END AS status,
CASE WHEN a.o_orderkey IS NOT NULL AND b.k % 10 = 3 THEN 'o_custkey' ELSE '' END AS changed FROM (SELECT * FROM orders WHERE o_orderkey % 11 <> 0) a FULL JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 13 <> 0) b ON a.o_orderkey = b.k"""


def generations(fx: Fixtures) -> DataFrame:
    o = fx.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    new = o.where("o_orderkey % 13 <> 0").withColumn("o_custkey", F.when(F.col("o_orderkey") % 10 == 3, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return va.compare_generations(o.where("o_orderkey % 11 <> 0"), new, "o_orderkey", ["o_custkey", "o_orderpriority"])


@query("j11_generation_parity", _GEN)
def generation_parity(fx: Fixtures) -> DataFrame:
    return generations(fx)


@query("v2_generation_drift", f"SELECT status, changed, count(*) AS n, changed IN ('', 'o_custkey') AS allowed FROM ({_GEN}) GROUP BY 1, 2")
def generation_drift(fx: Fixtures) -> DataFrame:
    """Changes by column, and whether only columns of the allow-list changed."""
    return generations(fx).groupBy("status", "changed").agg(F.count(F.lit(1)).alias("n")).withColumn("allowed", F.col("changed").isin("", "o_custkey"))


@query("v1_parity_gate", f"SELECT bool_and(status = 'same') AS passed, count(*) FILTER (status <> 'same') AS failed FROM ({_GEN})")
def parity_gate(fx: Fixtures) -> DataFrame:
    return generations(fx).agg(F.every(F.col("status") == "same").alias("passed"), c.total(F.col("status") != "same").alias("failed"))


@query("f12_completeness", "SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 13 = 0) AS missing, (SELECT count(*) FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 13 <> 0) AS extra")
def completeness(fx: Fixtures) -> DataFrame:
    o = fx.table("orders").select("o_orderkey")
    return va.require_complete(o.where("o_orderkey % 11 <> 0 or o_orderkey % 13 = 0"), o.where("o_orderkey % 13 <> 0"), "o_orderkey")


@query("e2_missing_tokens", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def missing_tokens(fx: Fixtures) -> DataFrame:
    return fx.table("orders").select("o_orderkey").subtract(fx.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey")))


_LISTS = "SELECT anchor_id, list(DISTINCT category) FILTER (obj_idx < 3) AS a, list(DISTINCT category) FILTER (obj_idx >= 2) AS b FROM fx_box GROUP BY 1"


@query("e3_factor_sets", duck(f"SELECT anchor_id, array_to_string(list_sort(list_intersect(coalesce(a, []), coalesce(b, []))), ',') AS shared, array_to_string(list_sort(list_filter(coalesce(a, []), lambda v: NOT list_contains(coalesce(b, []), v))), ',') AS uncovered FROM ({_LISTS})", "fx_box"))
def factor_sets(fx: Fixtures) -> DataFrame:
    sets = fx.view("fx_box").groupBy("anchor_id").agg(F.collect_set(F.when(F.col("obj_idx") < 3, F.col("category"))).alias("a"), F.collect_set(F.when(F.col("obj_idx") >= 2, F.col("category"))).alias("b"))
    return sets.select("anchor_id", F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("shared"), F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("uncovered"))


@query("e4_semantic_sets", duck(f"SELECT anchor_id, list_sort(coalesce(a, [])) = list_sort(coalesce(b, [])) AS same FROM ({_LISTS})", "fx_box"))
def semantic_sets(fx: Fixtures) -> DataFrame:
    sets = fx.view("fx_box").groupBy("anchor_id").agg(F.collect_set(F.when(F.col("obj_idx") < 3, F.col("category"))).alias("a"), F.collect_set(F.when(F.col("obj_idx") >= 2, F.col("category"))).alias("b"))
    return sets.select("anchor_id", (F.array_sort("a") == F.array_sort("b")).alias("same"))


@query("e5_concat", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 1")
def concat(fx: Fixtures) -> DataFrame:
    o = fx.table("orders").select("o_orderkey", "o_custkey")
    return o.where("o_orderkey % 2 = 0").unionByName(o.where("o_orderkey % 2 = 1").select("o_custkey", "o_orderkey"))


@query("e6_tree_diff", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '$.a' WHEN o_orderkey % 5 = 1 THEN '$.m.x' ELSE '' END AS paths FROM orders")
def tree_diff(fx: Fixtures) -> DataFrame:
    """Paths of the leaves that differ between two typed trees."""
    k = F.col("o_orderkey")
    left = F.struct(k.alias("a"), F.struct(F.col("o_orderpriority").alias("x")).alias("m"))
    right = F.struct(F.when(k % 5 == 0, k + 1).otherwise(k).alias("a"), F.struct(F.when(k % 5 == 1, F.lit("?")).otherwise(F.col("o_orderpriority")).alias("x")).alias("m"))
    both = fx.table("orders").select("o_orderkey", left.alias("l"), right.alias("r"))
    return both.select("o_orderkey", va.violations({"$.a": ~F.col("l.a").eqNullSafe(F.col("r.a")), "$.m.x": ~F.col("l.m.x").eqNullSafe(F.col("r.m.x"))}).alias("paths"))


@query("e7_line_diff", "SELECT count(*) AS differing FROM orders WHERE o_orderkey % 10 = 3")
def line_diff(fx: Fixtures) -> DataFrame:
    """Lines of one output that the other lacks, repeats counted."""
    a = order_json(fx).select(F.sha2("text", 256).alias("h"))
    b = order_json(fx).where("o_orderkey % 10 <> 3").select(F.sha2("text", 256).alias("h"))
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("differing"))


@query("d22_rebuild_compare", "SELECT count(*) AS n, true AS identical FROM orders")
def rebuild_compare(fx: Fixtures) -> DataFrame:
    a, b = (order_json(fx).select("o_orderkey", F.sha2("text", 256).alias(h)) for h in ("x", "y"))
    return a.join(b, "o_orderkey", "full_outer").agg(F.count(F.lit(1)).alias("n"), F.every(F.col("x").eqNullSafe(F.col("y"))).alias("identical"))


@query("v5_array_compare", "SELECT a.vec_id, round(CAST(list_max(list_transform(range(1, 65), lambda i: abs(a.embedding[i] - b.embedding[i]))) AS DOUBLE), 4) AS delta FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def array_compare(fx: Fixtures) -> DataFrame:
    e = fx.table("embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(va.array_difference(F.col("embedding"), F.col("other")).cast("double"), 4).alias("delta"))


@query("o4_lexicographic_share", duck("SELECT scene_token, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY scene_token ORDER BY CAST(sample_id AS VARCHAR)) AS r, count(*) OVER (PARTITION BY scene_token) AS n FROM fx_keyframe) WHERE r <= floor(n * 0.1)", "fx_keyframe"))
def lexicographic_share(fx: Fixtures) -> DataFrame:
    w = Window.partitionBy("scene_token")
    rows = fx.view("fx_keyframe").withColumns({"r": F.row_number().over(w.orderBy(F.col("sample_id").cast("string"))), "n": F.count(F.lit(1)).over(w)})
    return rows.where(F.col("r") <= F.floor(F.col("n") * 0.1)).select("scene_token", "sample_id")


@query("o6_prefix_limit", duck("SELECT scene_token, sample_id FROM fx_keyframe WHERE walk_idx < 4", "fx_keyframe"))
def prefix_limit(fx: Fixtures) -> DataFrame:
    return fx.view("fx_keyframe").where("walk_idx < 4").select("scene_token", "sample_id")


# -- text functions ---------------------------------------------------------------------------------------------------

_STOP_SQL = ", ".join(f"'{w}'" for w in c.STOP_WORDS)


@query("t1_keyword_counts", f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]*')) AS word FROM conversations) WHERE word NOT IN ({_STOP_SQL}) GROUP BY 1")
def keyword_counts(fx: Fixtures) -> DataFrame:
    words = fx.table("conversations").select(F.explode(c.keywords(F.col("text"))).alias("word"))
    return words.where(~F.col("word").isin(*c.STOP_WORDS)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("a27_top_keywords", f"SELECT word, n, round(100.0 * n / (SELECT count(*) FROM conversations), 6) AS per_hundred FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]*')) AS word FROM conversations) WHERE word NOT IN ({_STOP_SQL}) GROUP BY 1) ORDER BY n DESC, word LIMIT 20")
def top_keywords(fx: Fixtures) -> DataFrame:
    n = fx.table("conversations").agg(F.count(F.lit(1)).alias("rows"))
    return keyword_counts(fx).orderBy(F.desc("n"), "word").limit(20).crossJoin(F.broadcast(n)).select("word", "n", F.round(100.0 * F.col("n") / F.col("rows"), 6).alias("per_hundred"))


@query("o5_most_common", "SELECT event_type, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, event_type LIMIT 3")
def most_common(fx: Fixtures) -> DataFrame:
    return fx.table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("t2_normal_term", "SELECT p_partkey, replace(lower(regexp_replace(trim(p_type), '\\s+', ' ', 'g')), ' ', '_') AS term FROM part")
def normal_term(fx: Fixtures) -> DataFrame:
    return fx.table("part").select("p_partkey", c.normal_term(F.col("p_type")).alias("term"))


_SING = "array_to_string(list_transform(string_split(t, '_'), lambda w: CASE WHEN length(w) > 2 AND w LIKE '%s' AND NOT w LIKE '%ss' THEN left(w, -1) ELSE w END), '_')"


@query("t3_singular_term", f"SELECT w, {_SING} AS singular FROM (SELECT DISTINCT event_type || 's_boss_' || event_type AS w, event_type || 's_boss_' || event_type AS t FROM events)")
def singular_term(fx: Fixtures) -> DataFrame:
    words = fx.table("events").select(F.concat("event_type", F.lit("s_boss_"), "event_type").alias("w")).distinct()
    return words.select("w", c.singular_term(F.col("w")).alias("singular"))


#: Open terms, with the field of their vocabulary and the word that it has for them in v3 and in v7.
_OPEN_TERMS = [
    ("category", "Sedan", "car", "car"),
    ("category", "SUVs", "car", "car"),
    ("category", "car", "car", "car"),
    ("category", " road   Cone ", "traffic_cone", "traffic_cone"),
    ("category", "Delivery trucks", "truck", "truck"),
    ("category", "vehicle", None, None),
    ("motion_state", "parked", "stationary", "stationary"),
    ("motion_state", "head-on", "oncoming", "oncoming"),
    ("motion_state", "moving", None, None),
    ("risk_factor", "Pedestrian crossing", "pedestrian_crossing", "vru_crossing"),
    ("risk_factor", "cut-in", "vehicle_merging", "vehicle_crossing"),
    ("risk_factor", "tailgating", "small_following_gap", None),
    ("risk_factor", "object_near", None, "object_near"),
    ("category", None, None, None),
]


def open_terms(fx: Fixtures) -> DataFrame:
    """(p_partkey, version, field, text): for each part one open term, read under v3 for every second brand and under v7 for the others."""
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(t).cast("string").alias("text")) for f, t, _, _ in _OPEN_TERMS))
    version = F.when(F.substring("p_brand", -1, 1).cast("int") % 2 == 0, "v3").otherwise("v7")
    at = F.get(cells, (F.col("p_partkey") % len(_OPEN_TERMS)).cast("int"))
    return fx.table("part").select("p_partkey", version.alias("version"), at["field"].alias("field"), at["text"].alias("text"))


_V3 = "CAST(right(p_brand, 1) AS INT) % 2 = 0"
_OPEN = lambda k: f"CASE p_partkey % {len(_OPEN_TERMS)} {' '.join(f'WHEN {i} THEN ' + (repr(row[k]) if row[k] else 'NULL') for i, row in enumerate(_OPEN_TERMS))} END"
_WORDS = f"(SELECT p_partkey, CASE WHEN {_V3} THEN 'v3' ELSE 'v7' END AS version, {_OPEN(0)} AS field, {_OPEN(1)} AS text, CASE WHEN {_V3} THEN {_OPEN(2)} ELSE {_OPEN(3)} END AS word FROM part)"


@query("t4_synonyms", f"SELECT *, CASE WHEN word IS NULL THEN 'unmapped' WHEN word = text THEN 'canonical' ELSE 'normalized' END AS mapping FROM {_WORDS}")
def synonyms(fx: Fixtures) -> DataFrame:
    """The word of each open term in its contract's vocabulary: by the term, then by its singular; what is unmapped is told and never repaired."""
    terms = vocabulary.term_table(vocabulary.vocabulary_table(fx.spark))
    return vocabulary.with_words(open_terms(fx), terms, F.col("version"), F.col("field"), "text")


@query("t4_unmapped_terms", f"SELECT version, field, text, count(*) AS n FROM {_WORDS} WHERE word IS NULL AND text IS NOT NULL GROUP BY ALL")
def unmapped_terms(fx: Fixtures) -> DataFrame:
    """Open terms that no vocabulary knows, with how often they stand."""
    return synonyms(fx).where("mapping = 'unmapped' and text is not null").groupBy("version", "field", "text").agg(F.count(F.lit(1)).alias("n"))


_NAMED = lambda k: _by_kind(lambda name, row: {"other_words": ["[' Cars', 'Oncoming traffic']", "['car', 'oncoming_traffic']"], "synonym": ["['Sedans', 'not  moving']", "['car', 'stationary']"]}.get(name, [None] * 2)[k])


@query("d14_terms", duck(f"SELECT anchor_id, unnest({_NAMED(0)}) AS term, unnest({_NAMED(1)}) AS word FROM fx_anchor UNION ALL SELECT anchor_id, {_by_kind(lambda name, row: {'unmapped': repr('moving'), 'bad_category': repr('cart')}.get(name))}, NULL FROM fx_anchor WHERE {_by_kind(lambda name, row: str(name in ('unmapped', 'bad_category')))}", "fx_anchor"))
def parser_terms(fx: Fixtures) -> DataFrame:
    """Terms that the parser rewrote, with their words, and terms that it left for the schema to refuse."""
    p = outputs(fx).select("anchor_id", strict_parser()("text").alias("p"))
    rewritten = p.select("anchor_id", F.inline("p.terms"))
    return rewritten.unionByName(p.select("anchor_id", F.explode("p.unmapped").alias("term"), F.lit(None).cast("string").alias("word")))


@query("t5_fence_extract", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text END AS body FROM conversations")
def fence_extract(fx: Fixtures) -> DataFrame:
    """Only a text that is one fence has a body."""
    rows = fx.table("conversations")
    fenced = F.concat(F.when(F.col("turn") % 2 == 0, F.lit("")).otherwise(F.lit("so: ")), F.lit("```json\n"), "text", F.lit("\n```\n"))
    return rows.select("conv_id", "turn", c.fenced_body(fenced).alias("body"))


@query("t6_json_paths", "SELECT l_orderkey, '$.objects[' || (l_linenumber % 4) || '].bbox' AS path FROM lineitem")
def json_paths(fx: Fixtures) -> DataFrame:
    parts = F.array(F.lit("objects"), (F.col("l_linenumber") % 4).cast("string"), F.lit("bbox"))
    path = F.aggregate(parts, F.lit("$"), lambda acc, p: F.when(p.rlike(r"^\d+$"), F.concat(acc, F.lit("["), p, F.lit("]"))).otherwise(F.concat(acc, F.lit("."), p)))
    return fx.table("lineitem").select("l_orderkey", path.alias("path"))


@query("t8_predicates", "SELECT count(*) FILTER (contains(p_name, 'a')) AS has_a, count(*) FILTER (starts_with(p_brand, 'Brand#1')) AS brand1, count(*) FILTER (suffix(p_type, 'S')) AS ends FROM part")
def predicates(fx: Fixtures) -> DataFrame:
    return fx.table("part").agg(c.total(F.contains("p_name", F.lit("a"))).alias("has_a"), c.total(F.startswith("p_brand", F.lit("Brand#1"))).alias("brand1"), c.total(F.endswith("p_type", F.lit("S"))).alias("ends"))


@query("t9_list_text", "SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) AS joined, count(*) AS n FROM orders GROUP BY 1")
def list_text(fx: Fixtures) -> DataFrame:
    rows = fx.table("orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderpriority")), ",").alias("joined"))
    return rows.select("o_custkey", "joined", F.size(F.filter(F.split("joined", ","), lambda x: x != "")).cast("long").alias("n"))


@query("t10_time_parts", duck("SELECT sample_id, timestamp_us // 1000000 AS second, (timestamp_us // 3600000000) % 24 AS hour FROM fx_keyframe", "fx_keyframe"))
def time_parts(fx: Fixtures) -> DataFrame:
    us = F.col("timestamp_us")
    return fx.view("fx_keyframe").select("sample_id", F.floor(us / 1_000_000).alias("second"), (F.floor(us / 3_600_000_000) % 24).alias("hour"))


@query("t11_half_up", "SELECT l_orderkey, CAST(floor(l_quantity * 0.1 + 0.5) AS BIGINT) AS share, CASE WHEN l_discount < 0.05 THEN -l_quantity ELSE l_quantity END AS signed FROM lineitem")
def half_up(fx: Fixtures) -> DataFrame:
    q = F.col("l_quantity")
    return fx.table("lineitem").select("l_orderkey", F.floor(q * 0.1 + 0.5).alias("share"), F.when(F.col("l_discount") < 0.05, -q).otherwise(q).alias("signed"))


@query("t13_rectangle_gap", duck("SELECT anchor_id, ann_no, round(sqrt(greatest(abs(x_c) - 2.05, 0) * greatest(abs(x_c) - 2.05, 0) + greatest(abs(y_c) - 0.935, 0) * greatest(abs(y_c) - 0.935, 0)), 6) AS gap FROM fx_object", "fx_object"))
def rectangle_gap(fx: Fixtures) -> DataFrame:
    return fx.view("fx_object").select("anchor_id", "ann_no", F.round(c.rectangle_gap(F.col("x_c"), F.col("y_c"), 2.05, 0.935), 6).alias("gap"))


@query("t14_percent", "SELECT o_orderstatus, round(CASE WHEN count(*) FILTER (o_orderpriority = '1-URGENT') = 0 THEN 0 ELSE 100.0 * count(*) FILTER (o_orderkey % 50 = 0) / count(*) FILTER (o_orderpriority = '1-URGENT') END, 6) AS percent FROM orders GROUP BY 1")
def percent(fx: Fixtures) -> DataFrame:
    a, b = c.total(F.col("o_orderkey") % 50 == 0), c.total(F.col("o_orderpriority") == "1-URGENT")
    return fx.table("orders").groupBy("o_orderstatus").agg(F.round(c.ratio(a * 100.0, b), 6).alias("percent"))


@query("t15_finite_corners", duck("SELECT anchor_id, ann_no, CASE WHEN x_c = 0 THEN 'none' ELSE 'finite' END AS corners FROM fx_object", "fx_object"))
def finite_corners(fx: Fixtures) -> DataFrame:
    """Rounded coordinates, or nothing if one of them is no number."""
    corners = F.array(F.try_divide(F.col("y_c"), F.col("x_c")), F.col("y_c"))
    kept = F.when(~F.exists(corners, lambda v: v.isNull() | F.isnan(v)), F.transform(corners, lambda v: F.round(v, 3)))
    return fx.view("fx_object").select("anchor_id", "ann_no", F.when(kept.isNull(), "none").otherwise("finite").alias("corners"))


@query("j8_counterfactual_join", duck("SELECT count(*) AS n FROM fx_anchor a JOIN fx_anchor b ON b.anchor_id = a.anchor_id + 2 WHERE a.parse_ok AND b.parse_ok", "fx_anchor"))
def counterfactual_join(fx: Fixtures) -> DataFrame:
    a = fx.view("fx_anchor").where("parse_ok").select("anchor_id")
    return a.join(a.select((F.col("anchor_id") - 2).alias("anchor_id")), "anchor_id").agg(F.count(F.lit(1)).alias("n"))


@query("j12_attribution_bridge", duck("SELECT a.anchor_id, a.obj_idx AS pred_id, coalesce(b.obj_idx, -1) AS gt_id FROM fx_box a LEFT JOIN fx_box b ON b.anchor_id = a.anchor_id AND b.obj_idx = a.obj_idx - 1 AND b.category = a.category", "fx_box"))
def attribution_bridge(fx: Fixtures) -> DataFrame:
    """Predicted ids bridged to reference ids; -1 where there is no match."""
    b = fx.view("fx_box").select("anchor_id", "category", "obj_idx")
    matched = b.select("anchor_id", "category", (F.col("obj_idx") + 1).alias("pred_id"), F.col("obj_idx").alias("gt_id"))
    return b.withColumnRenamed("obj_idx", "pred_id").join(matched, ["anchor_id", "category", "pred_id"], "left").select("anchor_id", "pred_id", F.coalesce("gt_id", F.lit(-1)).alias("gt_id"))


@query("v3_policy_parity", duck(f"SELECT count(*) AS n, count(*) FILTER (k > 4 OR newest <> sample_id) AS broken FROM (SELECT sample_id, count(*) OVER h AS k, last_value(sample_id) OVER h AS newest FROM fx_keyframe WINDOW h AS ({_W} ROWS 3 PRECEDING))", "fx_keyframe"))
def policy_parity(fx: Fixtures) -> DataFrame:
    """The one-frame request is the newest frame of the four-frame one."""
    from quarryframe.operators.windows import history_window

    w = history_window(fx.view("fx_keyframe"))
    return w.agg(F.count(F.lit(1)).alias("n"), c.total((F.size("window") > 4) | (F.element_at("window", -1)["sample_id"] != F.col("sample_id"))).alias("broken"))


# a rule config for each part, with half widths in hundredths of a metre; the frozen one is that of every sixth part
_RULE_VALUES = {"y_brake": "CASE WHEN p_partkey % 6 = 0 THEN 1.185e0 ELSE p_size / 20e0 END", "y_still": "CASE WHEN p_partkey % 6 = 0 THEN 3e0 ELSE p_partkey % 40 / 10e0 END", "ego_width": "CASE WHEN p_partkey % 6 < 3 THEN 1.87e0 ELSE 1.9e0 END", "margin": "0.5e0", "drop": "CASE WHEN p_partkey % 11 = 5 THEN NULL ELSE 0.5e0 END"}
_RULES_OF = f"SELECT p_partkey, {', '.join(f'{v} AS {k}' for k, v in _RULE_VALUES.items())} FROM part"


@query(
    "v4_config_invariants",
    f"""SELECT p_partkey, concat_ws(',', CASE WHEN y_still < y_brake THEN 'stationary_narrower' END, CASE WHEN abs(1.185 - (ego_width + margin) / 2) > 1e-9 THEN 'band_width' END, CASE WHEN y_brake <= 0 OR y_still <= 0 THEN 'not_positive' END,
CASE WHEN "drop" IS NULL THEN 'missing_key' END) AS broken FROM ({_RULES_OF.replace('AS drop', 'AS "drop"')})""",
)
def config_invariants(fx: Fixtures) -> DataFrame:
    """The invariants that each rule config breaks."""
    fx.table("part").createOrReplaceTempView("part")
    return fx.spark.sql(_RULES_OF).select("p_partkey", va.violations(lb.config_invariants()).alias("broken"))


@query("s3_score_scan", duck("SELECT anchor_id, gt_yield = pred_yield AS agree FROM fx_anchor WHERE parse_ok", "fx_anchor"))
def score_scan(fx: Fixtures) -> DataFrame:
    """Scores by anchor; a repeated or missing key stops the job."""
    rows = fx.view("fx_anchor").where("parse_ok").select("anchor_id", (F.col("gt_yield") == F.col("pred_yield")).alias("agree"))
    return io.unique_by(rows, "anchor_id")


_FACES = " ".join(f"WHEN {int(v[1:])} THEN '{assets.model_face(v)}'" for v in assets.VERSIONS)


@query("s10_contract_lineage", f"SELECT p_partkey, 'v' || (p_partkey % 9) AS version, CASE p_partkey % 9 {_FACES} END AS face FROM part")
def contract_lineage(fx: Fixtures) -> DataFrame:
    """The version whose prompt the requests of each row's contract show; null for a version that there is not."""
    version = F.concat(F.lit("v"), (F.col("p_partkey") % 9).cast("string"))
    return fx.table("part").select("p_partkey", version.alias("version"), c.literal_map({v: assets.model_face(v) for v in assets.VERSIONS})[version].alias("face"))


@query("k5_grid_files", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def grid_files(fx: Fixtures) -> DataFrame:
    """A grid written as Parquet, CSV and JSON; all three read back the same."""
    grid = fx.table("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    back = io.write_grid(grid)
    first, *others = back
    for other in others:
        if not first.exceptAll(other).isEmpty() or not other.exceptAll(first).isEmpty():
            raise ValueError("the formats differ")
    return first


@query("p16_provenance", "SELECT o_orderkey, 'rules-1' AS rules, 'v7' AS contract FROM orders")
def provenance(fx: Fixtures) -> DataFrame:
    return fx.table("orders").select("o_orderkey", F.lit("rules-1").alias("rules"), F.lit("v7").alias("contract"))
