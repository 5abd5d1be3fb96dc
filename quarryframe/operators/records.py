"""Records of window anchors: building, the closed shape and rules of a record, requests, and the scan for future evidence."""

from __future__ import annotations

import json
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryframe.contracts.assets import DEFAULT_VERSION, VERSIONS, model_face
from quarryframe.contracts.parser import canonical_text, strict_parser
from quarryframe.contracts.schema import compile_schema
from quarryframe.functions.python_rules import py_round
from quarryframe.operators.windows import REASONS, history_window, quarantine_reason, scene_order

# The record's versions and sizes.
RECORD_VERSION, TEMPORAL_POLICY = "v1", "v1"
HISTORY, FUTURE = 4, 6
OFFSET_DIGITS = 6

_NAME = {"type": "string", "minLength": 1}
_INT, _NUMBER, _TARGET = {"type": "integer"}, {"type": "number"}, {"type": ["object", "null"]}


def _closed(**fields) -> dict:
    return {"type": "object", "additionalProperties": False, "required": list(fields), "properties": fields}


RECORD_SCHEMA = _closed(
    record_version={"const": RECORD_VERSION},
    sample_token=_NAME,
    scene_token=_NAME,
    model_inputs=_closed(frames={"type": "array", "minItems": HISTORY, "maxItems": HISTORY, "items": _closed(image_relpath=_NAME, frame_token=_NAME, timestamp_us=_INT, time_offset_s=_NUMBER)}, ego_speed_mps=_NUMBER),
    training_targets=_closed(expected_output=_TARGET, language_reference=_TARGET),
    oracle_only=_closed(future_ego_poses={"type": "array", "items": _closed(sample_token=_NAME, timestamp_us=_INT, x=_NUMBER, y=_NUMBER, yaw=_NUMBER)}),
    provenance=_closed(contract_version=_NAME, temporal_policy_version=_NAME, builder_commit=_NAME, nuscenes_version=_NAME),
)


# -- building --------------------------------------------------------------------------------------------------------


def _bad_pose(p: Column) -> Column:
    broken = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return broken(p["x"]) | broken(p["y"]) | broken(p["yaw"])


def build_records(frames: DataFrame, builder: str, source_version: str, max_gap_us: int = 90_000_000_000) -> DataFrame:
    """(scene_token, sample_id, walk_idx, reason, record) of every anchor that has three keyframes before it.

    ``frames`` has scene_token, sample_id, timestamp_us, walk_idx, image, has_camera, has_image, has_calibration and the ego pose. The record is null where there is a reason: the
    first check of the history that fails, then of the future poses (a missing calibration, a time that does not rise, a pose that is no number). The future ends with
    the scene, which is no fault. A null pose under a calibration is an anomaly.
    """
    seen = history_window(frames, HISTORY).withColumn("reason", quarantine_reason(HISTORY, max_gap_us))
    w = scene_order()
    pose = F.struct(F.col("sample_id").cast("string").alias("sample_token"), "timestamp_us", F.col("ego_x").alias("x"), F.col("ego_y").alias("y"), F.col("ego_yaw").alias("yaw"))
    told = F.struct("image", "sample_id", "timestamp_us", "has_calibration")
    seen = seen.withColumns(
        {
            "past": F.collect_list(told).over(w.rowsBetween(1 - HISTORY, 0)),
            "future": F.collect_list(F.struct(pose.alias("pose"), "has_camera", "has_calibration")).over(w.rowsBetween(1, FUTURE)),
            "before": F.lag(pose).over(w),
        }
    ).where(F.size("window") == HISTORY)
    speed = F.hypot(F.col("ego_x") - F.col("before.x"), F.col("ego_y") - F.col("before.y")) / ((F.col("timestamp_us") - F.col("before.timestamp_us")) / 1e6)
    steps = F.zip_with(F.slice("future", 1, F.size("future") - 1), F.slice("future", 2, F.size("future")), lambda a, b: b["pose"]["timestamp_us"] <= a["pose"]["timestamp_us"])
    # the future is read pose by pose, so the first pose that fails a check names the reason
    late = F.transform(
        F.col("future"),
        lambda f, i: F.when(~f["has_camera"], "NO_CAM_FRONT").when(~f["has_calibration"], "MISSING_CALIBRATION").when((i > 0) & F.coalesce(F.get(steps, i - 1), F.lit(False)), "NON_INCREASING_TIME").when(_bad_pose(f["pose"]), "NUMERIC_ANOMALY"),
    )
    # the images of the history come before its calibrations, and those before any number
    uncalibrated = F.exists("past", lambda f: ~f["has_calibration"]) & F.coalesce(~F.col("reason").isin(*REASONS[:6]), F.lit(True))
    reason = F.coalesce(F.when(uncalibrated, "MISSING_CALIBRATION"), "reason", F.when(speed.isNull() | F.isnan(speed) | (speed == float("inf")), "NUMERIC_ANOMALY"), F.get(F.filter(late, lambda r: r.isNotNull()), F.lit(0)))
    offset = lambda f: F.round((f["timestamp_us"] - F.col("timestamp_us")) / 1e6, OFFSET_DIGITS)
    frame = lambda f: F.struct(f["image"].alias("image_relpath"), f["sample_id"].cast("string").alias("frame_token"), f["timestamp_us"], offset(f).alias("time_offset_s"))
    record = F.struct(
        F.lit(RECORD_VERSION).alias("record_version"),
        F.col("sample_id").cast("string").alias("sample_token"),
        "scene_token",
        F.struct(F.transform("past", frame).alias("frames"), speed.alias("ego_speed_mps")).alias("model_inputs"),
        F.struct(F.lit(None).cast("string").alias("expected_output"), F.lit(None).cast("string").alias("language_reference")).alias("training_targets"),
        F.struct(F.transform("future", lambda f: f["pose"]).alias("future_ego_poses")).alias("oracle_only"),
        F.struct(F.lit(DEFAULT_VERSION).alias("contract_version"), F.lit(TEMPORAL_POLICY).alias("temporal_policy_version"), F.lit(builder).alias("builder_commit"), F.lit(source_version).alias("nuscenes_version")).alias("provenance"),
    )
    out = seen.withColumn("reason", reason)
    return out.select("scene_token", "sample_id", F.col("walk_idx").cast("long").alias("walk_idx"), "reason", F.when(F.col("reason").isNull(), record).alias("record"))


# -- rules -------------------------------------------------------------------------------------------------------------

#: Names of the rules of a record in the order of their report.
RULES = (
    "record_version", "sample_token", "scene_token", "frame_count", "frame_image", "frame_token", "frame_offset_finite", "frame_time", "frame_repeated", "frame_anchor",
    "frame_offset", "speed_finite", "speed_negative", "pose_token", "pose_finite", "pose_time", "pose_repeated", "pose_in_history", "contract_version", "temporal_policy", "builder", "source_version",
)


def record_violations(record: str = "record") -> Column:
    """The names of all rules that a record breaks, in the order of ``RULES``; empty for a good record."""
    r = F.col(record)
    frames, poses, made = r["model_inputs"]["frames"], r["oracle_only"]["future_ego_poses"], r["provenance"]
    empty = lambda v: v.isNull() | (v == "")
    infinite = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rising = lambda ts: ~F.exists(F.zip_with(F.slice(ts, 1, F.greatest(F.size(ts) - 1, F.lit(0))), F.slice(ts, 2, F.greatest(F.size(ts), F.lit(1))), lambda a, b: b <= a), lambda x: F.coalesce(x, F.lit(False)))
    repeated = lambda v: F.size(F.array_distinct(v)) < F.size(v)
    whole, last = F.size(frames) == HISTORY, F.element_at(frames, -1)
    tokens, speed = F.transform(frames, lambda f: f["frame_token"]), r["model_inputs"]["ego_speed_mps"]
    pose_tokens = F.transform(poses, lambda p: p["sample_token"])
    pose_times = F.concat(F.array(last["timestamp_us"]), F.transform(poses, lambda p: p["timestamp_us"]))
    broken = (
        ~r["record_version"].eqNullSafe(F.lit(RECORD_VERSION)),
        empty(r["sample_token"]),
        empty(r["scene_token"]),
        ~whole,
        whole & F.exists(frames, lambda f: empty(f["image_relpath"])),
        whole & F.exists(frames, lambda f: empty(f["frame_token"])),
        whole & F.exists(frames, lambda f: infinite(f["time_offset_s"])),
        whole & ~rising(F.transform(frames, lambda f: f["timestamp_us"])),
        whole & repeated(tokens),
        whole & ~last["frame_token"].eqNullSafe(r["sample_token"]),
        whole & F.exists(frames, lambda f: ~F.round((f["timestamp_us"] - last["timestamp_us"]) / 1e6, OFFSET_DIGITS).eqNullSafe(f["time_offset_s"])),
        infinite(speed),
        ~infinite(speed) & (speed < 0),
        F.exists(poses, lambda p: empty(p["sample_token"])),
        F.exists(poses, lambda p: infinite(p["x"]) | infinite(p["y"]) | infinite(p["yaw"])),
        whole & ~rising(pose_times),
        repeated(pose_tokens),
        F.coalesce(F.arrays_overlap(tokens, pose_tokens), F.lit(False)),
        ~F.coalesce(made["contract_version"].isin(*VERSIONS), F.lit(False)),
        ~made["temporal_policy_version"].eqNullSafe(F.lit(TEMPORAL_POLICY)),
        empty(made["builder_commit"]),
        empty(made["nuscenes_version"]),
    )
    named = F.array(*(F.when(b, F.lit(n)) for n, b in zip(RULES, broken, strict=True)))
    return F.array_compact(named)


@cache
def _shape():
    return compile_schema(RECORD_SCHEMA)


_TEXTS = [T.StructField(n, T.StringType()) for n in ("field", "keyword")]
LINE_TYPE = T.StructType([T.StructField("token", T.StringType()), T.StructField("canonical", T.BooleanType()), T.StructField("errors", T.ArrayType(T.StructType(_TEXTS)))])


@F.pandas_udf(LINE_TYPE)
def check_line(lines: pd.Series) -> pd.DataFrame:
    """Of a record's line: its token, whether it is the canonical text of its value, and where it leaves the closed shape. A text that is no JSON has no token."""
    check, rows = _shape(), []
    for line in lines:
        try:
            value = json.loads(line)
            token = value.get("sample_token") if isinstance(value, dict) else None
            rows.append((token if isinstance(token, str) else None, canonical_text(value) == line, [{"field": f, "keyword": k} for f, k, _ in check(value, "$")]))
        except (TypeError, ValueError, RecursionError):
            rows.append((None, False, [{"field": "$", "keyword": "json"}]))
    return pd.DataFrame(rows, columns=["token", "canonical", "errors"])


# -- requests and leaks ------------------------------------------------------------------------------------------------


def speed_line(speed: Column) -> Column:
    """The line of a prompt that tells the ego's speed, with two digits by Python's rounding."""
    return F.concat(F.format_string("%.2f", py_round(speed, 2)), F.lit(" m/s (backward difference from the previous keyframe)"))


def with_requests(records: DataFrame, prompt: str, one_frame: bool) -> DataFrame:
    """``request`` of each record, from its model inputs alone: policy, contract of the prompt, prompt, images, frames, offsets and speed."""
    inputs = F.col("record.model_inputs")
    frames = F.slice(inputs["frames"], -1, 1) if one_frame else inputs["frames"]
    request = F.struct(
        F.lit("1F" if one_frame else "4F").alias("policy"),
        F.lit(model_face(DEFAULT_VERSION)).alias("contract_version"),
        F.concat(F.lit(prompt), F.lit("\n"), speed_line(inputs["ego_speed_mps"])).alias("prompt"),
        F.transform(frames, lambda f: f["image_relpath"]).alias("image_relpaths"),
        F.transform(frames, lambda f: f["frame_token"]).alias("frame_tokens"),
        F.transform(frames, lambda f: f["time_offset_s"]).alias("time_offsets_s"),
        inputs["ego_speed_mps"].alias("ego_speed_mps"),
    )
    return records.withColumn("request", request)


def training_target(output: Column) -> Column:
    """The text that a model is trained to give: the contract's fields in its own order, compact. An output text that the contract refuses stops the job."""
    read = strict_parser(size=None)(output)
    thing = "struct<id: int, category: string, bbox_2d: array<double>, motion_state: string, bev_x: double, bev_y: double>"
    fields = F.from_json(read["output"], f"critical_objects array<{thing}>, risk_factors array<struct<factor: string, objects: array<int>>>, yield_required boolean, speed_action string")
    return F.when(read["status"] == "ok", F.to_json(fields)).otherwise(F.raise_error(F.concat(F.lit("not an output of the contract: "), F.coalesce(output, F.lit("no text")))))


def policy_differences(one: str = "one", four: str = "four") -> Column:
    """In what a one-frame request is not the newest frame of the four-frame request: ``prompt``, ``speed``, ``image``, ``token``, ``offset``, and ``frames`` for wrong numbers of them."""
    a, b = F.col(one), F.col(four)
    last = lambda k: ~F.element_at(a[k], -1).eqNullSafe(F.element_at(b[k], -1))
    checks = {"prompt": a["prompt"] != b["prompt"], "speed": a["ego_speed_mps"] != b["ego_speed_mps"], "image": last("image_relpaths"), "token": last("frame_tokens"), "offset": last("time_offsets_s"), "frames": (F.size(a["frame_tokens"]) != 1) | (F.size(b["frame_tokens"]) != HISTORY)}
    return F.array_compact(F.array(*(F.when(bad, F.lit(k)) for k, bad in checks.items())))


def future_fingerprints(record: str = "record") -> Column:
    """What no request may hold: tokens and times, as text, of the future poses."""
    poses = F.col(record)["oracle_only"]["future_ego_poses"]
    return F.flatten(F.transform(poses, lambda p: F.array(p["sample_token"], p["timestamp_us"].cast("string"))))


def leaking(payloads: dict[str, Column], fingerprints: Column) -> Column:
    """Sorted names of the payloads that hold a fingerprint."""
    held = lambda text: F.exists(fingerprints, lambda f: F.coalesce(F.contains(text, f), F.lit(False)))
    return F.array_compact(F.array(*(F.when(held(text), F.lit(name)) for name, text in sorted(payloads.items()))))
