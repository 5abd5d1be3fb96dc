"""Sequence operators over keyframes: ordered walks, history and future windows, window records, dense indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryframe.operators.numbering import dense_number

#: Reasons in the order of the checks; the first that fails counts.
REASONS = ("INSUFFICIENT_HISTORY", "CROSS_SCENE", "NO_CAM_FRONT", "NON_INCREASING_TIME", "BAD_GAP", "MISSING_IMAGE", "MISSING_CALIBRATION", "NUMERIC_ANOMALY")


def scene_order() -> Window:
    return Window.partitionBy("scene_token").orderBy("timestamp_us", "sample_id")


def keyframe_walk(frames: DataFrame) -> DataFrame:
    """Number the keyframes of each scene in time order, from 0."""
    return frames.withColumn("walk_idx", (F.row_number().over(scene_order()) - 1).cast("long"))


def history_window(frames: DataFrame, size: int = 4) -> DataFrame:
    """``window``: the last ``size`` keyframes up to this one, oldest first."""
    w = scene_order().rowsBetween(1 - size, 0)
    return frames.withColumn("window", F.collect_list(F.struct("sample_id", "timestamp_us", "has_camera", "has_image", "scene_token")).over(w))


def resolve_anchors(requests: DataFrame, frames: DataFrame, history: int = 3) -> DataFrame:
    """``requests`` (request, token, scene) with ``anchor`` and ``why``: the token that is asked for, else the first keyframe of the named scene that has ``history`` before it, else that of the first scene by name.

    ``why`` is ``token``, ``scene`` or ``first``, or, without an anchor, ``NO_TOKEN``, ``NO_SCENE`` or ``TOO_SHORT``. Scenes have one row each where they are joined; the first scene is one row.
    """
    walked = keyframe_walk(frames.select("scene_token", "sample_id", "timestamp_us"))
    scenes = walked.groupBy("scene_token").agg(F.min(F.when(F.col("walk_idx") == history, F.col("sample_id"))).alias("start"))
    first = scenes.agg(F.min(F.struct("scene_token", "start")).alias("f")).select(F.col("f.start").alias("default"))
    known = frames.select(F.col("sample_id").alias("token"), F.lit(True).alias("__known"))
    told = requests.join(known, "token", "left").join(scenes.select(F.col("scene_token").alias("scene"), "start", F.lit(True).alias("__scene")), "scene", "left").crossJoin(F.broadcast(first))
    by_token, by_scene = F.col("token").isNotNull(), F.col("scene").isNotNull()
    anchor = F.when(by_token, F.when(F.col("__known"), F.col("token"))).when(by_scene, F.col("start")).otherwise(F.col("default"))
    why = F.when(by_token, F.when(F.col("__known"), "token").otherwise("NO_TOKEN")).when(by_scene & F.col("__scene").isNull(), "NO_SCENE").when(anchor.isNull(), "TOO_SHORT").otherwise(F.when(by_scene, "scene").otherwise("first"))
    return told.select("request", anchor.alias("anchor"), why.alias("why"))


def linked_history(frames: DataFrame, size: int = 4) -> DataFrame:
    """``window`` as in ``history_window``, by the links ``prev_id`` of the keyframes: a link may lead into another scene, and one that is null or leads nowhere ends the history.

    One join by sample for each step back; ids have to be unique.
    """
    told = lambda: F.struct("sample_id", "timestamp_us", "has_camera", "has_image", "scene_token")
    back = frames.select(F.col("sample_id").alias("__id"), told().alias("__frame"), F.col("prev_id").alias("__next"))
    out = frames.withColumns({"window": F.array(told()), "__prev": F.col("prev_id")})
    for _ in range(size - 1):
        out = out.join(back, F.col("__prev") == F.col("__id"), "left")
        out = out.withColumns({"window": F.when(F.col("__frame").isNull(), F.col("window")).otherwise(F.concat(F.array("__frame"), "window")), "__prev": F.col("__next")}).drop("__id", "__frame", "__next")
    return out.drop("__prev")


def quarantine_reason(size: int = 4, max_gap_us: int = 90_000_000_000) -> Column:
    """Null for a valid window, else the first failing check; needs the columns of ``history_window``."""
    gaps = F.zip_with(F.slice("window", 1, F.size("window") - 1), F.slice("window", 2, F.size("window")), lambda a, b: b["timestamp_us"] - a["timestamp_us"])
    poses = [F.col(c) for c in ("ego_x", "ego_y", "ego_yaw")]
    broken = F.lit(False)
    for pose in poses:
        broken = broken | pose.isNull() | F.isnan(pose) | (F.abs(pose) == float("inf"))
    checks = (
        F.size("window") < size,
        F.exists("window", lambda f: f["scene_token"] != F.col("scene_token")),
        F.exists("window", lambda f: ~f["has_camera"]),
        F.exists(gaps, lambda g: g <= 0),
        F.exists(gaps, lambda g: g > max_gap_us),
        F.exists("window", lambda f: ~f["has_image"]),
        ~F.col("has_calibration"),
        broken,
    )
    out = F.when(checks[0], REASONS[0])
    for check, reason in zip(checks[1:], REASONS[1:], strict=True):
        out = out.when(check, reason)
    return out


def backward_speed(x: str = "ego_x", y: str = "ego_y") -> Column:
    """Planar speed since the keyframe before; null for the first and for a step that takes no time."""
    w = scene_order()
    dt = (F.col("timestamp_us") - F.lag("timestamp_us").over(w)) / 1e6
    return F.when(dt > 0, F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)) / dt)


def backward_speed_by(key: str) -> Column:
    """``backward_speed`` for rows that are told apart by another column than ``sample_id``."""
    w = Window.partitionBy("scene_token").orderBy("timestamp_us", key)
    dt = (F.col("timestamp_us") - F.lag("timestamp_us").over(w)) / 1e6
    return F.when(dt > 0, F.hypot(F.col("ego_x") - F.lag("ego_x").over(w), F.col("ego_y") - F.lag("ego_y").over(w)) / dt)


def future_window(frames: DataFrame, size: int = 6) -> DataFrame:
    """``future``: up to ``size`` following keyframes, cut at the scene's end."""
    w = scene_order().rowsBetween(1, size)
    return frames.withColumn("future", F.collect_list(F.struct("timestamp_us", "ego_x", "ego_y")).over(w))


def future_speeds(window_us: int) -> Column:
    """Speeds between consecutive future poses: a step without time is skipped, the first pose beyond the window stops."""
    start = F.struct(
        F.col("timestamp_us").alias("t"), F.col("ego_x").alias("x"), F.col("ego_y").alias("y"), F.lit(False).alias("stop"), F.expr("cast(array() as array<double>)").alias("out")
    )

    def step(acc: Column, p: Column) -> Column:
        stop = acc["stop"] | (p["timestamp_us"] - F.col("timestamp_us") > window_us)
        dt = (p["timestamp_us"] - acc["t"]) / 1e6
        keep = stop | (dt <= 0)
        speed = F.hypot(p["ego_x"] - acc["x"], p["ego_y"] - acc["y"]) / dt
        return F.struct(
            F.when(keep, acc["t"]).otherwise(p["timestamp_us"]).alias("t"),
            F.when(keep, acc["x"]).otherwise(p["ego_x"]).alias("x"),
            F.when(keep, acc["y"]).otherwise(p["ego_y"]).alias("y"),
            stop.alias("stop"),
            F.when(keep, acc["out"]).otherwise(F.concat(acc["out"], F.array(speed))).alias("out"),
        )

    return F.aggregate("future", start, step, lambda acc: acc["out"])


def dense_index(rows: DataFrame, group: str, order: list[str], name: str = "global_idx") -> DataFrame:
    """A dense number over all rows by (group, order), from 0."""
    return dense_number(rows, [group, *order], name)


def numbered_names(rows: DataFrame, name: str, number: str) -> DataFrame:
    """The rows with a dense number by ``name``, from 0."""
    return dense_number(rows, [name], number)


def lag_in_ranges(rows: DataFrame, place: str, value: str, name: str, span: int = 10_000) -> DataFrame:
    """``name``: the value of the row before by ``place``.

    Rows are dealt out by ranges of ``span`` places; the first of a range takes the last value of the range before, and only one
    row for each range passes through a single task.
    """
    dealt = rows.withColumn("__range", F.floor(F.col(place) / span))
    inside = F.lag(value).over(Window.partitionBy("__range").orderBy(place))
    first = F.row_number().over(Window.partitionBy("__range").orderBy(place)) == 1
    last = dealt.groupBy("__range").agg(F.max_by(value, place).alias("__last"))
    last = last.select("__range", F.lag("__last").over(Window.orderBy("__range")).alias("__before"))
    return dealt.withColumns({"__in": inside, "__first": first}).join(last, "__range").withColumn(name, F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__in"))).drop("__range", "__in", "__first", "__before")
