"""The chain from the world to a camera's image: rotations as columns, linked poses and calibrations, box corners."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Vector = tuple[Column, Column, Column]
Matrix = tuple[Vector, Vector, Vector]

#: Why a frame has no camera, in the order of the checks.
LINKS = ("NO_CAM_FRONT", "MISSING_POSE", "MISSING_CALIBRATION")


def rotation(q: Column, length: Column | None = None) -> Matrix:
    """The rows of the matrix of a quaternion (array w, x, y, z), which is normalised first."""
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3]) if length is None else length
    w, x, y, z = (q[i] / n for i in range(4))
    return (
        (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        (2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        (2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    )


def rotated(m: Matrix, v: Vector) -> Vector:
    return tuple(r[0] * v[0] + r[1] * v[1] + r[2] * v[2] for r in m)


def rotated_back(m: Matrix, v: Vector) -> Vector:
    """By the transpose, which turns a rotation back."""
    return tuple(m[0][i] * v[0] + m[1][i] * v[1] + m[2][i] * v[2] for i in range(3))


def into_frame(point: Vector, translation: Column, quaternion: Column) -> Vector:
    """A point of the outer frame in the frame that stands in it at ``translation`` with the rotation ``quaternion``."""
    shifted = tuple(p - translation[i] for i, p in enumerate(point))
    return rotated_back(rotation(quaternion), shifted)


def box_corners(centre: Vector, size: Vector, quaternion: Column) -> list[Vector]:
    """The eight corners of a box (length, width, height along its own axes) in the outer frame."""
    m = rotation(quaternion)
    corners = []
    for i in range(8):
        local = tuple(s / 2 * (1 if i >> k & 1 else -1) for k, s in enumerate(size))
        corners.append(tuple(c + r for c, r in zip(centre, rotated(m, local), strict=True)))
    return corners


def linked_cameras(frames: DataFrame, sample_data: DataFrame, poses: DataFrame, calibrations: DataFrame) -> DataFrame:
    """``frames`` with their camera's pose, calibration and ``link``: null where the chain is whole, else the first link that is missing.

    ``sample_data`` names for each sample the tokens of its pose and calibration. All joins keep the frames; tokens have to be unique. Calibrations are few, and Catalyst
    broadcasts them by their size.
    """
    chain = frames.join(sample_data, "sample_id", "left")
    chain = chain.join(poses.withColumn("__pose", F.lit(True)), "pose_token", "left").join(calibrations.withColumn("__cal", F.lit(True)), "calibration_token", "left")
    link = F.when(~F.coalesce("has_camera", F.lit(False)), LINKS[0]).when(F.col("__pose").isNull(), LINKS[1]).when(F.col("__cal").isNull(), LINKS[2])
    return chain.withColumn("link", link).drop("__pose", "__cal")


def _turns(q: np.ndarray) -> np.ndarray:
    """The matrices [row, column, box] of quaternions [w to z, box], which are normalised first; one of length 0 has no rotation and stops the job."""
    n = np.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    if (n == 0).any():
        raise ZeroDivisionError("a quaternion of length 0")
    return np.array(rotation(q, n))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(k, T.DoubleType()) for k in ("depth", "u", "v")])))
def _corners(*cells: pa.Array) -> pa.Array:
    """The corners of boxes from the 28 numbers of ``projected_corners``; null where a number is, and without a place at depth 0."""
    told = [c.is_valid().to_numpy(zero_copy_only=False) for c in cells]
    rows = np.array([c.to_numpy(zero_copy_only=False).astype(float) for c in cells])
    box, pose, sensor, at, size, pose_at, sensor_at, lens = np.split(rows, [4, 8, 12, 15, 18, 21, 24])
    b, p, s = _turns(box), _turns(pose), _turns(sensor)
    back = lambda m, n: np.array([[m[0][i] * n[0][k] + m[1][i] * n[1][k] + m[2][i] * n[2][k] for k in range(3)] for i in range(3)])
    m, centre = back(s, back(p, b)), rotated_back(s, np.array(rotated_back(p, at - pose_at)) - sensor_at)
    halves = [[size[n] / 2 * (1 if i >> n & 1 else -1) for n in range(3)] for i in range(8)]
    x, y, depth = (np.stack([centre[r] + (m[r][0] * h[0] + m[r][1] * h[1] + m[r][2] * h[2]) for h in halves], axis=1) for r in range(3))
    known = np.repeat(np.logical_and.reduce(told[:24]), 8)
    flat, out = depth.ravel(), [pa.array(depth.ravel(), mask=~known)]
    for side, focal, middle in ((x, 0, 2), (y, 1, 3)):
        with np.errstate(divide="ignore", invalid="ignore"):
            place = (lens[middle][:, None] + lens[focal][:, None] * (side / depth)).ravel()
        out.append(pa.array(place, mask=~(known & np.repeat(told[24 + focal] & told[24 + middle], 8) & (flat != 0))))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 8, dtype=np.int32)), pa.StructArray.from_arrays(out, ["depth", "u", "v"]))


def projected_corners(boxes: DataFrame) -> DataFrame:
    """``boxes`` with ``corners``: array of (depth, u, v) of the eight corners in the image of the linked camera.

    Boxes are in the world (x, y, z, length, width, height, rotation); pose and calibration are those of ``linked_cameras``, with the intrinsics fx, fy, cx, cy. The camera looks along its z
    axis; a corner at depth 0 has no place. The three rotations are made and multiplied once for each box, so a corner is one linear form of its half sizes; this is done for
    whole batches of boxes, as one expression of columns repeats its parts.
    """
    parts = lambda k, n: [F.col(k)[i] for i in range(n)]
    cells = [*parts("rotation", 4), *parts("pose_rotation", 4), *parts("sensor_rotation", 4), *map(F.col, ("x", "y", "z", "length", "width", "height")), *parts("pose_translation", 3), *parts("sensor_translation", 3), *map(F.col, ("fx", "fy", "cx", "cy"))]
    return boxes.withColumn("corners", _corners(*(v.cast("double") for v in cells)))
