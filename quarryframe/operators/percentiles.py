"""Exact percentiles without a task that holds all values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryframe.operators.numbering import RANGES, in_ranges
from quarryframe.sources.io import drop_folder, shared_folder

#: Distinct values of a range that the driver looks at one by one.
FEW = 2000


def _spans(counts: DataFrame, keys: list[str], ranges: int) -> list[dict]:
    """Of each range of the keys, in order: rows, and its first and last key."""
    key = F.struct(*keys)
    found = in_ranges(counts, keys, "__r", ranges).groupBy("__r").agg(F.sum("n").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("keys"))
    return [r.asDict() for r in found.orderBy("__r").collect()]


def _at_ranks(counts: DataFrame, keys: list[str], ranks: list[int], ranges: int) -> dict[int, tuple]:
    """The key at each of the sorted global ranks: ranges are counted, and only those that hold a rank are looked into again."""
    found: dict[int, tuple] = {}
    todo = [(counts, 0, sorted(set(ranks)))]
    while todo:
        part, before, wanted = todo.pop()
        for span in _spans(part, keys, ranges):
            inside = [r for r in wanted if before <= r < before + span["n"]]
            if inside and span["low"] == span["high"]:
                found |= dict.fromkeys(inside, tuple(span["low"]))
            elif inside:
                rest = part.where((F.struct(*keys) >= _literal(span["low"], part, keys)) & (F.struct(*keys) <= _literal(span["high"], part, keys)))
                if span["keys"] > FEW:
                    todo.append((rest, before, inside))
                else:
                    at = before
                    for row in rest.select(*keys, "n").orderBy(*keys).collect():
                        found |= dict.fromkeys([r for r in inside if at <= r < at + row["n"]], tuple(row[k] for k in keys))
                        at += row["n"]
            before += span["n"]
    return found


def _literal(key, rows: DataFrame, keys: list[str]):
    return F.struct(*(F.lit(v).cast(rows.schema[k].dataType).alias(k) for v, k in zip(key, keys, strict=True)))


def exact_percentiles(rows: DataFrame, column: str, probabilities: list[float], by: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """(by, probability, value, n): the percentiles of ``column`` in each group, as Spark's ``percentile`` has them, with linear interpolation.

    Equal values are counted first and the counts are written once to the shared folder. Counts of ranges of (group, value) then tell which range holds a rank, and
    only that one is dealt out again, until it is one value or few. The driver sees counts of ranges and the results, so groups should be few.
    Nulls are left out, NaN comes after all numbers; a group without values has no row.
    """
    by = by or []
    spark = rows.sparkSession
    path = shared_folder(spark, "values")
    kept = rows.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("value"))
    kept.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    counts = spark.read.parquet(path)
    groups = counts.groupBy(*by).agg(F.sum("n").alias("n"))
    sizes = [(tuple(r[k] for k in by), r["n"]) for r in (groups.orderBy(*by) if by else groups).collect() if r["n"]]
    starts, at = {}, 0
    for group, n in sizes:
        starts[group], at = at, at + n
    place = lambda n, p: p * (n - 1)
    ranks = [starts[g] + f(place(n, p)) for g, n in sizes for p in probabilities for f in (math.floor, math.ceil)]
    found = _at_ranks(counts, [*by, "value"], ranks, ranges)
    out = []
    for group, n in sizes:
        for p in probabilities:
            low, high = math.floor(place(n, p)), math.ceil(place(n, p))
            a, b = found[starts[group] + low][-1], found[starts[group] + high][-1]
            out.append((*group, p, a if low == high or a == b else (high - place(n, p)) * a + (place(n, p) - low) * b, n))
    drop_folder(spark, path)
    kinds = [T.StructField(k, counts.schema[k].dataType) for k in by]
    return spark.createDataFrame(out, T.StructType([*kinds, T.StructField("probability", T.DoubleType()), T.StructField("value", T.DoubleType()), T.StructField("n", T.LongType())]))
