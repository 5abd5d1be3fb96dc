"""Dense numbers over all rows, in two levels of ranges, without a task that sees more than its range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges of the key, and sampled keys for each: ranges then differ from their mean by an eighth or so.
RANGES, SAMPLED = 256, 64
#: Bounds that a row is compared with at a time; a row's range is found among groups of bounds first.
_BLOCK = 16


def range_bounds(rows: DataFrame, keys: list[str], ranges: int = RANGES) -> list:
    """Sorted bounds that deal the keys into about equal ranges; keys should be distinct.

    Rows are taken by a hash of their key at a rate that gives ``ranges * SAMPLED`` of them, so what the driver gets does not grow
    with the data, and the same rows give the same bounds. Up to that number, all keys are seen.
    """
    key = rows.select(F.struct(*keys).alias("key"))
    n = key.count()
    rate = min(2**31, -(-(2**31) * ranges * SAMPLED // max(n, 1)))
    taken = key.where(F.pmod(F.xxhash64("key"), F.lit(2**31)) < rate).distinct().orderBy("key").collect()
    places = {i * len(taken) // ranges for i in range(1, ranges)} if len(taken) >= ranges else range(len(taken))
    return [taken[i]["key"] for i in sorted(places)]


def range_number(key: Column, bounds: Column) -> Column:
    """How many of the sorted bounds do not lie above the key."""
    below = lambda part: F.size(F.filter(part, lambda b: b <= key))
    heads = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(bounds) - 1) / _BLOCK), F.lit(0))), lambda i: F.get(bounds, (i * _BLOCK).cast("int")))
    block = below(heads) - 1
    inside = F.slice(bounds, F.greatest(block, F.lit(0)).cast("int") * _BLOCK + 1, F.lit(_BLOCK))
    return F.when((F.size(bounds) == 0) | (block < 0), F.lit(0)).otherwise(block * _BLOCK + below(inside)).cast("int")


def in_ranges(rows: DataFrame, keys: list[str], name: str, ranges: int = RANGES) -> DataFrame:
    """``rows`` with the number of the range of their key; the ranges follow the order of the keys."""
    kind = T.ArrayType(T.StructType([rows.schema[k] for k in keys]))
    bounds = rows.sparkSession.createDataFrame([(range_bounds(rows, keys, ranges),)], T.StructType([T.StructField("__bounds", kind)]))
    # one row of at most ``ranges`` bounds
    return rows.crossJoin(F.broadcast(bounds)).withColumn(name, range_number(F.struct(*keys), F.col("__bounds"))).drop("__bounds")


def dense_number(rows: DataFrame, keys: list[str], name: str, ranges: int = RANGES) -> DataFrame:
    """``rows`` with a number from 0 in the order of ``keys``, nulls first; the keys should tell rows apart.

    A row is numbered inside its range and moved by the rows of the ranges before it; only one count for each range passes through
    a single task. The rows are read three times (count, sample, numbers), so pass what is cheap to read.
    """
    dealt = in_ranges(rows, keys, "__range", ranges)
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*keys)) - 1
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = dealt.withColumn("__in", inside).join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range")
    return numbered.withColumn(name, (F.col("__before") + F.col("__in")).cast("long")).drop("__range", "__in", "__before")
