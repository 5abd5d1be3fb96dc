"""Evaluation aggregates: confusion cells, one-versus-rest scores, zero-filled tables, percentiles, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryframe.functions.columns import f1, ratio, total


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("gt"), F.col(guess).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def full_confusion(cells: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """The square of a fixed class list with explicit zeros."""
    names = F.array(*map(F.lit, classes))
    grid = cells.sparkSession.range(1).select(F.explode(names).alias("gt")).select("gt", F.explode(names).alias("pred"))
    return grid.join(cells, ["gt", "pred"], "left").select("gt", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def one_versus_rest(cells: DataFrame) -> DataFrame:
    """(class, tp, fp, fn, f1) of each class of a confusion matrix."""
    n = F.col("n")
    sides = cells.select(F.col("gt").alias("cls"), F.when(F.col("gt") == F.col("pred"), n).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col("gt") != F.col("pred"), n).otherwise(0).alias("fn"))
    sides = sides.unionAll(cells.where("gt <> pred").select("pred", F.lit(0), n, F.lit(0)))
    sums = sides.groupBy("cls").agg(*(F.sum(k).cast("long").alias(k) for k in ("tp", "fp", "fn")))
    return sums.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def binary_counts(truth: Column, guess: Column) -> list[Column]:
    return [total(truth & guess).alias("tp"), total(~truth & guess).alias("fp"), total(truth & ~guess).alias("fn"), total(~truth & ~guess).alias("tn")]


def direction_rates(counts: DataFrame) -> DataFrame:
    """Miss rate over the positive and over-conservative rate over the negative references; 0 without any."""
    c = F.col
    return counts.withColumns({"miss_rate": ratio(c("fn"), c("tp") + c("fn")), "over_rate": ratio(c("fp"), c("fp") + c("tn"))})


def capped_histogram(counts: DataFrame, value: str, cap: int) -> DataFrame:
    """Rows by min(value, cap), with explicit zeros for all of 0..cap."""
    found = counts.groupBy(F.least(F.col(value), F.lit(cap)).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return counts.sparkSession.range(cap + 1).select(F.col("id").alias("k")).join(found, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"))


def nearest_rank(values: DataFrame, value: str, q: float) -> DataFrame:
    """Smallest value whose cumulative count reaches the rank round(q * n), at least 1; ties of the rank go to even.

    Works on the histogram of the values, whose size is that of the value range.
    """
    histogram = values.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy(value)
    ranked = histogram.withColumns({"run": F.sum("c").over(w), "all": F.sum("c").over(Window.partitionBy())})
    return ranked.where(F.col("run") >= F.greatest(F.lit(1.0), F.bround(F.col("all") * q))).agg(F.min(value).alias("value"))


def majority(rows: DataFrame, group: str, cls: str) -> DataFrame:
    """Most frequent class of each group and its share; of equals the lexicographically largest."""
    counts = rows.groupBy(group, cls).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(group).agg(F.max(F.struct("n", cls)).alias("m"), F.sum("n").alias("t"))
    return best.select(group, F.col(f"m.{cls}").alias(cls), (F.col("m.n") / F.col("t")).alias("share"))


def ci_gate(lo: Column, hi: Column, bound: Column | float) -> Column:
    """Three-valued: true if the whole interval is above the bound, false if below, null if it holds it."""
    return F.when(lo > bound, F.lit(True)).when(hi < bound, F.lit(False))
