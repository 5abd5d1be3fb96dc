"""Parity, drift and completeness checks between generations of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryframe.functions.columns import total


def compare_generations(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``status`` of each key over both tables: missing, extra, changed or same, and the names of the changed columns."""
    a = old.select(key, F.struct(*columns).alias("a"))
    b = new.select(key, F.struct(*columns).alias("b"))
    both = a.join(b, key, "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")), F.lit(k)) for k in columns)))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.size(changed) > 0, "changed").otherwise("same")
    return both.select(key, status.alias("status"), F.when(status == "changed", F.array_join(changed, ",")).otherwise(F.lit("")).alias("changed"))


def require_complete(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Counts of missing and extra keys in one row; the caller stops before it writes anything."""
    missing = expected.select(key).join(got.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return missing.crossJoin(got.select(key).join(expected.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("extra")))


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks, joined by commas; an empty text for a clean row."""
    return F.array_join(F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items()))), ",")


def gate_table(rows: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """(gate, failed rows, passed) for each gate, in one aggregation; ``gates`` are conditions that every row must meet."""
    sums = rows.agg(*(total(~F.coalesce(g, F.lit(False))).alias(f"g{i}") for i, g in enumerate(gates.values())))
    cells = (F.struct(F.lit(name).alias("gate"), F.col(f"g{i}").alias("failed"), (F.col(f"g{i}") == 0).alias("passed")) for i, name in enumerate(gates))
    return sums.select(F.inline(F.array(*cells)))


def array_difference(a: Column, b: Column) -> Column:
    """Largest absolute difference of two arrays; null if their sizes differ or a value is no number."""
    pairs = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.when((F.size(a) == F.size(b)) & ~F.exists(pairs, lambda d: d.isNull() | F.isnan(d)), F.array_max(pairs))
