"""Gates over paired intervals, in three-valued logic: what was not measured has not passed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The metrics of the main gate, its floor, and the largest share of a majority class.
PRIMARY, SECONDARY, PARSE = "object_f1_micro", "speed_action_f1_macro", "parse_rate"
PARSE_FLOOR, MAJORITY_CEILING = 0.99, 0.867
TRANSFORMS, CHANGES = ("blank", "shuffled"), ("action_flip", "output_change")
HIGHER_IS_WORSE, LOWER_IS_WORSE, ABSOLUTE = "higher_is_worse", "lower_is_worse", "absolute"


@dataclass(frozen=True)
class Guard:
    metric: str
    direction: str

    @property
    def criterion(self) -> str:
        return {HIGHER_IS_WORSE: "delta_low > 0", LOWER_IS_WORSE: "delta_high < 0"}[self.direction]


#: What must not get worse between two systems.
GUARDS = (
    Guard("overconservative_yield_rate", HIGHER_IS_WORSE),
    Guard("overconservative_stop_rate", HIGHER_IS_WORSE),
    *(Guard(f"{change}_{transform}", LOWER_IS_WORSE) for change in CHANGES for transform in TRANSFORMS),
)

CELLS = "metric string, point_a double, point_b double, delta double, delta_low double, delta_high double"


def paired_cells(points: DataFrame, replicates: DataFrame, metrics: list[str], level: float = 0.95) -> DataFrame:
    """(``CELLS``): both systems' points, their difference and its interval for each metric.

    ``points`` is one row and ``replicates`` one for each replicate, with columns ``a_<metric>`` and ``b_<metric>``. A metric with a null point or a null replicate was
    not measured and has no row.
    """
    low = (1 - level) / 2
    value = lambda x, m: F.col(f"{x}_{m}").cast("double")
    rows = lambda df: df.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), value("a", m).alias("a"), value("b", m).alias("b")) for m in metrics))))
    d = F.col("a") - F.col("b")
    spread = rows(replicates).groupBy("metric").agg(F.percentile(d, low).alias("delta_low"), F.percentile(d, 1 - low).alias("delta_high"), (F.count(d) < F.count(F.lit(1))).alias("gap"))
    told = rows(points).where("a is not null and b is not null").join(spread.where("not gap").drop("gap"), "metric")
    return told.select("metric", F.col("a").alias("point_a"), F.col("b").alias("point_b"), d.alias("delta"), "delta_low", "delta_high")


def main_gate(cells: DataFrame, floor: float = PARSE_FLOOR) -> DataFrame:
    """(gate, evaluated, passed) in one row: enough texts parse, at least as many as before, and the primary or the secondary metric rises.

    ``passed`` is null if one of the three metrics was not measured.
    """
    of = lambda metric, column: F.max(F.when(F.col("metric") == metric, F.col(column)))
    one = cells.agg(of(PARSE, "point_a").alias("a"), of(PARSE, "point_b").alias("b"), of(PRIMARY, "delta_low").alias("p"), of(SECONDARY, "delta_low").alias("q"))
    known = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("p").isNotNull() & F.col("q").isNotNull()
    holds = (F.col("a") >= F.greatest(F.lit(floor), F.col("b"))) & ((F.col("p") > 0) | (F.col("q") > 0))
    return one.select(F.lit("main").alias("gate"), known.alias("evaluated"), F.when(known, holds).alias("passed"))


def guard_rows(spark: SparkSession, cells: DataFrame, majority_share: DataFrame | None = None) -> DataFrame:
    """(metric, direction, criterion, evaluated, triggered, delta, delta_low, delta_high) of each guard; a guard whose metric was not measured is not evaluated.

    The last row guards against a constant answer: the share of the largest class (one row, ``share``, null or no frame if not measured) stays below its ceiling, and under no
    transform do fewer actions change than before.
    """
    registry = spark.createDataFrame([(g.metric, g.direction, g.criterion) for g in GUARDS], "metric string, direction string, criterion string")
    worse = F.when(F.col("direction") == HIGHER_IS_WORSE, F.col("delta_low") > 0).otherwise(F.col("delta_high") < 0)
    rows = F.broadcast(registry).join(cells, "metric", "left").select("metric", "direction", "criterion", F.col("delta").isNotNull().alias("evaluated"), worse.alias("triggered"), "delta", "delta_low", "delta_high")
    flips = [f"{CHANGES[0]}_{t}" for t in TRANSFORMS]
    held = cells.where(F.col("metric").isin(flips)).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("point_a") >= F.col("point_b")).alias("kept"))
    share = majority_share if majority_share is not None else spark.range(1).select(F.lit(None).cast("double").alias("share"))
    known = (F.col("n") == len(flips)) & F.col("share").isNotNull()
    answer = ~((F.col("share") <= MAJORITY_CEILING) & F.col("kept"))
    none = F.lit(None).cast("double")
    constant = held.crossJoin(share.select("share")).select(
        F.lit("constant_answer").alias("metric"), F.lit(ABSOLUTE).alias("direction"), F.lit(f"share <= {MAJORITY_CEILING} and flips not below").alias("criterion"), known.alias("evaluated"), F.when(known, answer).alias("triggered"), none.alias("delta"), none.alias("delta_low"), none.alias("delta_high")
    )
    return rows.unionByName(constant)


def fold(rows: DataFrame, name: str = "guards") -> DataFrame:
    """(gate, evaluated, passed): passed if no guard is triggered, null as soon as one was not evaluated."""
    return rows.agg(F.bool_and("evaluated").alias("all"), F.coalesce(F.bool_or("triggered"), F.lit(False)).alias("any")).select(F.lit(name).alias("gate"), F.col("all").alias("evaluated"), F.when(F.col("all"), ~F.col("any")).alias("passed"))


def all_of(gates: DataFrame) -> Column:
    """Three-valued and over ``passed``: false if one is false, else null if one is null."""
    return F.when(F.bool_or(~F.col("passed")), F.lit(False)).when(F.bool_or(F.col("passed").isNull()), F.lit(None).cast("boolean")).otherwise(F.lit(True))
