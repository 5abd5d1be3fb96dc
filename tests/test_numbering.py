"""Dense numbers over ranges of keys."""

import random

from pyspark.sql import functions as F

from quarryframe.operators import numbering as nb


def test_numbers_follow_the_order_of_the_keys(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None, "c é"]), i, "x") for i in range(5000)] + [("hot", i, "y") for i in range(3000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, k int, v string").repartition(7)
    got = nb.dense_number(frame, ["g", "k"], "no", ranges=20).orderBy("no").collect()
    assert [r["no"] for r in got] == list(range(8000))
    assert [(r["g"], r["k"]) for r in got] == sorted(((g, k) for g, k, _ in rows), key=lambda r: (r[0] is not None, r[0] or "", r[1]))


def test_names_with_one_prefix_fall_into_even_ranges(spark):
    names = spark.range(1_000_000).select(F.format_string("scene-%07d", "id").alias("name"))
    sizes = [r["count"] for r in nb.in_ranges(names, ["name"], "r").groupBy("r").count().collect()]
    assert len(sizes) == nb.RANGES and max(sizes) < 2 * 1_000_000 / nb.RANGES
    numbered = nb.dense_number(names, ["name"], "no")
    assert numbered.where(F.col("no") != F.substring("name", 7, 7).cast("long")).count() == 0


def test_few_and_no_rows(spark):
    for n in (0, 1, 3):
        got = nb.dense_number(spark.range(n).toDF("k"), ["k"], "no").collect()
        assert sorted((r["k"], r["no"]) for r in got) == [(i, i) for i in range(n)]
    equal = spark.range(50).select(F.lit(7).alias("k"))
    assert sorted(r["no"] for r in nb.dense_number(equal, ["k"], "no").collect()) == list(range(50))
