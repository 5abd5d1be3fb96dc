"""Scene-clustered bootstrap by weights, stratified splits and samples."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryframe.operators.windows import numbered_names


#: Scenes whose weights or counts make one row or matrix, and the scenes up to which their counts are broadcast (a few MB).
DRAW_BLOCK, MAX_BROADCAST_SCENES = 16_384, 5_000


_TURNS = [t for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in turns * 4]
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def md5_starts(head: bytes, low: int, high: int) -> np.ndarray:
    """The first 32 bits of the md5 of ``head`` and i as text, for each i from ``low`` to below ``high``; all have the same number of digits.

    The library's md5 costs a call for each short text; here a block of texts takes the 64 steps together.
    """
    digits = len(str(low))
    size = len(head) + digits
    if size > 55:  # more than one round of the algorithm
        return np.array([int.from_bytes(hashlib.md5(head + b"%d" % i).digest()[:4], "big") for i in range(low, high)], np.uint32)
    block = bytearray(64)
    block[:size] = head + b"0" * digits
    block[size], block[56:64] = 0x80, (8 * size).to_bytes(8, "little")
    words = [np.uint32(w) for w in np.frombuffer(bytes(block), "<u4")]
    rest = np.arange(low, high, dtype=np.uint32 if high <= 2**32 else np.uint64)
    for place in range(size - 1, len(head) - 1, -1):
        higher = rest // 10
        words[place // 4] = words[place // 4] + ((rest - higher * 10).astype(np.uint32) << np.uint32(8 * (place % 4)))
        rest = higher
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(high - low, x, np.uint32) for x in start)
    for i in range(64):
        if i < 16:
            f, w = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, w = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, w = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, w = c ^ (b | ~d), 7 * i % 16
        f += a
        f += np.uint32(_ADDED[i])
        f += words[w]
        turned = f << np.uint32(_TURNS[i])
        f >>= np.uint32(32 - _TURNS[i])
        turned |= f
        turned += b
        a, d, c, b = d, c, b, turned
    return (a + np.uint32(start[0])).byteswap()


def _weights(n: int, replicates: list[int], seed: str) -> Iterator[tuple[int, np.ndarray]]:
    """(replicate, weights): how often each of ``n`` scene numbers is drawn; draw i of replicate b is ``hash_draw(seed, b, i, n)``."""
    edges = sorted({*range(0, n, 16_384), *(10**k for k in range(1, 20) if 10**k < n), n})
    for b in replicates:
        head, drawn = f"{seed}:{b}:".encode(), np.empty(n, np.uint32)
        for low, high in zip(edges, edges[1:], strict=False):
            drawn[low:high] = md5_starts(head, low, high) % n
        yield b, np.bincount(drawn, minlength=n)


def _replicates(spark: SparkSession, n: int, replicates: int) -> DataFrame:
    return spark.range(0, replicates if n else 0, 1, max(1, min(replicates, 8 * spark.sparkContext.defaultParallelism)))


def _weight_rows(replicate: int, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
    no = np.nonzero(weight)[0]
    for part in np.array_split(no, max(1, -(-len(no) // 65_536))):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), replicate, np.int32)), pa.array(part.astype(np.int64)), pa.array(weight[part].astype(np.int64))], names=["replicate", "no", "weight"])


def scene_weights(spark: SparkSession, n: int, replicates: int, seed: str) -> DataFrame:
    """(replicate, no, weight): how often each of ``n`` scene numbers is drawn in a replicate of ``n`` draws.

    A task draws whole replicates, so nothing is shuffled. Spark takes the table for as small as its list of replicates: join it with ``hint("merge")``.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, weight in _weights(n, batch.column(0).to_pylist(), seed):
                yield from _weight_rows(b, weight)

    return _replicates(spark, n, replicates).mapInArrow(draw, "replicate int, no long, weight long")


def resample_weights(scenes: DataFrame, scene: str, replicates: int, seed: str) -> DataFrame:
    """(replicate, scene, weight): how often each scene is drawn in a bootstrap replicate of as many draws as scenes."""
    numbered = numbered_names(scenes.select(scene).distinct(), scene, "no")
    drawn = scene_weights(scenes.sparkSession, numbered.count(), replicates, seed)
    return drawn.hint("merge").join(numbered, "no").select("replicate", scene, "weight")


def pack_weights(weights: np.ndarray) -> bytes:
    """Weights as unsigned bytes, or as 32-bit numbers where one does not fit, in Huffman codes: most weights are 0, 1 or 2, so a draw takes about a quarter of a byte."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15, 8, zlib.Z_HUFFMAN_ONLY)
    return packer.compress(weights.astype("u1" if weights.max() < 256 else "<u4").tobytes()) + packer.flush()


def unpack_weights(packed: bytes, width: int) -> np.ndarray:
    """The ``width`` weights of a block."""
    plain = zlib.decompress(packed, -15)
    return np.frombuffer(plain, f"<u{len(plain) // width}").astype(np.uint32)


def block_weights(spark: SparkSession, n: int, replicates: int, seed: str, size: int = DRAW_BLOCK) -> DataFrame:
    """(replicate, block, weights): the packed weights of each ``size`` scenes."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, weight in _weights(n, batch.column(0).to_pylist(), seed):
                parts = [weight[low : low + size] for low in range(0, n, size)]
                packed = [pack_weights(p) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), b, np.int32)), pa.array(np.arange(len(parts))), pa.array(packed, pa.binary())], names=["replicate", "block", "weights"])

    return _replicates(spark, n, replicates).mapInArrow(draw, "replicate int, block long, weights binary")


def weighted_sums(weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``weights @ counts``; sums of integers that doubles may not hold are made in integers."""
    if counts.dtype.kind == "f" or not counts.size:
        return weights.astype(np.float64) @ counts
    if float(weights.sum(axis=1).max()) * max(abs(float(counts.max())), abs(float(counts.min()))) < 2**53:
        return (weights.astype(np.float64) @ counts.astype(np.float64)).astype(np.int64)
    return weights.astype(np.int64) @ counts


def resampled_totals(counts: DataFrame, scene: str, columns: list[str], replicates: int, seed: str) -> DataFrame:
    """(replicate, columns): additive counts of each bootstrap replicate over scenes; a null counts as 0.

    Counts are summed once per scene. Beyond ``MAX_BROADCAST_SCENES`` scenes, weights and counts meet by blocks of scenes: a draw then costs a quarter of a byte in
    one shuffle, whatever the number of columns, and a task holds one block; only partial sums of replicates are shuffled on.
    """
    spark, size = counts.sparkSession, DRAW_BLOCK
    per_scene = numbered_names(counts.groupBy(scene).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns)), scene, "no").select("no", *columns)
    n = counts.select(scene).distinct().count()
    if n <= MAX_BROADCAST_SCENES:
        return scene_weights(spark, n, replicates, seed).join(F.broadcast(per_scene), "no").groupBy("replicate").agg(*(F.sum(F.col("weight") * F.col(c)).alias(c) for c in columns))
    kinds = {f.name: f.dataType.simpleString() for f in per_scene.schema}
    whole = [c for c in columns if kinds[c] == "bigint"]
    other = [c for c in columns if kinds[c] != "bigint"]

    def add(scenes: pa.Table, drawn: pa.Table) -> pa.Table:
        low = scenes.column("no")[0].as_py() // size * size
        width, at = min(size, n - low), scenes.column("no").to_numpy() - low
        groups = []
        for names, kind in ((whole, np.int64), (other, np.float64)):
            table = np.zeros((width, len(names)), kind)
            for k, c in enumerate(names):
                table[at, k] = scenes.column(c).to_numpy()
            groups.append(table)
        packed, sums = drawn.column("weights").to_pylist(), ([], [])
        for first in range(0, len(packed), 64):
            weights = np.stack([unpack_weights(p, width) for p in packed[first : first + 64]])
            for out, table in zip(sums, groups, strict=True):
                out.append(weighted_sums(weights, table))
        made = {c: np.concatenate(out)[:, k] for names, out in zip((whole, other), sums, strict=True) for k, c in enumerate(names)}
        return pa.table({"replicate": drawn.column("replicate"), **{c: pa.array(made[c]) for c in columns}})

    blocks = per_scene.select((F.floor(F.col("no") / size)).alias("block"), "no", *whole, *(F.col(c).cast("double").alias(c) for c in other))
    met = blocks.groupBy("block").cogroup(block_weights(spark, n, replicates, seed, size).groupBy("block"))
    sums = met.applyInArrow(add, ", ".join(["replicate int", *(f"`{c}` {'bigint' if c in whole else 'double'}" for c in columns)]))
    return sums.groupBy("replicate").agg(*(F.sum(c).alias(c) for c in columns))


# -- draws of the Mersenne twister ---------------------------------------------------------------------------------

#: Draws between two saved states of the generator.
STATE_EVERY = 4_000_000


def _states(n: int, replicates: int, seed: int) -> list[tuple[int, int, bytes, int]]:
    """(first replicate, replicates, key, position) of the generator at the start of each block of replicates.

    One stream gives all draws in turn, so it is run through once here without keeping them; what is kept is 2.5 KB for each block.
    """
    rng, out, per = np.random.RandomState(seed), [], max(1, STATE_EVERY // max(n, 1))
    for first in range(0, replicates, per):
        _, key, at, _, _ = rng.get_state(legacy=True)
        out.append((first, min(per, replicates - first), key.astype("<u4").tobytes(), int(at)))
        for _ in range(out[-1][1]):
            rng.randint(0, n, size=n)
    return out


def mersenne_draws(spark: SparkSession, n: int, replicates: int, seed: int) -> DataFrame:
    """(replicate, no, weight): how often each of ``n`` numbers is drawn, bit for bit as ``RandomState(seed).randint(0, n, size=(replicates, n))`` draws them.

    Tasks take up the stream at saved states. The stream itself is sequential and costs some nanoseconds a draw, so this is for comparing with stored runs;
    ``scene_weights`` needs no stream.
    """
    if n < 1:
        return spark.createDataFrame([], "replicate int, no long, weight long")
    blocks = spark.createDataFrame(_states(n, replicates, seed), "first int, count int, key binary, at int").repartition(max(1, spark.sparkContext.defaultParallelism))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rng = np.random.RandomState()
                rng.set_state(("MT19937", np.frombuffer(row["key"], "<u4").copy(), row["at"]))
                for k in range(row["count"]):
                    yield from _weight_rows(row["first"] + k, np.bincount(rng.randint(0, n, size=n), minlength=n))

    return blocks.mapInArrow(draw, "replicate int, no long, weight long")


# -- statistics of one's own ----------------------------------------------------------------------------------------

#: Distinct rows that one replicate may have: a statistic that is not additive sees all of them in one task.
MAX_PLUG_IN_ROWS = 2_000_000
#: Distinct rows up to which weights meet the scenes by blocks: a task then has as many sums for each replicate.
MAX_BLOCK_ROWS = 1_000


def _weights_by_block(counted: DataFrame, others: list[str], draws: DataFrame, n: int) -> DataFrame:
    """(replicate, others, weight) from (no, others, __n) and the packed weights of ``n`` scenes: the weights of equal rows are summed inside each block, so draws are never rows."""
    fields = [T.StructField("replicate", T.IntegerType()), *(counted.schema[k] for k in others), T.StructField("weight", T.LongType())]

    def add(scenes: pa.Table, drawn: pa.Table) -> pa.Table:
        none = pa.table({"replicate": pa.array([], pa.int32()), **{k: scenes[k].slice(0, 0) for k in others}, "weight": pa.array([], pa.int64())})
        if not scenes.num_rows or not drawn.num_rows:
            return none
        no, times = scenes["no"].to_numpy(), scenes["__n"].to_numpy()
        low = int(no[0]) // DRAW_BLOCK * DRAW_BLOCK
        width = min(DRAW_BLOCK, n - low)
        keys = scenes.select(others).append_column("__at", pa.array(np.arange(len(no)))).group_by(others, use_threads=False).aggregate([("__at", "list")])
        lists = keys["__at_list"].combine_chunks()
        row = np.empty(len(no), np.int64)
        row[lists.flatten().to_numpy()] = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        # scenes in the order of their distinct row, and of each row where it starts
        order = np.argsort(row, kind="stable")
        at, times, starts = (no - low)[order], times[order], np.searchsorted(row[order], np.arange(len(lists)))
        packed, replicates, parts = drawn["weights"].to_pylist(), drawn["replicate"].to_numpy(), []
        for b, weights in zip(replicates, packed, strict=True):
            sums = np.add.reduceat(unpack_weights(weights, width)[at].astype(np.int64) * times, starts)
            some = np.nonzero(sums)[0]
            parts.append((np.full(len(some), b, np.int32), some, sums[some]))
        replicate, some, weight = (np.concatenate(p) for p in zip(*parts, strict=True))
        return pa.table({"replicate": replicate, **{k: keys[k].take(pa.array(some)) for k in others}, "weight": weight})

    blocks = counted.select(F.floor(F.col("no") / DRAW_BLOCK).alias("block"), "no", *others, "__n")
    return blocks.groupBy("block").cogroup(draws.groupBy("block")).applyInArrow(add, T.StructType(fields))


def _drawn_scenes(draws: DataFrame, n: int) -> DataFrame:
    """The rows (replicate, no, weight) of packed weights."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low = row["block"] * DRAW_BLOCK
                for part in _weight_rows(row["replicate"], unpack_weights(row["weights"], min(DRAW_BLOCK, n - low))):
                    yield part.set_column(1, "no", pc.add(part["no"], low))

    return draws.mapInArrow(unpack, "replicate int, no long, weight long")


def plug_in_bootstrap(rows: DataFrame, scene: str, statistic: Callable[[pd.DataFrame], dict[str, float]], draws: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """(replicate, metric, value) of a statistic of one's own, for each replicate of ``draws``: (replicate, no, weight), or the packed ``block_weights`` of the scenes.

    ``statistic`` is given the distinct rows of the drawn scenes, without the scene, with their ``weight``: how often such a row is drawn. ``drawn_rows`` repeats them by it, ``weighted_quantile``
    does without. Scenes are numbered by name. Equal rows are counted per scene and summed per replicate before a task sees them, so its memory goes by the distinct rows, and
    more than ``MAX_PLUG_IN_ROWS`` of them are refused. Up to ``MAX_BLOCK_ROWS`` distinct rows, packed weights are summed by blocks of scenes; beyond it each
    drawn scene is a row of a join. An additive statistic needs far less (``resampled_totals``). A replicate that draws no row has none. A statistic that fails stops the job, and so does one whose metrics are not ``metrics``, where those are given: classes that a replicate lacks must be told as 0.
    """
    others = [c for c in rows.columns if c != scene]
    distinct = rows.select(*others).distinct().count()
    if distinct > MAX_PLUG_IN_ROWS:
        raise ValueError(f"a plug-in statistic sees at most {MAX_PLUG_IN_ROWS} distinct rows; give an additive one to resampled_totals")
    numbered = numbered_names(rows.select(scene).distinct(), scene, "no")
    counted = rows.groupBy(scene, *others).agg(F.count(F.lit(1)).alias("__n")).join(numbered, scene).drop(scene)
    packed = "weights" in draws.columns
    n = numbered.count() if packed else 0
    if packed and distinct <= MAX_BLOCK_ROWS:
        weighted = _weights_by_block(counted, others, draws, n)
    else:
        draws = _drawn_scenes(draws, n) if packed else draws
        weighted = draws.hint("merge").join(counted, "no").select("replicate", *others, (F.col("weight") * F.col("__n")).alias("weight"))
    # replicates of few rows are little data and much work, so that they are not put together by their size
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    joined = weighted.groupBy("replicate", *others).agg(F.sum("weight").alias("weight")).repartition(tasks, "replicate")

    def one(part: pd.DataFrame) -> pd.DataFrame:
        told = statistic(part.drop(columns="replicate"))
        if metrics is not None and set(told) != set(metrics):
            raise ValueError(f"a replicate has the metrics {sorted(told)} and not {sorted(metrics)}")
        return pd.DataFrame({"replicate": int(part["replicate"].iloc[0]), "metric": list(told), "value": [float(v) for v in told.values()]})

    return joined.groupBy("replicate").applyInPandas(one, "replicate int, metric string, value double")


def drawn_rows(part: pd.DataFrame) -> pd.DataFrame:
    """The rows of a replicate, each as often as its scene was drawn."""
    return part.loc[part.index.repeat(part["weight"])].drop(columns="weight")


def weighted_quantile(part: pd.DataFrame, column: str, q: float) -> float:
    """The quantile of a column over the drawn rows, between neighbours by their distance; nulls are left out, and NaN stands for none."""
    part = part[[column, "weight"]].dropna().sort_values(column)
    if part.empty:
        return float("nan")
    values, ends = part[column].to_numpy(), part["weight"].cumsum().to_numpy()
    place = float(ends[-1] - 1) * q
    low = int(place)
    a, b = values[np.searchsorted(ends, [low, min(low + 1, int(ends[-1]) - 1)], side="right")]
    return float(a + (b - a) * (place - low))


def percentile_interval(values: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    low = (1 - level) / 2
    return values.agg(F.percentile(column, low).alias("lo"), F.percentile(column, 1 - low).alias("hi"), F.count(column).alias("n"))


def tail_split(scenes: DataFrame, strata: list[str], token: str, share: float) -> DataFrame:
    """``split``: of each stratum the last share by token, rounded half up, is val and the rest train."""
    w = Window.partitionBy(*strata)
    size = F.count(F.lit(1)).over(w)
    rank = F.row_number().over(w.orderBy(token))
    return scenes.withColumn("split", F.when(rank > size - F.floor(size * share + 0.5), "val").otherwise("train"))


def round_robin_sample(frames: DataFrame, scene: str, order: list[str], n: int) -> DataFrame:
    """``n`` rows, one of each scene in turn: the first of all scenes by ``order``, then the second of all, and so on."""
    turn = F.row_number().over(Window.partitionBy(scene).orderBy(*order))
    return frames.withColumn("turn", turn).orderBy("turn", scene).limit(n)
