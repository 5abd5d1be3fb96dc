"""MinHash near-dedup with an LSH forest.

Every distinct shingle set gets a pool of min-hash bytes and, from it, one label per tree: the pool's bytes
in the tree's own order. Each tree's labels are sorted over the cluster. Rows with a common prefix of ``depth`` bytes are a
region, and the depth is adapted to each region: while a region has more pairs than a few for each row, it is split at its next longer common
prefixes; what is small enough is compared whole. So a dense region costs as much per row as a sparse one.

A split loses pairs that part above it, so each row's coverage is counted: a tree that compares a region at depth d finds a
pair of the least similarity s with probability s**d. A row shares its partner's region in a part of the trees only, so what counts for all trees is
the value of the worst sixth of them. Rows with less than ``coverage`` in all go on in rounds with fresh min-hashes and twice the trees. Pairs inside one component count as found, so a group of near copies is closed after its first links, and a row with too many
shingles that no other open row has is closed for good.
Rows that are still open after the last round are joined exactly, on the rarest shingles (prefix filter), with all open rows.

Candidates are confirmed on full shingle sets: first each row's best candidate, then, once those links are
joined into components, all candidates that still lie between two components. Texts travel to candidates only, compressed.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryframe.llm._base import as_batch, byte_values, materialize, mix64, need_columns
from quarryframe.llm._components import connected_components


@dataclass(frozen=True)
class NearConfig:
    shingle_words: int = 5
    #: Linked if 100 * intersection >= percent * union.
    percent: int = 80
    #: Min-hash bytes of a set from which the labels of a round are taken.
    pool: int = 128
    #: Further min-hashes of the rows of later rounds, one bit of each, by which a task estimates similarities.
    bits: int = 2048
    trees: int = 24
    label_bytes: int = 16
    #: The common prefix that a region starts with.
    depth: int = 4
    #: A region is compared whole if its labels and sizes leave at most so many pairs for each of its rows; else it is split.
    region_pairs: int = 3
    #: The same in later rounds, whose rows tell more pairs apart.
    late_pairs: int = 8
    #: Trees that have to find a pair of the least similarity, in the mean: such a pair is missed with probability exp(-coverage).
    coverage: float = 6.0
    #: Trees of the first later round, and those of each round by which coverage is accounted for.
    account: int = 12
    #: Rounds for rows without that coverage, each with twice the trees; what is open then is joined exactly.
    rounds: int = 5
    #: So few open rows are joined exactly at once.
    exact_rows: int = 500
    #: Rows that a task holds of a region; it bounds memory, and what it cuts apart counts as not covered.
    buffer_rows: int = 8192
    seed: int = 20_240_117

    @property
    def least(self) -> float:
        return self.percent / 100


#: Regions of so many rows are looked at pair by pair inside a task, to count those that labels and sizes leave over.
_SMALL = 512
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words are one shingle, none give none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = out * _MULTIPLIERS[0] + h[i : n - k + 1 + i]
    return np.unique(mix64(out))


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _pool_constants(cfg: NearConfig, turn: int = 0, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(cfg.seed + 1000 * turn)
    shape = (size or cfg.pool, 1)
    return rng.randint(0, 1 << 32, shape, np.uint32), rng.randint(0, 1 << 32, shape, np.uint32) | np.uint32(1)


def min_hashes(shingles: np.ndarray, constants: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least hash of each function, its bits mixed into the low ones."""
    low = np.full(len(constants[0]), 0xFFFFFFFF, np.uint32)
    base = (shingles >> np.uint64(32)).astype(np.uint32)
    step = max(1, (1 << 18) // len(low))
    for at in range(0, len(base), step):
        np.minimum(low, ((base[at : at + step] ^ constants[0]) * constants[1]).min(1), out=low)
    return low ^ (low >> np.uint32(16)) ^ (low >> np.uint32(8))


def signature(shingles: np.ndarray, constants: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The low bytes of the pool's min-hashes."""
    return min_hashes(shingles, constants).astype(np.uint8).tobytes()


def bit_sketch(shingles: np.ndarray, constants: tuple[np.ndarray, np.ndarray]) -> bytes:
    """One bit of each min-hash; sets of similarity s differ in (1 - s) / 2 of them."""
    x = min_hashes(shingles, constants)
    return np.packbits((x ^ (x >> np.uint32(4)) ^ (x >> np.uint32(2)) ^ (x >> np.uint32(1))).astype(np.uint8) & 1).tobytes()


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary()), ("packed", pa.binary())])


def sketches(docs: DataFrame, cfg: NearConfig) -> DataFrame:
    """Per row: the set's size and digest (null without words); with the first row of a set in a task its signature and the words, compressed."""
    need_columns(docs, "doc_id", "text")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        constants, packer = _pool_constants(cfg), zstandard.ZstdCompressor(level=3)
        sent: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for doc_id, text in zip(part.column(0).to_pylist(), byte_values(part.column(1)), strict=True):
                    words = normal_words(text)
                    s = shingle_set(words, cfg.shingle_words)
                    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                    if d is None or d in sent:
                        rows.append((doc_id, len(s), d, None, None))
                        continue
                    if len(sent) > 1_000_000:
                        sent.clear()
                    sent.add(d)
                    rows.append((doc_id, len(s), d, signature(s, constants), packer.compress(b" ".join(words))))
                yield as_batch(_SKETCH, [list(c) for c in zip(*rows, strict=True)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketch, "doc_id long, n_shingles long, digest binary, signature binary, packed binary")


def least_agreement(width: int, similarity: float, miss: float = 1e-4) -> int:
    """Bytes of ``width`` in which two signatures of that similarity agree at least, but for a chance of ``miss``."""
    below, chance = 0.0, width * math.log(1 - similarity)
    for k in range(width + 1):
        below += math.exp(chance)
        chance += math.log((width - k) * similarity / ((k + 1) * (1 - similarity))) if k < width else 0
        if below > miss:
            return k
    return width


def scan(label: np.ndarray, comp: np.ndarray, size: np.ndarray, own: np.ndarray, before: int, after: int, cfg: NearConfig, bits: np.ndarray | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, float, float]], list[tuple[int, int]]]:
    """Of sorted labels: pairs (row, row, common prefix) to compare; (row, coverage that it lacks in this tree, and what it lacks
    if its region is whole after all); and (first row, component) of the regions that are cut off, -1 for several components.

    A label's first byte is its tree. ``before`` and ``after`` are the common prefixes of the first and the last row with the rows that lie
    outside, or the label's whole width where those are not known. Rows of one component need no comparison, nor do sets whose sizes and numbers of
    shingles of their ``own`` bound their similarity too low, or whose ``bits`` (else labels) tell that they are too unlike. A region counts as
    covered at the depth of its deepest part: a row that left the dense part early would have been split there with its partner.
    """
    n, width = len(label), label.shape[1] - 1
    full, need = cfg.least**cfg.depth, least_agreement(width, cfg.least)
    differ = 64 * bits.shape[1] - least_agreement(64 * bits.shape[1], (1 + cfg.least) / 2) if bits is not None else 0

    def left_over(lo: int, hi: int, rows: np.ndarray, limit: int) -> tuple[list[tuple[int, int]], int]:
        """Pairs of a region with one of ``rows`` in them that are worth a comparison, and their number; it stops beyond the limit."""
        out, total, done = [], 0, np.zeros(hi - lo, bool)
        for i in rows.tolist():
            done[i - lo] = True
            most = np.minimum(size[i] - own[i], size[lo:hi] - own[lo:hi])
            j = lo + np.nonzero(~done & (comp[lo:hi] != comp[i]) & (100 * most >= cfg.percent * (size[i] + size[lo:hi] - most)))[0]
            if bits is None:
                j = j[(label[j] == label[i]).sum(1) - 1 >= need]
            else:
                j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64) <= differ]
            total += len(j)
            if total > limit:
                break
            out += [(min(i, x), max(i, x)) for x in j.tolist()]
        return out, total
    common = np.empty(n + 1, np.int64)
    common[0], common[n] = before, after
    common[1:n] = np.cumprod(label[1:] == label[:-1], axis=1).sum(1) - 1
    bounds = np.concatenate([[0], np.nonzero(common[1:n] < cfg.depth)[0] + 1, [n]])
    odd = np.diff(bounds) > 1
    odd[0] |= before >= cfg.depth
    odd[-1] |= after >= cfg.depth
    pairs: list[tuple[int, int, int]] = []
    lacks: list[tuple[int, float, float]] = []
    cut: list[tuple[int, int]] = []
    for k in np.nonzero(odd)[0].tolist():
        first, last = int(bounds[k]), int(bounds[k + 1])
        todo, deepest = [(first, last, cfg.depth)], cfg.depth
        while todo:
            lo, hi, depth = todo.pop()
            m, inside = hi - lo, comp[lo:hi]
            names, counts = np.unique(inside, return_counts=True)
            cross = (m * m - int((counts**2).sum())) // 2
            found: list[tuple[int, int, int]] = []
            if cross and (m <= (_SMALL if bits is None else 4 * _SMALL) or cross <= cfg.region_pairs * m):
                # of the largest component in the region only the other rows look for partners
                few = lo + np.nonzero(inside != names[counts.argmax()])[0] if len(names) < m else np.arange(lo, hi)
                met, cross = left_over(lo, hi, few, cfg.region_pairs * m)
                if cross <= cfg.region_pairs * m:
                    found = [(a, b, int(common[a + 1 : b + 1].min())) for a, b in met]
            if cross > cfg.region_pairs * m:
                low = int(common[lo + 1 : hi].min())
                if low < width:
                    cuts = [lo, *(lo + 1 + np.nonzero(common[lo + 1 : hi] == low)[0]).tolist(), hi]
                    todo += [(a, b, low + 1) for a, b in zip(cuts, cuts[1:], strict=False)]
                    continue
                # equal labels throughout: neighbours only
                found = [(i, i + 1, width) for i in (lo + np.nonzero(inside[1:] != inside[:-1])[0]).tolist()]
                depth = width + 1
            pairs += found
            deepest = max(deepest, depth)
        whole = np.full(last - first, deepest)
        reached = whole
        if common[first] >= cfg.depth or common[last] >= cfg.depth:
            cut.append((first, int(comp[first]) if (comp[first:last] == comp[first]).all() else -1))
            left = np.minimum.accumulate(common[first:last])
            right = np.minimum.accumulate(common[first + 1 : last + 1][::-1])[::-1]
            reached = np.maximum(deepest, np.maximum(left, right) + 1)
        if reached.max() > cfg.depth:
            lack, least = (full - np.where(x <= width, cfg.least ** x.astype(float), 0.0) for x in (reached, whole))
            lacks += [(first + i, float(x), float(y)) for i, (x, y) in enumerate(zip(lack, least, strict=True)) if x > 0]
    return pairs, lacks, cut


def forest(rows: DataFrame, cfg: NearConfig, trees: int, width: int, turn: int) -> DataFrame:
    """Over ``rows`` (node, comp, size, own, signature, bits; null bits in the first round): candidates (a, b, prefix), and (a, lack) with null b for rows that miss coverage.

    A region that a task's edge cuts off lacks less where the table shows it as whole, or all its parts as one component: such rows have
    ``whole`` and ``region``, and the parts are rows with null a, the component as b, and ``region``.
    """
    rng = np.random.RandomState(cfg.seed + 1000 * turn + 1)
    orders = [rng.permutation(cfg.pool)[:width] for _ in range(trees)]

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 50_000 // trees)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                n = part.num_rows
                pool = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8).reshape(n, cfg.pool)
                labels = np.empty((trees, n, width + 2), np.uint8)
                for t, order in enumerate(orders):
                    labels[t, :, 0], labels[t, :, 1] = t >> 8, t & 255
                    labels[t, :, 2:] = pool[:, order]
                ends = pa.py_buffer((np.arange(trees * n + 1) * (width + 2)).astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), trees * n, [None, ends, pa.py_buffer(labels.tobytes())])
                rest = (pa.array(np.tile(part.column(i).to_numpy(), trees)) for i in range(4))
                bits = pa.concat_arrays([part.column(5)] * trees) if turn else pa.nulls(trees * n, pa.binary())
                yield pa.RecordBatch.from_arrays([packed, *rest, bits], names=["label", "node", "comp", "size", "own", "bits"])

    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("prefix", pa.int32()), ("lack", pa.float64()), ("whole", pa.float64()), ("region", pa.binary())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, rest = np.zeros((0, width + 2), np.uint8), [np.zeros(0, np.int64)] * 4
        bits = np.zeros((0, cfg.bits // 64), np.uint64) if turn else None
        before: int | None = None  # common prefix with the last row that was handled; unknown at the partition's start

        def handle(upto: int, after: int) -> Iterator[pa.RecordBatch]:
            # the two bytes of the tree's number count as one
            flat = label[:upto, 1:].copy()
            flat[:, 0] = np.concatenate([[0], np.cumsum((label[1:upto, :2] != label[: upto - 1, :2]).any(1)) & 255])
            node, comp, size, own = (c[:upto] for c in rest)
            pairs, lacks, cut = scan(flat, comp, size, own, width if before is None else before, after, cfg, bits)
            none = lambda n, *kinds: [pa.nulls(n, k) for k in kinds]
            if pairs:
                x, y, p = np.array(pairs, np.int64).T
                a, b = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
                yield as_batch(out, [pa.array(a), pa.array(b), pa.array(p.astype(np.int32)), *none(len(a), pa.float64(), pa.float64(), pa.binary())])
            name = lambda i: label[i, : cfg.depth + 2].tobytes()
            # trees are alike, so as many as the first round has give the account
            lacks, cut = ([x for x in rows if int(label[x[0], 0]) * 256 + label[x[0], 1] < cfg.trees] for rows in (lacks, cut))
            if lacks:
                names = {name(i) for i, _ in cut}
                keys = [k if (k := name(i)) in names else None for i, _, _ in lacks]
                yield as_batch(out, [pa.array(node[[i for i, _, _ in lacks]]), *none(len(lacks), pa.int64(), pa.int32()), [x for _, x, _ in lacks], [x for _, _, x in lacks], keys])
            if cut:
                n = len(cut)
                yield as_batch(out, [*none(n, pa.int64()), [c for _, c in cut], *none(n, pa.int32(), pa.float64(), pa.float64()), [name(i) for i, _ in cut]])

        for batch in batches:
            if not batch.num_rows:
                continue
            more = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, width + 2)
            label, rest = np.concatenate([label, more]), [np.concatenate([c, batch.column(k + 1).to_numpy()]) for k, c in enumerate(rest)]
            if bits is not None:
                bits = np.concatenate([bits, np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(batch.num_rows, -1)])
            while len(label) > cfg.buffer_rows:
                same = np.cumprod(label[1:] == label[:-1], axis=1).sum(1) - 2
                # the last place where a region ends, else the last of the least common prefix
                places = np.nonzero(same < cfg.depth)[0]
                places = places if len(places) else np.nonzero(same == same.min())[0]
                upto = int(places[-1]) + 1
                after = max(-1, int(same[upto - 1]))
                yield from handle(upto, after)
                label, rest, before = label[upto:], [c[upto:] for c in rest], after
                bits = bits[upto:] if bits is not None else None
        if len(label):
            yield from handle(len(label), width)

    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    labels = rows.select("node", "comp", "size", "own", "signature", "bits").mapInArrow(plant, "label binary, node long, comp long, size long, own long, bits binary")
    labels = labels.repartitionByRange(parts, "label", "node").sortWithinPartitions("label", "node")
    return materialize(labels.mapInArrow(walk, "a long, b long, prefix int, lack double, whole double, region binary"), "neighbours")


def open_rows(walked: DataFrame, before: DataFrame | None, trees: int, cfg: NearConfig) -> DataFrame:
    """(node, need) of the rows that lack coverage after a round of ``trees``; ``before`` has them for the round before."""
    parts = walked.where("a is null").groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("x"), F.max("b").alias("y"))
    # a large region has many rows, which are dealt out by a second key
    deal = F.sequence(F.lit(0), F.lit(63))
    closed = parts.where("n = 1 or x = y and x >= 0").select(F.col("region").alias("__region"), F.explode(deal).alias("__deal"))
    lacks = walked.where("lack is not null").withColumn("deal", F.pmod("a", F.lit(64)).cast("int"))
    lacks = lacks.join(closed, (F.col("region") == F.col("__region")) & (F.col("deal") == F.col("__deal")), "left")
    lacks = lacks.select("a", F.when(F.col("__region").isNull(), F.col("lack")).otherwise(F.col("whole")).alias("lack"))
    # the list holds a value for each tree of the account at most
    lacks = lacks.where("lack > 0").groupBy(F.col("a").alias("node")).agg(F.sort_array(F.collect_list("lack"), False).alias("lacks"))
    rows = lacks.withColumn("need", F.lit(cfg.coverage)) if before is None else before.join(lacks, "node", "left")
    worst = F.coalesce(F.get("lacks", F.lit(cfg.account // 6 - 1)), F.lit(0.0))
    need = F.col("need") - trees * (cfg.least**cfg.depth - worst)
    return materialize(rows.select("node", need.alias("need")).where("need > 0"), "open")


def confirm(pairs: DataFrame, texts: DataFrame, cfg: NearConfig) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; ``texts`` has (node, packed)."""
    left = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("packed").alias("packed_a")), "a")
    full = left.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("packed_b")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held: OrderedDict[int, np.ndarray] = OrderedDict()

        def set_of(key: int, packed: bytes) -> np.ndarray:
            if key not in held:
                if len(held) >= 64:
                    held.popitem(last=False)
                held[key] = shingle_set(unpack.decompress(packed).split(), cfg.shingle_words)
            return held[key]

        for batch in batches:
            a, b, pa_, pb_ = (c.to_pylist() for c in batch.columns)
            good = []
            for i in range(len(a)):
                x, y = set_of(a[i], pa_[i]), set_of(b[i], pb_[i])
                if 100 * min(len(x), len(y)) < cfg.percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= cfg.percent * (len(x) + len(y) - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], names=["a", "b"])

    return full.select("a", "b", "packed_a", "packed_b").mapInArrow(compare, "a long, b long")


def shingle_rows(texts: DataFrame, cfg: NearConfig) -> DataFrame:
    """(token, node, comp, size) of ``texts`` (node, comp, packed): one row for each shingle of a text."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for node, comp, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingle_set(unpack.decompress(packed).split(), cfg.shingle_words).view(np.int64)
                n = len(s)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(n, node)), pa.array(np.full(n, comp)), pa.array(np.full(n, n))], names=["token", "node", "comp", "size"])

    return texts.select("node", "comp", "packed").mapInArrow(shingles, "token long, node long, comp long, size long")


def own_shingles(texts: DataFrame, cfg: NearConfig) -> DataFrame:
    """(node, own): how many shingles of a text stand in no other text of ``texts``; texts without any are left out."""
    own = shingle_rows(texts, cfg).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
    return own.groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def prefix_pairs(texts: DataFrame, cfg: NearConfig) -> DataFrame:
    """All pairs (a, b) of ``texts`` (node, comp, packed) from two components that may be similar enough.

    Two similar sets share one of their rarest shingles: of a set of n, the n - ceil(least * n) + 1 first by frequency and hash.
    """
    cells = materialize(shingle_rows(texts, cfg), "open-shingles")
    counts = cells.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("n", "token"))
    first = cells.join(counts, "token").withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * cfg.percent / 100) + 1)
    first = materialize(first.where("n > 1").select("token", "node", "comp", "size"), "open-prefixes")
    other = first.select("token", F.col("node").alias("b"), F.col("comp").alias("comp_b"), F.col("size").alias("size_b"))
    # of a shingle's largest component only the other components' rows look for partners
    sizes = first.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max(F.struct("n", "comp")).alias("top"))
    looking = first.join(sizes, "token").where(F.col("comp") != F.col("top.comp")).drop("top")
    near = (F.lit(100) * F.least("size", "size_b") >= F.lit(cfg.percent) * F.greatest("size", "size_b")) & (F.col("comp") != F.col("comp_b"))
    return looking.join(other, "token").where(near).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


class _Groups:
    """Components so far: ``names`` has (node, comp) for the nodes that are linked."""

    def __init__(self):
        self.names: DataFrame | None = None

    def of(self, rows: DataFrame, node: str, name: str) -> DataFrame:
        """``rows`` with the component of a node as the column ``name``; a node without links is its own."""
        if self.names is None:
            return rows.withColumn(name, F.col(node))
        return rows.join(self.names.select(F.col("node").alias("__n"), F.col("comp").alias("__c")), F.col(node) == F.col("__n"), "left").withColumn(name, F.coalesce("__c", node)).drop("__n", "__c")

    def between(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose ends lie in two components."""
        return self.of(self.of(pairs, "a", "comp_a"), "b", "comp_b").where("comp_a <> comp_b")

    def link(self, links: DataFrame) -> None:
        """Join the components of the ends of ``links`` (a, b)."""
        bridges = materialize(self.between(links).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct(), "links")
        if bridges.isEmpty():
            return
        over = connected_components(bridges)
        if self.names is None:
            self.names = over.select("node", F.col("label").alias("comp"))
            return
        moved = self.names.join(over.select(F.col("node").alias("comp"), "label"), "comp", "left").select("node", F.coalesce("label", "comp").alias("comp"))
        fresh = over.select("node", F.col("label").alias("comp")).join(self.names.select("node"), "node", "left_anti")
        self.names = materialize(moved.unionAll(fresh), "components")


def near_dedup(docs: DataFrame, cfg: NearConfig | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Rows with equal shingle sets are linked. A text that is null or has no words has no shingles, is linked with
    nothing and is kept. A null doc_id takes part in links and has, alone, a null component; it is never the
    component's smallest. Rows that share a doc_id are separate; all rows with the smallest doc_id
    of a component are kept. Other columns are ignored, whatever their names. An empty table gives an empty table.
    """
    cfg = cfg or NearConfig()
    spark = docs.sparkSession
    table = materialize(sketches(docs, cfg), "sketches")
    sets = table.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("signature").alias("signature"), F.max("n_shingles").alias("size"))
    # numbered once, when the table is written
    sets = materialize(sets.withColumn("node", F.monotonically_increasing_id()), "sets")

    def texts_of(nodes: DataFrame, name: str) -> DataFrame:
        """(node, packed) of the wanted nodes."""
        wanted = sets.select("digest", "node").join(nodes, "node", "left_semi")
        found = table.where("packed is not null").select("digest", "packed").join(wanted, "digest")
        return materialize(found.dropDuplicates(["node"]).select("node", "packed"), name)

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    groups = _Groups()
    walked = forest(sets.select("node", F.col("node").alias("comp"), "size", F.lit(0).cast("long").alias("own"), "signature", F.lit(None).cast("binary").alias("bits")), cfg, cfg.trees, cfg.label_bytes, 0)
    pairs = materialize(walked.where("prefix is not null").groupBy("a", "b").agg(F.sum("prefix").alias("votes")), "candidates")
    texts = texts_of(ends(pairs), "candidate-texts")
    both = pairs.select(F.explode(F.array("a", "b")).alias("end"), F.struct("votes", "a", "b").alias("pair"))
    best = both.groupBy("end").agg(F.max("pair").alias("pair")).select("pair.a", "pair.b").distinct()
    groups.link(materialize(confirm(best, texts, cfg), "links-best"))
    groups.link(confirm(groups.between(pairs.join(best, ["a", "b"], "left_anti")), texts, cfg))

    if cfg.trees * cfg.least**cfg.depth < cfg.coverage:
        raise ValueError("the trees of the first round do not give the coverage that is asked for")

    def unsettled(need: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        """The open rows (node, need, comp) that may have a link to another component, and their texts; None without any."""
        rows = materialize(groups.of(need, "node", "comp"), "open")
        if rows.select("comp").distinct().limit(2).count() < 2:
            return None
        texts = texts_of(rows, "open-texts")
        own = own_shingles(texts.join(rows, "node"), cfg)
        rows = rows.join(sets.select("node", "size"), "node").join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        # a set with too many shingles of its own is linked with no other open set
        rows = materialize(rows.where(F.lit(100) * (F.col("size") - F.col("own")) >= F.lit(cfg.percent) * F.col("size")), "open")
        return (rows, texts) if rows.select("comp").distinct().limit(2).count() > 1 else None

    tested = pairs.select("a", "b")
    left = unsettled(open_rows(walked, None, cfg.trees, cfg))
    for turn in range(1, cfg.rounds + 1):
        if left is None or left[0].limit(cfg.exact_rows + 1).count() <= cfg.exact_rows:
            break
        (need, texts), trees = left, cfg.account << (turn - 1)
        signed = texts.mapInArrow(_fresh_signatures(cfg, turn), "node long, signature binary, bits binary")
        walked = forest(signed.join(need.drop("need"), "node"), replace(cfg, region_pairs=cfg.late_pairs), trees, cfg.pool // 2, turn)
        met = walked.where("prefix is not null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
        met = materialize(met, "candidates")
        tested = tested.unionAll(met)
        groups.link(confirm(groups.between(met), texts, cfg))
        left = unsettled(open_rows(walked, need.select("node", "need"), trees, cfg))
    if left is not None:
        need, texts = left
        met = materialize(prefix_pairs(texts.join(need.select("node", "comp"), "node"), cfg).join(tested, ["a", "b"], "left_anti"), "candidates")
        groups.link(confirm(met, texts, cfg))
    named = groups.of(sets.select("digest", "first_doc", "node"), "node", "comp")
    component = named.groupBy("comp").agg(F.min("first_doc").alias("component_id"))
    of_set = materialize(named.join(component, "comp").select("digest", "component_id"), "components")
    out = table.select("doc_id", "n_shingles", "digest").join(of_set, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _fresh_signatures(cfg: NearConfig, turn: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        constants, more, unpack = _pool_constants(cfg, turn), _pool_constants(cfg, -turn, cfg.bits), zstandard.ZstdDecompressor()
        for batch in batches:
            sets = [shingle_set(unpack.decompress(p).split(), cfg.shingle_words) for p in batch.column(1).to_pylist()]
            columns = [pa.array([f(s, c) for s in sets], pa.binary()) for f, c in ((signature, constants), (bit_sketch, more))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["node", "signature", "bits"])

    return sign
