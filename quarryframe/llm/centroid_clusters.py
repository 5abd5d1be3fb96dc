"""Centroid clustering: rounds of nearest-centroid assignment in integers, by filtering kd-trees.

Vectors are put on an integer grid (``floor(scale * x)``), so that sums, means and distances are exact and do not depend on
how rows are dealt. Each task builds kd-trees over blocks of its rows; a node holds its count, the integer sums of
its vectors and their bounding box. The trees are written once to the shared folder and read in each round. A round passes
the centroids down a tree: a centroid that is strictly farther than another one at every point of the box is pruned, a node
with one centroid left is assigned whole by its sums, and a leaf with several is resolved vector by vector. What a task returns is
one row per centroid and component, so the driver holds k * (d + 1) numbers, however many vectors there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from quarryframe.llm._base import as_batch, drop_path, few_arrow_rows, need_columns, stage

#: Grid numbers below this bound keep all squared distances of 64 components within 64 bits.
GRID_BOUND = 2**26
#: Below this bound the same holds for the 53 bits of a double, so that matrix products are exact.
FLOAT_BOUND = 2**22
#: Blocks in one Arrow batch.
BLOCK_ROWS = 16

TREE_SCHEMA = "vec_ids array<long>, points binary, spans binary, sums binary, low binary, high binary"


@dataclass(frozen=True)
class ClusterConfig:
    k: int = 40
    dims: int = 64
    rounds: int = 5
    scale: int = 256
    seed: str = "2"
    #: Vectors of one tree and of one leaf at most; they bound memory and never change the result.
    block_vectors: int = 2048
    leaf_vectors: int = 32

    def __post_init__(self):
        if not 0 < self.dims <= 64 or self.k < 1 or self.rounds < 0:
            raise ValueError("need 1 to 64 components, a centroid at least and no negative number of rounds")


# ---- trees -------------------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    points: np.ndarray  # in tree order
    spans: np.ndarray  # per node: first point, end, left child, right child (-1: a leaf)
    sums: np.ndarray
    low: np.ndarray
    high: np.ndarray


def build_tree(points: np.ndarray, leaf: int) -> tuple[Tree, np.ndarray]:
    """The tree over ``points`` (n, d), and the order in which it has them.

    A node is split at the median of its widest component; equal points stay in one leaf whatever their number.
    """
    order = np.arange(len(points))
    spans, sums, low, high = [[0, len(points), -1, -1]], [], [], []
    at = 0
    while at < len(spans):
        a, b = spans[at][:2]
        held = points[order[a:b]]
        lo, hi = held.min(axis=0), held.max(axis=0)
        sums.append(held.sum(axis=0))
        low.append(lo)
        high.append(hi)
        widest = int(np.argmax(hi - lo))
        if b - a > leaf and hi[widest] > lo[widest]:
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(held[:, widest], mid)]
            spans[at][2:] = [len(spans), len(spans) + 1]
            spans += [[a, a + mid, -1, -1], [a + mid, b, -1, -1]]
        at += 1
    return Tree(points[order], np.array(spans, np.int64), np.array(sums), np.array(low), np.array(high)), order


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (n, k) of integer vectors."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < FLOAT_BOUND:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def filter_tree(tree: Tree, centroids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
    """(node, first point, end, clusters of its points) for nodes that together hold each point once.

    ``clusters`` is one number for a node that is assigned whole. Of equally near centroids the smallest number is taken.
    """
    todo = [(0, np.arange(len(centroids)))]
    while todo:
        node, left = todo.pop()
        lo, hi = tree.low[node], tree.high[node]
        c = centroids[left]
        best = c[int(np.argmin(((2 * c - (lo + hi)) ** 2).sum(axis=1)))]
        # the corner of the box that suits each centroid most against the best one
        corner = np.where(c > best, hi, lo)
        left = left[((c - corner) ** 2).sum(axis=1) <= ((best - corner) ** 2).sum(axis=1)]
        a, b, first, second = tree.spans[node].tolist()
        if len(left) == 1:
            yield node, a, b, left
        elif first < 0:
            yield node, a, b, left[np.argmin(squared_distances(tree.points[a:b], centroids[left]), axis=1)]
        else:
            todo += [(first, left), (second, left)]


# ---- in tasks ----------------------------------------------------------------------------------------------------------


def on_grid(vectors: np.ndarray, scale: int) -> np.ndarray:
    grid = np.floor(scale * vectors.astype(np.float64))
    if np.abs(grid).max(initial=0) >= GRID_BOUND:
        raise ValueError(f"a component is beyond {GRID_BOUND / scale:g}: squared distances would not fit 64 bits")
    return grid.astype(np.int64)


def _tree_rows(cfg: ClusterConfig) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [pa.list_(pa.int64()), *[pa.binary()] * 5]
    schema = pa.schema(list(zip([c.split()[0] for c in TREE_SCHEMA.split(", ")], kinds, strict=True)))

    def row(ids: list, vectors: np.ndarray) -> pa.RecordBatch:
        tree, order = build_tree(on_grid(vectors, cfg.scale), cfg.leaf_vectors)
        packed = [tree.points.astype("<i4"), tree.spans.astype("<i4"), tree.sums.astype("<i8"), tree.low.astype("<i4"), tree.high.astype("<i4")]
        return as_batch(schema, [[[ids[i] for i in order.tolist()]], *[[x.tobytes()] for x in packed]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in batches:
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, cfg.dims)
            some = batch.column(0).to_pylist()
            at = 0
            while at < len(some):
                n = min(len(some) - at, cfg.block_vectors - held)
                ids += some[at : at + n]
                parts.append(vectors[at : at + n])
                held += n
                at += n
                if held == cfg.block_vectors:
                    yield row(ids, np.concatenate(parts))
                    ids, parts, held = [], [], 0
        if held:
            yield row(ids, np.concatenate(parts))

    return run


def _trees(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Scalar, Tree]]:
    for i in range(batch.num_rows):
        points, spans, sums, low, high = (np.frombuffer(batch.column(c)[i].as_py(), t).astype(np.int64) for c, t in enumerate(("<i4", "<i4", "<i8", "<i4", "<i4"), 1))
        yield batch.column(0)[i], Tree(points.reshape(-1, dims), spans.reshape(-1, 4), *(x.reshape(-1, dims) for x in (sums, low, high)))


def _partial_sums(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k, d = centroids.shape
    schema = pa.schema([("cluster", pa.int32()), ("part", pa.int32()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, d + 1), np.int64)  # component sums, then the count
        for batch in batches:
            for _, tree in _trees(batch, d):
                for node, a, b, clusters in filter_tree(tree, centroids):
                    if len(clusters) == 1:
                        total[clusters[0], :d] += tree.sums[node]
                        total[clusters[0], d] += b - a
                    else:
                        np.add.at(total[:, :d], clusters, tree.points[a:b])
                        total[:, d] += np.bincount(clusters, minlength=k)
        used = np.repeat(np.nonzero(total[:, d])[0], d + 1)
        yield as_batch(schema, [used, np.tile(np.arange(d + 1), len(used) // (d + 1)), total[total[:, d] > 0].ravel()])

    return run


def _assignments(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _trees(batch, centroids.shape[1]):
                cluster = np.zeros(len(tree.points), np.int64)
                for _, a, b, clusters in filter_tree(tree, centroids):
                    cluster[a:b] = clusters
                yield as_batch(schema, [ids.values, cluster, ((tree.points - centroids[cluster]) ** 2).sum(axis=1)])

    return run


# ---- the operator ------------------------------------------------------------------------------------------------------


def usable_vectors(vectors: DataFrame, cfg: ClusterConfig, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows whose vector has all components, none of them null or non-finite."""
    need_columns(vectors, id_col, vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kind = vectors.schema[vector_col].dataType
    held = F.col(vector_col) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else F.col(vector_col).cast(ArrayType(DoubleType()))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id"), held.alias("vector"))
    return out.where((F.size("vector") == cfg.dims) & F.forall("vector", finite))


def first_centroids(usable: DataFrame, cfg: ClusterConfig) -> np.ndarray:
    """The k vectors with the smallest hash of their id; k rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{cfg.seed}:"), F.col("vec_id").cast("string")), 256)
    rows = usable.where("vec_id is not null").orderBy(key, "vector").limit(cfg.k).collect()
    return on_grid(np.array([r["vector"] for r in rows], np.float64).reshape(-1, cfg.dims), cfg.scale)


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame, cfg: ClusterConfig | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each usable vector, and the centroids.

    Vectors that are null, of another length, or with a component that is null or not finite have no row; an empty table gives an empty
    result. Rows without an id are clustered, but never start as a centroid. Repeated rows count as often as they stand; equal
    vectors may all start as centroids, of which the smallest number then gets the vectors and the others stay empty. With fewer
    vectors than centroids there are as many centroids as vectors with an id; with none, there is no row. A component beyond 2^26 / scale stops the job, for distances
    would not fit 64 bits; inertia that does not fit is null. Other columns of the input are not read, whatever their names.
    """
    cfg = cfg or ClusterConfig()
    usable = usable_vectors(vectors, cfg, id_col, vector_col)
    spark = vectors.sparkSession
    result = "vec_id long, cluster int, distance long"
    centroids = first_centroids(usable, cfg)
    if not len(centroids):
        empty = spark.createDataFrame([], f"{result}, cluster_inertia long, inertia long, centroid_sha256 string")
        return empty, centroids
    trees, path = stage(usable.mapInArrow(_tree_rows(cfg), TREE_SCHEMA), "kd-trees")
    with few_arrow_rows(spark, BLOCK_ROWS):
        for _ in range(cfg.rounds):
            parts = trees.mapInArrow(_partial_sums(centroids), "cluster int, part int, value long")
            sums = parts.groupBy("cluster", "part").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
            total = {(r["cluster"], r["part"]): int(r["value"]) for r in sums}
            for c in {c for c, _ in total}:
                centroids[c] = [total[c, j] // total[c, cfg.dims] for j in range(cfg.dims)]
        assigned, _ = stage(trees.mapInArrow(_assignments(centroids), result), "clusters")
    drop_path(spark, path)
    spent = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 2**63 else None
    facts = [Row(cluster=c, cluster_inertia=fits(n), inertia=fits(sum(spent.values())), centroid_sha256=centroid_digest(centroids[c])) for c, n in spent.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most k rows
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
