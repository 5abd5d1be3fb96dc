"""Helpers that the corpus operators share: scratch tables, Arrow text access, 64-bit hashing."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Characters that the word and line contracts call white space (ASCII only).
ASCII_SPACE = b" \t\n\x0b\x0c\r"

#: Rows of an Arrow batch at most; the session's setting is lowered to it.
BATCH_ROWS = 2000

_ROOTS: dict[int, str] = {}
_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def scratch_root(spark: SparkSession) -> str:
    """A folder of this session inside the shared folder ``spark.checkpoint.dir``.

    Only a local session without that setting (tests on one machine) takes a temporary folder instead; on a cluster the setting has to be there.
    The folder goes when the driver process ends.
    """
    key = id(spark.sparkContext)
    if key not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = base or f"file://{tempfile.mkdtemp(prefix='quarryframe-')}"
        _ROOTS[key] = f"{base.rstrip('/')}/quarryframe-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, _ROOTS[key])
    return _ROOTS[key]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # the gateway may be gone at exit; the folder is then left to the store's own expiry
        pass


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder with the file system that Spark itself uses for it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back; and the folder, for ``drop_path`` when it is used up."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    return stage(df, name)[0]


def byte_values(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def as_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def mix64(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser on unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def on_workers(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it, whatever their working folder is."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _HOME])
    # texts are long rows: small Arrow batches bound the memory of both sides of a Python worker
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))


def need_columns(df: DataFrame, *names: str) -> None:
    """Stop early if a column is missing."""
    on_workers(df.sparkSession)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


@contextlib.contextmanager
def few_arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """While jobs over rows of megabytes run, Arrow batches have at most ``n`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)
