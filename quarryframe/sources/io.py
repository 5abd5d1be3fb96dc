"""Sources and sinks: JSON lines with uniqueness gates, hash-indexed shards, self-hashed manifests, training logs, configs."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import json
import re
import tempfile
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryframe.functions.python_rules import canonical_json, canonical_text
from quarryframe.operators.windows import dense_index

SHARD_SIZE = 1000


def unique_by(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows themselves; a key that is null or occurs twice stops the job when it runs."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    bad = (F.col("__n") > 1) | ~F.expr(" and ".join(f"`{k}` is not null" for k in keys))
    checked = counted.withColumn("__ok", F.when(bad, F.raise_error(F.concat(F.lit("missing or duplicate key "), F.to_json(F.struct(*keys))))).otherwise(F.lit(True)))
    return rows.join(checked.where("__ok").drop("__n", "__ok"), list(keys))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per line; blank lines are skipped, and a line that is no record of the schema stops the job."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    broken = F.col("r").isNull() | F.try_parse_json("value").isNull()
    return parsed.select(F.when(broken, F.raise_error(F.concat(F.lit("not a record: "), F.substring("value", 1, 80)))).otherwise(F.col("r")).alias("r")).select("r.*")


def shard_index(records: DataFrame, group: str, order: list[str], size: int = SHARD_SIZE) -> DataFrame:
    """``shard`` and ``line`` of each record by its dense number over all records."""
    return dense_index(records, group, order).withColumns({"shard": F.floor(F.col("global_idx") / size).cast("long"), "line": F.col("global_idx") % size})


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; only a local session without that setting takes one of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quarryframe-')}"
    path = f"{base.rstrip('/')}/quarryframe-{name}-{uuid.uuid4().hex}"
    atexit.register(drop_folder, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: what is used several times is computed once, and a lost executor repeats only tasks."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder with the file system that Spark itself uses for it; at the end of the driver its gateway may be gone, and the folder stays."""
    with contextlib.suppress(Exception):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def seal_manifest(payload: dict[str, Any], field: str = "manifest_sha256") -> dict[str, Any]:
    """The payload with the sha256 of its canonical text; small documents, made on the driver."""
    body = {k: v for k, v in payload.items() if k != field}
    return body | {field: hashlib.sha256(canonical_text(body).encode()).hexdigest()}


def open_manifest(text: str, field: str = "manifest_sha256") -> dict[str, Any]:
    payload = json.loads(text)
    if seal_manifest(payload, field)[field] != payload.get(field):
        raise ValueError("the manifest does not match its hash")
    return payload


def sealed_text(payload: Column, field: str = "manifest_sha256") -> Column:
    """Manifests as rows: the canonical text of a struct with the sha256 of that text as its last field."""
    body = canonical_json(F.to_json(payload))
    return F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(f',"{field}":"'), F.sha2(body, 256), F.lit('"}'))


def seal_holds(text: Column, field: str = "manifest_sha256") -> Column:
    """Whether a sealed text is the one that was sealed; false for a text without a seal."""
    tail = f',"{field}":"'
    at = F.length(text) - 64 - len(tail) - 2
    body = F.concat(F.substring(text, F.lit(1), at), F.lit("}"))
    stated = F.substring(text, at + len(tail) + 1, F.lit(64))
    return F.coalesce((at > 0) & (F.substring(text, at + 1, F.lit(len(tail))) == tail) & (F.sha2(body, 256) == stated), F.lit(False))


def frozen_configs(texts: DataFrame, column: str, schema: str) -> DataFrame:
    """``texts`` with ``config`` (null unless accepted), ``accepted`` and ``config_sha256`` of the text's bytes; accepted is a JSON text of the schema whose ``status`` is ``frozen``."""
    read = F.when(F.try_parse_json(column).isNotNull(), F.from_json(column, schema))
    ok = F.coalesce(read["status"] == "frozen", F.lit(False))
    return texts.withColumns({"config": F.when(ok, read), "accepted": ok, "config_sha256": F.sha2(F.col(column), 256)})


def open_config(text: str) -> tuple[dict[str, Any], str]:
    """A JSON config that has to be frozen, and the sha256 of its bytes."""
    payload = json.loads(text)
    if payload.get("status") != "frozen":
        raise ValueError("the config is not frozen")
    return payload, hashlib.sha256(text.encode()).hexdigest()


def training_log(lines: DataFrame) -> DataFrame:
    """(step, loss) of the lines ``value`` that hold a loss, by their place ``no``."""
    found = F.regexp_extract("value", r"'loss':\s*([0-9.eE+-]+)", 1)
    return lines.withColumn("loss", F.when(found != "", found.cast("double"))).where("loss is not null")


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do: rows whose key is not among those done."""
    return todo.join(done.select(key), key, "left_anti")


def markdown_table(rows: DataFrame) -> str:
    """A report table of an aggregate, whole; the caller passes what a report can hold."""
    data = rows.collect()
    head = rows.columns
    return "\n".join([f"| {' | '.join(head)} |", f"|{'|'.join('-' for _ in head)}|", *(f"| {' | '.join(str(v) for v in r)} |" for r in data)])


def write_grid(grid: DataFrame) -> list[DataFrame]:
    """A small aggregate as Parquet, CSV and JSON under the shared folder ``spark.checkpoint.dir``, each read back."""
    spark = grid.sparkSession
    path = shared_folder(spark, "grid")
    out = []
    for kind in ("parquet", "csv", "json"):
        grid.write.format(kind).save(f"{path}/{kind}")
        out.append(spark.read.format(kind).schema(grid.schema).load(f"{path}/{kind}"))
    return out
