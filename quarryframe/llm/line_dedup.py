"""Line dedup: two Bloom filters pick suspected repeats; only those are shuffled and confirmed exactly.

Pass 1 hashes the key of each long line, once per document. Each hash sets two bits; a bit that one
task sets for two documents, or that two tasks set, belongs to the twice-seen filter, any other set bit
to the once-seen filter. Bits are summed before and after the shuffle, so a frequent line costs one row per task.
Pass 2 sends a 128-bit digest for those lines whose bits are all in the twice-seen filter and counts their
documents exactly. Pass 3 drops lines. The filter's size has a fixed upper bound; with more keys
than it holds more lines become suspects, and the result stays exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryframe.llm._base import ASCII_SPACE, byte_values, materialize, need_columns


@dataclass(frozen=True)
class LineConfig:
    min_chars: int = 40
    min_docs: int = 5
    #: Bits of a filter: 256 per document, within these bounds (2**24 bits are 2 MB). The driver holds the filter several times over, so it stays small.
    min_bits_log2: int = 20
    max_bits_log2: int = 24
    #: Confirmed keys that are sent to all tasks (24 bytes each); more are joined to the documents instead.
    max_broadcast_keys: int = 250_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None if it has fewer than ``min_chars`` code points."""
    if len(line) < min_chars:
        return None
    key = line.strip(ASCII_SPACE).lower()  # bytes.lower changes A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _positions(hashes: np.ndarray, bits_log2: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits_log2) - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def twice_seen(docs: DataFrame, bits_log2: int, cfg: LineConfig) -> np.ndarray:
    """The twice-seen filter as 64-bit words; a filter of ``2**bits_log2`` bits at most reaches the driver."""

    def hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            values, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            held.clear()
            low, high = _positions(values, bits_log2)
            bit = np.concatenate([low, high]).astype(np.int64)
            seen = np.minimum(np.concatenate([counts, counts]), 2).astype(np.int64)
            for at in range(0, len(bit), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(bit[at : at + (1 << 18)]), pa.array(seen[at : at + (1 << 18)])], names=["bit", "seen"])

        for batch in batches:
            for text in byte_values(batch.column(0)):
                if text and len(text) >= cfg.min_chars:
                    keys = {k for k in (line_key(x, cfg.min_chars) for x in text.split(b"\n")) if k is not None}
                    held.append(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
                    size += len(keys)
            if size > 4_000_000:
                size = 0
                yield from flush()
        yield from flush()

    bits = docs.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(hash_lines, "bit long, seen long")
    twice = bits.groupBy("bit").agg(F.sum("seen").alias("seen")).where("seen >= 2")
    words = twice.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (bits_log2 - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _suspect(hashes: np.ndarray, words: np.ndarray, bits_log2: int) -> np.ndarray:
    hit = np.ones(len(hashes), bool)
    for p in _positions(hashes, bits_log2):
        hit &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return hit


def _suspects_of(texts: list[bytes | None], words: np.ndarray, bits_log2: int, min_chars: int) -> list[tuple[int, int, bytes]]:
    """(text, line, key) of the lines that the twice-seen filter has."""
    found = [(i, j, key) for i, text in enumerate(texts) if text for j, line in enumerate(text.split(b"\n")) if (key := line_key(line, min_chars)) is not None]
    hit = _suspect(np.fromiter((xxhash.xxh3_64_intdigest(k) for _, _, k in found), np.uint64, len(found)), words, bits_log2)
    return [found[i] for i in np.nonzero(hit)[0]]


def repeated_keys(docs: DataFrame, words: np.ndarray, bits_log2: int, cfg: LineConfig) -> tuple[DataFrame, DataFrame]:
    """The suspects as (digest, doc_id), and of them the keys in ``min_docs`` documents: (digest, keep_doc)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = {(i, k) for i, _, k in _suspects_of(byte_values(batch.column(1)), words, bits_log2, cfg.min_chars)}
            yield pa.RecordBatch.from_arrays([pa.array([_digest(k) for _, k in rows], pa.binary()), pa.array([ids[i] for i, _ in rows], pa.int64())], names=["digest", "doc_id"])

    suspects = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(send, "digest binary, doc_id long")
    keys = suspects.groupBy("digest").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keep_doc")).where(F.col("docs") >= cfg.min_docs)
    return suspects, keys.select("digest", "keep_doc")


RESULT = "n_lines long, n_dropped long"


def line_dedup(docs: DataFrame, cfg: LineConfig | None = None) -> DataFrame:
    """All rows of ``docs`` (with doc_id and text), their text without repeated lines, and RESULT behind it.

    A null text stays null and counts as one empty line. Rows that share a doc_id count as separate
    documents, and the largest doc_id keeps the line in each of them. Rows with a null doc_id are
    neither counted nor changed. Columns named as those of RESULT are replaced. Repeats inside one document
    count once, and all of them go or stay together.
    """
    need_columns(docs, "doc_id", "text")
    cfg = cfg or LineConfig()
    docs = docs.drop("n_lines", "n_dropped")
    n_docs = docs.select("doc_id").count()
    bits_log2 = min(cfg.max_bits_log2, max(cfg.min_bits_log2, (256 * n_docs).bit_length()))
    words = twice_seen(docs, bits_log2, cfg)
    suspects, keys = repeated_keys(docs, words, bits_log2, cfg)
    keys = materialize(keys, "repeated-lines")
    if keys.count() <= cfg.max_broadcast_keys:
        rows = keys.toPandas()
        return _drop_lines(docs, cfg, words, bits_log2, (b"".join(rows["digest"]), rows["keep_doc"].to_numpy(np.int64)))
    hits = suspects.join(keys, "digest").where(F.col("doc_id") != F.col("keep_doc"))
    hits = hits.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("digest").alias("__drop"))
    joined = docs.join(hits, F.col("doc_id").cast("long") == F.col("__doc"), "left").drop("__doc")
    return _drop_lines(joined, cfg, words, bits_log2, None)


def _drop_lines(docs: DataFrame, cfg: LineConfig, words: np.ndarray, bits_log2: int, keys: tuple[bytes, np.ndarray] | None) -> DataFrame:
    """``keys``: the digests in a row and the document that keeps each, or None where each row lists its digests in the column __drop."""
    names = [c for c in docs.columns if c != "__drop"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "__drop")
    doc_at, text_at = names.index("doc_id"), names.index("text")
    docs = docs.select(*names, *(["__drop"] if keys is None else []))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = {} if keys is None else {keys[0][16 * i : 16 * i + 16]: k for i, k in enumerate(keys[1].tolist())}
        for batch in batches:
            ids, texts = batch.column(doc_at).to_pylist(), byte_values(batch.column(text_at))
            listed = None if keys is not None else [set(x or ()) for x in batch.column(len(names)).to_pylist()]
            gone: dict[int, set[int]] = {}
            for i, j, key in _suspects_of(texts, words, bits_log2, cfg.min_chars):
                d = _digest(key)
                if (d in listed[i]) if listed is not None else (ids[i] is not None and keep.get(d, ids[i]) != ids[i]):
                    gone.setdefault(i, set()).add(j)
            for i, lines in gone.items():
                texts[i] = b"\n".join(x for j, x in enumerate(texts[i].split(b"\n")) if j not in lines)
            dropped = np.zeros(len(texts), np.int64)
            for i, lines in gone.items():
                dropped[i] = len(lines)
            left = np.fromiter(((t or b"").count(b"\n") + 1 for t in texts), np.int64, len(texts))
            # a text that lost all its lines is empty and has no line left
            left[[i for i, lines in gone.items() if texts[i] == b"" and len(lines) == _count(batch, text_at, i)]] = 0
            columns = list(batch.columns[: len(names)])
            columns[text_at] = pa.array(texts, pa.binary()).cast(batch.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(left + dropped), pa.array(dropped)], names=[*names, "n_lines", "n_dropped"])

    return docs.mapInArrow(drop, f"{fields}, {RESULT}")


def _count(batch: pa.RecordBatch, column: int, row: int) -> int:
    return batch.column(column)[row].as_py().count("\n") + 1
