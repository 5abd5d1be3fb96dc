"""Token-ID output: a content-addressed store of chunked id streams.

Layout of a store (a folder that Spark can read and write):

``recipes/``   one row per document in ascending doc_id order over numbered files: row number, doc_id, n_tokens,
               the chunks as (digest, n) in order, and the Merkle root over the chunk digests
``chunks/``    one row per distinct chunk: digest, n, and the ids as little-endian unsigned integers of
               16 bits where all are below 65536, else of 32 bits
``manifest/``  one row per recipe file: its number, documents, ids, first document and the Merkle root over
               its documents' roots

A rolling polynomial hash over the last WINDOW ids sets the cuts, so equal passages give equal chunks
wherever they stand. Reading verifies each chunk against its digest, each recipe against its root, and
each file against the manifest; a mismatch stops the job.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryframe.llm._base import as_batch, drop_path, materialize, mix64, need_columns, new_path

WINDOW = 16


@dataclass(frozen=True)
class StoreConfig:
    tokenizer_path: str
    end_id: int | None = 2
    #: A cut falls where the top ``cut_bits`` bits of the rolling hash are zero: chunks of 2**cut_bits ids on average.
    cut_bits: int = 9
    min_chunk: int = 128
    max_chunk: int = 4096
    #: Pieces whose ids a worker remembers; beyond it the memory starts anew. It bounds memory only.
    cache_pieces: int = 1_500_000
    docs_per_file: int = 200_000


class PieceEncoder:
    """Byte-level BPE ids of whole texts through the tokenizers library, remembering repeated pieces.

    The pre-tokenizer always breaks before a single space between two other characters that are no white
    space, so a text is encoded piece by piece with the ids of the whole. A text with the string of an added token, at which the
    library splits first, is encoded as a whole.
    """

    def __init__(self, path: str, cache_pieces: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit = cache_pieces
        self.whole: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}  # by what follows the space
        #: White space other than the space and the line feed; texts that have it are split with care.
        self.rare_space = re.compile(f"[{''.join(chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (10, 32))}]")
        self.safe_split = re.compile(r"(?<=\S)(?= \S)")
        #: Ids whose token starts with a space; inside a row of pieces such a token starts a piece.
        self.starts = np.array([(self.tokenizer.id_to_token(i) or "")[:1] == "\u0120" for i in range(self.tokenizer.get_vocab_size())])
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)

    def _learn_whole(self, texts: list[str]) -> None:
        ids = self.encode(texts, add_special_tokens=False)
        self.whole.update((t, np.array(e.ids, "<u4").tobytes()) for t, e in zip(texts, ids, strict=True))

    def _learn_rest(self, words: list[str]) -> None:
        """Many pieces in one call: they stand in a row, and their ids are split where a piece starts."""
        rows = [words[at : at + 1000] for at in range(0, len(words), 1000)]
        for row, e in zip(rows, self.encode([f" {' '.join(row)}" for row in rows], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.nonzero(self.starts[ids])[0].tolist()
            if len(at) != len(row) or at[0]:
                raise ValueError("the tokenizer does not break before each space")
            packed = ids.tobytes()
            self.rest.update((w, packed[4 * i : 4 * j]) for w, i, j in zip(row, at, [*at[1:], len(ids)], strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if len(self.whole) + len(self.rest) > self.limit:
            self.whole.clear()
            self.rest.clear()
        known, single, todo, missing, strange = [], self.rest.get, [], set(), set()
        for i, text in enumerate(texts):
            if any(a in text for a in self.added):
                known.append([np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()])
                continue
            parts = text.split(" ")
            odd = []
            if "" in parts or " \n" in text or "\n " in text or self.rare_space.search(text):
                parts = self.safe_split.split(text)
                odd = [j for j, p in enumerate(parts) if not j or not _plain(p)]
                parts = [p[1:] if j else p for j, p in enumerate(parts)]
            got = list(map(single, parts))
            for j in odd or (0,):
                key = f" {parts[j]}" if j else parts[j]
                got[j] = None
                strange.add(key)
                todo.append((i, j, key, self.whole))
            if None in got:
                fixed = set(odd or (0,))
                for j in [j for j, x in enumerate(got) if x is None and j not in fixed]:
                    missing.add(parts[j])
                    todo.append((i, j, parts[j], self.rest))
            known.append(got)
        self._learn_whole([t for t in strange if t not in self.whole])
        self._learn_rest(list(missing))
        for i, j, key, store in todo:
            known[i][j] = store[key]
        return [b"".join(got) for got in known]


def _plain(piece: str) -> bool:
    """Whether a piece is a space and a word without white space at its end and without further spaces."""
    return len(piece) > 1 and not piece[-1].isspace() and " " not in piece[1:]


_ENCODERS: dict[str, PieceEncoder] = {}


def shared_encoder(path: str, cache_pieces: int) -> PieceEncoder:
    """This worker's encoder; what it has learned stays for its next tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path, cache_pieces)
    return _ENCODERS[path]


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def cut_points(flat: np.ndarray, sizes: list[int], cfg: StoreConfig, powers: tuple[np.ndarray, np.ndarray]) -> list[list[int]]:
    """Ends of the chunks of each of the id streams that ``flat`` holds one after the other; an empty stream has none.

    A cut depends on the last WINDOW ids only, and these lie in one stream.
    """
    n = len(flat)
    total = np.cumsum(mix64(flat) * powers[0][:n])
    total[WINDOW:] -= total[:-WINDOW].copy()
    marks = np.nonzero(((total * powers[1][:n]) >> np.uint64(64 - cfg.cut_bits)) == 0)[0] + 1
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    first = np.searchsorted(marks, starts + WINDOW)
    marks, out = marks.tolist(), []
    for k, size in enumerate(sizes):
        base, ends, last = int(starts[k]), [], 0
        for m in [*(m - base for m in marks[first[k] : first[k + 1]] if m - base < size), size]:
            while m - last > cfg.max_chunk:
                last += cfg.max_chunk
                ends.append(last)
            if m - last >= cfg.min_chunk or m == size and m > last:
                ends.append(m)
                last = m
        out.append(ends)
    return out


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is, and no leaves give the digest of nothing."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        leaves = [digest(b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def _pack(ids: np.ndarray) -> bytes:
    return ids.astype("<u2" if not len(ids) or ids.max() < 65536 else "<u4").tobytes()


def _unpack(payload: bytes, n: int) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if len(payload) == 2 * n else "<u4").astype("<u4")


_STAGED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("digests", pa.list_(pa.binary())),
        ("sizes", pa.list_(pa.int32())),
        ("root", pa.binary()),
        ("new_digests", pa.list_(pa.binary())),
        ("new_sizes", pa.list_(pa.int32())),
        ("new_ids", pa.list_(pa.binary())),
    ]
)
_STAGED_SQL = "doc_id long, n_tokens long, digests array<binary>, sizes array<int>, root binary, new_digests array<binary>, new_sizes array<int>, new_ids array<binary>"
#: Digests of chunks that a task has already sent; a memory bound, for the store drops repeats anyway.
_SENT_LIMIT = 1_000_000


def write_store(docs: DataFrame, path: str, cfg: StoreConfig) -> None:
    """Encode ``docs`` (doc_id, text) into a new store at ``path``.

    A null or empty text is a document of the end id alone (of nothing, if ``end_id`` is None).
    Rows that share a doc_id are separate documents, ordered by their Merkle roots. Other columns are ignored.
    An empty table gives a store without documents.
    """
    need_columns(docs, "doc_id", "text")
    spark = docs.sparkSession
    end = b"" if cfg.end_id is None else np.array([cfg.end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(cfg.tokenizer_path, cfg.cache_pieces)
        powers = (_powers(_BASE, 1 << 18), _powers(_INVERSE, 1 << 18))
        sent: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                streams = [np.frombuffer(x + end, "<u4") for x in encoder([t or "" for t in part.column(1).to_pylist()])]
                sizes = list(map(len, streams))
                if sum(sizes) > len(powers[0]):
                    powers = (_powers(_BASE, 2 * sum(sizes)), _powers(_INVERSE, 2 * sum(sizes)))
                for doc_id, ids, ends in zip(part.column(0).to_pylist(), streams, cut_points(np.concatenate(streams), sizes, cfg, powers), strict=True):
                    chunks, fresh, last = [], [], 0
                    for stop in ends:
                        payload = _pack(ids[last:stop])
                        chunks.append((digest(payload), stop - last))
                        if chunks[-1][0] not in sent:
                            sent.add(chunks[-1][0])
                            fresh.append((*chunks[-1], payload))
                        last = stop
                    root = merkle_root([d for d, _ in chunks])
                    rows.append((doc_id, len(ids), [d for d, _ in chunks], [n for _, n in chunks], root, *([x[i] for x in fresh] for i in range(3))))
                if len(sent) > _SENT_LIMIT:
                    sent.clear()
                yield as_batch(_STAGED, [list(c) for c in zip(*rows, strict=True)])

    staged_at = new_path(spark, "staged-tokens")
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, _STAGED_SQL).write.option("compression", "zstd").parquet(staged_at)
    staged = spark.read.schema(_STAGED_SQL).parquet(staged_at)
    chunks = staged.select(F.explode(F.arrays_zip("new_digests", "new_sizes", "new_ids")).alias("c"))
    chunks = chunks.groupBy(F.col("c.new_digests").alias("digest")).agg(F.first("c.new_sizes").alias("n"), F.first("c.new_ids").alias("ids"))
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = staged.select("doc_id", "n_tokens", F.arrays_zip(F.col("digests").alias("digest"), F.col("sizes").alias("n")).alias("chunks"), "root")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    recipes = recipes.repartitionByRange(parts, "doc_id", "root").sortWithinPartitions("doc_id", "root")
    # numbered once, when the files are written
    recipes = recipes.withColumn("row", F.monotonically_increasing_id())
    recipes.write.option("compression", "zstd").option("maxRecordsPerFile", cfg.docs_per_file).parquet(f"{path}/recipes")
    drop_path(spark, staged_at)
    _manifest(_numbered(spark, path)).write.parquet(f"{path}/manifest")


_RECIPES_SQL = "doc_id long, n_tokens long, chunks array<struct<digest: binary, n: int>>, root binary, row long"


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with their file's number; ``row`` grows in the order of reading."""
    name = F.input_file_name()
    number = F.regexp_extract(name, r"part-(\d+)-", 1).cast("long") * 1_000_000 + F.coalesce(F.regexp_extract(name, r"-c(\d+)\.", 1).cast("long"), F.lit(0))
    return spark.read.schema(_RECIPES_SQL).parquet(f"{path}/recipes").withColumn("file_no", number)


def _manifest(recipes: DataFrame) -> DataFrame:
    """One row per recipe file; a file holds ``docs_per_file`` documents at most, which bounds the group."""
    out = pa.schema([("file_no", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_doc", pa.int64()), ("root", pa.binary())])

    def roots(key, table):
        table = table.sort_by("row")
        return pa.table(
            [[key[0].as_py()], [table.num_rows], [sum(table["n_tokens"].to_pylist())], [table["doc_id"][0].as_py()], [merkle_root(table["root"].to_pylist())]], schema=out
        )

    return recipes.select("file_no", "row", "doc_id", "n_tokens", "root").groupBy("file_no").applyInArrow(roots, "file_no long, n_docs long, n_tokens long, first_doc long, root binary")


def _shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 values moved before ``n_bytes`` further bytes, by squaring the one-zero-byte operator over GF(2)."""
    crc = crc.astype(np.uint32)
    bits = np.array([0xEDB88320, *(1 << k for k in range(31))], np.uint32)  # operator of one zero bit

    def times(op: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for k in range(32):
            out ^= np.where((x >> np.uint32(k)) & np.uint32(1), op[k], np.uint32(0))
        return out

    op = bits
    for _ in range(3):
        op = times(op, op)
    left = n_bytes.astype(np.int64).copy()
    while left.any():
        odd = (left & 1).astype(bool)
        crc[odd] = times(op, crc[odd])
        op = times(op, op)
        left >>= 1
    return crc


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """digest, n and the chunk's ids, each checked against its digest."""
    out = pa.schema([("digest", pa.binary()), ("n", pa.int32()), ("ids", pa.binary()), ("crc", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, payloads = (batch.column(i).to_pylist() for i in range(3))
            ids, crcs = [], []
            for d, n, payload in zip(digests, sizes, payloads, strict=True):
                if digest(payload) != d:
                    raise ValueError(f"chunk {d.hex()} does not match its digest")
                ids.append(_unpack(payload, n).tobytes())
                crcs.append(zlib.crc32(ids[-1]))
            yield as_batch(out, [digests, sizes, ids, crcs])

    return spark.read.schema("digest binary, n int, ids binary").parquet(f"{path}/chunks").mapInArrow(check, "digest binary, n int, ids binary, crc long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, all from the store's files.

    Chunks are read once each and reduced to their checksums, which are joined to the recipes and
    combined in order; the ids themselves are not shuffled.
    """
    recipes = _numbered(spark, path)
    files = _manifest(recipes).withColumnsRenamed({"root": "found"}).join(spark.read.parquet(f"{path}/manifest").select("file_no", "root", F.col("n_docs").alias("docs")), "file_no", "full")
    # one row per file: a table of that size may pass through one task
    offset = F.sum("n_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("file_no", F.coalesce(offset, F.lit(0)).alias("before"), F.when(F.col("found").eqNullSafe(F.col("root")) & F.col("n_docs").eqNullSafe(F.col("docs")), True).otherwise(F.raise_error("a recipe file does not match the manifest")).alias("ok"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file_no").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    starts = recipes.select("file_no", "row", "doc_id", "root", F.coalesce(inside, F.lit(0)).alias("inside"))
    starts = starts.join(files, "file_no").where("ok").select("row", "doc_id", "root", (F.col("before") + F.col("inside")).alias("start"))
    used = recipes.select("row", F.posexplode("chunks").alias("pos", "c")).select("row", "pos", F.col("c.digest").alias("digest"))
    parts = used.join(read_chunks(spark, path).select("digest", "n", "crc"), "digest", "left")
    lists = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "n", "crc"))).alias("parts"))
    joined = starts.join(lists, "row", "left").select("doc_id", "start", "root", F.col("parts.digest").alias("digests"), F.col("parts.n").alias("sizes"), F.col("parts.crc").alias("crcs"))
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, starts_, roots, digests, sizes, crcs = (c.to_pylist() for c in batch.columns)
            tails, flat, totals = [], [], []
            for doc_id, root, d, n, c in zip(doc_ids, roots, digests, sizes, crcs, strict=True):
                d, n, c = d or [], n or [], c or []
                if len(n) != len(d) or None in n or merkle_root(d) != root:
                    raise ValueError(f"document {doc_id} does not match its Merkle root")
                totals.append(sum(n))
                tail = totals[-1] - np.cumsum(np.array(n, np.int64))
                tails.append(tail)
                flat.append(np.array(c, np.int64))
            shifted = _shift(np.concatenate(flat), 4 * np.concatenate(tails)) if flat else []
            ends = np.cumsum([len(f) for f in flat])
            whole = [int(np.bitwise_xor.reduce(shifted[e - len(f) : e], initial=0)) for e, f in zip(ends, flat, strict=True)]
            yield as_batch(out, [doc_ids, starts_, totals, whole])

    return joined.mapInArrow(combine, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and the document's ids as an array; the chunks travel to their documents."""
    recipes = _numbered(spark, path).select("row", "doc_id", F.posexplode_outer("chunks").alias("pos", "c")).select("row", "doc_id", "pos", F.col("c.digest").alias("digest"))
    parts = recipes.join(read_chunks(spark, path).select("digest", "ids"), "digest", "left")
    lists = parts.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts")).select("doc_id", F.col("parts.ids").alias("ids"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x or b"" for x in p), "<u4").astype(np.int64) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return lists.mapInArrow(whole, "doc_id long, ids array<long>")


def token_digests(docs: DataFrame, cfg: StoreConfig, path: str | None = None) -> DataFrame:
    """Write a store (in the session's scratch folder unless ``path`` is given) and return ``read_documents`` of it."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-store")
    write_store(docs, path, cfg)
    return materialize(read_documents(spark, path), "token-digests")
