"""SentencePiece encoding and decoding, with a parallel scan for giant documents.

A piece sequence is the BPE encoding of a text if and only if each two neighbours are the encoding of
their own concatenation. So encoding is a path problem: an arc joins compatible neighbours with weight 0, any other
pair has weight minus infinity, and the best path is the encoding. A giant document is cut into chunks. The state at
a cut is the piece that reaches or crosses it; a chunk yields the max-plus transfer matrix from the states at its
start to those at its end. As all weights are 0 or minus infinity, a row of it is a bit set. Matrices
combine associatively; the product gives each chunk's entry and exit state, and each chunk then
traces its own pieces back, independently of the others. No piece crosses a place in front of a space, so
such a place has one state only: a chunk's matrix is the product of those of its head (up to the first such place) and of its tail (from the last one),
and the words between them are encoded by the library.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryframe.llm._base import as_batch, materialize, need_columns

SPACE = "▁"  # how the model writes a space
#: The state at a cut that every neighbour is compatible with.
CLEAN = ("", 0)


@dataclass(frozen=True)
class PieceConfig:
    model_path: str
    #: Documents with more characters than this are cut into chunks of this size.
    chunk_chars: int = 65_536
    #: Words whose ids a worker remembers; it bounds memory only.
    cache_words: int = 400_000


class Model:
    """A BPE model of the sentencepiece library with byte fallback, and its compatibility relation."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        self.ids = {names[i]: i for i in plain}
        self.scores = {names[i]: self.library.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(p.strip(SPACE).count(SPACE) or p.rstrip(SPACE) != p and p.strip(SPACE) for p in self.ids):
            raise ValueError("pieces that go on into a space are not supported")
        if "".join(self.library.encode("a  b", out_type=str)) != f"{SPACE}a{SPACE}{SPACE}b" or self.library.encode("ａ") == self.library.encode("a"):
            raise ValueError("only models without text normalisation and with a space in front are supported")
        self.surface = [b""] * n
        for i in plain:
            self.surface[i] = names[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.surface[i] = bytes([b])
        self.compatible = lru_cache(1 << 18)(self._compatible)

    def merge(self, text: str) -> list[str]:
        """BPE of a short string: the best-scored neighbouring pair merges first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = max(((self.scores.get(parts[i] + parts[i + 1], -np.inf), -i) for i in range(len(parts) - 1)), default=(-np.inf, 0))
            if best[0] == -np.inf:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _compatible(self, left: str, right: str) -> bool:
        return self.merge(left + right) == [left, right]

    def ids_of(self, parts: list[str]) -> list[int]:
        """Ids of pieces; a character that is no piece gives its bytes."""
        out: list[int] = []
        for p in parts:
            if p in self.ids:
                out.append(self.ids[p])
            else:
                out.extend(self.byte_ids[b] for b in p.encode())
        return out

    def starting(self, text: str, at: int) -> Iterator[str]:
        """The pieces that ``text`` has at a place; a lone character always counts."""
        yield text[at]
        for size in range(2, min(self.longest, len(text) - at) + 1):
            if (p := text[at : at + size]) in self.ids:
                yield p


def spaced(text: str) -> str:
    """The text as the model sees it, with the space in front; an empty one stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def clean_cut(text: str, cut: int) -> bool:
    """Whether no piece can cross a place of a spaced text: it is the start, or a space follows another character."""
    return cut == 0 or text[cut] == SPACE and text[cut - 1] != SPACE


def chunk_cuts(text: str, size: int) -> list[int]:
    """Places where a text is cut: after each ``size`` characters, wherever that is."""
    return list(range(0, len(text), size)) or [0]


def clean_span(text: str, begin: int, end: int, first: bool, last: bool) -> tuple[int, int] | None:
    """The first and the last clean cut of a chunk, its ends included; None without one."""
    low = begin if first or clean_cut(text, begin) else next((i for i in range(begin + 1, end) if clean_cut(text, i)), None)
    high = end if last or clean_cut(text, end) else next((i for i in range(end - 1, begin, -1) if clean_cut(text, i)), None)
    if low is None:
        low = high
    if high is None:
        high = low
    return None if low is None else (low, high)


def chunk_matrix(model: Model, text: str, begin: int, end: int, first: bool, last: bool) -> tuple[list[tuple[str, int]], list[tuple[str, int]], list[int]]:
    """Entry states, exit states and the bit set of entries that reach each exit of a chunk."""
    entries = [CLEAN] if first else states_at(model, text, begin)
    span = clean_span(text, begin, end, first, last)
    if span is None:
        return entries, *transfer(model, text, begin, end, entries, last)[:2]
    head = _either(transfer(model, text, begin, span[0], entries, last and span[0] == end)[1]) if span[0] > begin else _either([1 << k for k in range(len(entries))])
    exits = transfer(model, text, span[1], end, [CLEAN], last)[0] if span[1] < end else [CLEAN]
    return entries, exits, [head] * len(exits)


def chunk_ids(model: Model, text: str, begin: int, end: int, first: bool, last: bool, entry: int, exit_state: tuple[str, int], words) -> list[int]:
    """The ids of the pieces that start in a chunk, traced back from its exit state; ``words`` encodes a part between clean cuts."""
    entries = [CLEAN] if first else states_at(model, text, begin)
    span = clean_span(text, begin, end, first, last)
    if span is None:
        return model.ids_of(trace(model, transfer(model, text, begin, end, entries, last)[2], begin, end, entry, exit_state))
    out: list[int] = []
    if span[0] > begin:
        exits, bits, reach = transfer(model, text, begin, span[0], entries, last and span[0] == end)
        reached = next(s for s, b in zip(exits, bits, strict=True) if b >> entry & 1)
        out += model.ids_of(trace(model, reach, begin, span[0], entry, reached))
    if span[1] > span[0]:
        out += words(text[span[0] : span[1]])
    if span[1] < end:
        out += model.ids_of(trace(model, transfer(model, text, span[1], end, [CLEAN], last)[2], span[1], end, 0, exit_state))
    return out


def states_at(model: Model, text: str, cut: int) -> list[tuple[str, int]]:
    """All pieces that reach or cross a cut, with their characters beyond it; CLEAN at the start and before a space."""
    if clean_cut(text, cut):
        return [CLEAN]
    out = []
    for start in range(max(0, cut - model.longest), cut):
        for p in model.starting(text, start):
            if start + len(p) >= cut and model.merge(p) == [p]:
                out.append((p, start + len(p) - cut))
    return out


def transfer(model: Model, text: str, begin: int, end: int, entries: list[tuple[str, int]], last: bool) -> tuple[list[tuple[str, int]], list[int], list[dict]]:
    """Exit states of a chunk, the bit set of entries that reach each, and the arcs for the trace.

    ``text`` reaches beyond ``end`` by the longest piece, unless the document ends there (``last``). The arcs hold, by
    place, each piece that ends there with its entries and the pieces before it.
    """
    reach: list[dict[str, list]] = [{} for _ in range(end - begin + model.longest + 1)]
    for k, (piece, over) in enumerate(entries):
        reach[over].setdefault(piece, [0, set()])[0] |= 1 << k
    for at in range(begin, end):
        here = reach[at - begin]
        if not here:
            continue
        for piece in model.starting(text, at):
            stop = at + len(piece)
            if last and stop > end:
                continue
            for before, (bits, _) in here.items():
                if before == "" or model.compatible(before, piece):
                    cell = reach[stop - begin].setdefault(piece, [0, set()])
                    cell[0] |= bits
                    cell[1].add(before)
    clean = last or clean_cut(text, end)
    exits, bits = [], []
    for over in range(0, model.longest + 1):
        for piece, (b, _) in reach[end - begin + over].items():
            if clean and over:
                continue
            exits.append((piece, over))
            bits.append(b)
    return exits, bits, reach


def trace(model: Model, reach: list[dict], begin: int, end: int, entry: int, exit_state: tuple[str, int]) -> list[str]:
    """The chunk's own pieces, from those that start in it: back from its exit state to one entry."""
    piece, over = exit_state
    at, parts = end - begin + over, []
    while True:
        bits, before = reach[at][piece]
        if at - len(piece) < 0 or not before:
            return parts[::-1]
        parts.append(piece)
        at -= len(piece)
        piece = next(b for b in sorted(before) if reach[at].get(b, [0])[0] >> entry & 1)


def combine(left: list[int], right: list[int]) -> list[int]:
    """Max-plus product of two bit-set matrices by column: which entries of ``left`` reach each exit of ``right``."""
    out = []
    for column in right:
        bits, k = 0, 0
        while column:
            if column & 1:
                bits |= left[k]
            column >>= 1
            k += 1
        out.append(bits)
    return out


def encode_scan(model: Model, text: str, chunk_chars: int) -> list[int]:
    """Ids of one text by the scan, chunk after chunk on one machine; the reference of the distributed form."""
    text = spaced(text)
    ends = [*chunk_cuts(text, chunk_chars)[1:], len(text)] if text else []
    chunks = [(a, b, a == 0, b == len(text)) for a, b in zip([0, *ends], ends, strict=False)]
    states = select_states([(*chunk_matrix(model, text, *c), c[3]) for c in chunks])
    words = lambda part: model.library.encode(part[1:].replace(SPACE, " ")) if len(part) > 1 else [model.ids[SPACE]]
    return [i for c, s in zip(chunks, states, strict=True) for i in chunk_ids(model, text, *c, *s, words)]


def select_states(chunks: list[tuple[list, list, list[int], bool]]) -> list[tuple[int, tuple[str, int]]]:
    """(entry number, exit state) of each chunk on the one path from the text's start to its end.

    ``chunks`` has (entries, exits, bits, last) in order. Exits are first brought into the order of the next
    chunk's entries, then prefix products run forward and the path is picked backward.
    """
    if not chunks:
        return []
    columns = []
    for k, (_, exits, bits, last) in enumerate(chunks):
        if last:
            columns.append(([CLEAN], [_either(bits)], exits, bits))
        elif chunks[k + 1][0] == [CLEAN]:
            columns.append(([CLEAN], [_either(bits)], exits, bits))
        else:
            found = dict(zip(exits, bits, strict=True))
            columns.append((chunks[k + 1][0], [found.get(s, 0) for s in chunks[k + 1][0]], exits, bits))
    prefix, so_far = [], [1]
    for _, bits, _, _ in columns:
        so_far = combine(so_far, bits) if prefix else list(bits)
        prefix.append(so_far)
    path: list[tuple[int, tuple[str, int]]] = []
    want = 0
    for k in range(len(chunks) - 1, -1, -1):
        states, bits, exits, raw = columns[k]
        state = states[want]
        before = prefix[k - 1] if k else [1]
        live = next(e for e in range(len(before)) if before[e] & 1 and bits[want] >> e & 1)
        if state == CLEAN:
            state = next(s for s, b in zip(exits, raw, strict=True) if b >> live & 1)
        path.append((live, state))
        want = live
    return path[::-1]


def _either(bits: list[int]) -> int:
    out = 0
    for b in bits:
        out |= b
    return out


class WordEncoder:
    """Ids of texts word by word through the library; no piece crosses a space, so the ids are those of the whole."""

    def __init__(self, model: Model, limit: int):
        self.model, self.limit = model, limit
        self.known: dict[str, bytes] = {}
        self.runs = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")

    def _words(self, text: str) -> list[str]:
        """Parts between clean cuts, each without the space in front."""
        text = text.replace(SPACE, " ")
        if text[:1] == " " or "  " in text:
            return [p[1:].replace(SPACE, " ") for p in self.runs.split(spaced(text))]
        return text.split(" ") if text else []

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; an empty text has none."""
        if len(self.known) > self.limit:
            self.known.clear()
        split = [self._words(t) for t in texts]
        need: set[str] = set()
        for words in split:
            need.update(words)
        new = [w for w in need if w not in self.known]
        for w, ids in zip(new, self.model.library.encode(new, num_threads=1), strict=True):
            self.known[w] = np.array(ids if w else [self.model.ids[SPACE]], "<u4").tobytes()
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


def decode(model: Model, ids: np.ndarray) -> str:
    """The text of ids, without the space that encoding puts in front; bytes that are no UTF-8 become U+FFFD."""
    text = b"".join(map(model.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


_OUT = "n_ids long, ids_crc32 long, round_trip boolean"


def _finish(model: Model, text: str, packed: bytes, keep: bool) -> tuple:
    ids = np.frombuffer(packed, "<u4")
    same = decode(model, ids) == text.replace(SPACE, " ")
    return (len(ids), zlib.crc32(packed), same, *([ids.astype(np.int32)] if keep else []))


def encode_documents(docs: DataFrame, cfg: PieceConfig, keep_ids: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` (with text), then n_ids, ids_crc32, round_trip and, if asked for, ids.

    ``ids_crc32`` is the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers; ``round_trip`` tells
    whether decoding gives the text back (the model writes U+2581 as a space). A null or empty text has no ids.
    Columns with the name of a result are replaced. Giant documents are cut, encoded by the scan over
    several tasks and put together again.
    """
    need_columns(docs, "text")
    names = ["n_ids", "ids_crc32", "round_trip", *(["ids"] if keep_ids else [])]
    docs = docs.drop(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    sql = f"{fields}, {_OUT}" + (", ids array<int>" if keep_ids else "")
    at = docs.columns.index("text")
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())][: len(names)]
    giant = F.coalesce(F.length("text") > cfg.chunk_chars, F.lit(False))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(cfg.model_path)
        encoder = WordEncoder(model, cfg.cache_words)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [t or "" for t in part.column(at).to_pylist()]
                rows = [_finish(model, t, p, keep_ids) for t, p in zip(texts, encoder(texts), strict=True)]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *names])

    return docs.where(~giant).mapInArrow(small, sql).unionAll(_encode_giants(docs.where(giant), cfg, sql, at, names, kinds, keep_ids))


_CHUNK = pa.schema([("no", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("last", pa.bool_()), ("part", pa.string())])


def cut_giants(giants: DataFrame, cfg: PieceConfig) -> DataFrame:
    """(row, no, begin, end, last, part): the chunks of ``giants`` (row, text) with as much text around them as pieces can reach."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = Model(cfg.model_path).longest
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = spaced(text)
                cuts = [*chunk_cuts(text, cfg.chunk_chars), len(text)]
                rows = []
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    low, high = max(0, a - around), min(len(text), b + around)
                    rows.append((k, a - low, b - low, b == len(text), text[low:high]))
                columns = as_batch(_CHUNK, [list(c) for c in zip(*rows, strict=True)]).columns
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(rows), pa.int64()), *columns], names=["row", *_CHUNK.names])

    return giants.mapInArrow(cut, "row long, no long, begin int, end int, last boolean, part string")


def chunk_matrices(chunks: DataFrame, cfg: PieceConfig) -> DataFrame:
    """(row, no, n_entries, matrix) of each chunk of ``cut_giants``."""

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(cfg.model_path)
        out = pa.schema([("row", pa.int64()), ("no", pa.int64()), ("n_entries", pa.int32()), ("matrix", pa.string())])
        for batch in batches:
            rows = []
            for row, no, begin, end, last, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entries, exits, bits = chunk_matrix(model, part, begin, end, no == 0, last)
                rows.append((row, no, len(entries), repr((entries, exits, bits, last))))
            yield as_batch(out, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 4)

    return chunks.select("row", "no", "begin", "end", "last", "part").mapInArrow(matrix, "row long, no long, n_entries int, matrix string")


def _encode_giants(docs: DataFrame, cfg: PieceConfig, sql: str, at: int, names: list[str], kinds: list, keep_ids: bool) -> DataFrame:
    giants = materialize(docs, "giant-documents").withColumn("__row", F.monotonically_increasing_id())
    chunks = materialize(cut_giants(giants.select("__row", "text"), cfg).repartition("row", "no"), "chunks")

    def choose(key, table):
        from ast import literal_eval

        table = table.sort_by("no")
        states = select_states([literal_eval(m) for m in table["matrix"].to_pylist()])
        return pa.table({"row": table["row"], "no": table["no"], "state": pa.array([repr(s) for s in states], pa.string())})

    states = chunk_matrices(chunks, cfg).drop("n_entries").groupBy("row").applyInArrow(choose, "row long, no long, state string")
    placed = chunks.join(states, ["row", "no"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ast import literal_eval

        model = Model(cfg.model_path)
        encoder = WordEncoder(model, cfg.cache_words)
        words = lambda part: np.frombuffer(encoder([part[1:].replace(SPACE, " ")])[0], "<u4").tolist() if len(part) > 1 else [model.ids[SPACE]]
        for batch in batches:
            rows, nos, ids = [], [], []
            for row, no, begin, end, last, part, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entry, exit_state = literal_eval(state)
                ids.append(np.array(chunk_ids(model, part, begin, end, no == 0, last, entry, exit_state, words), "<u4").tobytes())
                rows.append(row)
                nos.append(no)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(nos, pa.int64()), pa.array(ids, pa.binary())], names=["row", "no", "ids"])

    traced = placed.select("row", "no", "begin", "end", "last", "part", "state").mapInArrow(back, "row long, no long, ids binary")
    whole = traced.groupBy(F.col("row").alias("__at")).agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("p")).select("__at", F.col("p.ids").alias("__parts"))
    joined = giants.join(whole, F.col("__row") == F.col("__at")).drop("__row", "__at")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(cfg.model_path)
        for batch in batches:
            n = batch.num_columns - 1
            rows = [_finish(model, t, b"".join(p), keep_ids) for t, p in zip(batch.column(at).to_pylist(), batch.column(n).to_pylist(), strict=True)]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], names=[*batch.schema.names[:n], *names])

    return joined.mapInArrow(join, sql)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with ``text``, decoded from its column ``ids``; null ids give a null text."""
    need_columns(encoded, "ids")
    encoded = encoded.drop("text")
    at = encoded.columns.index("ids")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(model_path)
        for batch in batches:
            texts = [None if x is None else decode(model, np.array(x, np.int64)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(run, f"{fields}, text string")
