"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ by ``floor(rate * m)`` edits. It is cut into one piece more than that,
so any match leaves a piece untouched: one Aho-Corasick pass over a document finds all exact
piece hits, and each place that they point to is verified with Myers' bit-parallel distance. The benchmark is
taken in blocks of bounded size; each block is one pass over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryframe.llm._base import materialize, need_columns


@dataclass(frozen=True)
class LeakConfig:
    #: Edits allowed per character of an item.
    rate: float = 0.08
    #: Items with fewer characters are too short to show a leak and are left out.
    min_item_chars: int = 40
    #: Characters of the items that one pass holds in memory.
    block_chars: int = 1_000_000


def normal_text(text: str | None) -> str:
    """Lower case, with one space for each run of white space."""
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` consecutive pieces with their offsets, as even as possible."""
    n, m = budget + 1, len(item)
    return [(m * j // n, item[m * j // n : m * (j + 1) // n]) for j in range(n)]


def myers(pattern_bits: dict[str, int], m: int, text: str) -> int:
    """Least edit distance between a pattern of m characters and any substring of ``text``."""
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = pattern_bits.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            best = min(best, score)
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
    return best


class Matcher:
    """All items of a block against one text at a time."""

    def __init__(self, items: list[tuple[int, str]], cfg: LeakConfig):
        import ahocorasick

        self.items = [(i, t, int(cfg.rate * len(t))) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for at, (_, text, budget) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                places.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.bits: dict[int, dict[str, int]] = {}

    def _bits(self, at: int) -> dict[str, int]:
        if at not in self.bits:
            out: dict[str, int] = {}
            for i, c in enumerate(self.items[at][1]):
                out[c] = out.get(c, 0) | 1 << i
            self.bits[at] = out
        return self.bits[at]

    def __call__(self, text: str) -> list[tuple[int, int]]:
        """(item_id, least distance) of the items within their budget, in order of item_id."""
        if not self.items or not text:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for at, offset in where:
                _, item, budget = self.items[at]
                first = max(0, end + 1 - size - offset - budget)
                stop = end + 1 - size - offset + len(item) + budget
                spans = windows.setdefault(at, [])
                if spans and spans[-1][0] <= first <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(stop, spans[-1][1]))
                else:
                    spans.append((first, stop))
        found: dict[int, int] = {}
        for at, spans in windows.items():
            key, item, budget = self.items[at]
            for first, stop in spans:
                part = text[first:stop]
                distance = 0 if item in part else myers(self._bits(at), len(item), part)
                if distance <= budget:
                    found[key] = min(distance, found.get(key, distance))
        return sorted(found.items())


_LEAKS = "array<struct<item_id: bigint, distance: int>>"
_LEAKS_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))


def _tag(docs: DataFrame, items: list[tuple[int, str]], cfg: LeakConfig) -> DataFrame:
    at = docs.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(items, cfg)
        for batch in batches:
            leaks = [[{"item_id": i, "distance": d} for i, d in match(normal_text(t))] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaks, _LEAKS_ARROW)], names=[*batch.schema.names, "leaks"])

    return docs.mapInArrow(tag, f"{fields}, leaks {_LEAKS}")


def _blocks(benchmark: DataFrame, cfg: LeakConfig) -> Iterator[list[tuple[int, str]]]:
    need_columns(benchmark, "item_id", "text")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / cfg.block_chars))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        texts = sorted({(r.item_id, normal_text(r.text)) for r in rows})
        yield [(i, t) for i, t in texts if len(t) >= cfg.min_item_chars]


def tag_leaks(docs: DataFrame, benchmark: DataFrame, cfg: LeakConfig | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with ``leaks``: the items found and their least distances, by item_id.

    A null or empty text has no leaks. Items with a null id or text are left out; two texts with one
    item_id count as one item with the lesser distance. A column named ``leaks`` is replaced. With a benchmark of
    several blocks the hits of each block are written and joined by doc_id, so rows that share a
    doc_id then share their leaks.
    """
    need_columns(docs, "text")
    cfg = cfg or LeakConfig()
    docs = docs.drop("leaks")
    blocks = _blocks(benchmark, cfg)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return _tag(docs, first, cfg)
    need_columns(docs, "doc_id")
    hits = None
    for items in (first, second, *blocks):
        found = _tag(docs.select("doc_id", "text"), items, cfg).where(F.size("leaks") > 0).select("doc_id", F.explode("leaks").alias("leak"))
        found = materialize(found, "leaks")
        hits = found if hits is None else hits.unionAll(found)
    hits = hits.groupBy("doc_id", "leak.item_id").agg(F.min("leak.distance").alias("distance"))
    hits = hits.groupBy(F.col("doc_id").alias("__doc")).agg(F.array_sort(F.collect_list(F.struct("item_id", "distance"))).alias("leaks"))
    joined = docs.join(hits, docs["doc_id"] == F.col("__doc"), "left").drop("__doc")
    return joined.withColumn("leaks", F.coalesce("leaks", F.expr(f"cast(array() as {_LEAKS})")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, cfg: LeakConfig | None = None) -> DataFrame:
    """The rows of ``docs`` without a leak."""
    return tag_leaks(docs, benchmark, cfg).where(F.size("leaks") == 0).drop("leaks")
