"""Source divergence audit: how far the sources of a language differ in their use of terms.

One pass over the texts counts terms by (lang, source). The terms that a language keeps have a sparse vector of counts over its
sources; terms with the same vector behave alike in every comparison, so each distinct vector is evaluated once and its value is
multiplied by the number of its terms. Most terms of a large corpus are rare and share a few vectors.

For a pair of sources s and t, with p(c) the share of a term that occurs c times, the sum of ``abs(p_s - p_t)`` is taken from the value
of a term that neither has, times all terms, and corrections for the terms that one or both have. So the work grows with the pairs that
stand in a vector and not with terms times pairs. All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryframe.llm._base import as_batch, byte_values, drop_path, materialize, need_columns, stage


@dataclass(frozen=True)
class AuditConfig:
    #: Documents of a language that must hold a term.
    min_docs: int = 30
    #: Added to each count.
    smoothing: int = 5
    #: Shares are integers of this unit.
    unit: int = 1_000_000_000
    #: Ranks of the term report.
    top_terms: int = 50


#: Terms that a task remembers before it passes on its partial counts; it bounds memory only.
HELD_TERMS = 200_000
#: A-Z in lower case; other ASCII characters end a term; all other characters belong to it.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

COUNT_SCHEMA = "lang string, source string, term binary, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts; the row without a term counts the documents of a group."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
    held = defaultdict(lambda: (Counter(), Counter()))
    rows = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            yield as_batch(schema, [[lang] * len(n), [source] * len(n), list(n), list(n.values()), [docs[t] for t in n]])
        yield as_batch(schema, [[g[0] for g in rows], [g[1] for g in rows], [None] * len(rows), [0] * len(rows), list(rows.values())])
        held.clear()
        rows.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_values(batch.column(2)), strict=True):
            rows[lang, source] += 1
            n, docs = held[lang, source]
            once = Counter(text.translate(_FOLD).split())
            n.update(once)
            docs.update(once.keys())
        if sum(len(n) for n, _ in held.values()) + len(rows) > HELD_TERMS:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group and documents that hold it; a null term counts the group's documents."""
    need_columns(docs, "text", "lang", "source")
    told = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = told.mapInArrow(_count, COUNT_SCHEMA).withColumn("term", F.col("term").cast("string"))
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column, cfg: AuditConfig) -> Column:
    wide = lambda c: c.cast("decimal(20,0)")
    up = F.lit(cfg.unit).cast("decimal(12,0)") * (wide(count) + F.lit(cfg.smoothing))
    return F.call_function("div", up, wide(total) + F.lit(cfg.smoothing) * wide(terms)) + F.lit(1)


def _exact_sum(c: Column) -> Column:
    return F.sum(c.cast("decimal(38,0)")).cast("long")


def kept_terms(counts: DataFrame, cfg: AuditConfig) -> DataFrame:
    """(lang, term, vector) of the terms that enough documents of the language hold; the vector is an array of (source, n) by source."""
    held = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("v"))
    return held.where(F.col("docs") >= cfg.min_docs).select("lang", "term", F.array_sort("v").alias("vector"))


def group_sizes(counts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(lang, source, size, lang_size, terms) of every group: occurrences of kept terms in group and language, and the number of kept terms."""
    sizes = vectors.select("lang", "m", F.inline("vector")).groupBy("lang", "source").agg(F.sum(F.col("m") * F.col("n")).alias("size"))
    langs = sizes.groupBy("lang").agg(F.sum("size").alias("lang_size"))
    terms = vectors.groupBy("lang").agg(F.sum("m").alias("terms"))
    groups = counts.where("term is null").select("lang", "source")
    return groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").join(terms, "lang", "left").na.fill(0, ["size", "lang_size", "terms"])


def pair_divergences(vectors: DataFrame, sizes: DataFrame, cfg: AuditConfig) -> DataFrame:
    """(lang, s, t, value) for all pairs s < t of sources of a language."""
    own = lambda x: sizes.select("lang", "terms", F.col("source").alias(x), F.col("size").alias(f"size_{x}"))
    p = lambda x, n: _share(n, F.col(f"size_{x}"), F.col("terms"), cfg)
    none = F.lit(0).cast("long")
    neither = F.abs(p("s", none) - p("t", none))
    pairs = own("s").join(own("t"), ["lang", "terms"]).where("s < t")
    base = pairs.select("lang", "s", "t", F.when(F.col("terms") > 0, F.col("terms") * neither).otherwise(0).alias("value"))
    # what a term adds beyond that if s has it, whether t does or not
    entries = vectors.select("lang", "m", F.inline("vector")).groupBy("lang", F.col("source").alias("s"), "n").agg(F.sum("m").alias("m"))
    single = entries.join(own("s"), ["lang", "s"]).join(own("t"), ["lang", "terms"]).where("s <> t")
    single = single.select("lang", F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t"), (F.col("m") * (F.abs(p("s", F.col("n")) - p("t", none)) - neither)).alias("value"))
    # and what is then wrong if both have it
    first = vectors.select("lang", "m", "vector", F.posexplode("vector").alias("at", "x"))
    both = first.select("lang", "m", "x", F.explode(F.slice("vector", F.col("at") + 2, F.size("vector"))).alias("y"))
    both = both.select("lang", "m", F.col("x.source").alias("s"), F.col("x.n").alias("n_s"), F.col("y.source").alias("t"), F.col("y.n").alias("n_t"))
    both = both.groupBy("lang", "s", "n_s", "t", "n_t").agg(F.sum("m").alias("m")).join(own("s"), ["lang", "s"]).join(own("t"), ["lang", "terms", "t"])
    ps, pt = p("s", F.col("n_s")), p("t", F.col("n_t"))
    off = F.abs(ps - pt) - F.abs(ps - p("t", none)) - F.abs(p("s", none) - pt) + neither
    both = both.select("lang", "s", "t", (F.col("m") * off).alias("value"))
    return base.unionByName(single).unionByName(both).groupBy("lang", "s", "t").agg(_exact_sum(F.col("value")).alias("value"))


def marked_terms(kept: DataFrame, vectors: DataFrame, sizes: DataFrame, cfg: AuditConfig) -> DataFrame:
    """(lang, source, item, value) of the terms that a source has more often than its language, best first, up to ``top_terms`` of a group.

    Vectors are ranked first, then the terms of those that can be among the best.
    """
    total = F.aggregate("vector", F.lit(0).cast("long"), lambda a, e: a + e["n"])
    seen = vectors.select("lang", "vector", total.alias("total"), F.inline("vector")).join(sizes, ["lang", "source"])
    gain = _share(F.col("n"), F.col("size"), F.col("terms"), cfg) - _share(F.col("total"), F.col("lang_size"), F.col("terms"), cfg)
    seen = seen.select("lang", "source", "vector", gain.alias("value")).where("value > 0")
    best = seen.withColumn("r", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("r") <= cfg.top_terms)
    return best.drop("r").join(kept, ["lang", "vector"]).select("lang", "source", F.col("term").alias("item"), "value")


def audit_sources(docs: DataFrame, cfg: AuditConfig | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank) for each (lang, source) of ``docs`` (text, lang, source).

    Part ``pair``: the other sources of the language and the summed difference of their term shares. Part ``term``: the terms that
    the source uses more than its language, the first ``top_terms``. Null texts, languages and sources are read as empty; a group without terms
    is compared like any other, and where a language keeps no term all its pairs have value 0. A language with one source has no pairs.
    Repeated rows count as often as they stand; ties are ranked by the bytes of the item. An empty table gives no rows. Other columns are not read.
    """
    cfg = cfg or AuditConfig()
    counts, path = stage(term_counts(docs), "term-counts")
    kept, kept_path = stage(kept_terms(counts, cfg), "kept-terms")
    vectors, vector_path = stage(kept.groupBy("lang", "vector").agg(F.count("*").alias("m")), "count-vectors")
    sizes = materialize(group_sizes(counts, vectors), "group-sizes")
    drop_path(docs.sparkSession, path)
    pairs = pair_divergences(vectors, sizes, cfg)
    ways = F.inline(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item"))))
    pairs = pairs.select("lang", "value", ways).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.withColumn("rank", rank)
    terms = marked_terms(kept, vectors, sizes, cfg).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    out = materialize(pairs.unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= cfg.top_terms)), "source-audit")
    for used in (kept_path, vector_path):
        drop_path(docs.sparkSession, used)
    return out
