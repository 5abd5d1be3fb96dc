"""Toxicity: cumulative-link ordinal regression on sparse text features.

A text's features are its letter words and their beginnings, each valued by its share of the words. One weight vector
gives a score s; grade k or more has the probability sigmoid(s - threshold_k), with ordered thresholds and the same
weights for all of them. The expected severity is the sum of those probabilities.

Labels say toxic or not. The grades come from them in two steps: a first fit with two grades ranks the
toxic documents by score, and their quantiles are the grades from 1 up; documents that are not toxic have grade 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryframe.llm._base import need_columns
from quarryframe.llm._words import letter_words


@dataclass(frozen=True)
class ToxicityConfig:
    #: Bound of the training sample: about this many labelled documents of each of the two classes.
    sample_docs: int = 2500
    grades: int = 3
    prefixes: tuple[int, ...] = (3, 4, 5, 6)
    #: Features need so many documents of the sample, and the most telling are kept.
    min_docs: int = 4
    max_features: int = 3000
    l2: float = 2e-4
    l1: float = 5e-5
    steps: int = 300
    cache_words: int = 400_000


@dataclass
class OrdinalModel:
    weights: dict[str, float]
    thresholds: list[float]
    prefixes: tuple[int, ...]

    def score(self, counts: dict[str, int], n_words: int) -> float:
        return sum(self.weights[f] * value(c, n_words) for f, c in counts.items())

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """Probability of each grade or more, (n, grades)."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - np.asarray(score)[:, None], -60, 600)))


def value(count: int | np.ndarray, n_words: int | np.ndarray) -> float | np.ndarray:
    """A feature's value: its occurrences per hundred words, damped."""
    return np.log1p(100.0 * count / n_words)


def word_features(word: bytes, prefixes: tuple[int, ...]) -> list[str]:
    text = word.decode("utf-8", "replace")
    return [f"={text}", *(f"{text[:k]}*" for k in prefixes if len(text) > k)]


def text_features(text: str | None, prefixes: tuple[int, ...]) -> tuple[Counter, int]:
    words = letter_words(text or "")
    out: Counter = Counter()
    for word, n in Counter(words).items():
        for f in word_features(word, prefixes):
            out[f] += n
    return out, len(words)


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, weight: np.ndarray, n_features: int, n_grades: int, cfg: ToxicityConfig) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of a cumulative-link model, by proximal gradient steps with momentum.

    The matrix is given by its non-zero cells. The likelihood of grade y is P(>= y) - P(>= y + 1).
    Thresholds are a first value and positive gaps, which keeps their order.
    """
    n = len(grades)
    weight = weight / weight.sum()
    w, first, gaps = np.zeros(n_features), 1.0, np.zeros(n_grades - 1)
    m = [np.zeros(n_features), 0.0, np.zeros(n_grades - 1)]
    v = [np.zeros(n_features), 0.0, np.zeros(n_grades - 1)]
    for step in range(1, cfg.steps + 1):
        s = np.bincount(rows, values * w[columns], n)
        theta = np.concatenate([[first], first + np.cumsum(np.exp(gaps))])
        p = 1 / (1 + np.exp(np.clip(theta[None, :] - s[:, None], -60, 60)))
        p = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)
        like = np.maximum(1e-9, p[np.arange(n), grades] - p[np.arange(n), grades + 1])
        slope = p * (1 - p)
        high, low = slope[np.arange(n), grades], slope[np.arange(n), grades + 1]
        d_s = -weight * (high - low) / like
        d_theta = np.zeros(n_grades + 2)
        np.add.at(d_theta, grades, weight * high / like)
        np.add.at(d_theta, grades + 1, -weight * low / like)
        d_theta = d_theta[1:-1]
        tails = np.cumsum(d_theta[::-1])[::-1]
        grads = [np.bincount(columns, values * d_s[rows], n_features) + cfg.l2 * w, tails[0], tails[1:] * np.exp(gaps)]
        rate = 0.15 * (1 - 0.9 * step / cfg.steps)
        moved = []
        for i, (x, g) in enumerate(zip((w, first, gaps), grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            moved.append(x - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6))
        w, first, gaps = moved
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * cfg.l1)
    return w, np.concatenate([[first], first + np.cumsum(np.exp(gaps))])


def fit(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig | None = None) -> OrdinalModel:
    """Train on a bounded sample of the documents with a label (doc_id, toxic).

    About ``sample_docs`` documents of each class are taken by a hash of the doc_id and weighted back to their
    class's share. Their features are counted on the executors. Null labels and labels without
    a document are left out, and rows that share a doc_id count each. Without a toxic label every document has severity 0.
    """
    need_columns(docs, "doc_id", "text")
    need_columns(labels, "doc_id", "toxic")
    cfg = cfg or ToxicityConfig()
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").alias("__id"), (F.col("toxic") > 0).alias("__toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("__toxic").count().collect()}
    if not sizes.get(True):
        return OrdinalModel({}, [100.0 + k for k in range(cfg.grades)], cfg.prefixes)  # nothing to learn from: severity 0
    share = F.when(F.col("__toxic"), min(1.0, cfg.sample_docs / sizes[True])).otherwise(min(1.0, cfg.sample_docs / max(1, sizes.get(False, 0))))
    chosen = known.where(F.pmod(F.xxhash64(F.col("__id").cast("string")), F.lit(1_000_003)) < share * 1_000_003)
    # about 2 * sample_docs rows of 9 bytes
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    schema = pa.schema([("toxic", pa.bool_()), ("n_words", pa.int64()), ("features", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts, n = text_features(text, cfg.prefixes)
                rows.append((toxic, n, list(counts), list(counts.values())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema, strict=True)], schema=schema)

    cells = sample.select("__toxic", "text").mapInArrow(describe, "toxic boolean, n_words long, features array<string>, counts array<int>").where("n_words > 0")
    # the telling features are found on the executors, so that a sample of long texts stays small on the driver
    by_class = cells.groupBy("toxic").count().collect()
    n_class = {r[0]: max(1, r[1]) for r in by_class}
    n_class.setdefault(False, 1)
    docs_with = cells.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum(F.col("toxic").cast("long")).alias("bad"), F.sum((~F.col("toxic")).cast("long")).alias("good"))
    rate_bad, rate_good = (F.col("bad") + 0.5) / (n_class[True] + 1), (F.col("good") + 0.5) / (n_class[False] + 1)
    gain = F.abs(F.log(rate_bad / rate_good)) * F.sqrt(F.least("bad", F.lit(200)) + F.least("good", F.lit(200)))
    chosen_features = docs_with.where(F.col("bad") + F.col("good") >= cfg.min_docs).orderBy(gain.desc(), "f").limit(cfg.max_features)
    names = sorted(r.f for r in chosen_features.collect())
    index = {f: i for i, f in enumerate(names)}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = [], []
            for n, fs, cs in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                got = [(index[f], float(value(c, n))) for f, c in zip(fs, cs, strict=True) if f in index]
                ids.append([i for i, _ in got])
                values.append([x for _, x in got])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["toxic", "ids", "values"])

    table = cells.mapInArrow(keep, "toxic boolean, ids array<int>, values array<double>").toPandas()
    return _fit_table(table, names, sizes, cfg)


def _fit_table(table, names: list[str], sizes: dict, cfg: ToxicityConfig) -> OrdinalModel:
    toxic = table["toxic"].to_numpy(bool)
    lengths = table["ids"].map(len).to_numpy()
    rows = np.repeat(np.arange(len(table)), lengths)
    columns = np.concatenate([np.asarray(x, np.int64) for x in table["ids"]]) if len(rows) else np.zeros(0, np.int64)
    values = np.concatenate([np.asarray(x, float) for x in table["values"]]) if len(rows) else np.zeros(0)
    weight = np.where(toxic, sizes[True] / max(1, toxic.sum()), sizes.get(False, 0) / max(1, (~toxic).sum()))
    w, _ = fit_ordinal(rows, columns, values, toxic.astype(int), weight, len(names), 1, cfg)
    score = np.bincount(rows, values * w[columns], len(table))
    grades = np.zeros(len(table), int)
    cuts = np.quantile(score[toxic], np.arange(1, cfg.grades) / cfg.grades) if toxic.any() else []
    grades[toxic] = 1 + np.searchsorted(cuts, score[toxic], side="right")
    w, thresholds = fit_ordinal(rows, columns, values, grades, weight, len(names), cfg.grades, cfg)
    return OrdinalModel({f: float(x) for f, x in zip(names, w, strict=True) if x}, thresholds.tolist(), cfg.prefixes)


def predict_severity(docs: DataFrame, model: OrdinalModel, cfg: ToxicityConfig | None = None) -> DataFrame:
    """All rows and columns of ``docs`` (with text), then severity (expected grade), grade and toxic.

    ``grade`` is the largest that is reached with a probability of one half, and ``toxic`` is grade 1 or more.
    A null text or one without letters has severity 0, grade 0 and is not toxic.
    Columns with these names are replaced.
    """
    need_columns(docs, "text")
    cfg = cfg or ToxicityConfig()
    docs = docs.drop("severity", "grade", "toxic")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[str, ...]] = {}
        for batch in batches:
            scores, empty = [], []
            for text in batch.column(at).to_pylist():
                words = letter_words(text or "")
                if len(known) > cfg.cache_words:
                    known.clear()
                for w in set(words).difference(known):
                    known[w] = tuple(f for f in word_features(w, model.prefixes) if f in model.weights)
                counts: Counter = Counter()
                for fs in filter(None, map(known.__getitem__, words)):
                    counts.update(fs)
                scores.append(model.score(counts, len(words)) if words else 0.0)
                empty.append(not words)
            p = model.probabilities(np.array(scores))
            p[empty] = 0
            grade = (p >= 0.5).sum(1)
            columns = [pa.array(p.sum(1)), pa.array(grade, pa.int32()), pa.array(grade >= 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "severity", "grade", "toxic"])

    return docs.mapInArrow(run, f"{fields}, severity double, grade int, toxic boolean")
