"""Quality rules: distribution divergence against language references.

A document is described by two histograms: its characters by class, and its words over a list of
common words (everything else in one last bucket). Both are compared, by Jensen-Shannon distance
(base 2, so 0 to 1), with references that are summed over all documents of a language that pass
the base rules. The distance to the nearest reference counts, so a wrong language label does not
condemn a clean text. Short documents are never judged by a histogram that they cannot fill.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryframe.llm._base import ASCII_SPACE, as_batch, byte_values, need_columns

# Frequent function words by language.
COMMON_WORDS = {
    "en": "the of and a to in is that for it as was with be on are at from this by not or have which you",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden",
    "fr": "de la le et les des en un une du que est pour qui dans par plus pas sur au ne se ce il",
    "es": "de la que el en y los se del las un por con no una su para es al lo como más o pero",
}
SYMBOLS = "#*$%&|<>"
CLASSES = ("upper", "lower", "digit", "space", "symbol", "other")

#: Reference languages hold at least this share of all reference words, so there are at most 1000 of them.
MIN_LANGUAGE_SHARE = 0.001


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A character histogram is judged from so many word characters on, a word histogram from so many words on.
    min_histogram_chars: int = 200
    min_histogram_words: int = 100
    max_char_distance: float = 0.30
    max_word_distance: float = 0.50
    #: Of the distance that a text without a common word has from a reference; None leaves the absolute bound alone, which that distance may not reach.
    max_word_share: float | None = 0.80
    #: References with a smaller share of common words belong to languages that the list does not serve; they judge no words.
    min_common_share: float = 0.05


@dataclass(frozen=True)
class References:
    """Normalised histograms by language: ``chars`` (n, 6) and ``words`` (n, len(vocabulary) + 1)."""

    languages: tuple[str, ...]
    chars: np.ndarray
    words: np.ndarray


def vocabulary() -> list[str]:
    return sorted({w for words in COMMON_WORDS.values() for w in words.split()})


_TABLE: np.ndarray | None = None


def _class_table() -> np.ndarray:
    """Class of each code point of the basic plane; all beyond it count as ``other``."""
    global _TABLE
    if _TABLE is None:
        table = np.full(65536, CLASSES.index("other"), np.uint8)
        for cp in range(65536):
            kind = unicodedata.category(chr(cp))
            if kind in ("Lu", "Lt"):
                table[cp] = CLASSES.index("upper")
            elif kind[0] == "L":
                table[cp] = CLASSES.index("lower")
            elif kind == "Nd":
                table[cp] = CLASSES.index("digit")
        table[list(ASCII_SPACE)] = CLASSES.index("space")
        table[[ord(c) for c in SYMBOLS]] = CLASSES.index("symbol")
        _TABLE = table
    return _TABLE


def char_histogram(text: bytes) -> np.ndarray:
    cps = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    classes = _class_table()[np.minimum(cps, 65535)]
    classes[cps > 65535] = CLASSES.index("other")
    return np.bincount(classes, minlength=len(CLASSES))


_A, _B, _C = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    grams = h[:-2] * _A + h[1:-1] * _B + h[2:] * _C
    ranked = np.sort(grams)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0  # equal windows have equal hashes, so there are none
    at = np.nonzero(np.isin(grams, twice))[0].tolist()
    seen = Counter((words[i], words[i + 1], words[i + 2]) for i in at)
    covered = np.zeros(len(words), bool)
    for i in at:
        if seen[words[i], words[i + 1], words[i + 2]] > 1:
            covered[i : i + 3] = True
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(ASCII_SPACE)]
    return len(lines) - len(set(lines))


BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
FEATURES = f"{BASE}, char_histogram array<long>, common_ids array<int>, common_counts array<long>"
RESULT = f"{BASE}, base_failed boolean, char_distance double, word_distance double, kept boolean"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def quality_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of FEATURES behind those of ``docs``; the common words as sparse counts."""
    need_columns(docs, text)
    index = {w.encode(): i for i, w in enumerate(vocabulary())}
    space, symbol = CLASSES.index("space"), CLASSES.index("symbol")
    docs = docs.drop(*_names(FEATURES))
    at = docs.columns.index(text)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in byte_values(batch.column(at)):
                value = value or b""
                words = value.split()
                chars = char_histogram(value)
                common = Counter(filter(index.__contains__, value.lower().split()))
                ids = [index[w] for w in common]
                rows.append((len(words), int(chars.sum() - chars[space]), int(chars[symbol]), duplicate_lines(value), repeat_words(words), chars.tolist(), ids, list(common.values())))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*batch.schema.names, *_names(FEATURES)])

    return docs.mapInArrow(describe, f"{_fields(docs)}, {FEATURES}")


def base_failed(cfg: QualityConfig) -> F.Column:
    return (F.col("n_words") < cfg.min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(cfg.max_repeat_percent) * F.col("n_words"))


def fit_references(features: DataFrame, cfg: QualityConfig | None = None) -> References:
    """Sum both histograms by language over all documents with a language that pass the base rules.

    Partial sums come before the shuffle, and of each language only its buckets are collected: what
    reaches the driver depends on the number of languages (1000 at most) and not on the documents.
    """
    need_columns(features, "lang", *_names(FEATURES))
    good = features.where(F.col("lang").isNotNull() & ~base_failed(cfg or QualityConfig()))
    n_classes, n_vocab = len(CLASSES), len(vocabulary())
    cells = good.select(
        "lang",
        F.explode(
            F.concat(
                F.transform("char_histogram", lambda n, i: F.struct(i.alias("bucket"), n.alias("n"))),
                F.zip_with("common_ids", "common_counts", lambda i, n: F.struct((i + n_classes).alias("bucket"), n.alias("n"))),
                F.array(F.struct(F.lit(n_classes + n_vocab).alias("bucket"), (F.col("n_words") - F.aggregate("common_counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))),
            )
        ).alias("c"),
    )
    counts = cells.groupBy("lang", "c.bucket").agg(F.sum("c.n").alias("n"))
    words = F.when(F.col("bucket") >= n_classes, F.col("n")).otherwise(0)
    per_lang = counts.groupBy("lang").agg(F.sum(words).alias("n_words"), F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("h"))
    total = counts.agg(F.sum(words).alias("total"))
    rows = per_lang.crossJoin(F.broadcast(total)).where(F.col("n_words") >= MIN_LANGUAGE_SHARE * F.col("total")).orderBy("lang").collect()
    width = n_classes + n_vocab + 1
    table = np.array([[r.h.get(i, 0) for i in range(width)] for r in rows], float).reshape(len(rows), width)
    chars, hist = table[:, :n_classes], table[:, n_classes:]
    return References(tuple(r.lang for r in rows), chars / np.maximum(1, chars.sum(1, keepdims=True)), hist / np.maximum(1, hist.sum(1, keepdims=True)))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (n, k) between the rows of p (n, b) and of q (k, b), base 2."""
    p, q = p[:, None, :], q[None, :, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.maximum(0, (left + right) / 2))


def bare_distances(refs: References) -> np.ndarray:
    """Distance of a text without a common word from each reference: the largest that a lack of common words can give."""
    bare = np.zeros((1, refs.words.shape[1]))
    bare[0, -1] = 1
    return js_distance(bare, refs.words)[0]


def judge(features: DataFrame, refs: References, cfg: QualityConfig | None = None) -> DataFrame:
    """The columns of RESULT in the place of those of FEATURES.

    With ``max_word_share`` a text fails by its words if it is further than that share of ``bare_distances`` from each reference
    that has common words. Texts of a language that has no such reference are not judged by it; texts without a language are.
    """
    cfg = cfg or QualityConfig()
    need_columns(features, "lang", *_names(FEATURES))
    listed = np.nonzero(refs.words[:, -1] <= 1 - cfg.min_common_share)[0] if cfg.max_word_share is not None else np.zeros(0, int)
    listed_words = refs.words[listed]
    far = bare_distances(refs)[listed] * (cfg.max_word_share or 0)
    served = {None, *(refs.languages[i] for i in listed)}
    rest = features.drop(*_names(FEATURES), *_names(RESULT))
    features = features.select(*rest.columns, *_names(FEATURES))
    n_rest, n_vocab = len(rest.columns), len(vocabulary())
    lang_at = rest.columns.index("lang")

    def verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            base = [batch.column(n_rest + i) for i in range(5)]
            n_words, word_chars, _, _, n_repeat = (c.to_numpy() for c in base)
            chars = np.array(batch.column(n_rest + 5).to_pylist(), float).reshape(n, len(CLASSES))
            words = np.zeros((n, n_vocab + 1))
            for i, (ids, counts) in enumerate(zip(batch.column(n_rest + 6).to_pylist(), batch.column(n_rest + 7).to_pylist(), strict=True)):
                words[i, ids] = counts
            words[:, -1] = n_words - words.sum(1)
            near = np.full((2, n), np.nan)
            bare = np.zeros(n, bool)
            if len(refs.languages) and n:
                near[0] = js_distance(chars / np.maximum(1, chars.sum(1, keepdims=True)), refs.chars).min(1)
                shares = words / np.maximum(1, words.sum(1, keepdims=True))
                near[1] = js_distance(shares, refs.words).min(1)
                if len(listed):
                    bare = (js_distance(shares, listed_words) > far).all(1) & (n_words >= cfg.min_histogram_words)
                    bare &= np.fromiter((x in served for x in batch.column(lang_at).to_pylist()), bool, n)
                near[0][word_chars < cfg.min_histogram_chars] = np.nan
                near[1][n_words < cfg.min_histogram_words] = np.nan
            failed = (n_words < cfg.min_words) | (100 * n_repeat > cfg.max_repeat_percent * n_words)
            kept = ~failed & ~(near[0] > cfg.max_char_distance) & ~(near[1] > cfg.max_word_distance) & ~bare
            columns = [pa.array(failed), *(pa.array(x, pa.float64(), from_pandas=True) for x in near), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_rest], *base, *columns], names=[*batch.schema.names[:n_rest], *_names(RESULT)])

    return features.mapInArrow(verdict, f"{_fields(rest)}, {RESULT}" if rest.columns else RESULT)


def quality_rules(docs: DataFrame, cfg: QualityConfig | None = None, refs: References | None = None) -> DataFrame:
    """All rows and columns of ``docs`` (with ``text`` and ``lang``) and the rule columns of RESULT behind them.

    A null or empty text has no words and fails the base rules. Distances are null where a histogram
    is too short to judge or where there is no reference; such a document is kept unless the base
    rules fail. Repeated rows are judged each. Columns of ``docs`` with the name of a rule column are
    replaced by it. An empty table gives an empty table. Without ``refs`` they are fitted on ``docs``
    itself, which reads the texts one time more.
    """
    need_columns(docs, "text", "lang")
    refs = refs or fit_references(quality_features(docs.select("lang", "text")), cfg)
    return judge(quality_features(docs), refs, cfg)


assert sys.byteorder == "little", "utf-32-le buffers are read in place"
