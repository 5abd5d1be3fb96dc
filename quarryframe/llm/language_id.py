"""Language ID: a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word between two spaces in both directions and gives each byte a probability for
each language. A document's probabilities are the mean over all its positions, so every byte of every letter
word counts. Words do not depend on each other, so a worker computes a repeated word once.
It is trained in numpy by backpropagation through time on a bounded sample of labelled documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryframe.llm._base import need_columns
from quarryframe.llm._words import has_letter, letter_words

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageConfig:
    #: Bound of the training sample: about this many documents of each language, this many words of each.
    sample_docs: int = 600
    sample_words: int = 120
    #: Languages need so many labelled documents, however many the others have.
    min_docs: int = 5
    hidden: int = 16
    #: Longer words are read in parts of so many bytes.
    word_bytes: int = 24
    batch: int = 1024
    steps: int = 400
    rate: float = 0.02
    seed: int = 11
    #: Words that a worker remembers; it bounds memory only.
    cache_words: int = 500_000


def held_out(doc_id: F.Column) -> F.Column:
    """Documents that are never learned from: CRC-32 of the doc_id as text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


@dataclass
class Network:
    languages: list[str]
    #: Per direction: input rows (256, 3h), recurrent matrix (h, 3h), bias (3h); then the output layer.
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    word_bytes: int = 24
    key: int = field(default=0)

    @property
    def hidden(self) -> int:
        return self.recurrent[0].shape[0]

    def _states(self, x: np.ndarray, d: int, keep: list | None = None) -> np.ndarray:
        """Hidden states (n, length, h) of one direction over byte rows x (n, length)."""
        n, length = x.shape
        h = self.hidden
        state = np.zeros((n, h), np.float32)
        states = np.empty((length, n, h), np.float32)
        for t in range(length) if d == 0 else range(length - 1, -1, -1):
            a = self.inputs[d][x[:, t]] + self.bias[d]
            u = state @ self.recurrent[d]
            gates = 1 / (1 + np.exp(-(a[:, : 2 * h] + u[:, : 2 * h])))
            new = np.tanh(a[:, 2 * h :] + gates[:, h:] * u[:, 2 * h :])
            before, state = state, new + gates[:, :h] * (state - new)
            if keep is not None:
                keep.append((t, before, u[:, 2 * h :], gates, new))
            states[t] = state
        return states.transpose(1, 0, 2)

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities (n, length, languages) of every position of byte rows."""
        both = np.concatenate([self._states(x, 0), self._states(x, 1)], 2)
        return _softmax(both @ self.out + self.out_bias)

    def words(self, words: list[bytes]) -> np.ndarray:
        """Sums of the probabilities over each word's bytes, and the number of bytes as the last column."""
        sums = np.zeros((len(words), len(self.languages) + 1), np.float32)
        parts: dict[int, list[tuple[int, bytes]]] = {}
        for i, w in enumerate(words):
            for at in range(0, len(w), self.word_bytes):
                part = w[at : at + self.word_bytes]
                parts.setdefault(len(part), []).append((i, part))
        for size, rows in parts.items():
            for at in range(0, len(rows), 4096):
                some = rows[at : at + 4096]
                x = np.frombuffer(b"".join(b" %b " % p for _, p in some), np.uint8).reshape(len(some), size + 2)
                p = self.positions(x)[:, 1:-1].sum(1)
                where = np.fromiter((i for i, _ in some), np.int64, len(some))
                np.add.at(sums, where, np.concatenate([p, np.full((len(some), 1), size, np.float32)], 1))
        return sums


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(words: list[bytes], labels: np.ndarray, languages: list[str], cfg: LanguageConfig) -> Network:
    """Fit a network to words with their languages (numbers) by Adam and backpropagation through time."""
    rng = np.random.RandomState(cfg.seed)
    h, c = cfg.hidden, len(languages)
    shape = {"i": (256, 3 * h), "r": (h, 3 * h), "b": (3 * h,)}
    params = [rng.normal(0, 0.3 if k == "i" else h**-0.5, s).astype(np.float32) * (k != "b") for _ in range(2) for k, s in shape.items()]
    params += [rng.normal(0, (2 * h) ** -0.5, (2 * h, c)).astype(np.float32), np.zeros(c, np.float32)]
    net = Network(languages, params[0:6:3], params[1:6:3], params[2:6:3], params[6], params[7], cfg.word_bytes)
    parts = [w[: cfg.word_bytes] for w in words]
    sizes = np.array([len(p) for p in parts])
    weight = 1 / np.maximum(1, np.bincount(labels, minlength=c))[labels]
    by_size = {int(s): np.nonzero(sizes == s)[0] for s in np.unique(sizes)}
    mass = np.array([weight[v].sum() * s for s, v in by_size.items()])
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, cfg.steps + 1):
        size = list(by_size)[rng.choice(len(by_size), p=mass / mass.sum())]
        pool = by_size[size]
        pick = rng.choice(pool, cfg.batch, p=weight[pool] / weight[pool].sum())
        x = np.frombuffer(b"".join(b" %b " % parts[i] for i in pick), np.uint8).reshape(len(pick), size + 2)
        grads = _gradients(net, x, labels[pick])
        rate = cfg.rate * min(1.0, 2 * (1 - step / (cfg.steps + 1)))
        for p, g, a, b in zip(params, grads, m1, m2, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    # a worker's memory of words belongs to these weights
    net.key = int.from_bytes(hashlib.blake2b(b"".join(p.tobytes() for p in params), digest_size=8).digest(), "little")
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross entropy over all positions but the two spaces, in the order of the parameters."""
    h, n, length = net.hidden, *x.shape
    keeps: list[list] = [[], []]
    both = np.concatenate([net._states(x, d, keeps[d]) for d in range(2)], 2)
    delta = _softmax(both @ net.out + net.out_bias)
    delta[np.arange(n)[:, None], np.arange(length)[None, :], y[:, None]] -= 1
    delta[:, [0, -1]] = 0
    delta /= n * (length - 2)
    flat = delta.reshape(-1, delta.shape[2])
    d_out, d_bias = both.reshape(-1, 2 * h).T @ flat, flat.sum(0)
    above = delta @ net.out.T
    grads: list[np.ndarray] = []
    for d in range(2):
        gi, gr = np.zeros_like(net.inputs[d]), np.zeros_like(net.recurrent[d])
        carry = np.zeros((n, h), np.float32)
        for t, before, un, gates, new in reversed(keeps[d]):
            carry = carry + above[:, t, d * h : (d + 1) * h]
            z, r = gates[:, :h], gates[:, h:]
            d_new = carry * (1 - z) * (1 - new * new)
            d_pre = np.concatenate([carry * (before - new) * z * (1 - z), d_new * un * r * (1 - r), d_new], 1)
            d_u = np.concatenate([d_pre[:, : 2 * h], d_new * r], 1)
            gr += before.T @ d_u
            hot = np.zeros((n, 256), np.float32)
            hot[np.arange(n), x[:, t]] = 1
            gi += hot.T @ d_pre
            carry = carry * z + d_u @ net.recurrent[d].T
        grads += [gi, gr, gi.sum(0)]
    return [*grads, d_out, d_bias]


def unlearned(cfg: LanguageConfig) -> Network:
    """A network without languages: every document is ``und``."""
    return Network([], [], [], [], np.zeros((0, 0)), np.zeros(0), cfg.word_bytes)


def fit(docs: DataFrame, cfg: LanguageConfig | None = None) -> Network:
    """Train on a sample of ``docs`` (doc_id, text, lang) outside the held-out part.

    Of each language about ``sample_docs`` documents are taken by a hash of the doc_id, and of each up to
    ``sample_words`` words spread over the whole text. Null texts, labels and ids teach nothing, rows that share a doc_id count each,
    and without a document to learn from the network has no language.
    """
    need_columns(docs, "doc_id", "text", "lang")
    cfg = cfg or LanguageConfig()
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.where(F.col("n") >= cfg.min_docs).orderBy("lang").collect()
    if not rows:
        return unlearned(cfg)
    languages = [r.lang for r in rows]
    share = F.create_map(*(F.lit(v) for r in rows for v in (r.lang, min(1.0, cfg.sample_docs / r.n))))
    chosen = known.where(F.col("lang").isin(languages)).where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = []
            for text in batch.column(1).to_pylist():
                words = letter_words(text or "")
                step = max(1, len(words) / cfg.sample_words)
                picked.append(b" ".join(words[int(k * step)] for k in range(min(len(words), cfg.sample_words))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(picked, pa.binary())], names=["lang", "words"])

    table = chosen.select("lang", "text").mapInArrow(sample, "lang string, words binary").toPandas()
    table = table.sort_values(["lang", "words"])
    words, labels = [], []
    for lang, line in zip(table["lang"], table["words"], strict=True):
        some = bytes(line).split()
        words += some
        labels += [languages.index(lang)] * len(some)
    if not words:
        return unlearned(cfg)
    return train(words, np.array(labels), languages, cfg)


#: The remembered words of this worker by network; kept between tasks.
_MEMORY: dict[int, tuple[dict[bytes, int], list[np.ndarray]]] = {}


class Labeller:
    def __init__(self, net: Network, limit: int):
        self.net, self.limit = net, limit
        if net.key not in _MEMORY:
            _MEMORY.clear()
            _MEMORY[net.key] = ({}, [np.zeros((0, len(net.languages) + 1), np.float32)])
        self.index, self.table = _MEMORY[net.key]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """Per text the summed probabilities over its letter words' bytes, and the number of those bytes."""
        if len(self.index) > self.limit:
            self.index.clear()
            self.table[0] = self.table[0][:0]
        split = [letter_words(t or "") for t in texts]
        need: set[bytes] = set()
        for words in split:
            need.update(words)
        new = sorted(w for w in need if w not in self.index)
        start = len(self.index)
        self.table[0] = np.concatenate([self.table[0], self.net.words(new)])
        self.index.update(zip(new, range(start, start + len(new)), strict=True))
        get = self.index.__getitem__
        out = np.zeros((len(texts), len(self.net.languages) + 1))
        for i, words in enumerate(split):
            if words:
                rows = np.fromiter(map(get, words), np.int64, len(words))
                out[i] = self.table[0][rows].sum(0, dtype=np.float64)
        return out


def identify(docs: DataFrame, net: Network, cfg: LanguageConfig | None = None) -> DataFrame:
    """All rows and columns of ``docs`` (with text), then lang_pred, score and shares.

    ``shares`` are the mean probabilities by language over the text's positions, ``lang_pred`` the language with the
    largest (the first by name of equals) and ``score`` its share. A text that is null or has no letter gives
    ``und``, 0 and no shares. Columns with these names are replaced.
    """
    need_columns(docs, "text")
    cfg = cfg or LanguageConfig()
    docs = docs.drop("lang_pred", "score", "shares")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(net, cfg.cache_words) if net.languages else None
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = part.column(at).to_pylist()
                pred, score, shares = [], [], []
                for text, row in zip(texts, label(texts) if net.languages else np.zeros((len(texts), 1)), strict=True):
                    if not row[-1] or not has_letter(text):
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        shares.append([])
                        continue
                    p = row[:-1] / row[-1]
                    best = int(p.argmax())
                    pred.append(net.languages[best])
                    score.append(float(min(1.0, p[best])))
                    shares.append(list(zip(net.languages, p.tolist(), strict=True)))
                columns = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, "lang_pred", "score", "shares"])

    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double, shares map<string,double>")
