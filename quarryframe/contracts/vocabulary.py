"""Vocabularies as dimension tables, and the words that open terms mean."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryframe.contracts import assets
from quarryframe.functions.columns import normal_term, singular_term

Terms = dict[str, str]


def plain_term(text: str) -> str:
    """Lower case, with runs of white space as one underscore."""
    return "_".join(text.lower().split())


def single_term(term: str) -> str:
    """Each word without a plural s."""
    return "_".join(w[:-1] if len(w) > 2 and re.search("[^s]s$", w) else w for w in term.split("_"))


def known_terms(words: dict[str, list[str]]) -> Terms:
    """Normal term -> word; a term that two words claim is refused."""
    out: Terms = {}
    for word, synonyms in words.items():
        for term in map(plain_term, (word, *synonyms)):
            if out.setdefault(term, word) != word:
                raise ValueError(f"{term!r} stands for {out[term]!r} and for {word!r}")
    return out


def word_of(text: str, terms: Terms) -> str | None:
    """The word that an open term means: by the term itself, then by its singular; None if there is none, for nothing is guessed."""
    term = plain_term(text)
    return terms.get(term) or terms.get(single_term(term))


def vocabulary_table(spark: SparkSession, *versions: str) -> DataFrame:
    """(version, field, word, synonyms) of the named contracts, by default of all."""
    rows = [(v, field, word, synonyms) for v in versions or assets.VERSIONS for field, words in assets.vocabularies(v).items() for word, synonyms in words.items()]
    return spark.createDataFrame(rows, "version string, field string, word string, synonyms array<string>")


def term_table(vocabulary: DataFrame) -> DataFrame:
    """(version, field, term, word): one row per known term; a term that two words of one field claim stops the job when it runs."""
    told = vocabulary.select("version", "field", "word", F.explode(F.concat(F.array("word"), "synonyms")).alias("term"))
    told = told.groupBy("version", "field", normal_term(F.col("term")).alias("term")).agg(F.min("word").alias("word"), F.max("word").alias("other"))
    clash = F.concat(F.col("term"), F.lit(" stands for "), F.col("word"), F.lit(" and for "), F.col("other"))
    return told.select("version", "field", "term", F.when(F.col("word") == F.col("other"), F.col("word")).otherwise(F.raise_error(clash)).alias("word"))


def with_words(rows: DataFrame, terms: DataFrame, version: Column, field: Column, text: str) -> DataFrame:
    """``rows`` with ``word`` and ``mapping`` for the open terms in column ``text``.

    ``mapping`` is ``canonical`` for a text that is the word itself, ``normalized`` for one that means it, and ``unmapped`` (then without a word) for all others,
    also for a null text. Terms are a small dimension; Catalyst broadcasts it by its size.
    """
    term = normal_term(F.col(text))
    keyed = rows.withColumns({"__v": version, "__f": field, "__t": term, "__s": singular_term(term)})
    for at, key in (("__w", "__t"), ("__x", "__s")):
        keyed = keyed.join(terms.select(F.col("version").alias("__v"), F.col("field").alias("__f"), F.col("term").alias(key), F.col("word").alias(at)), ["__v", "__f", key], "left")
    word = F.coalesce("__w", "__x")
    mapping = F.when(word.isNull(), "unmapped").when(word == F.col(text), "canonical").otherwise("normalized")
    return keyed.withColumns({"word": word, "mapping": mapping}).drop("__v", "__f", "__t", "__s", "__w", "__x")
