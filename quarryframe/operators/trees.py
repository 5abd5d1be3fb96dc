"""Differences of two generations of JSON documents: paths of what differs, what may differ, and what has to."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryframe.contracts.parser import canonical_text

DIFFERENCE = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "kind", "old", "new")])


def tree_differences(a, b) -> list[tuple[str, str, str | None, str | None]]:
    """(path, kind, old, new) where two JSON values differ, in the order of their paths.

    Objects are compared key by key, and a key on one side only is ``missing_old`` or ``missing_new``. Lists of unequal length are one
    difference, ``length``; others are compared place by place. All else that is not equal is a ``value``, a change of type among it. Nothing is said of what lies
    below a difference.
    """
    out, todo = [], [("", a, b)]
    while todo:
        path, x, y = todo.pop()
        if isinstance(x, dict) and isinstance(y, dict):
            for key in sorted(x.keys() | y.keys(), reverse=True):
                todo.append((f"{path}.{key}", x.get(key, _NONE), y.get(key, _NONE)))
        elif isinstance(x, list) and isinstance(y, list) and len(x) == len(y):
            todo += [(f"{path}[{i}]", x[i], y[i]) for i in reversed(range(len(x)))]
        elif isinstance(x, list) and isinstance(y, list):
            out.append((path, "length", str(len(x)), str(len(y))))
        elif x is _NONE or y is _NONE:
            out.append((path, "missing_old", None, canonical_text(y)) if x is _NONE else (path, "missing_new", canonical_text(x), None))
        elif x != y:
            out.append((path, "value", canonical_text(x), canonical_text(y)))
    return out


_NONE = object()


def text_differences(old: str | None, new: str | None) -> list[dict]:
    """``tree_differences`` of two JSON texts; a text that is no JSON differs as a whole, and a null text is a missing document."""

    def value(text):
        try:
            return _NONE if text is None else json.loads(text)
        except (ValueError, RecursionError):
            return {"not json": text}

    if old is None and new is None:
        return []
    try:
        found = tree_differences(value(old), value(new))
    except RecursionError:  # too deep to print
        found = [("", "value", None, None)]
    return [dict(zip(DIFFERENCE.names, d, strict=True)) for d in found]


@F.pandas_udf(T.ArrayType(DIFFERENCE))
def differences(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series(list(map(text_differences, old, new)))


def compare_documents(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """(key, old, new, differences) of every key of both generations; keys have to be unique."""
    a, b = old.select(key, F.col(text).alias("old")), new.select(key, F.col(text).alias("new"))
    both = a.join(b, key, "full_outer")
    return both.withColumn("differences", differences("old", "new"))


def under(path: Column, prefix: str) -> Column:
    """Whether a path is the prefix or lies below it."""
    return (path == prefix) | path.startswith(f"{prefix}.") | path.startswith(f"{prefix}[")


def generation_checks(compared: DataFrame, kept: dict[str, list[str]], drift: list[str], changed: list[tuple[str, str, str]]) -> DataFrame:
    """``compared`` with a boolean for each check, null where a document is missing on one side, and ``unexpected``, the paths that no rule allows.

    ``kept`` names, for each check, prefixes below which nothing may differ; ``drift`` are the prefixes where something may. ``changed`` are (check, old column, new
    column) of hashes that have to differ. A difference that lies neither below a kept prefix nor below a drifting one is unexpected.
    """
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    any_of = lambda path, prefixes: reduce(or_, (under(path, p) for p in prefixes), F.lit(False))
    touched = lambda prefixes: F.exists("differences", lambda d: any_of(d["path"], prefixes))
    checks = {name: F.when(both, ~touched(prefixes)) for name, prefixes in kept.items()}
    checks |= {name: F.when(both, ~F.col(a).eqNullSafe(F.col(b))) for name, a, b in changed}
    allowed = [*drift, *(p for prefixes in kept.values() for p in prefixes)]
    unexpected = F.transform(F.filter("differences", lambda d: ~any_of(d["path"], allowed)), lambda d: d["path"])
    return compared.withColumns(checks).withColumn("unexpected", F.when(both, unexpected))
