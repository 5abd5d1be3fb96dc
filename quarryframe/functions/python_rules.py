"""Functions that need Python: exact decimal rounding and canonical JSON; the strict parser is in ``contracts``."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryframe.contracts.parser import canonical_text


def py_round(x: Column, digits: int) -> Column:
    """Round the exact binary value to the nearest decimal, ties to even; -0.0 becomes 0.0 and null stays null."""

    @F.pandas_udf(T.DoubleType())
    def rounded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or v != v else round(v, digits) + 0.0)

    return rounded(x.cast("double"))


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON text with sorted keys and no spaces; null for what is no JSON or nests too deep."""

    def one(text):
        try:
            return None if text is None else canonical_text(json.loads(text))
        except (ValueError, RecursionError):
            return None

    return texts.map(one)
