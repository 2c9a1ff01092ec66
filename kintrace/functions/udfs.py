"""The one function that column expressions cannot give: longest-matching-block similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def seqratio(a: Column, b: Column) -> Column:
    """2 * matched / total length over recursive longest matching blocks; the order of the arguments matters.

    Arrow batches; equal arguments and repeated pairs of a batch are computed once.
    Null counts as an empty text.
    """

    @pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(x.fillna(""), y.fillna(""), strict=True):
            if pair not in known:
                known[pair] = 1.0 if pair[0] == pair[1] else SequenceMatcher(None, *pair).ratio()
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return ratio(a, b)
