"""Ratcliff-Obershelp similarity, which no built-in offers, behind exact native bounds."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2M / (len a + len b); 0 where either is empty.  Not symmetric: a comes first."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def round2(x: pd.Series) -> pd.Series:
    """Two decimals as Python rounds them."""
    return pd.Series([None if v is None or v != v else round(v, 2) for v in x], dtype="float64")


def can_reach(a: Column, b: Column, least: float) -> Column:
    """False only where the lengths alone keep the ratio under least."""
    la, lb = F.length(a), F.length(b)
    return 2 * F.least(la, lb) >= F.lit(least) * (la + lb)
