"""Wrappers that run a small per-value helper over Arrow batches.

The functions are declared nondeterministic although they are not: that keeps the
optimizer from pushing filters on their results below them, which would run them twice.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F


def text_udf(fn: Callable[[str], str]):
    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else fn(v) for v in col], dtype=object)

    return run.asNondeterministic()


def struct_udf(fn: Callable[..., tuple], schema: str):
    """``fn`` gets one value per column and returns one tuple in schema order."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    @F.pandas_udf(schema)
    def run(*cols: pd.Series) -> pd.DataFrame:
        rows = [fn(*vals) for vals in zip(*cols)]
        return pd.DataFrame(rows, columns=names)

    return run.asNondeterministic()
