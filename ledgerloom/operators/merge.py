"""AGG18, DOM10: golden records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def golden_record(df: DataFrame, keys: list[str], by: dict[str, Column], first: list[str] = (), last: list[str] = (), any_of: list[str] = ()) -> DataFrame:
    """One row for each key in one aggregation: of each field in ``by`` the first value that is not
    null in the order given for it; the least of ``first`` and the greatest of ``last`` (``column`` or
    ``column:name``); whether any row has ``any_of``."""
    out = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c, order in by.items()]
    for names, f in ((first, F.min), (last, F.max), (any_of, F.bool_or)):
        for c in names:
            source, _, name = c.partition(":")
            out.append(f(source).alias(name or source))
    return df.groupBy(*keys).agg(*out)
