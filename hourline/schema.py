"""Schemas of inputs and helpers for open ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIXELS = "date date, row_idx int, col_idx int, lat float, lon float, value float, quality short, is_fill boolean"
FOLD_RESULT = "model string, fold int, cutoff date, horizon_days int, n_train long, n_test long, rmse double, mae double, mape_pct double, pearson_r double, n_samples long"


def with_missing_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """df with null columns for the names that it lacks."""
    return df.select("*", *[F.lit(None).cast(k).alias(n) for n, k in kinds.items() if n not in df.columns])


def keep_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that df has."""
    return df.select(*[c for c in wanted if c in df.columns])


def drop_like(df: DataFrame, prefixes: tuple[str, ...] = (), parts: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(tuple(prefixes)) or any(p in c for p in parts)])


def order_columns(df: DataFrame, head: list[str], prefixes: list[str], tail: list[str]) -> DataFrame:
    """head, then sorted columns of each prefix, then tail; others go."""
    fixed = {*head, *tail}
    middle = [c for p in prefixes for c in sorted(df.columns) if c.startswith(p) and c not in fixed]
    return keep_present(df, [*head, *dict.fromkeys(middle), *tail])
