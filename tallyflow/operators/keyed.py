"""First and last rows by key, and the joins behind keyed writes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by_key(df: DataFrame, key: Sequence[str], order: str = "seq") -> DataFrame:
    """The first row of each key. An aggregate, so copies are combined before the shuffle."""
    return df.groupBy(*key).agg(F.min_by(F.struct(*[c for c in df.columns if c not in key]), order).alias("__row")).select(*[F.col(c) if c in key else F.col(f"__row.{c}") for c in df.columns])


def last_by_key(df: DataFrame, key: Sequence[str], order: str = "seq") -> DataFrame:
    """The last row of each key."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), order).alias("__row")).select(*[F.col(c) if c in key else F.col(f"__row.{c}") for c in df.columns])


def absent(candidates: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Candidates whose key is not stored; keys compare null-safe."""
    own = stored.select(*[F.col(k).alias(f"__{k}") for k in key])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    return candidates.join(own, same, "left_anti")


def live_and_backfilled(live: DataFrame, backfill: DataFrame, key: Sequence[str]) -> DataFrame:
    """Live rows, and backfilled ones whose key is not live."""
    return live.unionByName(absent(backfill.dropDuplicates(list(key)), live, key))
