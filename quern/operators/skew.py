"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut

#: A key is hot with more than 1/HOT of all rows (so fewer than HOT keys are) and more than LEAST rows.
HOT = 1000
LEAST = 100_000


def hot_keys(counts: DataFrame, keys: list[str], count: str = "count") -> tuple[int, int, DataFrame | None]:
    """Rows, different keys, and the hot keys, to be broadcast, if there are any. ``counts`` has one row a key."""
    total, different, most = counts.agg(F.sum(count), F.count("*"), F.max(count)).first()
    bound = max((total or 0) // HOT, LEAST)
    few = F.broadcast(cut(counts.where(F.col(count) > bound).select(*keys), "hot")) if (most or 0) > bound else None
    return total or 0, different, few


def join_on(rows: DataFrame, other: DataFrame, keys: list[str], few: DataFrame | None, how: str = "left") -> DataFrame:
    """``rows`` join ``other`` (one row a key); rows of the keys in ``few`` meet theirs by broadcast, where they are.

    Without hot keys there is nothing to split off; the rows that come out are the same.
    """
    if few is None:
        return rows.join(other, keys, how)
    cold = rows.join(few, keys, "left_anti").join(other, keys, how)
    return cold.unionByName(rows.join(few, keys).join(F.broadcast(other.join(few, keys)), keys, how))
