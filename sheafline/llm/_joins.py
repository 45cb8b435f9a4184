"""Joining many rows with one row of facts a key, where some keys hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with at least this part of all rows are hot; there are no more of them than this.
HOT = 10_000


def told(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """`rows` with the columns of `facts` (one row a key, `weight` of its rows, `total` in all).

    Facts of hot keys are broadcast, HOT rows at most, so that these rows are not shuffled; the others
    meet by shuffle, and no key of theirs has more than total / HOT rows. Rows without facts are dropped.
    """
    limit = max(2, -(-total // HOT))
    hot = facts.where(F.col(weight) >= limit).drop(weight)
    rest = facts.where(F.col(weight) < limit).drop(weight)
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys)
    return near.unionByName(far)
