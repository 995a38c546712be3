"""Joining a large table, any key of which may hold a third of its rows, to a table with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

#: A key is hot from this share of the rows on, so there are at most HOT_KEYS of them, which bounds the broadcast.
HOT_KEYS = 256


def lookup(big: DataFrame, small: DataFrame, key: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Left join of ``big`` to ``small`` (unique in ``key``) that no hot key slows down.

    Keys with more than 1/hot_keys of the rows are counted first (with map-side
    combine); there can be no more than ``hot_keys`` of them.  Their rows stay
    where they are and meet the broadcast rows of ``small``; all others are
    joined by shuffle.  Rows with a null key keep nulls and are not shuffled.
    """
    # One pass: the commonest keys, and the sum of all counts beside them.
    seen = Observation()
    counts = big.groupBy(key).count().observe(seen, F.sum("count").alias("total"))
    top = counts.where(F.col(key).isNotNull()).orderBy(F.desc("count")).limit(hot_keys).collect()
    total = seen.get.get("total") or 0
    hot = [r[0] for r in top if r["count"] > total / hot_keys]
    if not hot:
        return big.join(small, key, "left")
    in_hot = F.coalesce(F.col(key).isin(hot), F.lit(True))  # null keys go with the broadcast side
    there = big.where(in_hot).join(F.broadcast(small.where(F.col(key).isin(hot))), key, "left")
    rest = big.where(~in_hot).join(small, key, "left")
    return there.unionByName(rest)
