"""The place of each row among those of its key, where a key may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from voxtide.session import materialise


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``: the row's place, from 0, among the rows of its keys in ``order`` (which should tell them apart).

    Rows are laid out by ranges of keys and order, so a large key lies in many partitions; places inside
    a partition are added to the rows of the key in the partitions before.  The layout is written once.
    """
    laid, _ = materialise(df.repartitionByRange(*keys, *order).withColumn("__p", F.spark_partition_id()), "laid")
    sums = laid.groupBy(*keys, "__p").agg(F.count("*").alias("__n"))
    before = sums.select(*(F.col(k).alias(f"__b_{k}") for k in (*keys, "__p")), F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    cond = F.lit(True)
    for k in (*keys, "__p"):
        cond = cond & laid[k].eqNullSafe(before[f"__b_{k}"])
    inside = F.row_number().over(Window.partitionBy(*keys, "__p").orderBy(*order)) - 1
    return laid.join(before, cond).withColumn(name, F.col("__before") + inside).drop("__p", "__before", *(f"__b_{k}" for k in (*keys, "__p")))
