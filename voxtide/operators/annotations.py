"""Annotation layers on tokens: joining them, and the gate that makes an incomplete layer unavailable as a whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def attach(tok: DataFrame, ann: DataFrame, layers: Sequence[str], numbers: Sequence[str] = ()) -> DataFrame:
    """The tokens with one column per layer; the first layer of a name (lowest layer_pos) holds.

    ``ann``: recording_id, layer_pos, layer, token_id, s_val, d_val.  All layers meet the tokens in one join.
    """
    first = ann.groupBy("recording_id", "layer").agg(F.min("layer_pos").alias("layer_pos"))
    one = ann.join(first, ["recording_id", "layer", "layer_pos"])
    cols = [F.max(F.when(F.col("layer") == x, F.col("d_val" if x in numbers else "s_val"))).alias(x) for x in layers]
    wide = one.where(F.col("layer").isin(list(layers))).groupBy("recording_id", "token_id").agg(*cols)
    return tok.join(wide, ["recording_id", "token_id"], "left")


def words(tok: DataFrame) -> DataFrame:
    """The first token of each word of an utterance: word representatives."""
    w = Window.partitionBy("recording_id", "speaker_id", "utt_idx", "__w").orderBy("tok_idx")
    group = F.when(F.col("word_id").isNotNull(), F.concat(F.lit("g"), "word_id")).otherwise(F.concat(F.lit("t"), F.col("token_id").cast("string")))
    return tok.where("kind = 'word'").withColumn("__w", group).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__w")


def complete(c: Column) -> Column:
    """Aggregate: has every row a valid value?"""
    return F.bool_and(F.coalesce(c, F.lit(False)))


def gated(ok: Column, value: Column) -> Column:
    """The value where the gate holds, else null."""
    return F.when(ok, value)


def binary(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & c.isin(0, 1)


def consistent(df: DataFrame, group: Sequence[str], label: str) -> DataFrame:
    """One row per group with its label, and ``one``: whether all rows of the group agree on it."""
    return df.groupBy(*group).agg(F.min(label).alias(label), (F.min(label).eqNullSafe(F.max(label)) & (F.count(label) == F.count("*"))).alias("one"))
