"""Times of words from the frames of an aligner, and speakers from embeddings of segments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def aligned_words(frames: DataFrame, targets: DataFrame, keys: Sequence[str], blank: int, frame_ms: float) -> DataFrame:
    """(keys, word, start_ms, end_ms): words timed by the frames of their tokens; null for all of a key where any step fails.

    ``frames``: keys, frame, label, a path of an aligner; ``targets``: keys, pos, label, word (null for a delimiter).  Frames of one
    label in a row, and without a blank between, are one token; the k-th must carry the k-th target's label, and there must be as many.
    Words must follow each other without overlap and have some length.  Times are rounded half to even.
    """
    ks = list(keys)
    w = Window.partitionBy(*ks).orderBy("frame")
    new = F.when(F.lag("label").over(w) == F.col("label"), 0).otherwise(1)
    f = frames.select(*ks, "frame", "label").withColumn("__n", new).withColumn("__run", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("label") != blank)
    runs = f.groupBy(*ks, "__run").agg(F.min("frame").alias("lo"), (F.max("frame") + 1).alias("hi"), F.first("label").alias("said"))
    runs = runs.withColumn("__k", F.row_number().over(Window.partitionBy(*ks).orderBy("__run"))).drop("__run")
    t = targets.select(*ks, "pos", "label", "word").withColumn("__k", F.row_number().over(Window.partitionBy(*ks).orderBy("pos")))
    j = t.join(runs, [*ks, "__k"], "full")
    fits = j.groupBy(*ks).agg(F.bool_and(F.coalesce(F.col("label") == F.col("said"), F.lit(False))).alias("fits"))
    ms = lambda frame: F.bround(frame * F.lit(float(frame_ms)), 0).cast("long")
    words = j.where("word is not null").groupBy(*ks, "word").agg(F.min("__k").alias("__k"), ms(F.min("lo")).alias("s"), ms(F.max("hi")).alias("e"))
    o = Window.partitionBy(*ks).orderBy("__k")
    words = words.withColumn("rising", (F.col("s") >= F.coalesce(F.lag("e").over(o), F.lit(0))) & (F.col("e") > F.col("s")))
    good = words.groupBy(*ks).agg(F.bool_and(F.coalesce("rising", F.lit(False))).alias("rising")).join(fits, ks)
    out = words.drop("rising").join(good, ks)
    ok = F.col("fits") & F.col("rising")
    return out.select(*ks, "word", F.when(ok, F.col("s")).alias("start_ms"), F.when(ok, F.col("e")).alias("end_ms"))


def time_segments(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Segments without words of their own, tightened to the first and last of their aligned words if all with a letter or digit are timed.

    ``segments``: segment_id, start_ms, end_ms; ``words``: segment_id, word, text, start_ms, end_ms relative to the segment.
    A segment without bounds or without words stays as it is.
    """
    lexical = F.col("text").rlike(r"[\p{L}\p{N}]")
    spans = words.groupBy("segment_id").agg(F.min("start_ms").alias("lo"), F.max("end_ms").alias("hi"), F.bool_and(~lexical | F.col("start_ms").isNotNull()).alias("all"))
    ok = F.coalesce(F.col("all") & F.col("lo").isNotNull() & F.col("end_ms").isNotNull(), F.lit(False))
    j = segments.join(spans, "segment_id", "left")
    return j.withColumns({"end_ms": F.when(ok, F.col("start_ms") + F.col("hi")).otherwise(F.col("end_ms")), "start_ms": F.when(ok, F.col("start_ms") + F.col("lo")).otherwise(F.col("start_ms"))}).drop("lo", "hi", "all")


#: Average linkage needs all pairs of a recording's segments: more than this many of them get no cluster.
MOST_SEGMENTS = 4_000


def average_linkage(x: np.ndarray, k: int) -> np.ndarray:
    """Cluster numbers from 0, in order of first members: the two nearest clusters, by the mean of the distances of their members, join until ``k`` are left.

    Sums of distances between clusters add up when clusters join; among equal means the pair of first rows is joined.
    """
    n = len(x)
    sq = (x * x).sum(1)
    total = np.sqrt(np.maximum(sq[:, None] + sq[None] - 2 * x @ x.T, 0))
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    mean = total.copy()
    np.fill_diagonal(mean, np.inf)
    for _ in range(n - k):
        i, j = sorted(divmod(int(mean.argmin()), n))
        total[i] += total[j]
        total[:, i] = total[i]
        size[i] += size[j]
        label[label == j] = i
        alive[j] = False
        mean[j] = mean[:, j] = np.inf
        row = np.where(alive, total[i] / (size * size[i]), np.inf)
        row[i] = np.inf
        mean[i] = mean[:, i] = row
    return np.unique(label, return_inverse=True)[1]


def clusters(segments: DataFrame, key: str, segment: str, vector: str, k: int = 2, most: int = MOST_SEGMENTS) -> DataFrame:
    """(key, segment, cluster): each key's segments in at most ``k`` clusters by average linkage of their unit vectors.

    Clusters are numbered from 0 in order of their first segment.  A null vector, and every vector of a key with more than
    ``most``, has none (null); a zero vector stays as it is.  Repeated segments count once.
    """
    kinds = dict(segments.dtypes)
    s = segments.where(F.col(segment).isNotNull()).groupBy(key, segment).agg(F.first(vector, ignorenulls=True).alias("v"))
    n = s.groupBy(key).agg(F.count("v").alias("__n"))
    s = s.join(n.withColumnRenamed(key, "__k"), F.col(key).eqNullSafe(F.col("__k"))).drop("__k")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(segment)
        x = np.stack([np.asarray(v, float) for v in pdf["v"]])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        return pd.DataFrame({key: pdf[key].to_numpy(), segment: pdf[segment].to_numpy(), "cluster": average_linkage(x, min(k, len(x)))})

    schema = f"{key} {kinds[key]}, {segment} {kinds[segment]}, cluster long"
    some = F.col("v").isNotNull() & (F.col("__n") <= most)
    found = s.where(some).select(key, segment, "v").groupBy(key).applyInPandas(run, schema)
    return found.unionByName(s.where(~some).select(key, segment, F.lit(None).cast("long").alias("cluster")))
