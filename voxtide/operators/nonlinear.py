"""Nonlinear measures of series of voice periods: entropy of periods, recurrence, fluctuation, correlation dimension.

All but the correlation dimension are aggregates over rows, so a series may be of any length; its pairs
make the correlation dimension undefined beyond ``MOST_PAIRS``, so the series it holds are short.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from voxtide.functions.exprs import ratio
from voxtide.operators.intervals import carry_in
from voxtide.operators.lookup import lookup
from voxtide.operators.order import positions
from voxtide.session import materialise

# Least periods, bins of the histogram, lags and radius of recurrence, sizes of boxes, pairs, radii.
LEAST = 64
BINS = 32
LAGS, RADIUS = 100, 0.1
BOXES = (4, 8, 16, 32, 64)
MOST_PAIRS = 1_000_000
RADII = 8
NAMES = ("voice_pitch_period_entropy", "voice_rpde", "voice_dfa", "voice_correlation_dimension")

#: Places in a bucket of a running sum, and in a block of the recurrence count.
PLACES = 50_000


def period_entropy(s: DataFrame) -> DataFrame:
    """Entropy of the histogram of the logarithms less their line over place, over ln(BINS); 0 where all lie on the line."""
    log = F.log("v")
    line = s.groupBy("key").agg(F.regr_slope(log, "i").alias("b"), F.regr_intercept(log, F.col("i")).alias("a"))
    r = lookup(s, line, "key").select("key", "n", (log - F.col("a") - F.col("b") * F.col("i")).alias("r"))
    span = r.groupBy("key").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    flat = F.col("hi") - F.col("lo") <= np.finfo(float).eps
    cell = F.when(flat, 0).otherwise(F.least(F.floor((F.col("r") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)))
    p = F.col("c") / F.col("n")
    return lookup(r, span, "key").groupBy("key", "n", cell.alias("cell")).agg(F.count("*").alias("c")).groupBy("key").agg((F.sum(-p * F.log(p)) / np.log(BINS)).alias(NAMES[0]))


def recurrence(s: DataFrame) -> DataFrame:
    """Entropy, over that of equal shares, of how often the series is within RADIUS deviations of itself after each lag."""
    block = F.floor(F.col("i") / PLACES)
    # A block also holds the LAGS rows behind it, which its own rows look at.
    held = F.when(F.col("i") % PLACES < LAGS, F.array(block, block - 1)).otherwise(F.array(block))
    rows = s.select("key", "i", "v", "n", (F.lit(RADIUS) * F.col("sd")).alias("near"), F.explode(held).alias("block")).where("block >= 0")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        v, near = pdf["v"].to_numpy(), pdf["near"].iloc[0]
        own = int((pdf["i"] < (pdf["block"].iloc[0] + 1) * PLACES).sum())
        lags = np.arange(1, min(LAGS, int(pdf["n"].iloc[0]) // 2) + 1)
        met = [int((np.abs(v[k : own + k] - v[: len(v[k : own + k])]) <= near).sum()) for k in lags]
        return pd.DataFrame({"key": pdf["key"].iloc[0], "lags": len(lags), "lag": lags, "c": met})

    kind = dict(s.dtypes)["key"]
    c = rows.groupBy("key", "block").applyInPandas(count, f"key {kind}, lags long, lag long, c long").groupBy("key", "lags", "lag").agg(F.sum("c").alias("c")).where("c > 0")
    total = c.groupBy("key").agg(F.sum("c").alias("t"))
    p = F.col("c") / F.col("t")
    return c.join(total, "key").groupBy("key", "lags").agg(F.sum(-p * F.log(p)).alias("h")).select("key", ratio(F.col("h"), F.log("lags")).alias(NAMES[1]))


def fluctuation(s: DataFrame) -> DataFrame:
    """Slope of the logarithm of the fluctuation about the lines of whole boxes on that of the box's size."""
    dev = s.withColumns({"d": F.col("v") - F.col("mean"), "__b": F.floor(F.col("i") / PLACES)}).select("key", "i", "n", "d", "__b")
    run = Window.partitionBy("key", "__b").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    profile = carry_in(dev, ["key"], "__b", {"before": F.sum("d")}).select("key", "i", "n", (F.col("before") + F.sum("d").over(run)).alias("y"))
    profile = profile.withColumn("size", F.explode(F.array(*map(F.lit, BOXES))))
    box = F.floor(F.col("i") / F.col("size"))
    whole = profile.where(F.col("i") < F.floor(F.col("n") / F.col("size")) * F.col("size"))
    x, y = F.col("i") % F.col("size"), F.col("y")
    left = whole.groupBy("key", "size", box.alias("box")).agg((F.regr_syy(y, x) - F.pow(F.regr_sxy(y, x), 2) / F.regr_sxx(y, x)).alias("rss"))
    f = left.groupBy("key", "size").agg(F.sqrt(F.greatest(F.sum("rss"), F.lit(0.0)) / (F.count("*") * F.col("size"))).alias("f")).where("f > 0")
    return f.groupBy("key").agg(F.when(F.count("*") >= 2, F.regr_slope(F.log("f"), F.log("size"))).alias(NAMES[2]))


def correlation_dimension(v: np.ndarray) -> float | None:
    """Slope of the logarithm of the share of pairs of (value, next value) within a radius on that of the radius; null
    where the tenth percentile of distances is 0 or equals the sixtieth."""
    upper = np.triu_indices(len(v) - 1, 1)
    near = np.sqrt(np.subtract.outer(v[:-1], v[:-1]) ** 2 + np.subtract.outer(v[1:], v[1:]) ** 2)[upper]
    lo, hi = np.percentile(near, (10, 60))
    if not 0 < lo < hi:
        return None
    radii = lo * (hi / lo) ** (np.arange(RADII) / (RADII - 1))
    within = np.searchsorted(np.sort(near), radii, side="right") / len(near)
    return float(np.polyfit(np.log(radii), np.log(within), 1)[0]) if within.min() > 0 else None


def nonlinear(frames: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, and one column each of NAMES): measures of each key's series in ``order``.

    All are null for fewer than LEAST values, and for a series with a null, infinite or non-positive value;
    the correlation dimension is null for more than MOST_PAIRS pairs as well.  A null key is a series of its own
    and gets nulls.  Ties in ``order`` are ranked arbitrarily.
    """
    x = frames.select(F.col(key).alias("key"), F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    fine = F.coalesce((F.col("v") > 0) & (F.col("v") < float("inf")), F.lit(False))
    of = x.groupBy("key").agg(F.count("*").alias("n"), F.bool_and(fine).alias("fine"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    good = of.where((F.col("n") >= LEAST) & F.col("fine") & F.col("key").isNotNull()).drop("fine")
    s, _ = materialise(lookup(positions(x, ["key"], ["o"], "i"), good, "key").where("n is not null"), "series")
    kind = dict(x.dtypes)["key"]
    pairs = (F.col("n") - 1) * (F.col("n") - 2) / 2
    short = s.where(pairs <= MOST_PAIRS).select("key", "i", "v").groupBy("key").applyInPandas(lambda pdf: pd.DataFrame({"key": pdf["key"].iloc[:1], NAMES[3]: [correlation_dimension(pdf.sort_values("i")["v"].to_numpy())]}), f"key {kind}, {NAMES[3]} double")
    out = of.select("key")
    for part in (period_entropy(s), recurrence(s), fluctuation(s), short):
        out = out.join(part, "key", "left")
    return out.select(F.col("key").alias(key), *NAMES)
