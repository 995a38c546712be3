"""Measures over frames: spectral shape of power arrays, pitch and amplitude perturbation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtide.functions.exprs import iqr, quantile, ratio, sd

EPS = 1e-12


def _sum(a: Column, f=lambda x: x) -> Column:
    return F.aggregate(F.transform(a, f), F.lit(0.0), lambda s, x: s + x)


def spectral_shape(frames: DataFrame, power: str, bin_hz: float) -> DataFrame:
    """Per frame: centroid, spread, skewness, kurtosis, slope, 85 % roll-off, flatness, entropy and energy of its power array.

    Frames without power, or with a null array, have null measures.
    """
    p = F.col(power)
    n = F.size(p).cast("double")
    at = F.transform(p, lambda x, i: F.struct(x.alias("p"), (i * bin_hz).alias("f")))
    total = _sum(p)
    f = frames.withColumns({"__at": at, "__total": total}).withColumn("centroid", F.when(F.col("__total") > EPS, F.aggregate("__at", F.lit(0.0), lambda s, x: s + x["p"] * x["f"]) / F.col("__total")))
    moment = lambda k: F.aggregate("__at", F.lit(0.0), lambda s, x: s + x["p"] * F.pow(x["f"] - F.col("centroid"), F.lit(float(k)))) / F.col("__total")
    f = f.withColumn("__var", moment(2)).withColumn("spread", F.sqrt("__var"))
    real = F.col("__var") > EPS
    share = lambda x: x / F.col("__total")
    cum = F.aggregate("__at", F.struct(F.lit(0.0).alias("c"), F.lit(-1.0).alias("f")), lambda s, x: F.struct((s["c"] + x["p"]).alias("c"), F.when((s["f"] < 0) & (s["c"] + x["p"] >= 0.85 * F.col("__total")), x["f"]).otherwise(s["f"]).alias("f")))
    db = lambda x: 10 * F.log10(F.greatest(x, F.lit(EPS)))
    mean_f = (n - 1) / 2 * bin_hz
    cov = F.aggregate("__at", F.lit(0.0), lambda s, x: s + (x["f"] - mean_f) * db(x["p"]))
    varf = F.aggregate("__at", F.lit(0.0), lambda s, x: s + F.pow(x["f"] - mean_f, F.lit(2.0)))
    ok = F.col("__total") > EPS
    return f.withColumns({
        "skewness": F.when(ok & real, moment(3) / F.pow("__var", F.lit(1.5))), "kurtosis": F.when(ok & real, moment(4) / F.pow("__var", F.lit(2.0))),
        "slope": F.when(ok & (n > 1), cov / varf), "rolloff_85": F.when(ok, cum["f"]),
        "flatness": F.when(ok, F.exp(F.aggregate(p, F.lit(0.0), lambda s, x: s + F.log(F.greatest(x, F.lit(EPS)))) / n) / (F.col("__total") / n)),
        "entropy": F.when(ok & (n > 1), F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, share(x) * F.log(share(x))).otherwise(0.0)) / F.log(n)),
        "energy_db": F.when(ok, 10 * F.log10("__total")),
    }).drop("__at", "__total", "__var")


def flux(frames: DataFrame, keys: list[str], order: str, power: str) -> DataFrame:
    """Distance of successive power arrays of unit length within a key."""
    norm = F.sqrt(_sum(F.col(power), lambda x: x * x))
    f = frames.withColumn("__u", F.when(norm > EPS, F.transform(power, lambda x: x / norm)))
    prev = F.lag("__u").over(Window.partitionBy(*keys).orderBy(order))
    f = f.withColumn("__p", prev)
    return f.withColumn("flux", F.when(F.col("__p").isNotNull() & F.col("__u").isNotNull(), F.sqrt(_sum(F.zip_with("__u", "__p", lambda a, b: (a - b) * (a - b)))))).drop("__u", "__p")


def summary(frames: DataFrame, keys: list[str], columns: list[str], prefix: str = "spectral_") -> DataFrame:
    """Mean and population deviation of frame measures."""
    return frames.groupBy(*keys).agg(*(e for c in columns for e in (F.avg(c).alias(f"{prefix}{c}_mean"), sd(c).alias(f"{prefix}{c}_sd"))))


def voiced(frames: DataFrame, region: list[str], energy: str, floor: float = 1e-6) -> DataFrame:
    """``voiced``: energy above the floor and at least the mean of the region's energies above the floor."""
    above = F.when(F.col(energy) > floor, F.col(energy))
    mean = frames.groupBy(*region).agg(F.avg(above).alias("__mean"))
    return frames.join(mean, region).withColumn("voiced", F.coalesce((F.col(energy) > floor) & (F.col(energy) >= F.col("__mean")), F.lit(False))).drop("__mean")


def perturbation(frames: DataFrame, keys: list[str], region: str, order: str, value: str, spans: dict[str, int]) -> DataFrame:
    """Local, and n-point perturbation quotients: residuals within a region, pooled over the key, over its mean."""
    w = Window.partitionBy(*keys, region).orderBy(order)
    cols = {"__l": F.abs(F.col(value) - F.lag(value).over(w))}
    for name, n in spans.items():
        k = n // 2
        c = w.rowsBetween(-k, k)
        cols[f"__{name}"] = F.when(F.count(value).over(c) == n, F.abs(F.col(value) - F.avg(value).over(c)))
    t = frames.where(F.col(value).isNotNull()).withColumns(cols)
    return t.groupBy(*keys).agg(ratio(F.avg("__l"), F.avg(value)).alias("local"), *(ratio(F.avg(f"__{name}"), F.avg(value)).alias(name) for name in spans))


def semitones(frames: DataFrame, keys: list[str], f0: str) -> DataFrame:
    """Range and median absolute deviation of pitch in semitones about the median."""
    t = frames.where(F.col(f0) > 0)
    m = t.groupBy(*keys).agg(quantile(f0, 0.5).alias("__m"))
    s = t.join(m, keys).withColumn("__s", 12 * F.log2(F.col(f0) / F.col("__m")))
    return s.groupBy(*keys).agg((F.max("__s") - F.min("__s")).alias("voice_f0_range_semitones"), quantile(F.abs("__s"), 0.5).alias("voice_f0_mad_semitones"))


def pitch_summary(frames: DataFrame, keys: list[str], f0: str, time: str) -> DataFrame:
    """Mean, median, spread, range and slope of pitch."""
    t = frames.where(F.col(f0) > 0)
    return t.groupBy(*keys).agg(
        F.avg(f0).alias("voice_f0_mean_hz"), quantile(f0, 0.5).alias("voice_f0_median_hz"), sd(f0).alias("voice_f0_sd_hz"), iqr(f0).alias("voice_f0_iqr_hz"),
        (quantile(f0, 0.95) - quantile(f0, 0.05)).alias("voice_f0_range_5_95_hz"), F.regr_slope(f0, time).alias("voice_f0_slope_hz_per_s"), F.when(F.avg(f0) != 0, F.stddev_pop(f0) / F.avg(f0)).alias("voice_f0_cv"),
    )
