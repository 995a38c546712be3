"""Acoustic features of recordings from frame rows: everything after the frame kernel is SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from voxtide.functions.exprs import count_if, cv, iqr, kurt, quantile, ratio, sd, skew
from voxtide.operators import frames as fr
from voxtide.operators.nonlinear import nonlinear
from voxtide.session import materialise

HOP_S = 0.01
PAUSE_S, LONG_PAUSE_S = 0.20, 2.0
KEY = ["path"]
REGION = ["path", "region"]


def marked(frames: DataFrame) -> DataFrame:
    """Frames with ``voiced`` (energy, by region), ``pitched`` (voiced with pitch), harmonicity and level."""
    v = fr.voiced(frames.where("error_code is null"), REGION, "energy")
    pitched = F.col("voiced") & F.col("f0_hz").isNotNull()
    r = F.least("nccf", F.lit(0.999))
    return v.withColumns({"pitched": pitched, "hnr_db": F.when(pitched & (r > 0), 10 * F.log10(r / (1 - r))), "level_db": F.when(F.col("rms") > 0, 20 * F.log10("rms"))})


def runs(frames: DataFrame, flag: str) -> DataFrame:
    """Runs of equal ``flag`` in each region: where they begin, their frames, and whether they touch the region's ends."""
    w = Window.partitionBy(*REGION).orderBy("frame_idx")
    t = frames.withColumn("__new", F.when(F.lag(flag).over(w) == F.col(flag), 0).otherwise(1))
    t = t.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = t.groupBy(*REGION, "run").agg(F.first(flag).alias("on"), F.min("t_s").alias("start_s"), F.count("*").alias("n"))
    last = F.max("run").over(Window.partitionBy(*REGION))
    return r.withColumn("inner", (F.col("run") > 1) & (F.col("run") < last)).withColumn("d", F.col("n") * HOP_S)


def timing(frames: DataFrame, gaps: DataFrame, duration: DataFrame) -> DataFrame:
    """Voiced segments, pauses inside and between regions, and the rhythm of timing events.

    ``gaps``: (path, start_s, d) silent time between the regions; ``duration``: (path, duration_s).
    """
    r = runs(frames, "voiced")
    least = -(-PAUSE_S // HOP_S)
    seg = r.where("on").groupBy(*KEY).agg(F.avg("d").alias("time_voiced_segment_mean_s"), sd("d").alias("time_voiced_segment_sd_s"))
    inside = r.where(~F.col("on") & (F.col("n") >= least)).select("path", "d", F.lit(False).alias("between"))
    p = inside.unionByName(gaps.where(F.col("d") >= PAUSE_S).select("path", "d", F.lit(True).alias("between")))
    pause = p.groupBy(*KEY).agg(
        F.count("*").alias("time_pause_count"), F.avg("d").alias("time_pause_mean_s"), sd("d").alias("time_pause_sd_s"), F.max("d").alias("time_pause_max_s"), count_if(F.col("d") >= LONG_PAUSE_S).alias("time_long_pause_count"), F.sum("d").alias("time_pause_total_s"),
        quantile("d", 0.5).alias("time_pause_median_s"), iqr("d").alias("time_pause_iqr_s"), cv("d").alias("time_pause_cv"), ratio(F.sum(F.when(F.col("between"), F.col("d")).otherwise(0.0)), F.sum("d")).alias("time_between_utterance_pause_proportion"),
    )
    ev = r.select("path", "start_s", F.when(F.col("on"), "voiced").when(F.col("d") >= PAUSE_S, "pause").otherwise("unvoiced").alias("cls")).unionByName(gaps.where("d > 0").select("path", "start_s", F.when(F.col("d") >= PAUSE_S, "pause").otherwise("unvoiced").alias("cls")))
    e = ev.join(duration, "path")
    n = e.groupBy("path", "duration_s").agg(F.count("*").alias("n"), count_if(F.col("start_s") < F.col("duration_s") / 2).alias("a"))
    pr = F.col("c") / F.col("n")
    h = e.groupBy("path", "cls").agg(F.count("*").alias("c")).join(n.select("path", "n"), "path").groupBy("path").agg((F.sum(-pr * F.log(pr)) / F.log(F.lit(3.0))).alias("time_timing_event_entropy"))
    half = F.col("duration_s") / 120
    rhythm = n.join(h, "path").select("path", ratio("n", F.col("duration_s") / 60).alias("time_timing_event_rate_per_min"), "time_timing_event_entropy", (((F.col("n") - F.col("a")) / half - F.col("a") / half) / (F.col("duration_s") / 60)).alias("time_timing_acceleration_per_min2"))
    out = duration.join(seg, "path", "left").join(pause, "path", "left").join(rhythm, "path", "left")
    out = out.fillna(0, ["time_pause_count", "time_long_pause_count", "time_pause_total_s"])
    return out.withColumns({"time_pause_rate_per_min": ratio("time_pause_count", F.col("duration_s") / 60), "time_pause_proportion": ratio("time_pause_total_s", "duration_s")}).drop("duration_s")


def phonation(frames: DataFrame, duration: DataFrame) -> DataFrame:
    """Pitch, intensity, harmonicity, cepstral prominence, perturbation and voice breaks."""
    p = frames.where("pitched")
    w = Window.partitionBy(*REGION).orderBy("frame_idx")
    step = p.withColumn("df", F.abs(F.col("f0_hz") - F.lag("f0_hz").over(w)))
    f0 = fr.pitch_summary(p, KEY, "f0_hz", "t_s").join(step.groupBy(*KEY).agg(F.avg("df").alias("voice_f0_abs_change_hz")), KEY).join(fr.semitones(p, KEY, "f0_hz"), KEY)
    some = p.select(*REGION).distinct()
    loud = frames.where("voiced").join(some, REGION, "left_semi").groupBy(*KEY).agg(
        F.avg("level_db").alias("voice_intensity_mean_dbfs"), quantile("level_db", 0.5).alias("voice_intensity_median_dbfs"), sd("level_db").alias("voice_intensity_sd_db"), iqr("level_db").alias("voice_intensity_iqr_db"),
        F.regr_slope("level_db", "t_s").alias("voice_intensity_slope_db_per_s"), (F.max("level_db") - F.min("level_db")).alias("voice_intensity_range_db"), cv("rms").alias("voice_intensity_cv"),
    )
    ratio_all = frames.groupBy(*KEY).agg(ratio(count_if(F.col("pitched")), F.count("*")).alias("voice_voiced_ratio"), (F.count("*") * HOP_S).alias("analysed_s"))
    tone = p.groupBy(*KEY).agg(*(e for c, n in (("hnr_db", "voice_hnr"), ("cpp_db", "voice_cpp")) for e in (F.avg(c).alias(f"{n}_mean_db"), quantile(c, 0.5).alias(f"{n}_median_db"), sd(c).alias(f"{n}_sd_db"), iqr(c).alias(f"{n}_iqr_db")))).withColumn("voice_nhr_mean_db", -F.col("voice_hnr_mean_db"))
    period = fr.perturbation(p.withColumn("x", 1 / F.col("f0_hz")), KEY, "region", "frame_idx", "x", {"rap": 3, "ppq5": 5}).select("path", F.col("local").alias("voice_jitter_local"), F.col("rap").alias("voice_jitter_rap"), F.col("ppq5").alias("voice_jitter_ppq5"), (3 * F.col("rap")).alias("voice_jitter_ddp"))
    amp = fr.perturbation(p, KEY, "region", "frame_idx", "rms", {"apq3": 3, "apq5": 5, "apq11": 11}).select("path", F.col("local").alias("voice_shimmer_local"), *(F.col(c).alias(f"voice_shimmer_{c}") for c in ("apq3", "apq5", "apq11")), (3 * F.col("apq3")).alias("voice_shimmer_dda"))
    breaks = runs(frames, "pitched").where(~F.col("on") & F.col("inner") & (F.col("d") >= PAUSE_S)).groupBy(*KEY).agg(F.count("*").alias("voice_break_count"), F.sum("d").alias("break_s"))
    order = p.withColumn("t", F.col("region") * 1e6 + F.col("frame_idx")).withColumn("period", 1 / F.col("f0_hz"))
    out = duration.join(ratio_all, "path", "left")
    for part in (f0, loud, tone, period, amp, breaks, nonlinear(order, "path", "t", "period")):
        out = out.join(materialise(part, "frames-part")[0], "path", "left")
    out = out.withColumn("voice_break_count", F.when(F.col("analysed_s") > 0, F.coalesce("voice_break_count", F.lit(0))))
    return out.withColumns({"voice_break_rate_per_min": ratio("voice_break_count", F.col("duration_s") / 60), "voice_break_proportion": ratio(F.coalesce("break_s", F.lit(0.0)), F.col("analysed_s"))}).drop("duration_s", "analysed_s", "break_s")


def spectrum(frames: DataFrame, rate: int = 16_000) -> DataFrame:
    """Spectral shape, flux, formants and mel coefficients of the pitched frames."""
    p = frames.where("pitched")
    bin_hz = rate / 2 / 200  # 400-sample frames have 201 bins
    s = fr.flux(fr.spectral_shape(p, "power", bin_hz), REGION, "frame_idx", "power")
    half = F.expr("size(power) div 2 + 1")
    low, high = F.aggregate(F.slice("power", F.lit(1), half), F.lit(0.0), lambda a, x: a + x), F.aggregate(F.slice("power", half + 1, F.size("power")), F.lit(0.0), lambda a, x: a + x)
    s = s.withColumns({"__low": low, "__high": high})
    units = {"centroid": "hz", "spread": "hz", "slope": "db_per_hz", "rolloff_85": "hz", "flux": "", "flatness": "", "entropy": "", "energy_db": "db", "skewness": "", "kurtosis": ""}
    cols = []
    for c, u in units.items():
        stem = "spectral_" + c.removesuffix("_db")
        cols += [F.avg(c).alias(f"{stem}_mean_{u}".rstrip("_")), sd(c).alias(f"{stem}_sd_{u}".rstrip("_"))]
    total_high = F.sum("__high")
    cols.append((10 * F.log10(F.when(total_high > 0, F.sum("__low") / total_high))).alias("spectral_low_high_energy_ratio_db"))
    for i in (1, 2, 3):
        for x in "fb":
            cols += [F.avg(f"{x}{i}").alias(f"spectral_{x}{i}_mean_hz"), sd(f"{x}{i}").alias(f"spectral_{x}{i}_sd_hz")]
    shape = s.groupBy(*KEY).agg(*cols)
    m = p.select("path", *(F.get("mfcc", F.lit(i - 1)).alias(f"m{i}") for i in range(1, 14)))
    mel = m.groupBy(*KEY).agg(*(e for i in range(1, 14) for e in (F.avg(f"m{i}").alias(f"spectral_mfcc_{i}_mean"), sd(f"m{i}").alias(f"spectral_mfcc_{i}_sd"), skew(f"m{i}").alias(f"spectral_mfcc_{i}_skewness"), kurt(f"m{i}").alias(f"spectral_mfcc_{i}_kurtosis"))))
    return shape.join(mel, KEY)


def features(frames: DataFrame, gaps: DataFrame, duration: DataFrame) -> DataFrame:
    """All frame features of each path; ``frames`` as from ``marked``."""
    parts = [materialise(p, "frames-part")[0] for p in (phonation(frames, duration), spectrum(frames))]
    out = timing(frames, gaps, duration)
    for p in parts:
        out = out.join(p, "path", "left")
    return out
