"""Motor-speech measures from labelled segments: vowels, consonants, rhythm, syllable trains, breath groups, sustained phonation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from voxtide.functions.exprs import count_if, cv, quantile, ratio, sd

KEY = ["recording_id"]


def vowel_space(seg: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Area, articulation index and its inverse from the median formants of i, a and u; null where one is missing.

    ``seg``: segment_type, segment_label, f1_hz, f2_hz, start_s.
    """
    v = seg.where("segment_type = 'vowel' and f1_hz is not null and f2_hz is not null")
    m = v.groupBy(*keys, "segment_label").agg(quantile("f1_hz", 0.5).alias("f1"), quantile("f2_hz", 0.5).alias("f2"))
    p = m.groupBy(*keys).agg(*(F.max(F.when(F.col("segment_label") == x, F.col(f))).alias(f + x) for x in "iau" for f in ("f1", "f2")))
    area = F.abs(F.col("f1i") * (F.col("f2a") - F.col("f2u")) + F.col("f1a") * (F.col("f2u") - F.col("f2i")) + F.col("f1u") * (F.col("f2i") - F.col("f2a"))) / 2
    num, den = F.col("f2i") + F.col("f1a"), F.col("f1i") + F.col("f1u") + F.col("f2u") + F.col("f2a")
    return p.select(*keys, area.alias("artic_vowel_space_area_hz2"), ratio(num, den).alias("artic_vowel_articulation_index"), ratio(den, num).alias("artic_formant_centralization_ratio"))


def vowel_dispersion(seg: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Distance of vowels to their centroid, mean spread within a label, and slope of F2 from vowel to vowel."""
    v = seg.where("segment_type = 'vowel' and f1_hz is not null and f2_hz is not null")
    c = v.groupBy(*keys).agg(F.avg("f1_hz").alias("c1"), F.avg("f2_hz").alias("c2"))
    w = Window.partitionBy(*keys).orderBy("start_s", "token_id")
    dt, df2 = F.lead("start_s").over(w) - F.col("start_s"), F.lead("f2_hz").over(w) - F.col("f2_hz")
    t = v.withColumn("slope", F.when(dt > 0, F.abs(df2 / dt))).join(c, keys).withColumn("d", F.hypot(F.col("f1_hz") - F.col("c1"), F.col("f2_hz") - F.col("c2")))
    within = v.groupBy(*keys, "segment_label").agg(sd("f1_hz").alias("s1"), sd("f2_hz").alias("s2")).groupBy(*keys).agg(F.avg("s1").alias("artic_f1_within_vowel_sd_hz"), F.avg("s2").alias("artic_f2_within_vowel_sd_hz"))
    return t.groupBy(*keys).agg(F.avg("d").alias("artic_vowel_dispersion_mean_hz"), sd("d").alias("artic_vowel_dispersion_sd_hz"), F.avg("slope").alias("artic_formant_transition_slope_mean_hz_s")).join(within, keys)


def consonants(seg: DataFrame, layers: dict[str, tuple[str, str]], keys: list[str] = KEY) -> DataFrame:
    """Mean and spread of number layers on segments of a type; null unless all of them have it.  layers: name -> (type, column)."""
    cols = []
    for name, (kind, c) in layers.items():
        here = F.when(F.col("segment_type") == kind, F.col(c))
        ok = count_if((F.col("segment_type") == kind) & F.col(c).isNull()) == 0
        cols += [F.when(ok, F.avg(here)).alias(f"{name}_mean"), F.when(ok & (F.count(here) >= 2), F.stddev_pop(here)).alias(f"{name}_sd")]
    dur = F.when(F.col("segment_type").isin("consonant", "stop", "fricative"), F.col("end_s") - F.col("start_s"))
    return seg.groupBy(*keys).agg(*cols, F.avg(dur).alias("artic_consonant_duration_mean_s"), F.when(F.count(dur) >= 2, F.stddev_pop(dur)).alias("artic_consonant_duration_sd_s"))


def rhythm(seg: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Share of vocalic time, and variability of vocalic and consonantal intervals.

    Neighbouring segments of one class, in order of time, are one interval as long as all of them together; any other
    segment ends it.  All is null unless every segment has a type and each interval's segments have positive lengths;
    pairwise measures need two intervals of the class.
    """
    order = Window.partitionBy(*keys).orderBy("start_s", "token_id")
    cls = F.when(F.col("segment_type") == "vowel", "v").when(F.col("segment_type").isin("consonant", "stop", "fricative"), "c").otherwise("-")
    d = F.when(F.col("end_s") > F.col("start_s"), F.col("end_s") - F.col("start_s"))
    t = seg.select(*keys, "start_s", "token_id", "segment_type", cls.alias("cls"), d.alias("d"))
    ok = t.groupBy(*keys).agg(F.bool_and(F.col("segment_type").isNotNull() & (F.col("d").isNotNull() | (F.col("cls") == "-"))).alias("ok"))
    t = t.withColumn("new", F.when(F.lag("cls").over(order) == F.col("cls"), 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    iv = t.where("cls <> '-'").groupBy(*keys, "run", "cls").agg(F.sum("d").alias("d"))
    p = F.lag("d").over(Window.partitionBy(*keys, "cls").orderBy("run"))
    iv = iv.withColumns({"a": F.abs(F.col("d") - p), "m": (F.col("d") + p) / 2}).join(ok.where("ok"), keys)
    out = []
    for c in "vc":
        here = F.col("cls") == c
        out += [(100 * cv(F.when(here, F.col("d")))).alias(f"rhythm_varco_{c}"), F.avg(F.when(here, F.col("a"))).alias(f"rhythm_rpvi_{c}"), (100 * F.avg(F.when(here, F.col("a") / F.col("m")))).alias(f"rhythm_npvi_{c}")]
    v = F.sum(F.when(F.col("cls") == "v", F.col("d")).otherwise(0.0))
    return ok.select(*keys).join(iv.groupBy(*keys).agg((100 * ratio(v, F.sum("d"))).alias("rhythm_percent_vocalic"), *out), keys, "left")


def syllable_train(tok: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Rate, regularity, acceleration and decay of a train of syllables; ``tok``: start_s, end_s, segment_label, token_id.

    All is null unless there are two syllables at least, all with positive lengths, whose onsets rise strictly; instability and
    acceleration need three, alternation a label on each.  The span runs from the first onset to the end of the last syllable.
    """
    order = F.struct("start_s", "token_id")
    w = Window.partitionBy(*keys).orderBy("start_s", "token_id")
    gap = F.lead("start_s").over(w) - F.col("start_s")
    t = tok.withColumns({"g": gap, "mid": F.col("start_s") + gap / 2, "swap": (F.lead("segment_label").over(w) != F.col("segment_label")).cast("int")})
    t = t.withColumn("dg", F.abs(F.col("g") - F.lag("g").over(w)))
    n, span = F.count("*"), F.max_by("end_s", order) - F.min("start_s")
    ok = F.bool_and(F.coalesce(F.col("end_s") > F.col("start_s"), F.lit(False)) & F.coalesce(F.col("g") > 0, F.lit(True))) & (n >= 2) & (span > 0)
    first, last = (f("g", F.when(F.col("g").isNotNull(), order)) for f in (F.min_by, F.max_by))
    cols = {
        "task_ddk_rate_syllables_s": ratio(n, span), "task_ddk_inter_onset_mean_s": F.avg("g"), "task_ddk_inter_onset_median_s": quantile("g", 0.5), "task_ddk_inter_onset_sd_s": F.stddev_pop("g"), "task_ddk_inter_onset_cv": cv("g"),
        "task_ddk_instability_s": F.avg("dg"), "task_ddk_acceleration_syllables_s2": F.when(n >= 3, F.regr_slope(1 / F.when(F.col("g") > 0, F.col("g")), F.when(F.col("g") > 0, F.col("mid")))), "task_ddk_decay_ratio": ratio(first, last),
        "task_ddk_voiced_interval_mean_s": F.avg(F.col("end_s") - F.col("start_s")), "task_ddk_sequential_alternating_ratio": F.when(F.count("segment_label") == n, F.avg("swap")),
    }
    return t.groupBy(*keys).agg(*(F.when(ok, e).alias(k) for k, e in cols.items()))


def breath_groups(tok: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Runs of one breath_group: number, lengths, rate and pauses in each; ``tok``: breath_group, is_pause, start_s, end_s, token_id."""
    w = Window.partitionBy(*keys).orderBy("start_s", "token_id")
    t = tok.withColumn("new", F.when(F.lag("breath_group").over(w) == F.col("breath_group"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    r = t.groupBy(*keys, "run").agg(F.min("start_s").alias("s"), F.max("end_s").alias("e"), count_if(F.col("is_pause")).alias("p"))
    n, d = F.count("*"), F.col("e") - F.col("s")
    return r.groupBy(*keys).agg(n.alias("resp_breath_group_count"), F.avg(d).alias("resp_breath_group_mean_s"), sd(d).alias("resp_breath_group_sd_s"), ratio(60 * n, F.max("e") - F.min("s")).alias("resp_rate_per_min"), ratio(F.sum("p"), n).alias("resp_pauses_per_breath"))


def sustained(tok: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Longest phonation, interval rates and spreads of pitch (semitones) and power; ``tok``: interval_type, f0_hz, power_db, start_s, end_s."""
    d = F.col("end_s") - F.col("start_s")
    total = F.sum(d)
    return tok.where("end_s > start_s").groupBy(*keys).agg(
        F.max(d).alias("task_max_phonation_time_s"), ratio(60 * count_if(F.col("interval_type") == "gaping"), total).alias("voice_gaping_interval_rate_per_min"),
        ratio(F.sum(F.when(F.col("interval_type") == "subharmonic", d).otherwise(0.0)), total).alias("voice_subharmonic_interval_proportion"),
        F.when(F.count("f0_hz") >= 2, F.stddev_pop(12 * F.log2(F.when(F.col("f0_hz") > 0, F.col("f0_hz"))))).alias("voice_sustained_f0_sd_semitones"), F.when(F.count("power_db") >= 2, F.stddev_pop("power_db")).alias("voice_sustained_power_sd_db"),
    )
