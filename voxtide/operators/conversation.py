"""Turns, latencies and overlaps between speakers, and timing of speech from utterance times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtide.functions.exprs import count_if, cv, iqr, quantile, ratio, sd
from voxtide.operators.intervals import meet, nearest_values, periods_and_gaps

KEY = ["recording_id", "speaker_id"]


def turn_sizes(utt: DataFrame, tok: DataFrame) -> DataFrame:
    """Words and syllables of each utterance, and their mean and spread by speaker."""
    per = tok.where("kind = 'word'").groupBy(*KEY, "utt_idx").agg(F.count("*").alias("n"))
    per = utt.select(*KEY, "utt_idx").join(per, [*KEY, "utt_idx"], "left").fillna(0, ["n"])
    return per.groupBy(*KEY).agg(F.count("*").alias("discourse_turn_count"), F.avg("n").alias("discourse_turn_length_mean_syllables"), sd("n").alias("discourse_turn_length_sd_syllables"))


def ordered_latency(utt: DataFrame) -> DataFrame:
    """Latency to the utterance before in (start, end, id), clipped at 0, where another speaker uttered it."""
    timed = utt.where("start_s is not null and end_s is not null")
    w = Window.partitionBy("recording_id").orderBy("start_s", "end_s", "utterance_id")
    t = timed.withColumns({"p": F.lag("speaker_id").over(w), "pe": F.lag("end_s").over(w)})
    prompted = F.col("p").isNotNull() & (F.col("p") != F.col("speaker_id"))
    lat = F.when(prompted, F.greatest(F.lit(0.0), F.col("start_s") - F.col("pe")))
    return t.groupBy(*KEY).agg(ratio(count_if(prompted), F.count("*")).alias("discourse_examiner_prompt_ratio"), F.avg(lat).alias("discourse_response_latency_mean_s"), sd(lat).alias("discourse_response_latency_sd_s"))


def asof_latency(utt: DataFrame) -> DataFrame:
    """Mean of start minus end of the utterance that ended last at or before it, where another speaker uttered that one.

    As-of without a range join: ends and starts in one order of time, ends first; among equal ends the first utterance holds.
    """
    timed = utt.where("start_s is not null and end_s is not null")
    ends = timed.select("recording_id", F.col("end_s").alias("t"), F.lit(0).alias("side"), F.col("utt_idx").alias("i"), F.struct(F.col("end_s").alias("e"), F.col("speaker_id").alias("s")).alias("end"), F.lit(None).cast(utt.schema["speaker_id"].dataType).alias("speaker_id"))
    starts = timed.select("recording_id", F.col("start_s").alias("t"), F.lit(1).alias("side"), F.col("utt_idx").alias("i"), F.lit(None).cast(ends.schema["end"].dataType).alias("end"), "speaker_id")
    seen = nearest_values(ends.unionByName(starts), ["recording_id"], "t", [F.col("side"), -F.col("i")], "end", 600.0, "last").where("side = 1")
    return seen.groupBy(*KEY).agg(F.avg(F.when(F.col("last.s") != F.col("speaker_id"), F.col("t") - F.col("last.e"))).alias("time_response_latency_s"))


def union_lengths(iv: DataFrame, keys: list[str], start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Length of the union of the intervals of each key."""
    p = periods_and_gaps(iv, keys, start, end, bucket_width=600).where("kind = 'period'")
    return p.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("length"), F.count("*").alias("islands"))


def overlaps(utt: DataFrame, slice_s: float = 60.0) -> DataFrame:
    """Every stretch that utterances of two speakers of a recording share: (recording_id, speaker_id, utt_idx, other, start_s, end_s)."""
    t = utt.select("recording_id", "speaker_id", "utt_idx", F.col("start_s").alias("s"), F.col("end_s").alias("e"))
    o = utt.select("recording_id", F.col("speaker_id").alias("other"), F.col("start_s").alias("os"), F.col("end_s").alias("oe"))
    met = meet(t, o, ["recording_id"], ("s", "e"), ("os", "oe"), slice_s).where("speaker_id <> other")
    return met.select("recording_id", "speaker_id", "utt_idx", "other", F.col("lo").alias("start_s"), F.col("hi").alias("end_s"))


def overlap_measures(utt: DataFrame) -> DataFrame:
    """Union of what a speaker shares with others, and its share of the speaker's own time."""
    own = union_lengths(utt, KEY).select(*KEY, F.col("length").alias("own"))
    shared = union_lengths(overlaps(utt), KEY).select(*KEY, F.col("length").alias("discourse_overlap_s"))
    out = own.join(shared, KEY, "left").fillna(0.0, ["discourse_overlap_s"])
    return out.select(*KEY, "discourse_overlap_s", ratio("discourse_overlap_s", "own").alias("discourse_overlap_ratio"))


def island_overlap(utt: DataFrame) -> DataFrame:
    """How long a speaker's islands and the merged islands of all others run together: 0 where they never do, null where nobody else speaks."""
    isl = periods_and_gaps(utt, KEY, "start_s", "end_s", bucket_width=600).where("kind = 'period'").select(*KEY, "start_s", "end_s")
    shared = union_lengths(overlaps(isl.withColumn("utt_idx", F.lit(0))), KEY).select(*KEY, "length")
    others = utt.select(*KEY).distinct()
    some = others.groupBy("recording_id").agg((F.count("*") > 1).alias("others"))
    return others.join(some, "recording_id").join(shared, KEY, "left").select(*KEY, F.when(F.col("others"), F.coalesce("length", F.lit(0.0))).alias("time_overlap_s"))


def speech_segments(utt: DataFrame, duration: DataFrame) -> DataFrame:
    """Merged speech of each speaker: how much, how many stretches, how long and how regular they are."""
    isl = periods_and_gaps(utt, KEY, "start_s", "end_s", bucket_width=600).where("kind = 'period'").withColumn("d", F.col("end_s") - F.col("start_s"))
    out = isl.groupBy(*KEY).agg(
        F.sum("d").alias("time_speech_s"), F.count("*").alias("time_speech_segment_count"), quantile("d", 0.5).alias("time_speech_segment_median_s"), iqr("d").alias("time_speech_segment_iqr_s"),
        cv("d").alias("time_speech_segment_cv"), F.max("d").alias("time_speech_segment_max_s"),
    ).join(duration, "recording_id")
    return out.withColumns({"time_speech_ratio": ratio("time_speech_s", "duration_s"), "time_speech_segment_rate_per_min": ratio("time_speech_segment_count", F.col("duration_s") / 60)}).drop("duration_s")


def speech_rates(utt: DataFrame, tok: DataFrame) -> DataFrame:
    """Words and syllables per minute of merged speech; words are distinct word ids of the whole speaker plus ungrouped tokens."""
    w = tok.where("kind = 'word'").groupBy(*KEY).agg((F.count_distinct("word_id") + count_if(F.col("word_id").isNull())).alias("words"), F.count("*").alias("syllables"))
    s = union_lengths(utt, KEY).select(*KEY, "length")
    j = s.join(w, KEY, "left").fillna(0, ["words", "syllables"])
    return j.select(*KEY, ratio("words", F.col("length") / 60).alias("time_words_per_min"), ratio("syllables", F.col("length") / 60).alias("time_syllables_per_min"), ratio("syllables", "length").alias("time_articulation_rate_syllables_per_s"))


def local_rate_max(utt: DataFrame, tok: DataFrame) -> DataFrame:
    """Highest rate of words over three consecutive utterances of a speaker."""
    n = tok.where("kind = 'word'").groupBy(*KEY, "utt_idx").agg(F.count("*").alias("n"))
    t = utt.where("end_s > start_s").join(n, [*KEY, "utt_idx"], "left").fillna(0, ["n"]).withColumn("d", F.col("end_s") - F.col("start_s"))
    w = Window.partitionBy(*KEY).orderBy("start_s", "end_s", "utterance_id").rowsBetween(0, 2)
    r = t.withColumn("r", F.when(F.count("*").over(w) == 3, F.sum("n").over(w) / (F.sum("d").over(w) / 60)))
    return r.groupBy(*KEY).agg(F.max("r").alias("time_max_local_speech_rate_wpm"))


def pauses(utt: DataFrame, duration: DataFrame, least_s: float = 0.25, long_s: float = 2.0) -> DataFrame:
    """Gaps between a speaker's islands of at least ``least_s``: count, lengths and share of the recording; true zeros where none is."""
    g = periods_and_gaps(utt, KEY, "start_s", "end_s", bucket_width=600)
    gap = F.when((F.col("kind") == "gap") & (F.col("end_s") - F.col("start_s") >= least_s), F.col("end_s") - F.col("start_s"))
    out = g.withColumn("g", gap).groupBy(*KEY).agg(
        F.count("g").alias("time_pause_count"), F.avg("g").alias("time_pause_mean_s"), sd("g").alias("time_pause_sd_s"), F.max("g").alias("time_pause_max_s"), count_if(F.col("g") >= long_s).alias("time_long_pause_count"),
        F.coalesce(F.sum("g"), F.lit(0.0)).alias("time_pause_total_s"), quantile("g", 0.5).alias("time_pause_median_s"), iqr("g").alias("time_pause_iqr_s"), cv("g").alias("time_pause_cv"),
    ).join(duration, "recording_id")
    return out.withColumns({"time_pause_proportion": ratio("time_pause_total_s", "duration_s"), "time_pause_rate_per_min": ratio("time_pause_count", F.col("duration_s") / 60)}).drop("duration_s")


def same_class_events(iv: DataFrame, keys: list[str], label: str, start: str, end: str, tolerance: float = 0.0) -> DataFrame:
    """Touching intervals of one class and key, in order of time, as one event."""
    w = Window.partitionBy(*keys).orderBy(start, end, label)
    new = F.when((F.lag(label).over(w) == F.col(label)) & (F.col(start) <= F.lag(end).over(w) + tolerance), 0).otherwise(1)
    run = iv.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return run.groupBy(*keys, "__run").agg(F.first(label).alias(label), F.min(start).alias(start), F.max(end).alias(end)).drop("__run")


def event_rhythm(events: DataFrame, keys: list[str], label: str, start: str, duration: DataFrame, classes: int) -> DataFrame:
    """Rate, entropy over ``classes`` and change of rate between the halves (by start) of events."""
    e = events.join(duration, "recording_id")
    first = count_if(F.col(start) < F.col("duration_s") / 2)
    by = e.groupBy(*keys, "duration_s").agg(F.count("*").alias("n"), first.alias("a"))
    p = F.col("c") / F.col("n")
    h = e.groupBy(*keys, label).agg(F.count("*").alias("c")).join(by.select(*keys, "n"), keys).groupBy(*keys).agg((F.sum(-p * F.log(p)) / F.log(F.lit(float(classes)))).alias("time_timing_event_entropy"))
    half = F.col("duration_s") / 120
    rate = ratio("n", F.col("duration_s") / 60).alias("time_timing_event_rate_per_min")
    change = ratio(ratio(F.col("n") - F.col("a"), half) - ratio("a", half), F.col("duration_s") / 60).alias("time_timing_acceleration_per_min2")
    return by.join(h, keys).select(*keys, rate, "time_timing_event_entropy", change)


def successive_variability(values: DataFrame, keys: list[str], order: list[str], value: str, prefix: str) -> DataFrame:
    """Mean, spread, normalized and raw pairwise variability of a sequence of positive durations."""
    w = Window.partitionBy(*keys).orderBy(*order)
    prev = F.lag(value).over(w)
    t = values.where(F.col(value) > 0).withColumns({"__d": F.abs(F.col(value) - prev), "__n": F.abs(F.col(value) - prev) / ((F.col(value) + prev) / 2)})
    return t.groupBy(*keys).agg(F.avg(value).alias(f"{prefix}_mean"), sd(value).alias(f"{prefix}_sd"), F.when(F.count("*") >= 2, cv(value)).alias(f"{prefix}_cv"), (100 * F.avg("__n")).alias(f"{prefix}_npvi"), F.avg("__d").alias(f"{prefix}_rpvi"))


def sessions(items: DataFrame, keys: list[str], start: str, end: str, gap: float, stop: Column | None = None, order: list[str] = ()) -> DataFrame:
    """Number the runs of each key that no pause over ``gap``, and no ``stop`` on the item before, breaks; ``order`` breaks ties."""
    order = [F.col(start), F.col(end), *(F.col(c) for c in order)]
    w = Window.partitionBy(*keys).orderBy(*order)
    cut = (F.col(start) - F.lag(end).over(w) > gap) | (F.lag(F.coalesce(stop, F.lit(False))).over(w) if stop is not None else F.lit(False))
    t = items.withColumn("__cut", F.when(F.lag(start).over(w).isNull(), 1).otherwise(F.coalesce(cut, F.lit(False)).cast("int")))
    return t.withColumn("session_no", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__cut")


