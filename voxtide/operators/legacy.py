"""The earlier, smaller feature sets: 17 lexical and 23 acoustic measures of one speaker or one sound."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from voxtide.functions.exprs import count_if, iqr, quantile, ratio
from voxtide.operators.acoustic import HOP_S, LONG_PAUSE_S, PAUSE_S, runs

KEY = ["recording_id", "speaker_id"]


def lexical(tok: DataFrame, function_words: Sequence[str] | None = None) -> DataFrame:
    """Counts, diversity and ratios over all of a speaker's words in order; repetition runs across utterances.

    Brunet's W is here V to the 0.172.  Without ``function_words`` their ratio is null.
    """
    w = tok.where("kind = 'word'")
    prev = F.lag("norm").over(Window.partitionBy(*KEY).orderBy("utt_idx", "tok_idx"))
    rep = w.select(*KEY, F.coalesce(prev == F.col("norm"), F.lit(False)).alias("again"), F.col("norm").isin(list(function_words)).alias("fw") if function_words else F.lit(None).cast("boolean").alias("fw"))
    rep = rep.groupBy(*KEY).agg(count_if(F.col("again")).alias("again"), (count_if(F.col("fw")) if function_words else F.lit(None).cast("long")).alias("fw"))
    types = w.groupBy(*KEY, "norm").agg(F.count("*").alias("f")).groupBy(*KEY).agg(F.count("*").alias("v"), count_if(F.col("f") == 1).alias("v1"))
    word = F.col("kind") == "word"
    t = tok.groupBy(*KEY).agg(
        F.count("*").alias("lex_token_count"), count_if(word).alias("lex_word_count"), F.sum(F.when(word, F.char_length("norm")).otherwise(0)).cast("long").alias("lex_char_count"),
        *(count_if(F.col("kind") == k).alias(f"lex_{k}_count") for k in ("filler", "fragment", "noise")),
    ).join(types, KEY, "left").join(rep, KEY, "left")
    n, v, v1 = F.col("lex_word_count"), F.col("v"), F.col("v1")
    return t.withColumns({
        "lex_unique_count": F.coalesce(v, F.lit(0)), "lex_mean_token_length": ratio("lex_char_count", n), "lex_ttr": ratio(v, n), "lex_hapax_ratio": ratio(v1, n), "lex_brunet_w": F.pow(v, F.lit(0.172)),
        "lex_honore_r": F.when((n > 0) & (v != v1), 100 * F.log(n) / (1 - v1 / v)), **{f"lex_{k}_ratio": ratio(f"lex_{k}_count", "lex_token_count") for k in ("filler", "fragment", "noise")},
        "lex_repetition_ratio": ratio("again", n), "lex_function_word_ratio": ratio("fw", n),
    }).drop("v", "v1", "again", "fw")


def acoustic(frames: DataFrame, duration: DataFrame) -> DataFrame:
    """Energy, spectrum, pitch, harmonicity and pauses of whole sounds; ``frames`` as from ``acoustic.marked`` with spectral shape."""
    e = frames.groupBy("path").agg(
        F.avg("energy").alias("ac_frame_energy_mean"), F.stddev_pop("energy").alias("ac_frame_energy_sd"), iqr("energy").alias("ac_frame_energy_iqr"), (quantile("energy", 0.95) - quantile("energy", 0.05)).alias("ac_frame_energy_span"),
        *(F.avg(c).alias(f"ac_spectral_{c}_mean") for c in ("centroid", "spread", "flatness")), ratio(count_if(F.col("voiced")), F.count("*")).alias("voice"),
    )
    p = frames.where("pitched").groupBy("path").agg(
        F.avg("f0_hz").alias("ac_pitch_voiced_mean"), F.stddev_pop("f0_hz").alias("ac_pitch_voiced_sd"), ratio(F.stddev_pop("f0_hz"), F.avg("f0_hz")).alias("ac_pitch_voiced_cv"), quantile("f0_hz", 0.5).alias("ac_pitch_voiced_median"), iqr("f0_hz").alias("ac_pitch_voiced_iqr"),
        (quantile("f0_hz", 0.95) - quantile("f0_hz", 0.05)).alias("ac_pitch_voiced_span"), (F.max("f0_hz") - F.min("f0_hz")).alias("ac_pitch_voiced_delta"), quantile("hnr_db", 0.5).alias("ac_hnr_median"), iqr("hnr_db").alias("ac_hnr_iqr"),
    )
    least = -(-PAUSE_S // HOP_S)
    s = runs(frames, "voiced").where(~F.col("on") & (F.col("n") >= least)).groupBy("path").agg(F.count("*").alias("n"), F.avg("d").alias("ac_pause_mean_s"), F.stddev_pop("d").alias("ac_pause_sd_s"), F.max("d").alias("ac_pause_max_s"), count_if(F.col("d") >= LONG_PAUSE_S).alias("long"))
    j = e.join(p, "path", "left").join(s, "path", "left").join(duration, "path")
    heard = F.col("ac_pitch_voiced_mean").isNotNull()
    return j.withColumns({"ac_voice_ratio": F.when(heard, F.col("voice")), "ac_pause_count": F.when(heard, F.coalesce("n", F.lit(0))), "ac_long_pause_count": F.when(heard, F.coalesce("long", F.lit(0))), "ac_pause_rate_per_min": F.when(heard, ratio(F.coalesce("n", F.lit(0)), F.col("duration_s") / 60))}).drop("voice", "n", "long", "duration_s")
