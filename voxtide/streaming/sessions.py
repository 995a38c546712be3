"""Transcript measures over streams: sessions of words, and rolling speech time, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def word_sessions(words: DataFrame, time: str = "aligned_at", key: str = "recording_id", gap: str = "700 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Runs of words of a key with no pause over ``gap``: when they begin and end, and how many words they hold.

    A session is final once the watermark, ``late`` behind the newest word, has passed it; later words are dropped by then.
    """
    return words.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("words")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "words")


def talk_time(turns: DataFrame, time: str = "created_at", key: str = "recording_id", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Talk time per key, cluster and window of arrival; turns without both ends, or that end before they start, add nothing."""
    d = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    return turns.withWatermark(time, late).groupBy(F.window(time, window), key, "cluster_id").agg(F.sum(d).alias("talk_ms"), F.count("*").alias("turns")).select(key, "cluster_id", F.col("window.start").alias("start"), "talk_ms", "turns")


def distinct_rows(rows: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each id once, as long as its repetition arrives within ``late``; the state kept is bounded by the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
