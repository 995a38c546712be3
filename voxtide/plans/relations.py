"""Views of the tables as the relations that the feature packs read, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtide.sources.tables import table

# Spellings of entries that name the examiner; all others stand for the participant.
EXAMINER = ("inv", "*inv", "inv.", "inv:", "*inv:", "investigator", "examiner", "người hỏi", "khám viên")


def utterances(spark: SparkSession, d: str) -> DataFrame:
    """(recording_id, speaker_id, utt_idx, utterance_id, start_s, end_s): one row per segment, repeated ones once."""
    seg = table(spark, d, "asr_segment").select("segment_id", "recording_id", "segment_no", "start_ms", "end_ms").distinct()
    said = table(spark, d, "speaker_result").select("recording_id", F.posexplode("utterance_speakers").alias("segment_no", "entry"))
    said = said.groupBy("recording_id", "segment_no").agg(F.max(F.trim(F.lower("entry")).isin(list(EXAMINER))).alias("inv"))
    u = seg.join(said, ["recording_id", "segment_no"], "left")
    return u.select("recording_id", F.when(F.col("inv"), "INV").otherwise("PAR").alias("speaker_id"), F.col("segment_no").alias("utt_idx"), F.col("segment_id").alias("utterance_id"), (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """(recording_id, speaker_id, utt_idx, tok_idx, token_id, norm, kind, word_id, start_s, end_s): timed words of segments, repeated ones once.

    ``word_id`` joins an article to the word after it, so that words of two tokens occur.
    Words without a segment have no speaker and are left out here, so of all measures by speaker.
    """
    w = table(spark, d, "word_timing").where("segment_id is not null").select("word_id", "segment_id", "word_no", "word", "start_ms", "end_ms").distinct()
    norm = F.lower(F.regexp_replace("word", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    forms = table(spark, d, "nonword_form").groupBy(F.col("form").alias("norm")).agg(F.min("kind").alias("form_kind"))
    t = w.withColumn("norm", norm).join(forms, "norm", "left")
    kind = F.when(F.col("form_kind") == "filler", "filler").when(F.col("form_kind").isNotNull(), "noise").when(F.col("word").endswith("-"), "fragment").otherwise("word")
    t = t.withColumn("kind", kind).join(utterances(spark, d).select("recording_id", "speaker_id", "utt_idx", F.col("utterance_id").alias("segment_id")), "segment_id")
    return t.select(
        "recording_id", "speaker_id", "utt_idx", F.col("word_no").alias("tok_idx"), F.col("word_id").alias("token_id"), "norm", "kind",
        F.when(F.col("norm").isin("the", "a", "cái"), F.col("word_no") + 1).when(F.col("word_no") > 0, F.col("word_no")).cast("string").alias("word_id"),
        (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"),
    )


def durations(spark: SparkSession, d: str) -> DataFrame:
    """(recording_id, duration_s): the last end of a segment or turn."""
    ends = table(spark, d, "asr_segment").select("recording_id", "end_ms").union(table(spark, d, "diarization_turn").select("recording_id", "end_ms"))
    return ends.groupBy("recording_id").agg((F.max("end_ms") / 1000).alias("duration_s")).where("duration_s > 0")


_INV = ", ".join(f"'{e}'" for e in EXAMINER)
UTT_SQL = f"""utt AS (
  SELECT s.recording_id, CASE WHEN coalesce(lower(trim(r.utterance_speakers[s.segment_no + 1])) IN ({_INV}), false) THEN 'INV' ELSE 'PAR' END AS speaker_id,
         s.segment_no AS utt_idx, s.segment_id AS utterance_id, s.start_ms / 1000 AS start_s, s.end_ms / 1000 AS end_s
  FROM (SELECT DISTINCT segment_id, recording_id, segment_no, start_ms, end_ms FROM asr_segment) s
  LEFT JOIN (SELECT DISTINCT ON (recording_id) recording_id, utterance_speakers FROM speaker_result) r USING (recording_id))"""
TOK_SQL = UTT_SQL + r""",
tok AS (
  SELECT u.recording_id, u.speaker_id, u.utt_idx, w.word_no AS tok_idx, w.word_id AS token_id, w.norm,
         CASE WHEN f.kind = 'filler' THEN 'filler' WHEN f.kind IS NOT NULL THEN 'noise' WHEN word LIKE '%-' THEN 'fragment' ELSE 'word' END AS kind,
         CASE WHEN w.norm IN ('the', 'a', 'cái') THEN word_no + 1 WHEN word_no > 0 THEN word_no END::VARCHAR AS word_id, w.start_ms / 1000 AS start_s, w.end_ms / 1000 AS end_s
  FROM (SELECT *, lower(regexp_replace(word, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')) AS norm FROM (
          SELECT DISTINCT word_id, segment_id, word_no, word, start_ms, end_ms FROM word_timing WHERE segment_id IS NOT NULL)) w
  LEFT JOIN (SELECT DISTINCT form, kind FROM nonword_form) f ON f.form = w.norm
  JOIN utt u ON u.utterance_id = w.segment_id)"""
DUR_SQL = "dur AS (SELECT recording_id, max(end_ms) / 1000 AS duration_s FROM (SELECT recording_id, end_ms FROM asr_segment UNION ALL SELECT recording_id, end_ms FROM diarization_turn) GROUP BY 1 HAVING max(end_ms) > 0)"
