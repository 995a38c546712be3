"""Batch and study manifests as tables, with one error row for each row that isn't valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

V2 = "version int, rows array<struct<recording_id:string,audio_path:string,transcript_path:string,target_speakers:array<string>,task_spec_path:string>>"
V1 = "version int, rows array<struct<participant_id:string,task:string,recording_id:string,audio_id:string,transcript_id:string,audio_path:string,transcript_path:string,task_spec_path:string,diagnosis:string,age:double,sex:string,education_years:double>>"
STUDY = "version int, rows array<struct<session_id:string,participant_id:string,audio_path:string,channel_index:int,sha256:string,split:string,reference_path:string,asr_revision:string>>"
# What a study row may hold.
ID = r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z"
SPLITS = ("dev", "held_out")


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m")).select("m.version", F.posexplode_outer("m.rows").alias("row_no", "r")).select("version", "row_no", "r.*")


def _judged(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    message = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for m, c in rules.items()))
    j = rows.withColumn("message", message)
    return j.where("message is null").drop("message", "version"), j.where("message is not null").select("row_no", F.lit("INVALID_MANIFEST").alias("code"), "message")


def _empty(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def _repeated(c: str) -> Column:
    return F.count("*").over(Window.partitionBy(c)) > 1


def read_batch(spark: SparkSession, path: str, base: str = "") -> tuple[DataFrame, DataFrame]:
    """Rows of a version 2 manifest with paths below ``base``, and the errors of the others."""
    t = F.col("target_speakers")
    good, bad = _judged(_rows(spark, path, V2), {
        "manifest must have version == 2": ~F.col("version").eqNullSafe(2), "manifest must contain rows": F.col("row_no").isNull(), "recording_id, audio_path and transcript_path must be non-empty": _empty("recording_id") | _empty("audio_path") | _empty("transcript_path"),
        "duplicate recording_id": _repeated("recording_id"), "target_speakers must be a non-empty list of distinct names": (F.size(t) == 0) | F.exists(t, lambda x: x.isNull() | (x == "")) | (F.size(F.array_distinct(t)) != F.size(t)),
    })
    below = lambda c: F.when(F.col(c).startswith("/") | (F.lit(base) == ""), F.col(c)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.col(c)))
    return good.withColumns({c: below(c) for c in ("audio_path", "transcript_path", "task_spec_path")}), bad


def read_labelled(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a version 1 manifest; its labels go their own way (participant_id, diagnosis)."""
    return _judged(_rows(spark, path, V1), {
        "manifest must have version == 1": ~F.col("version").eqNullSafe(1), "ids and paths must be non-empty": _empty("participant_id") | _empty("task") | _empty("recording_id") | _empty("audio_path") | _empty("transcript_path"),
        "duplicate recording_id": _repeated("recording_id"), "age and education_years must be finite": F.isnan("age") | F.isnan("education_years"),
    })


def read_study(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a study manifest; messages never repeat a value of the row."""
    return _judged(_rows(spark, path, STUDY), {
        "session_id and participant_id must be plain ids": ~F.coalesce(F.col("session_id").rlike(ID) & F.col("participant_id").rlike(ID), F.lit(False)), "sha256 must be 64 hex digits": ~F.coalesce(F.col("sha256").rlike(r"\A[0-9a-f]{64}\z"), F.lit(False)),
        "split must be dev or held_out": ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), "channel_index must be 0 or more": ~F.coalesce(F.col("channel_index") >= 0, F.lit(False)), "duplicate session_id": _repeated("session_id"),
    })


def targets(rows: DataFrame) -> DataFrame:
    """(recording_id, speaker_id): the declared targets of a batch."""
    return rows.select("recording_id", F.explode("target_speakers").alias("speaker_id"))


def digests(files: DataFrame) -> DataFrame:
    """(path, sha256) of each distinct file of (path, content)."""
    return files.dropDuplicates(["path"]).select("path", F.sha2("content", 256).alias("sha256"))
