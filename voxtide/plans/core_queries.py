"""Queries of the general operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtide.operators import intervals, profile
from voxtide.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


PROFILED = ("feature_recording", "feature_issue")

_P2_VALUES = {
    "feature_recording": ["row_id", "recording_id", "speaker_id", "audio_duration_s", "audio_rms_dbfs", "audio_clipping_ratio", "time_speech_ratio", "time_words_per_min", "time_pause_mean_s", "time_long_pause_count", "voice_f0_mean_hz", "voice_jitter_local", "voice_hnr_mean_db", "lex_token_count", "lex_token_ttr"],
    "feature_issue": ["issue_id", "recording_id", "speaker_id", "utterance_id", "feature", "code", "severity", "message"],
}
_P2_TEXT = {"recording_id", "speaker_id", "utterance_id", "feature", "code", "severity", "message"}
_P2_CELLS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, load_id, '{c}' AS column_name, {c if c in _P2_TEXT else 'NULL::VARCHAR'} AS s, {'NULL::DOUBLE' if c in _P2_TEXT else f"CASE WHEN {c}::VARCHAR <> 'nan' THEN {c}::DOUBLE END"} AS x FROM {t} WHERE load_id IS NOT NULL"
    for t, cs in _P2_VALUES.items()
    for c in cs
)
_P2_BEFORE = ("n_rows", "n_null", "n_distinct", "n_pattern", "n_range", "min_value", "max_value", "min_text", "max_text", "q1", "q2", "q3")
_P2_FIGURES = f"""
cells AS ({_P2_CELLS}),
fig AS (
  SELECT c.table_name, c.load_id, c.column_name, count(*) AS n_rows,
         count(*) - count(s) - count(x) AS n_null, count(DISTINCT s) + count(DISTINCT x) AS n_distinct,
         count(*) FILTER (WHERE s IS NOT NULL AND r.value_pattern <> '' AND NOT regexp_full_match(s, r.value_pattern)) AS n_pattern,
         count(*) FILTER (WHERE x < r.min_value OR (x > r.max_value AND NOT isnan(r.max_value))) AS n_range,
         quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3,
         min(x) AS min_value, max(x) AS max_value, min(s) AS min_text, max(s) AS max_text,
         c.column_name NOT IN ('recording_id', 'speaker_id', 'utterance_id', 'feature', 'code', 'severity', 'message') AS num, any_value(r.column_name) IS NOT NULL AS ruled
  FROM cells c LEFT JOIN (SELECT DISTINCT * FROM column_rule) r USING (table_name, column_name)
  GROUP BY c.table_name, c.load_id, c.column_name),
runs AS (SELECT load_id, lag(load_id) OVER (PARTITION BY stream_name ORDER BY seq) AS prev_id FROM (SELECT DISTINCT load_id, stream_name, seq FROM load_run)),
freq AS (SELECT table_name, load_id, column_name, s, count(*) AS n FROM cells WHERE s IS NOT NULL GROUP BY ALL),
tv AS (
  SELECT table_name, load_id, column_name, sum(abs(a / ma - b / mb)) / 2 AS tv FROM (
    SELECT u.table_name, u.load_id, u.column_name, s, sum(a) AS a, sum(b) AS b,
           any_value(f.n_rows - f.n_null) AS ma, any_value(g.n_rows - g.n_null) AS mb
    FROM (SELECT table_name, load_id, column_name, s, n AS a, 0 AS b FROM freq
          UNION ALL
          SELECT table_name, r.load_id, column_name, s, 0, n FROM freq f JOIN runs r ON r.prev_id = f.load_id) u
    JOIN runs r ON r.load_id = u.load_id
    JOIN fig f ON f.table_name = u.table_name AND f.load_id = u.load_id AND f.column_name = u.column_name
    JOIN fig g ON g.table_name = u.table_name AND g.load_id = r.prev_id AND g.column_name = u.column_name
    GROUP BY ALL) WHERE ma > 0 AND mb > 0 GROUP BY ALL),
prof AS (
  SELECT f.*, {', '.join(f"p.{c} AS prev_{c}" for c in _P2_BEFORE)}, tv.tv
  FROM fig f LEFT JOIN runs r USING (load_id)
  LEFT JOIN fig p ON p.table_name = f.table_name AND p.column_name = f.column_name AND p.load_id = r.prev_id
  LEFT JOIN tv ON tv.table_name = f.table_name AND tv.column_name = f.column_name AND tv.load_id = f.load_id)
"""


def _profiles(spark: SparkSession, d: str, drift_of_numbers: bool, every: bool = False) -> DataFrame:
    return profile.profile({t: table(spark, d, t) for t in PROFILED}, "load_id", table(spark, d, "column_rule"), table(spark, d, "load_run"), drift_of_numbers, every)


@query(
    "p2_found",
    f"""WITH {_P2_FIGURES}
SELECT table_name, load_id, column_name, unnest(list_filter([
  CASE WHEN n_pattern > 0 THEN 'pattern' END,
  CASE WHEN n_range > 0 THEN 'range' END,
  CASE WHEN n_null::DOUBLE / n_rows - prev_n_null::DOUBLE / prev_n_rows > 0.10 + 1e-12 THEN 'null_rate' END,
  CASE WHEN n_distinct < 0.5 * prev_n_distinct OR n_distinct > 2 * prev_n_distinct THEN 'distinct' END,
  CASE WHEN num AND abs(q2 - prev_q2) > least(q3 - q1, prev_q3 - prev_q1) THEN 'centre' END,
  CASE WHEN num AND (q3 - q1 < 0.5 * (prev_q3 - prev_q1) OR q3 - q1 > 2 * (prev_q3 - prev_q1)) THEN 'spread' END,
  CASE WHEN NOT num AND column_name <> 'utterance_id' AND tv > 0.25 + 1e-12 THEN 'mix' END], lambda v: v IS NOT NULL)) AS finding
FROM prof WHERE ruled""",
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.findings(_profiles(spark, d, False), no_mix=["utterance_id"])


@query(
    "p2_profile",
    f"""WITH {_P2_FIGURES}
SELECT table_name, load_id, column_name, n_rows, n_null, n_distinct, n_pattern, n_range, min_value, max_value, min_text, max_text,
       round(q1, 9) AS q1, round(q2, 9) AS q2, round(q3, 9) AS q3, CASE WHEN NOT num THEN round(tv, 6) END AS tv,
       {', '.join(f"round(prev_{c}, 9) AS prev_{c}" if c in ("q1", "q2", "q3") else f"prev_{c}" for c in _P2_BEFORE)} FROM prof""",
)
def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every column of the tables, ruled or not, with its range and the figures of the load before."""
    p = _profiles(spark, d, False, every=True)
    counts, ends, cuts = ["n_rows", "n_null", "n_distinct", "n_pattern", "n_range"], ["min_value", "max_value", "min_text", "max_text"], ["q1", "q2", "q3"]
    return p.select(
        "table_name", "load_id", "column_name", *counts, *ends, *(F.round(q, 9).alias(q) for q in cuts), F.when(~F.col("num"), F.round("tv", 6)).alias("tv"),
        *(f"prev_{c}" for c in counts + ends), *(F.round(f"prev_{q}", 9).alias(f"prev_{q}") for q in cuts),
    )


@query(
    "p2_drift",
    f"""WITH {_P2_FIGURES},
v AS (SELECT table_name, load_id, column_name, s, x, count(*) AS n FROM cells WHERE s IS NOT NULL OR x IS NOT NULL GROUP BY ALL),
pr AS (SELECT f.table_name, f.load_id, f.column_name, f.num, p.load_id AS prev_id, f.n_rows - f.n_null AS ma, p.n_rows - p.n_null AS mb, p.q1 AS c1, p.q2 AS c2, p.q3 AS c3
  FROM fig f JOIN runs r USING (load_id) JOIN fig p ON p.table_name = f.table_name AND p.column_name = f.column_name AND p.load_id = r.prev_id),
cell AS (SELECT pr.table_name, pr.load_id, pr.column_name, ma, mb, CASE WHEN num THEN ((x > c1)::INT + (x > c2)::INT + (x > c3)::INT)::VARCHAR ELSE s END AS c,
    sum(CASE WHEN v.load_id = pr.load_id THEN n ELSE 0 END) AS a, sum(CASE WHEN v.load_id = pr.prev_id THEN n ELSE 0 END) AS b
  FROM pr JOIN v ON v.table_name = pr.table_name AND v.column_name = pr.column_name AND v.load_id IN (pr.load_id, pr.prev_id) WHERE ma > 0 AND mb > 0 GROUP BY ALL)
SELECT table_name, load_id, column_name, round(sum((sqrt(mb / ma) * a - b / sqrt(mb / ma)) ** 2 / (a + b)), 6) AS chi2,
  round(sum((greatest(a / ma, 1e-4) - greatest(b / mb, 1e-4)) * ln(greatest(a / ma, 1e-4) / greatest(b / mb, 1e-4))), 6) AS psi FROM cell GROUP BY ALL""",
)
def p2_drift(spark: SparkSession, d: str) -> DataFrame:
    """Chi-square and population stability index of every column against the load before."""
    return _profiles(spark, d, True, every=True).where("psi is not null").select("table_name", "load_id", "column_name", F.round("chi2", 6).alias("chi2"), F.round("psi", 6).alias("psi"))


def _islands_sql(t: str) -> str:
    return f"""
  SELECT '{t}' AS origin, recording_id, island, min(start_ms) AS s, max(end_ms) AS e FROM (
    SELECT *, sum(CASE WHEN start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT recording_id, start_ms, end_ms, max(end_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM {t} WHERE end_ms > start_ms)) GROUP BY ALL"""


@query(
    "p4_found",
    f"""WITH p AS ({_islands_sql('reference_utterance')} UNION ALL {_islands_sql('diarization_turn')})
SELECT origin, recording_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM p
UNION ALL
SELECT origin, recording_id, 'gap', e, nxt FROM (SELECT *, lead(s) OVER (PARTITION BY origin, recording_id ORDER BY s) AS nxt FROM p) WHERE nxt - e <= 600000""",
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    both = None
    for t in ("reference_utterance", "diarization_turn"):
        part = table(spark, d, t).select(F.lit(t).alias("origin"), "recording_id", "start_ms", "end_ms")
        both = part if both is None else both.unionByName(part)
    return intervals.periods_and_gaps(both, ["origin", "recording_id"], "start_ms", "end_ms", max_gap=600_000)
