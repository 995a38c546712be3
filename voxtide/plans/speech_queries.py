"""Lexical, disfluency, conversation and timing measures over the transcript tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtide.operators import conversation as conv, legacy, lexical as lex
from voxtide.plans.relations import DUR_SQL, TOK_SQL, UTT_SQL, durations, tokens, utterances
from voxtide.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEY = "recording_id, speaker_id"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Doubles rounded, without negative zero; ``nudge`` moves values off the halves at which rounding turns."""
    return df.select(*((F.round(F.col(c) + nudge, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(
    "lex_counts",
    f"""WITH {TOK_SQL},
u AS (SELECT {KEY}, count(*) AS lex_utterance_count FROM utt GROUP BY ALL),
t AS (SELECT {KEY}, count(*) AS lex_token_count, count(*) FILTER (WHERE kind = 'word') AS lex_syllable_count,
        count(DISTINCT utt_idx::VARCHAR || ':' || coalesce('g' || word_id, 't' || token_id)) FILTER (WHERE kind = 'word') AS lex_word_count,
        coalesce(sum(length(norm)) FILTER (WHERE kind = 'word'), 0)::BIGINT AS lex_character_count, count(DISTINCT norm) FILTER (WHERE kind = 'word') AS lex_unique_token_count
      FROM tok GROUP BY ALL)
SELECT {KEY}, lex_utterance_count, coalesce(lex_token_count, 0) AS lex_token_count, coalesce(lex_word_count, 0) AS lex_word_count, coalesce(lex_syllable_count, 0) AS lex_syllable_count,
  coalesce(lex_character_count, 0) AS lex_character_count, coalesce(lex_unique_token_count, 0) AS lex_unique_token_count,
  round(coalesce(lex_word_count, 0) / lex_utterance_count, 6) AS lex_mlu_words, round(coalesce(lex_syllable_count, 0) / lex_utterance_count, 6) AS lex_mlu_syllables
FROM u LEFT JOIN t USING ({KEY})""",
)
def lex_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lex.counts(utterances(spark, d), tokens(spark, d)))


@query(
    "lex_length_stats",
    f"""WITH {TOK_SQL}, w AS (SELECT * FROM tok WHERE kind = 'word'),
per AS (SELECT {KEY}, utt_idx, coalesce('g' || word_id, 't' || token_id) AS w, count(*) AS n FROM w GROUP BY ALL),
a AS (SELECT {KEY}, avg(length(norm)) AS m, CASE WHEN count(*) > 1 THEN stddev_pop(length(norm)) END AS s FROM w GROUP BY ALL),
b AS (SELECT {KEY}, avg(n) AS m2, CASE WHEN count(*) > 1 THEN stddev_pop(n) END AS s2 FROM per GROUP BY ALL)
SELECT {KEY}, round(m, 6) AS lex_token_length_mean_characters, round(s, 6) AS lex_token_length_sd_characters, round(m2, 6) AS lex_word_length_mean_syllables, round(s2, 6) AS lex_word_length_sd_syllables
FROM a JOIN b USING ({KEY})""",
)
def lex_length_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lex.lengths(tokens(spark, d)))


_WORDS = f"WITH {TOK_SQL}, types AS (SELECT {KEY}, norm, count(*) AS f FROM tok WHERE kind = 'word' GROUP BY ALL), tot AS (SELECT {KEY}, sum(f)::BIGINT AS n, count(*) AS v, count(*) FILTER (WHERE f = 1) AS v1 FROM types GROUP BY ALL)"


@query(
    "lex_diversity",
    _WORDS + f""",
h AS (SELECT {KEY}, sum(-(f / n) * ln(f / n)) AS h FROM types JOIN tot USING ({KEY}) GROUP BY ALL),
drawn AS (SELECT {KEY}, f, count(*) AS types, any_value(n) AS n FROM types JOIN tot USING ({KEY}) GROUP BY {KEY}, f HAVING any_value(n) >= 42),
hdd AS (SELECT {KEY}, sum(types * (1 - absent) / 42) AS hdd FROM (
  SELECT {KEY}, f, types, product(greatest(n - f - k, 0)::DOUBLE / (n - k)) AS absent FROM drawn, range(42) r(k) GROUP BY ALL) GROUP BY ALL)
SELECT {KEY}, round(v / n, 6) AS lex_token_ttr, round(hdd, 6) AS lex_token_hdd_42, round(v1 / n, 6) AS lex_token_hapax_ratio, round(pow(n, pow(v, -0.165)), 6) AS lex_token_brunet_w,
  round(CASE WHEN v <> v1 THEN 100 * ln(n) / (1 - v1 / v) END, 6) AS lex_token_honore_r, round(CASE WHEN v = 1 THEN 0 ELSE h / ln(v) END, 6) AS lex_token_entropy
FROM tot LEFT JOIN h USING ({KEY}) LEFT JOIN hdd USING ({KEY})""",
)
def lex_diversity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lex.diversity(tokens(spark, d).where("kind = 'word'"), "norm", "lex_token"))


@query(
    "lex_mattr20",
    f"""WITH {TOK_SQL}, seq AS (SELECT {KEY}, list(norm ORDER BY utt_idx, tok_idx) AS l FROM tok WHERE kind = 'word' GROUP BY ALL HAVING count(*) >= 20),
win AS (SELECT {KEY}, len(list_distinct(l[i:i + 19])) / 20 AS r FROM seq, (SELECT unnest(range(1, 200000)) AS i) x WHERE i <= len(l) - 19)
SELECT {KEY}, round(avg(r), 6) AS lex_token_mattr_20 FROM win GROUP BY ALL""",
)
def lex_mattr20(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lex.ordered_diversity(tokens(spark, d).where("kind = 'word'"), "norm", ["utt_idx", "tok_idx"], "lex_token").drop("lex_token_mtld").where("lex_token_mattr_20 is not null"))


@query(
    "lex_mtld",
    f"""WITH RECURSIVE {TOK_SQL}, seq AS (SELECT {KEY}, list(norm ORDER BY utt_idx, tok_idx) AS l FROM tok WHERE kind = 'word' GROUP BY ALL),
win AS (SELECT {KEY}, avg(len(list_distinct(l[i:i + 19])) / 20) AS r FROM seq, (SELECT unnest(range(1, 200000)) AS i) x WHERE i <= len(l) - 19 GROUP BY ALL),
f AS (SELECT {KEY}, way, v, 0 AS i, 0 AS k, []::VARCHAR[] AS t, 0 AS n FROM (SELECT {KEY}, 1 AS way, l AS v FROM seq UNION ALL SELECT {KEY}, 2, list_reverse(l) FROM seq)
  UNION ALL
  SELECT {KEY}, way, v, i + 1, CASE WHEN n > 0 AND len(u) / (n + 1) <= 0.72 THEN k + 1 ELSE k END, CASE WHEN n > 0 AND len(u) / (n + 1) <= 0.72 THEN [] ELSE u END, CASE WHEN n > 0 AND len(u) / (n + 1) <= 0.72 THEN 0 ELSE n + 1 END
  FROM (SELECT *, CASE WHEN list_contains(t, v[i + 1]) THEN t ELSE list_append(t, v[i + 1]) END AS u FROM f WHERE i < len(v))),
e AS (SELECT {KEY}, way, len(v) AS m, k + CASE WHEN n > 0 THEN (1 - len(t) / n) / (1 - 0.72) ELSE 0 END AS factors FROM f WHERE i = len(v)),
g AS (SELECT {KEY}, max(CASE WHEN way = 1 AND factors > 0 THEN m / factors END) AS a, max(CASE WHEN way = 2 AND factors > 0 THEN m / factors END) AS b FROM e GROUP BY ALL)
SELECT {KEY}, round(r, 6) AS lex_token_mattr_20, round((a + b) / 2, 6) AS lex_token_mtld FROM g LEFT JOIN win USING ({KEY})""",
)
def lex_mtld(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lex.ordered_diversity(tokens(spark, d).where("kind = 'word'"), "norm", ["utt_idx", "tok_idx"], "lex_token"))


_DIS = {k: f"count(*) FILTER (WHERE kind = '{k}')" for k in ("filler", "fragment", "retracing", "revision", "error")}


@query(
    "disfluency",
    f"""WITH {TOK_SQL},
rep AS (SELECT {KEY}, count(*) AS r FROM (SELECT {KEY}, norm, lag(norm) OVER (PARTITION BY {KEY}, utt_idx ORDER BY tok_idx) AS p FROM tok WHERE kind = 'word') WHERE norm = p GROUP BY ALL),
c AS (SELECT {KEY}, count(*) AS n, count(*) FILTER (WHERE kind = 'word') AS w, {', '.join(f'{e} AS {k}' for k, e in _DIS.items())} FROM tok GROUP BY ALL),
j AS (SELECT c.*, coalesce(r, 0) AS rep FROM c LEFT JOIN rep USING ({KEY}))
SELECT {KEY}, rep AS disfluency_immediate_repetition_count, round(rep / nullif(w, 0), 6) AS disfluency_immediate_repetition_ratio,
  {', '.join(f"{k} AS disfluency_{'annotated_error' if k == 'error' else k}_count, round({k} / n, 6) AS disfluency_{'annotated_error' if k == 'error' else k}_ratio" for k in _DIS)},
  rep + filler + fragment + retracing + revision AS disfluency_maze_count, round((rep + filler + fragment + retracing + revision) / n, 6) AS disfluency_maze_ratio FROM j""",
)
def disfluency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lex.disfluency(tokens(spark, d)))


@query(
    "turn_length_stats",
    f"""WITH {TOK_SQL}, n AS (SELECT {KEY}, utt_idx, count(*) AS n FROM tok WHERE kind = 'word' GROUP BY ALL),
per AS (SELECT u.recording_id, u.speaker_id, coalesce(n, 0) AS n FROM utt u LEFT JOIN n USING ({KEY}, utt_idx))
SELECT {KEY}, count(*) AS discourse_turn_count, round(avg(n), 6) AS discourse_turn_length_mean_syllables, round(CASE WHEN count(*) > 1 THEN stddev_pop(n) END, 6) AS discourse_turn_length_sd_syllables FROM per GROUP BY ALL""",
)
def turn_length_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(conv.turn_sizes(utterances(spark, d), tokens(spark, d)))


@query(
    "latency_ordered",
    f"""WITH {UTT_SQL}, t AS (SELECT *, lag(speaker_id) OVER w AS p, lag(end_s) OVER w AS pe FROM utt WHERE start_s IS NOT NULL AND end_s IS NOT NULL WINDOW w AS (PARTITION BY recording_id ORDER BY start_s, end_s, utterance_id)),
l AS (SELECT *, CASE WHEN p <> speaker_id THEN greatest(0, start_s - pe) END AS x FROM t)
SELECT {KEY}, round(count(x) / count(*), 6) AS discourse_examiner_prompt_ratio, round(avg(x), 6) AS discourse_response_latency_mean_s, round(CASE WHEN count(x) > 1 THEN stddev_pop(x) END, 6) AS discourse_response_latency_sd_s FROM l GROUP BY ALL""",
)
def latency_ordered(spark: SparkSession, d: str) -> DataFrame:
    return rounded(conv.ordered_latency(utterances(spark, d)))


@query(
    "latency_asof",
    f"""WITH {UTT_SQL}, t AS (SELECT * FROM utt WHERE start_s IS NOT NULL AND end_s IS NOT NULL),
p AS (SELECT a.recording_id, a.utt_idx, a.speaker_id, a.start_s, b.end_s AS e, b.speaker_id AS s, row_number() OVER (PARTITION BY a.recording_id, a.utterance_id ORDER BY b.end_s DESC, b.utt_idx) AS k
      FROM t a JOIN t b ON a.recording_id = b.recording_id AND b.end_s <= a.start_s)
SELECT {KEY}, round(avg(CASE WHEN s <> speaker_id THEN start_s - e END), 6) AS time_response_latency_s
FROM t LEFT JOIN (SELECT recording_id, utt_idx, start_s AS st, e, s FROM p WHERE k = 1) q USING (recording_id, utt_idx) GROUP BY ALL""",
)
def latency_asof(spark: SparkSession, d: str) -> DataFrame:
    return rounded(conv.asof_latency(utterances(spark, d)))


def _islands(source: str, keys: str) -> str:
    return f"""SELECT {keys}, island, min(start_s) AS s, max(end_s) AS e FROM (
    SELECT *, sum(CASE WHEN start_s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, max(end_s) OVER (PARTITION BY {keys} ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source} WHERE end_s > start_s)) GROUP BY {keys}, island"""


_SHARED = """shared AS (SELECT a.recording_id, a.speaker_id, greatest(a.start_s, b.start_s) AS start_s, least(a.end_s, b.end_s) AS end_s
  FROM utt a JOIN utt b ON a.recording_id = b.recording_id AND a.speaker_id <> b.speaker_id AND a.start_s < b.end_s AND b.start_s < a.end_s WHERE a.end_s > a.start_s AND b.end_s > b.start_s)"""


@query(
    "overlap_recording",
    f"""WITH {UTT_SQL}, {_SHARED}, own AS (SELECT {KEY}, sum(e - s) AS own FROM ({_islands('utt', KEY)}) GROUP BY ALL), sh AS (SELECT {KEY}, sum(e - s) AS sh FROM ({_islands('shared', KEY)}) GROUP BY ALL)
SELECT {KEY}, round(coalesce(sh, 0), 6) AS discourse_overlap_s, round(coalesce(sh, 0) / own, 6) AS discourse_overlap_ratio FROM own LEFT JOIN sh USING ({KEY})""",
)
def overlap_recording(spark: SparkSession, d: str) -> DataFrame:
    return rounded(conv.overlap_measures(utterances(spark, d)))


@query(
    "overlap_utterance",
    f"""WITH {UTT_SQL}, o AS (SELECT a.recording_id, a.speaker_id, a.utt_idx, greatest(a.start_s, b.start_s) AS start_s, least(a.end_s, b.end_s) AS end_s
  FROM utt a JOIN utt b ON a.recording_id = b.recording_id AND a.speaker_id <> b.speaker_id AND a.start_s < b.end_s AND b.start_s < a.end_s WHERE a.end_s > a.start_s AND b.end_s > b.start_s)
SELECT {KEY}, utt_idx, round(sum(e - s), 6) AS discourse_turn_overlap_s FROM ({_islands('o', KEY + ', utt_idx')}) GROUP BY ALL""",
)
def overlap_utterance(spark: SparkSession, d: str) -> DataFrame:
    u = conv.union_lengths(conv.overlaps(utterances(spark, d)), ["recording_id", "speaker_id", "utt_idx"])
    return rounded(u.select("recording_id", "speaker_id", "utt_idx", F.col("length").alias("discourse_turn_overlap_s")))


@query(
    "speech_segments",
    f"""WITH {UTT_SQL}, {DUR_SQL}, isl AS (SELECT *, e - s AS d FROM ({_islands('utt', KEY)}))
SELECT {KEY}, round(sum(d), 6) AS time_speech_s, count(*) AS time_speech_segment_count, round(quantile_cont(d, 0.5), 6) AS time_speech_segment_median_s, round(quantile_cont(d, 0.75) - quantile_cont(d, 0.25), 6) AS time_speech_segment_iqr_s,
  round(stddev_pop(d) / avg(d), 6) AS time_speech_segment_cv, round(max(d), 6) AS time_speech_segment_max_s, round(sum(d) / any_value(duration_s), 6) AS time_speech_ratio, round(count(*) / (any_value(duration_s) / 60), 6) AS time_speech_segment_rate_per_min
FROM isl JOIN dur USING (recording_id) GROUP BY ALL""",
)
def speech_segments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(conv.speech_segments(utterances(spark, d), durations(spark, d)))


@query(
    "speech_rates",
    f"""WITH {TOK_SQL}, w AS (SELECT {KEY}, count(DISTINCT word_id) + count(*) FILTER (WHERE word_id IS NULL) AS words, count(*) AS syl FROM tok WHERE kind = 'word' GROUP BY ALL),
isl AS (SELECT {KEY}, sum(e - s) AS len FROM ({_islands('utt', KEY)}) GROUP BY ALL)
SELECT {KEY}, round(coalesce(words, 0) / (len / 60), 6) AS time_words_per_min, round(coalesce(syl, 0) / (len / 60), 6) AS time_syllables_per_min, round(coalesce(syl, 0) / len, 6) AS time_articulation_rate_syllables_per_s FROM isl LEFT JOIN w USING ({KEY})""",
)
def speech_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(conv.speech_rates(utterances(spark, d), tokens(spark, d)))


@query(
    "local_rate_max",
    f"""WITH {TOK_SQL}, n AS (SELECT {KEY}, utt_idx, count(*) AS n FROM tok WHERE kind = 'word' GROUP BY ALL),
t AS (SELECT u.*, coalesce(n, 0) AS n, end_s - start_s AS d FROM utt u LEFT JOIN n USING ({KEY}, utt_idx) WHERE end_s > start_s),
r AS (SELECT {KEY}, CASE WHEN count(*) OVER w = 3 THEN sum(n) OVER w / (sum(d) OVER w / 60) END AS r FROM t WINDOW w AS (PARTITION BY {KEY} ORDER BY start_s, end_s, utterance_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT {KEY}, round(max(r), 6) AS time_max_local_speech_rate_wpm FROM r GROUP BY ALL""",
)
def local_rate_max(spark: SparkSession, d: str) -> DataFrame:
    return rounded(conv.local_rate_max(utterances(spark, d), tokens(spark, d)))


@query(
    "pause_stats",
    f"""WITH {UTT_SQL}, {DUR_SQL}, isl AS ({_islands('utt', KEY)}),
g AS (SELECT {KEY}, CASE WHEN nxt - e >= 0.25 THEN nxt - e END AS g FROM (SELECT *, lead(s) OVER (PARTITION BY {KEY} ORDER BY s) AS nxt FROM isl))
SELECT {KEY}, count(g) AS time_pause_count, round(avg(g) + 1e-9, 6) AS time_pause_mean_s, round(CASE WHEN count(g) > 1 THEN stddev_pop(g) END + 1e-9, 6) AS time_pause_sd_s, round(max(g) + 1e-9, 6) AS time_pause_max_s, count(*) FILTER (WHERE g >= 2) AS time_long_pause_count,
  round(coalesce(sum(g), 0) + 1e-9, 6) AS time_pause_total_s, round(quantile_cont(g, 0.5) + 1e-9, 6) AS time_pause_median_s, round(quantile_cont(g, 0.75) - quantile_cont(g, 0.25) + 1e-9, 6) AS time_pause_iqr_s, round(stddev_pop(g) / avg(g) + 1e-9, 6) AS time_pause_cv,
  round(coalesce(sum(g), 0) / any_value(duration_s) + 1e-9, 6) AS time_pause_proportion, round(count(g) / (any_value(duration_s) / 60) + 1e-9, 6) AS time_pause_rate_per_min
FROM g JOIN dur USING (recording_id) GROUP BY ALL""",
)
def pause_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(conv.pauses(utterances(spark, d), durations(spark, d)), nudge=1e-9)


_CLASS = "regexp_extract(cluster_id, '([0-9]+)$', 1)::INT"
_TURNS = f"turns AS (SELECT DISTINCT turn_id, recording_id, {_CLASS} AS cls, start_ms, end_ms FROM diarization_turn WHERE end_ms > start_ms AND cluster_id IS NOT NULL)"


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """(turn_id, recording_id, cls, start_ms, end_ms): valid turns once each, with the number of their cluster."""
    t = table(spark, d, "diarization_turn").select("turn_id", "recording_id", F.regexp_extract("cluster_id", "([0-9]+)$", 1).alias("c"), "start_ms", "end_ms").where("end_ms > start_ms and cluster_id is not null").distinct()
    return t.select("turn_id", "recording_id", F.col("c").cast("int").alias("cls"), "start_ms", "end_ms")


_EVENTS = f"""{_TURNS}, ev AS (
  SELECT recording_id, any_value(cls) AS cls, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (
    SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms, cls ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT recording_id, cls, start_ms, end_ms, CASE WHEN lag(cls) OVER w = cls AND start_ms <= lag(end_ms) OVER w THEN 0 ELSE 1 END AS new
      FROM turns WINDOW w AS (PARTITION BY recording_id ORDER BY start_ms, end_ms, cls))) GROUP BY recording_id, run)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    t = clusters(spark, d).groupBy("recording_id", "cls", "start_ms", "end_ms").agg(F.count("*").alias("k"))
    return conv.same_class_events(t, ["recording_id"], "cls", "start_ms", "end_ms")


@query(
    "timing_events",
    f"""WITH {DUR_SQL}, {_EVENTS.replace('FROM turns WINDOW', 'FROM (SELECT DISTINCT recording_id, cls, start_ms, end_ms FROM turns) WINDOW')},
e AS (SELECT ev.*, start_ms / 1000 AS start_s, duration_s FROM ev JOIN dur USING (recording_id)),
b AS (SELECT recording_id, duration_s, count(*) AS n, count(*) FILTER (WHERE start_s < duration_s / 2) AS a FROM e GROUP BY ALL),
h AS (SELECT recording_id, sum(-(c / n) * ln(c / n)) / ln(3) AS h FROM (SELECT recording_id, cls, count(*) AS c FROM e GROUP BY ALL) JOIN b USING (recording_id) GROUP BY ALL)
SELECT recording_id, round(n / (duration_s / 60), 6) AS time_timing_event_rate_per_min, round(h, 6) + 0.0 AS time_timing_event_entropy, round(((n - a) / (duration_s / 120) - a / (duration_s / 120)) / (duration_s / 60), 6) + 0.0 AS time_timing_acceleration_per_min2 FROM b JOIN h USING (recording_id)""",
)
def timing_events(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("start_s", F.col("start_ms") / 1000)
    return rounded(conv.event_rhythm(e, ["recording_id"], "cls", "start_s", durations(spark, d), 3))


@query(
    "syllable_npvi",
    f"""WITH {TOK_SQL}, w AS (SELECT {KEY}, utt_idx, tok_idx, end_s - start_s AS d FROM tok WHERE kind = 'word' AND end_s > start_s),
l AS (SELECT *, lag(d) OVER (PARTITION BY {KEY} ORDER BY utt_idx, tok_idx) AS p FROM w)
SELECT {KEY}, round(avg(d), 6) AS time_syllable_duration_mean, round(CASE WHEN count(*) > 1 THEN stddev_pop(d) END, 6) AS time_syllable_duration_sd, round(CASE WHEN count(*) > 1 THEN stddev_pop(d) / avg(d) END, 6) AS time_syllable_duration_cv,
  round(100 * avg(abs(d - p) / ((d + p) / 2)), 6) AS time_syllable_duration_npvi, round(avg(abs(d - p)), 6) AS time_syllable_duration_rpvi FROM l GROUP BY ALL""",
)
def syllable_npvi(spark: SparkSession, d: str) -> DataFrame:
    w = tokens(spark, d).where("kind = 'word' and end_s > start_s").select("recording_id", "speaker_id", "utt_idx", "tok_idx", (F.col("end_s") - F.col("start_s")).alias("d"))
    return rounded(conv.successive_variability(w, ["recording_id", "speaker_id"], ["utt_idx", "tok_idx"], "d", "time_syllable_duration"))


@query(
    "session_split_700ms",
    """WITH w AS (SELECT DISTINCT recording_id, word_id, start_ms AS s, end_ms AS e FROM word_timing WHERE recording_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL),
c AS (SELECT *, CASE WHEN lag(s) OVER q IS NULL OR s - lag(e) OVER q > 700 THEN 1 ELSE 0 END AS cut FROM w WINDOW q AS (PARTITION BY recording_id ORDER BY s, e, word_id)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY recording_id ORDER BY s, e, word_id ROWS UNBOUNDED PRECEDING) AS session_no FROM c)
SELECT recording_id, session_no::BIGINT AS session_no, count(*) AS words, min(s) AS start_ms, max(e) AS end_ms FROM r GROUP BY recording_id, session_no""",
)
def session_split_700ms(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of all timed words, also those without a segment."""
    w = table(spark, d, "word_timing").where("recording_id is not null and start_ms is not null and end_ms is not null")
    w = w.select("recording_id", F.col("word_id").alias("token_id"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e")).distinct()
    return conv.sessions(w, ["recording_id"], "s", "e", 700, order=["token_id"]).groupBy("recording_id", "session_no").agg(F.count("*").alias("words"), F.min("s").alias("start_ms"), F.max("e").alias("end_ms"))


_FUNCTION_WORDS = ("the", "a", "and", "was", "not", "là", "rồi", "có", "cho")


@query(
    "legacy_lexical",
    f"""WITH {TOK_SQL}, w AS (SELECT {KEY}, norm, lag(norm) OVER (PARTITION BY {KEY} ORDER BY utt_idx, tok_idx) AS p FROM tok WHERE kind = 'word'),
r AS (SELECT {KEY}, count(*) FILTER (WHERE norm = p) AS again, count(*) FILTER (WHERE norm IN ({', '.join(repr(x) for x in _FUNCTION_WORDS)})) AS fw FROM w GROUP BY ALL),
f AS (SELECT {KEY}, count(*) AS v, count(*) FILTER (WHERE f = 1) AS v1 FROM (SELECT {KEY}, norm, count(*) AS f FROM w GROUP BY ALL) GROUP BY ALL),
c AS (SELECT {KEY}, count(*) AS n, count(*) FILTER (WHERE kind = 'word') AS w, coalesce(sum(length(norm)) FILTER (WHERE kind = 'word'), 0)::BIGINT AS ch, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in ('filler', 'fragment', 'noise'))} FROM tok GROUP BY ALL)
SELECT {KEY}, n AS lex_token_count, w AS lex_word_count, ch AS lex_char_count, {', '.join(f"{k} AS lex_{k}_count, round({k} / n, 6) AS lex_{k}_ratio" for k in ('filler', 'fragment', 'noise'))}, coalesce(v, 0) AS lex_unique_count, round(ch / nullif(w, 0), 6) AS lex_mean_token_length,
  round(v / nullif(w, 0), 6) AS lex_ttr, round(v1 / nullif(w, 0), 6) AS lex_hapax_ratio, round(pow(v, 0.172), 6) AS lex_brunet_w, round(CASE WHEN v <> v1 THEN 100 * ln(w) / (1 - v1 / v) END, 6) AS lex_honore_r, round(again / nullif(w, 0), 6) AS lex_repetition_ratio, round(fw / nullif(w, 0), 6) AS lex_function_word_ratio
FROM c LEFT JOIN f USING ({KEY}) LEFT JOIN r USING ({KEY})""",
)
def legacy_lexical(spark: SparkSession, d: str) -> DataFrame:
    return rounded(legacy.lexical(tokens(spark, d), _FUNCTION_WORDS))
