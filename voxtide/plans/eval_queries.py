"""Scoring, selection and transcription queries, frame measures over vectors, and table utilities, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voxtide.operators import evaluation as ev, frames as fr, transcription as tr
from voxtide.operators.nonlinear import nonlinear
from voxtide.plans.relations import TOK_SQL, UTT_SQL, tokens, utterances
from voxtide.plans.speech_queries import _TURNS, KEY, clusters, rounded
from voxtide.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# Gold and predicted texts: an utterance's words, and the same without fillers and with every 5th word respelled.
_PAIR = f"""{TOK_SQL}, pair AS (SELECT recording_id, speaker_id, utt_idx, list(norm ORDER BY tok_idx) AS g, list(CASE WHEN token_id % 5 = 0 THEN 'zz' ELSE norm END ORDER BY tok_idx) FILTER (WHERE kind = 'word') AS p FROM tok GROUP BY ALL)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d)
    words = lambda c: F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(c)), lambda x: x["w"]))
    return t.groupBy("recording_id", "speaker_id", "utt_idx").agg(
        words(F.struct("tok_idx", F.col("norm").alias("w"))).alias("gold"),
        words(F.when(F.col("kind") == "word", F.struct("tok_idx", F.when(F.col("token_id") % 5 == 0, "zz").otherwise(F.col("norm")).alias("w")))).alias("predicted"),
    )


@query(
    "edit_rates",
    f"""WITH RECURSIVE {_PAIR}, items AS (SELECT 'syer' AS kind, {KEY}, utt_idx, list_filter(g, lambda w: w <> '') AS g, list_filter(coalesce(p, []), lambda w: w <> '') AS p FROM pair
  UNION ALL SELECT 'cer', {KEY}, utt_idx, list_filter(string_split(array_to_string(g, ''), ''), lambda c: c <> ''), list_filter(string_split(array_to_string(coalesce(p, []), ''), ''), lambda c: c <> '') FROM pair),
dp AS (SELECT *, 0 AS i, range(len(p) + 1) AS r FROM items
  UNION ALL
  SELECT kind, {KEY}, utt_idx, g, p, i + 1, list_reduce(range(1, len(p) + 1), lambda acc, j: list_append(acc, least(acc[j] + 1, r[j + 1] + 1, r[j] + CASE WHEN g[i + 1] = p[j] THEN 0 ELSE 1 END)), [i + 1]) FROM dp WHERE i < len(g))
SELECT {KEY}, {', '.join(f"sum(CASE WHEN kind = '{k}' THEN r[len(p) + 1] END)::BIGINT AS {k}_edits, sum(CASE WHEN kind = '{k}' THEN len(g) END)::BIGINT AS {k}_ref" for k in ('syer', 'cer'))} FROM dp WHERE i = len(g) GROUP BY ALL""",
)
def edit_rates(spark: SparkSession, d: str) -> DataFrame:
    """Token and character edits of every utterance, summed by speaker."""
    e = ev.edit_counts(_pairs(spark, d), "gold", "predicted")
    return e.groupBy("recording_id", "speaker_id").agg(*(F.sum(c).alias(c) for c in ("syer_edits", "syer_ref", "cer_edits", "cer_ref")))


@query(
    "edit_rates_words",
    f"""WITH RECURSIVE {_PAIR}, x AS (SELECT recording_id, speaker_id, utt_idx, g, coalesce(p, []) AS p FROM pair),
dp AS (SELECT recording_id, speaker_id, utt_idx, g, p, 0 AS i, range(len(p) + 1) AS r FROM x
  UNION ALL
  SELECT recording_id, speaker_id, utt_idx, g, p, i + 1, list_reduce(range(1, len(p) + 1), lambda acc, j: list_append(acc, least(acc[j] + 1, r[j + 1] + 1, r[j] + CASE WHEN g[i + 1] = p[j] THEN 0 ELSE 1 END)), [i + 1]) FROM dp WHERE i < len(g))
SELECT {KEY}, sum(r[len(p) + 1])::BIGINT AS syer_edits, sum(len(g))::BIGINT AS syer_ref FROM dp WHERE i = len(g) GROUP BY ALL""",
)
def edit_rates_words(spark: SparkSession, d: str) -> DataFrame:
    e = ev.edit_counts(_pairs(spark, d), "gold", "predicted", ["syer"])
    return e.groupBy("recording_id", "speaker_id").agg(F.sum("syer_edits").alias("syer_edits"), F.sum("syer_ref").alias("syer_ref"))


def _merged_sql(src: str, keys: str, s: str = "start_ms", e: str = "end_ms") -> str:
    return f"""SELECT {keys}, min({s}) AS s, max({e}) AS e FROM (
    SELECT *, sum(CASE WHEN {s} > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY {s}, {e} ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, max({e}) OVER (PARTITION BY {keys} ORDER BY {s}, {e} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src} WHERE {e} > {s})) GROUP BY {keys}, island"""


_DER = f"""{UTT_SQL}, {_TURNS}, ref0 AS (SELECT recording_id, speaker_id AS speaker, round(start_s * 1000)::BIGINT + 250 AS start_ms, round(end_s * 1000)::BIGINT - 250 AS end_ms FROM utt),
hyp0 AS (SELECT recording_id, CASE cls WHEN 0 THEN 'PAR' ELSE 'INV' END AS speaker, start_ms, end_ms FROM turns)"""


@query(
    "der_collar",
    f"""WITH {_DER}, r AS (SELECT *, row_number() OVER () AS k FROM ref0 WHERE end_ms > start_ms),
m AS (SELECT r.recording_id, r.k, any_value(r.end_ms - r.start_ms) AS total, coalesce(sum(CASE WHEN h.start_ms IS NOT NULL THEN greatest(0, least(r.end_ms, h.end_ms) - greatest(r.start_ms, h.start_ms)) END), 0) AS matched
  FROM r LEFT JOIN hyp0 h ON h.recording_id = r.recording_id AND h.speaker = r.speaker AND h.start_ms < r.end_ms AND h.end_ms > r.start_ms GROUP BY ALL),
s AS (SELECT recording_id, sum(total) AS total, sum(greatest(0, total - matched)) AS gone FROM m GROUP BY ALL),
every AS (SELECT recording_id FROM utt WHERE start_s IS NOT NULL AND end_s IS NOT NULL UNION SELECT recording_id FROM hyp0)
SELECT recording_id, coalesce(total, 0)::BIGINT AS reference_ms, coalesce(gone, 0)::BIGINT AS uncovered_ms, round(CASE WHEN total > 0 THEN least(1, gone / total) ELSE 0 END, 6) AS der FROM every LEFT JOIN s USING (recording_id)""",
)
def der_collar(spark: SparkSession, d: str) -> DataFrame:
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    ref = utterances(spark, d).where("start_s is not null and end_s is not null").select("recording_id", F.col("speaker_id").alias("speaker"), ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"))
    hyp = clusters(spark, d).select("recording_id", F.when(F.col("cls") == 0, "PAR").otherwise("INV").alias("speaker"), "start_ms", "end_ms")
    return rounded(ev.diarization_error(ref, hyp))


@query(
    "coverage_retention",
    f"""WITH u AS (SELECT DISTINCT recording_id, start_ms, end_ms FROM reference_utterance WHERE end_ms > start_ms), w AS ({_merged_sql('diarization_turn', 'recording_id')}), m AS ({_merged_sql('u', 'recording_id')}),
k AS (SELECT m.recording_id, sum(least(m.e, w.e) - greatest(m.s, w.s)) AS kept FROM m JOIN w ON m.recording_id = w.recording_id AND w.s < m.e AND w.e > m.s GROUP BY ALL),
b AS (SELECT u.*, coalesce(sum(CASE WHEN w.s IS NOT NULL THEN least(u.end_ms, w.e) - greatest(u.start_ms, w.s) END), 0) AS kept FROM u LEFT JOIN w ON u.recording_id = w.recording_id AND w.s < u.end_ms AND w.e > u.start_ms GROUP BY ALL),
n AS (SELECT recording_id, count(*) AS utterances, count(*) FILTER (WHERE 2 * kept >= end_ms - start_ms) AS retained_utterances FROM b GROUP BY ALL),
t AS (SELECT recording_id, sum(e - s)::BIGINT AS reference_ms FROM m GROUP BY ALL)
SELECT recording_id, reference_ms, utterances, retained_utterances, coalesce(kept, 0)::BIGINT AS retained_ms, round(coalesce(kept, 0) / reference_ms, 6) AS coverage FROM t JOIN n USING (recording_id) LEFT JOIN k USING (recording_id)""",
)
def coverage_retention(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.retention(table(spark, d, "reference_utterance"), table(spark, d, "diarization_turn")))


# Study arms: orders are sessions, customers participants, priorities arms; edits and reference sizes follow from the keys.
_ARM = """ses AS (SELECT o_custkey AS participant, o_orderkey AS session, substr(o_orderpriority, 1, 1) AS arm, (o_orderkey * 7) % 40 AS edits, 50 + o_orderkey % 30 AS ref, o_custkey % 2 AS split,
  (o_orderkey * 13) % 100 AS retained, 100 AS spoken, CASE WHEN o_orderkey % 211 > 0 THEN (o_orderkey % 17)::DOUBLE END AS runtime_s, 60 + o_orderkey % 9 AS audio_s FROM orders)"""


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        c.alias("participant"), k.alias("session"), F.substring("o_orderpriority", 1, 1).alias("arm"), ((k * 7) % 40).alias("edits"), (50 + k % 30).alias("ref"), (c % 2).alias("split"),
        ((k * 13) % 100).alias("retained"), F.lit(100).cast("long").alias("spoken"), F.when(k % 211 > 0, (k % 17).cast("double")).alias("runtime_s"), (60 + k % 9).alias("audio_s"),
    )


@query(
    "pooled_vs_macro",
    f"""WITH {_ARM}, p AS (SELECT split, arm, participant, sum(edits) AS e, sum(ref) AS r FROM ses GROUP BY ALL)
SELECT split, arm, round(sum(e) / sum(r), 6) AS pooled_rate, round(avg(e / r), 6) AS macro_rate, count(*) AS participants, sum(e)::BIGINT AS edits, sum(r)::BIGINT AS ref_count FROM p GROUP BY ALL""",
)
def pooled_vs_macro(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.pooled_and_macro(_sessions(spark, d), "participant", "edits", "ref", ["split", "arm"]))


@query(
    "gates_95",
    f"""WITH {_ARM} SELECT participant, arm, CASE WHEN sum(spoken) > 0 THEN sum(spoken - retained) * 100 >= sum(spoken) * 95 END AS retention_gate, count(runtime_s) = count(*) AS no_failed_session,
  round(CASE WHEN count(runtime_s) = count(*) THEN sum(runtime_s) / (sum(audio_s) / 3600) END, 6) AS runtime_s_per_audio_hour FROM ses GROUP BY ALL""",
)
def gates_95(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_sessions(spark, d).groupBy("participant", "arm").agg(
        ev.gate(F.sum(F.col("spoken") - F.col("retained")), F.sum("spoken")).alias("retention_gate"), (F.count("runtime_s") == F.count("*")).alias("no_failed_session"),
        ev.complete_rate(F.col("runtime_s"), F.col("audio_s") / 3600).alias("runtime_s_per_audio_hour"),
    ))


_ARM_RATES = f"""{_ARM}, rates AS (SELECT participant, arm, sum(edits) / sum(ref) AS rate, sum(retained) AS missed, CASE WHEN count(runtime_s) = count(*) THEN sum(runtime_s) END AS rt FROM ses GROUP BY ALL)"""


def _arm_rates(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).groupBy("participant", "arm").agg((F.sum("edits") / F.sum("ref")).alias("rate"), F.sum("retained").alias("missed"), F.when(F.count("runtime_s") == F.count("*"), F.sum("runtime_s")).alias("rt"))


@query(
    "selection_tiebreak",
    f"""WITH {_ARM_RATES}, b AS (SELECT participant, rate AS base FROM rates WHERE arm = '1'), e AS (SELECT r.*, base FROM rates r JOIN b USING (participant) WHERE arm <> '1' AND rt IS NOT NULL AND rate <= base),
m AS (SELECT participant, min(rate) AS best FROM e GROUP BY ALL),
k AS (SELECT e.participant, arm, rate, row_number() OVER (PARTITION BY e.participant ORDER BY missed, rt NULLS LAST, arm) AS k FROM e JOIN m ON m.participant = e.participant WHERE round((rate - best) * 100, 9) <= 1)
SELECT participant, arm AS selected, round(rate, 6) AS rate FROM k WHERE k = 1""",
)
def selection_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    r = _arm_rates(spark, d)
    j = r.where("arm <> '1'").join(r.where("arm = '1'").select("participant", F.col("rate").alias("base")), "participant").withColumn("ok", F.col("rt").isNotNull())
    s = ev.select_arm(j, ["participant"], "rate", "base", "ok", [F.col("missed"), F.col("rt").asc_nulls_last(), F.col("arm")])
    return rounded(s.select("participant", F.col("arm").alias("selected"), "rate"))


@query(
    "paired_difference",
    f"""WITH {_ARM_RATES}, x AS (SELECT r.arm, r.rate - b.rate AS dif FROM rates r JOIN rates b ON b.participant = r.participant AND b.arm = '1' WHERE r.arm <> '1'), m AS (SELECT arm, avg(dif) AS m, count(*) AS n FROM x GROUP BY ALL)
SELECT arm, round(any_value(m), 6) AS mean_difference, any_value(n) AS participants, count(*) FILTER (WHERE sign(dif) = sign(m)) AS sign_agreement FROM x JOIN m USING (arm) GROUP BY arm""",
)
def paired_difference(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.paired_difference(_arm_rates(spark, d), "arm", "1", "participant", "rate"))


@query(
    "arm_window_reuse",
    """WITH f AS (SELECT recording_id, segment_no % 6 AS arm, concat_ws('-', count(*), sum(start_ms)::BIGINT, sum(end_ms)::BIGINT, sum((start_ms * 1000003 + end_ms) % 1000000007)::BIGINT) AS fp
  FROM (SELECT DISTINCT segment_id, recording_id, segment_no, start_ms, end_ms FROM asr_segment WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL) GROUP BY ALL)
SELECT recording_id, arm, fp, min(arm) OVER (PARTITION BY recording_id, fp) AS reused_from FROM f""",
)
def arm_window_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Arms of a recording with the same windows are decoded once: each with the first arm of its fingerprint.

    The fingerprint is made of sums, so no arm's windows are gathered.
    """
    s = table(spark, d, "asr_segment").where("start_ms is not null and end_ms is not null").select("segment_id", "recording_id", "segment_no", "start_ms", "end_ms").distinct()
    mix = F.sum((F.col("start_ms") * 1000003 + F.col("end_ms")) % 1000000007)
    f = s.groupBy("recording_id", (F.col("segment_no") % 6).alias("arm")).agg(F.concat_ws("-", *(x.cast("string") for x in (F.count("*"), F.sum("start_ms"), F.sum("end_ms"), mix))).alias("fp"))
    return f.join(f.groupBy("recording_id", "fp").agg(F.min("arm").alias("reused_from")), ["recording_id", "fp"]).select("recording_id", "arm", "fp", "reused_from")


@query(
    "promotion_verdict",
    f"""WITH {_ARM_RATES}, m AS (SELECT participant, rate AS main FROM rates WHERE arm = '2') SELECT arm, count(*) AS participants, count(*) FILTER (WHERE rate < main) AS better, count(*) FILTER (WHERE rate > main) AS worse, count(*) FILTER (WHERE rate < main) > count(*) FILTER (WHERE rate > main) AS promoted
FROM rates JOIN m USING (participant) WHERE arm <> '2' GROUP BY ALL""",
)
def promotion_verdict(spark: SparkSession, d: str) -> DataFrame:
    r = _arm_rates(spark, d)
    j = r.where("arm <> '2'").join(r.where("arm = '2'").select("participant", F.col("rate").alias("main")), "participant")
    b, w = F.sum((F.col("rate") < F.col("main")).cast("long")), F.sum((F.col("rate") > F.col("main")).cast("long"))
    return j.groupBy("arm").agg(F.count("*").alias("participants"), b.alias("better"), w.alias("worse"), (b > w).alias("promoted"))




@query(
    "auroc_rank",
    """WITH c AS (SELECT speaker_id, time_words_per_min AS x, lex_token_ttr > 0.5 AS y FROM (SELECT DISTINCT * FROM feature_recording) WHERE speaker_id IN ('PAR', 'INV') AND NOT isnan(time_words_per_min) AND time_words_per_min IS NOT NULL AND lex_token_ttr IS NOT NULL AND NOT isnan(lex_token_ttr)),
r AS (SELECT *, rank() OVER (PARTITION BY speaker_id ORDER BY x) + (count(*) OVER (PARTITION BY speaker_id, x) - 1) / 2 AS rk FROM c),
s AS (SELECT speaker_id, sum(rk) FILTER (WHERE y) AS sr, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM r GROUP BY ALL)
SELECT speaker_id, round((sr - p * (p + 1) / 2) / (p * n), 6) AS auroc, p AS positives, n AS negatives FROM s""",
)
def auroc_rank(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "feature_recording").distinct().where("speaker_id in ('PAR', 'INV') and not isnan(time_words_per_min) and not isnan(lex_token_ttr)")
    return rounded(ev.auroc(t.withColumn("y", F.col("lex_token_ttr") > 0.5), "time_words_per_min", "y", ["speaker_id"]))


@query(
    "confusion_metrics",
    """WITH c AS (SELECT load_id, lex_token_count > 400 AS p, audio_duration_s > 500 AS t FROM (SELECT DISTINCT * FROM feature_recording) WHERE lex_token_count IS NOT NULL AND audio_duration_s IS NOT NULL AND NOT isnan(audio_duration_s)),
a AS (SELECT load_id, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn FROM c GROUP BY ALL)
SELECT *, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy FROM a""",
)
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "feature_recording").distinct().where("not isnan(audio_duration_s)")
    return rounded(ev.confusion(t.withColumns({"p": F.col("lex_token_count") > 400, "t": F.col("audio_duration_s") > 500}), "t", "p", ["load_id"]))


@query(
    "missingness",
    """WITH t AS (SELECT DISTINCT * FROM feature_recording), u AS (SELECT speaker_id, unnest([{'feature': 'time_pause_mean_s', 'x': time_pause_mean_s}, {'feature': 'voice_f0_mean_hz', 'x': voice_f0_mean_hz}, {'feature': 'voice_hnr_mean_db', 'x': voice_hnr_mean_db}], recursive := true) FROM t)
SELECT speaker_id, feature, count(*) AS n_rows, count(*) FILTER (WHERE x IS NULL OR isnan(x)) AS n_missing, count(DISTINCT round(x, 9)) FILTER (WHERE NOT isnan(x)) >= 2 AS usable FROM u GROUP BY ALL""",
)
def missingness(spark: SparkSession, d: str) -> DataFrame:
    fs = ("time_pause_mean_s", "voice_f0_mean_hz", "voice_hnr_mean_db")
    t = table(spark, d, "feature_recording").distinct()
    u = t.select("speaker_id", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.when(~F.isnan(f), F.col(f)).alias("x")) for f in fs))).alias("c")).select("speaker_id", "c.*")
    return u.groupBy("speaker_id", "feature").agg(F.count("*").alias("n_rows"), (F.count("*") - F.count("x")).alias("n_missing"), (F.count_distinct(F.round("x", 9)) >= 2).alias("usable"))


# Transcription operators.


@query(
    "role_assignment",
    f"""WITH {_TURNS}, t AS (SELECT recording_id, cls, sum(end_ms - start_ms)::BIGINT AS talk_ms FROM turns GROUP BY ALL)
SELECT *, CASE WHEN row_number() OVER (PARTITION BY recording_id ORDER BY talk_ms DESC, cls) = 1 THEN 'PAR' ELSE 'INV' END AS role FROM t""",
)
def role_assignment(spark: SparkSession, d: str) -> DataFrame:
    return tr.roles(clusters(spark, d))


@query(
    "overlap_argmax",
    f"""WITH {_TURNS}, s AS (SELECT DISTINCT segment_id, recording_id, start_ms, end_ms FROM asr_segment WHERE end_ms > start_ms),
o AS (SELECT segment_id, cls, sum(least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms)) AS ms FROM s JOIN turns t ON t.recording_id = s.recording_id AND t.start_ms < s.end_ms AND t.end_ms > s.start_ms GROUP BY ALL)
SELECT segment_id AS id, arg_max(cls, ms * 100 - cls) AS cls, max(ms)::BIGINT AS overlap_ms FROM o GROUP BY ALL""",
)
def overlap_argmax(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "asr_segment").select(F.col("segment_id").alias("id"), "recording_id", "start_ms", "end_ms").distinct()
    return tr.overlap_argmax(s, clusters(spark, d))


@query(
    "nearest_turn",
    f"""WITH {_TURNS}, s AS (SELECT DISTINCT segment_id, recording_id, start_ms, end_ms FROM asr_segment WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL),
o AS (SELECT segment_id, turn_id, row_number() OVER (PARTITION BY segment_id ORDER BY abs(s.start_ms + s.end_ms - t.start_ms - t.end_ms), turn_id) AS k FROM s LEFT JOIN turns t USING (recording_id))
SELECT segment_id AS id, turn_id FROM o WHERE k = 1""",
)
def nearest_turn(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "asr_segment").select(F.col("segment_id").alias("id"), "recording_id", "start_ms", "end_ms").distinct()
    return tr.nearest_midpoint(s, clusters(spark, d))


@query(
    "loop_collapse",
    f"""WITH {TOK_SQL}, r AS (SELECT recording_id, utt_idx, norm, tok_idx, tok_idx - row_number() OVER (PARTITION BY recording_id, utt_idx, norm ORDER BY tok_idx) AS grp FROM (SELECT recording_id, utt_idx, norm, row_number() OVER (PARTITION BY recording_id, utt_idx ORDER BY tok_idx) AS tok_idx FROM tok))
SELECT recording_id, utt_idx, norm, min(tok_idx)::INT AS first, count(*) AS length FROM r GROUP BY recording_id, utt_idx, norm, grp HAVING count(*) >= 3""",
)
def loop_collapse(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("recording_id", "utt_idx").orderBy("tok_idx")
    t = tokens(spark, d).withColumn("at", F.row_number().over(w))
    return tr.loops(t, ["recording_id", "utt_idx"], "at", "norm", 3)


_AGAIN = " ".join(f"WHEN i + {2 * n} <= len(l) AND l[i + 1:i + {n}] = l[i + {n + 1}:i + {2 * n}] THEN {n}" for n in (4, 3, 2, 1))


@query(
    "retrace_ngrams",
    f"""WITH RECURSIVE {TOK_SQL}, u AS (SELECT {KEY}, utt_idx, list(CASE WHEN kind = 'word' THEN norm ELSE chr(1) || tok_idx END ORDER BY tok_idx) AS l, list(tok_idx ORDER BY tok_idx) AS places FROM tok WHERE kind <> 'filler' GROUP BY ALL),
s AS (SELECT {KEY}, utt_idx, l, places, 0 AS i, -1 AS was, 0 AS n FROM u
  UNION ALL SELECT {KEY}, utt_idx, l, places, i + greatest(m, 1), i, m FROM (SELECT *, CASE {_AGAIN} ELSE 0 END AS m FROM s WHERE i < len(l)))
SELECT {KEY}, utt_idx, places[was + 1] AS tok_idx, n, array_to_string(l[was + 1:was + n], ' ') AS text FROM s WHERE n > 0""",
)
def retrace_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return tr.retraces(tokens(spark, d))


@query(
    "vad_window_merge",
    f"""WITH w AS (SELECT recording_id, start_ms, end_ms + 700 AS end_ms FROM diarization_turn WHERE end_ms > start_ms), m AS ({_merged_sql('w', 'recording_id')}),
p AS (SELECT recording_id, greatest(0, s - 30) AS s, e - 670 AS e FROM m), c AS (SELECT *, unnest(generate_series(0, (e - s - 1) // 20000)) AS i FROM p)
SELECT recording_id, s + i * 20000 AS start_ms, least(e, s + (i + 1) * 20000) AS end_ms FROM c""",
)
def vad_window_merge(spark: SparkSession, d: str) -> DataFrame:
    return tr.window_merge(table(spark, d, "diarization_turn"))


@query(
    "comma_cleanup",
    f"""WITH {TOK_SQL}, x AS (SELECT recording_id, utt_idx, tok_idx, norm, token_id % 4 = 0 AS c FROM tok),
k AS (SELECT *, coalesce(max(CASE WHEN NOT c THEN 1 END) OVER (PARTITION BY recording_id, utt_idx ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, coalesce(lag(c) OVER (PARTITION BY recording_id, utt_idx ORDER BY tok_idx), false) AS dbl FROM x)
SELECT recording_id, utt_idx, tok_idx, norm FROM k WHERE NOT c OR (b = 1 AND NOT dbl)""",
)
def comma_cleanup(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d).select("recording_id", "utt_idx", "tok_idx", "norm", (F.col("token_id") % 4 == 0).alias("c"))
    return tr.comma_cleanup(t, ["recording_id", "utt_idx"], "tok_idx", "c").drop("c")


# Fixed values, spelled out here once more: Vietnamese digits.
_DIGITS = "['không', 'một', 'hai', 'ba', 'bốn', 'năm', 'sáu', 'bảy', 'tám', 'chín']"


def _triple(g: str, full: str) -> str:
    """Three digits in words; ``full`` where others stand before them."""
    h, t, u = f"({g} // 100)", f"({g} // 10 % 10)", f"({g} % 10)"
    return f"""concat_ws(' ', CASE WHEN {full} OR {h} > 0 THEN {_DIGITS}[{h} + 1] || ' trăm' END,
      CASE WHEN {t} > 1 THEN {_DIGITS}[{t} + 1] || ' mươi' WHEN {t} = 1 THEN 'mười' WHEN {u} > 0 AND ({full} OR {h} > 0) THEN 'lẻ' END,
      CASE WHEN {u} = 0 THEN NULL WHEN {t} > 1 AND {u} = 1 THEN 'mốt' WHEN {t} > 1 AND {u} = 4 THEN 'tư' WHEN {t} > 0 AND {u} = 5 THEN 'lăm' ELSE {_DIGITS}[{u} + 1] END)"""


_PLACES = ((10**9, " tỷ"), (10**6, " triệu"), (10**3, " nghìn"), (1, ""))
_SPELLED = "CASE WHEN n = 0 THEN 'không' ELSE concat_ws(' ', " + ", ".join(f"CASE WHEN n // {x} % 1000 > 0 THEN {_triple(f'(n // {x} % 1000)', f'(n >= {x * 1000})')} || '{name}' END" for x, name in _PLACES) + ") END"


@query("number_spelling", f"SELECT n AS l_orderkey, {_SPELLED} AS spelled FROM (SELECT DISTINCT l_orderkey AS n FROM lineitem)")
def number_spelling(spark: SparkSession, d: str) -> DataFrame:
    return tr.spelled(table(spark, d, "lineitem").select("l_orderkey").distinct(), "l_orderkey")


# Frames: vectors are power arrays of frames, their label the region.
_FRAMES = "fr AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS p FROM embeddings)"


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * x.cast("double")).alias("p"))


_BINS = "b AS (SELECT vec_id, label, unnest(p) AS x, unnest(range(len(p))) * 125.0::DOUBLE AS f FROM fr)"


@query(
    "spectral_shape",
    f"""WITH {_FRAMES}, {_BINS}, t AS (SELECT vec_id, label, sum(x) AS tot, count(*) AS n, sum(x * f) / sum(x) AS cen, exp(avg(ln(greatest(x, 1e-12)))) / avg(x) AS flat, regr_slope(10 * log10(greatest(x, 1e-12)), f) AS slope FROM b GROUP BY ALL),
m AS (SELECT vec_id, label, any_value(tot) AS tot, any_value(cen) AS cen, any_value(flat) AS flat, any_value(slope) AS slope, sum(x * (f - cen) ** 2) / any_value(tot) AS v, sum(x * (f - cen) ** 3) / any_value(tot) AS m3, sum(x * (f - cen) ** 4) / any_value(tot) AS m4,
  -sum(CASE WHEN x > 0 THEN x / tot * ln(x / tot) ELSE 0 END) / ln(any_value(n)) AS h FROM b JOIN t USING (vec_id, label) GROUP BY ALL),
g AS (SELECT label, avg(cen) AS a, stddev_pop(cen) AS b, avg(sqrt(v)) AS c, avg(m3 / v ** 1.5) AS d, avg(m4 / v ** 2) AS e, avg(h) AS f, avg(flat) AS g, avg(10 * log10(tot)) AS h, avg(slope) AS i FROM m GROUP BY ALL)
SELECT label, round(a, 6) AS spectral_centroid_mean, round(b, 6) AS spectral_centroid_sd, round(c, 6) AS spectral_spread_mean, round(d, 6) AS spectral_skewness_mean, round(e, 6) AS spectral_kurtosis_mean, round(f, 6) AS spectral_entropy_mean, round(g, 6) AS spectral_flatness_mean, round(h, 6) AS spectral_energy_db_mean, round(i, 6) AS spectral_slope_mean FROM g""",
)
def spectral_shape(spark: SparkSession, d: str) -> DataFrame:
    s = fr.summary(fr.spectral_shape(_frames(spark, d), "p", 125.0), ["label"], ["centroid", "spread", "skewness", "kurtosis", "entropy", "flatness", "energy_db", "slope"])
    keep = ["spectral_centroid_mean", "spectral_centroid_sd", *(f"spectral_{c}_mean" for c in ("spread", "skewness", "kurtosis", "entropy", "flatness", "energy_db", "slope"))]
    return rounded(s.select("label", *keep))


@query(
    "spectral_rolloff",
    f"""WITH {_FRAMES}, {_BINS}, c AS (SELECT *, sum(x) OVER (PARTITION BY vec_id ORDER BY f ROWS UNBOUNDED PRECEDING) AS cum, sum(x) OVER (PARTITION BY vec_id) AS tot FROM b), r AS (SELECT vec_id, any_value(label) AS label, min(f) FILTER (WHERE cum >= 0.85 * tot) AS r FROM c GROUP BY vec_id)
SELECT label, round(avg(r), 6) AS spectral_rolloff_85_mean, round(stddev_pop(r), 6) AS spectral_rolloff_85_sd FROM r GROUP BY ALL""",
)
def spectral_rolloff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fr.summary(fr.spectral_shape(_frames(spark, d), "p", 125.0), ["label"], ["rolloff_85"]))


@query(
    "spectral_flux",
    f"""WITH {_FRAMES}, n AS (SELECT vec_id, label, list_transform(p, lambda x: x / sqrt(list_sum(list_transform(p, lambda y: y * y)))) AS u FROM fr), l AS (SELECT label, u, lag(u) OVER (PARTITION BY label ORDER BY vec_id) AS q FROM n)
SELECT label, round(avg(list_distance(u, q)), 6) AS spectral_flux_mean, round(stddev_pop(list_distance(u, q)), 6) AS spectral_flux_sd FROM l WHERE q IS NOT NULL GROUP BY ALL""",
)
def spectral_flux(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fr.summary(fr.flux(_frames(spark, d), ["label"], "vec_id", "p"), ["label"], ["flux"]))


@query(
    "vad_threshold",
    f"""WITH {_FRAMES}, e AS (SELECT vec_id, label, round(list_sum(p[1:16]), 9) AS e FROM fr), m AS (SELECT label, avg(e) FILTER (WHERE e > 1e-6) AS m FROM e GROUP BY ALL) SELECT label, count(*) FILTER (WHERE e > 1e-6 AND e >= m) AS voiced_frames, count(*) AS frames FROM e JOIN m USING (label) GROUP BY ALL""",
)
def vad_threshold(spark: SparkSession, d: str) -> DataFrame:
    f = _frames(spark, d).select("vec_id", "label", F.round(F.aggregate(F.slice("p", 1, 16), F.lit(0.0), lambda s, x: s + x), 9).alias("e"))
    v = fr.voiced(f, ["label"], "e")
    return v.groupBy("label").agg(F.sum(F.col("voiced").cast("long")).alias("voiced_frames"), F.count("*").alias("frames"))


# Pitch-like series: event values by user and type.
_SER = "s AS (SELECT user_id, event_type, event_id, epoch_us(ts) / 1e6 AS t, value FROM events WHERE value > 0)"


def _series(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("value > 0").select("user_id", "event_type", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value")


@query(
    "perturbation",
    f"""WITH {_SER}, w AS (SELECT user_id, value, abs(value - lag(value) OVER o) AS l, CASE WHEN count(*) OVER (o ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 3 THEN abs(value - avg(value) OVER (o ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) END AS a,
  CASE WHEN count(*) OVER (o ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5 THEN abs(value - avg(value) OVER (o ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) END AS b FROM s WINDOW o AS (PARTITION BY user_id, event_type ORDER BY event_id))
SELECT user_id, round(avg(l) / avg(value), 6) AS local, round(avg(a) / avg(value), 6) AS rap, round(avg(b) / avg(value), 6) AS ppq5 FROM w GROUP BY ALL""",
)
def perturbation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fr.perturbation(_series(spark, d), ["user_id"], "event_type", "event_id", "value", {"rap": 3, "ppq5": 5}))


@query(
    "semitone_mad",
    f"""WITH {_SER}, m AS (SELECT user_id, quantile_cont(value, 0.5) AS m FROM s GROUP BY ALL), x AS (SELECT user_id, 12 * log2(value / m) AS x FROM s JOIN m USING (user_id))
SELECT user_id, round(max(x) - min(x), 6) AS voice_f0_range_semitones, round(quantile_cont(abs(x), 0.5), 6) AS voice_f0_mad_semitones FROM x GROUP BY ALL""",
)
def semitone_mad(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fr.semitones(_series(spark, d), ["user_id"], "value"))


@query(
    "pitch_summary",
    f"""WITH {_SER} SELECT user_id, round(avg(value), 6) AS voice_f0_mean_hz, round(quantile_cont(value, 0.5), 6) AS voice_f0_median_hz, round(CASE WHEN count(*) > 1 THEN stddev_pop(value) END, 6) AS voice_f0_sd_hz, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS voice_f0_iqr_hz,
  round(quantile_cont(value, 0.95) - quantile_cont(value, 0.05), 6) AS voice_f0_range_5_95_hz, round(stddev_pop(value) / avg(value), 6) AS voice_f0_cv, round(regr_slope(value, t - 1704067200), 9) AS voice_f0_slope_hz_per_s FROM s GROUP BY ALL""",
)
def pitch_summary(spark: SparkSession, d: str) -> DataFrame:
    s = _series(spark, d).withColumn("t", F.col("t") - 1704067200)  # from the first day on, so that the slope keeps its digits
    out = fr.pitch_summary(s, ["user_id"], "value", "t").withColumnRenamed("voice_f0_slope_hz_per_s", "slope")
    return rounded(out.drop("slope")).join(out.select("user_id", F.round("slope", 9).alias("voice_f0_slope_hz_per_s")), "user_id")


@query(
    "nonlinear_voice",
    f"""WITH {_SER}, p AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, avg(value) OVER (PARTITION BY user_id) AS mean, stddev_pop(value) OVER (PARTITION BY user_id) AS sd FROM s),
x AS (SELECT * FROM p WHERE n >= 64),
line AS (SELECT user_id, regr_slope(ln(v), i) AS b, regr_intercept(ln(v), i) AS a FROM x GROUP BY ALL), res AS (SELECT user_id, n, ln(v) - a - b * i AS r FROM x JOIN line USING (user_id)),
cell AS (SELECT user_id, n, least(31, floor((r - min(r) OVER w) / (max(r) OVER w - min(r) OVER w) * 32)) AS c FROM res WINDOW w AS (PARTITION BY user_id)),
ppe AS (SELECT user_id, sum(-k / n * ln(k / n)) / ln(32) AS e FROM (SELECT user_id, n, c, count(*) AS k FROM cell GROUP BY ALL) GROUP BY ALL),
lag_ AS (SELECT a.user_id, a.n, b.i - a.i AS k, count(*) AS c FROM x a JOIN x b ON a.user_id = b.user_id AND b.i - a.i BETWEEN 1 AND least(100, a.n // 2) AND abs(b.v - a.v) <= 0.1 * a.sd GROUP BY ALL),
rp AS (SELECT user_id, sum(-c / t * ln(c / t)) / ln(least(100, any_value(n) // 2)) AS e FROM (SELECT *, sum(c) OVER (PARTITION BY user_id) AS t FROM lag_) GROUP BY ALL),
prof AS (SELECT user_id, i, n, sum(v - mean) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS y FROM x),
box AS (SELECT user_id, size, i // size AS b, regr_syy(y, i) - regr_sxy(y, i) ** 2 / regr_sxx(y, i) AS rss FROM prof, (VALUES (4), (8), (16), (32), (64)) AS z(size) WHERE i < n // size * size GROUP BY ALL),
df AS (SELECT user_id, regr_slope(ln(f), ln(size)) AS e FROM (SELECT user_id, size, sqrt(sum(rss) / (count(*) * size)) AS f FROM box GROUP BY user_id, size) GROUP BY ALL),
emb AS (SELECT *, lead(v) OVER (PARTITION BY user_id ORDER BY i) AS v2 FROM x), dist AS (SELECT a.user_id, sqrt((a.v - b.v) ** 2 + (a.v2 - b.v2) ** 2) AS d FROM emb a JOIN emb b ON a.user_id = b.user_id AND a.i < b.i AND a.v2 IS NOT NULL AND b.v2 IS NOT NULL),
pc AS (SELECT user_id, quantile_cont(d, 0.1) AS lo, quantile_cont(d, 0.6) AS hi, count(*) AS m FROM dist GROUP BY ALL), rad AS (SELECT user_id, lo * pow(hi / lo, k / 7) AS r, m FROM pc, generate_series(0, 7) AS g(k)),
cs AS (SELECT rad.user_id, r, count(*) / any_value(m) AS c FROM rad JOIN dist ON dist.user_id = rad.user_id AND d <= r GROUP BY ALL), cd AS (SELECT user_id, regr_slope(ln(c), ln(r)) AS e FROM cs GROUP BY ALL)
SELECT k.user_id, round(ppe.e, 6) AS voice_pitch_period_entropy, round(rp.e, 6) AS voice_rpde, round(df.e, 6) AS voice_dfa, round(cd.e, 6) AS voice_correlation_dimension
FROM (SELECT DISTINCT user_id FROM s) k LEFT JOIN ppe USING (user_id) LEFT JOIN rp USING (user_id) LEFT JOIN df USING (user_id) LEFT JOIN cd USING (user_id)""",
)
def nonlinear_voice(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nonlinear(_series(spark, d), "user_id", "event_id", "value"))


@query(
    "f0_moments",
    f"""WITH {_SER} SELECT user_id, round(CASE WHEN count(*) >= 3 AND stddev_pop(value) > 0 THEN skewness(value) END, 6) AS skewness, round(CASE WHEN count(*) >= 4 AND stddev_pop(value) > 0 THEN kurtosis(value) END, 6) AS kurtosis FROM s GROUP BY ALL""",
)
def f0_moments(spark: SparkSession, d: str) -> DataFrame:
    from voxtide.functions.exprs import kurt, skew

    return rounded(_series(spark, d).groupBy("user_id").agg(skew("value").alias("skewness"), kurt("value").alias("kurtosis")))


# Table utilities: the catalog, issues, targets and digests.


# The articulation keys, spelled out here once more.
_ARTICULATION = """
  ('artic_consonant_duration_mean_s'), ('artic_consonant_duration_sd_s'), ('artic_f1_within_vowel_sd_hz'), ('artic_f2_within_vowel_sd_hz'),
  ('artic_formant_centralization_ratio'), ('artic_formant_transition_slope_mean_hz_s'), ('artic_fricative_m1_mean'), ('artic_fricative_m2_mean'),
  ('artic_fricative_m3_mean'), ('artic_fricative_m4_mean'), ('artic_resonance_attenuation_mean_db'), ('artic_stop_gap_mean_s'), ('artic_stop_gap_sd_s'),
  ('artic_vot_mean_s'), ('artic_vot_sd_s'), ('artic_vowel_articulation_index'), ('artic_vowel_dispersion_mean_hz'), ('artic_vowel_dispersion_sd_hz'),
  ('artic_vowel_space_area_hz2')"""


@query("catalog_filter", f"SELECT key, 'motor_neuro' AS pack, 'recording' AS level, 'articulation' AS domain FROM (VALUES {_ARTICULATION}) v(key)")
def catalog_filter(spark: SparkSession, d: str) -> DataFrame:
    from voxtide import catalog

    return catalog.table(spark, pack="motor_neuro", domain="articulation").drop("unit")


_ISSUE_KEYS = ("audio_duration_s", "audio_rms_dbfs", "time_speech_ratio", "voice_f0_mean_hz", "voice_hnr_mean_db", "lex_token_ttr")


@query(
    "issues_long",
    "WITH t AS (SELECT DISTINCT recording_id, speaker_id, load_id, row_id, " + ", ".join(f"CASE WHEN {c}::VARCHAR <> 'nan' THEN {c} END AS {c}" for c in _ISSUE_KEYS) + " FROM feature_recording)"
    + " UNION ALL ".join(f" SELECT recording_id, speaker_id, row_id, '{c}' AS feature FROM t WHERE {c} IS NULL" for c in _ISSUE_KEYS),
)
def issues_long(spark: SparkSession, d: str) -> DataFrame:
    """One issue for each value that is missing."""
    t = table(spark, d, "feature_recording").select("recording_id", "speaker_id", "load_id", "row_id", *_ISSUE_KEYS).distinct()
    gone = F.array_compact(F.array(*(F.when(F.col(c).isNull() | F.isnan(c), F.lit(c)) for c in _ISSUE_KEYS)))
    return t.select("recording_id", "speaker_id", "row_id", F.explode(gone).alias("feature"))


@query(
    "manifest_targets",
    "SELECT DISTINCT r.recording_id, cluster AS number, element_at(cluster_to_role, cluster)[1] AS role FROM speaker_result r, unnest(map_keys(cluster_to_role)) u(cluster)",
)
def manifest_targets(spark: SparkSession, d: str) -> DataFrame:
    """Each recording with each of its clusters and the role of it."""
    return table(spark, d, "speaker_result").select("recording_id", F.explode("cluster_to_role").alias("number", "role")).distinct()


@query("dedupe_digest", "SELECT session_id, participant_id, any_value(sha256(concat_ws('|', coalesce(audio_path, ''), sha256))) AS digest, count(*) AS n FROM (SELECT DISTINCT manifest_id, session_id, participant_id, audio_path, sha256 FROM manifest_row WHERE audio_path IS NOT NULL AND sha256 IS NOT NULL) GROUP BY session_id, participant_id HAVING count(DISTINCT concat_ws('|', audio_path, sha256)) = 1")
def dedupe_digest(spark: SparkSession, d: str) -> DataFrame:
    """One digest per asset, where all rows of a session and participant name the same."""
    t = table(spark, d, "manifest_row").where("audio_path is not null and sha256 is not null").select("manifest_id", "session_id", "participant_id", "audio_path", "sha256").distinct()
    asset = F.concat_ws("|", "audio_path", "sha256")
    return t.groupBy("session_id", "participant_id").agg(F.sha2(F.min(asset), 256).alias("digest"), F.count("*").alias("n"), F.count_distinct(asset).alias("k")).where("k = 1").drop("k")


@query(
    "word_grouping",
    f"""WITH {TOK_SQL}, s AS (SELECT recording_id, utt_idx, row_number() OVER (PARTITION BY recording_id, utt_idx ORDER BY tok_idx) - 1 AS p, start_s, end_s FROM tok),
n AS (SELECT recording_id, utt_idx, count(*) AS n FROM s GROUP BY ALL), g AS (SELECT recording_id, utt_idx, p // 2 AS pos, min(start_s) AS start_ms, max(end_s) AS end_ms FROM s GROUP BY ALL)
SELECT recording_id, utt_idx, pos::INT AS pos, CASE WHEN n % 2 = 0 THEN start_ms END AS start_ms, CASE WHEN n % 2 = 0 THEN end_ms END AS end_ms, n % 2 = 0 AS aligned FROM g JOIN n USING (recording_id, utt_idx)""",
)
def word_grouping(spark: SparkSession, d: str) -> DataFrame:
    """Words of two syllables each; an utterance of an odd number of syllables doesn't add up."""
    w = Window.partitionBy("recording_id", "utt_idx").orderBy("tok_idx")
    s = tokens(spark, d).select("recording_id", "utt_idx", (F.row_number().over(w) - 1).alias("pos"), F.col("start_s").alias("start_ms"), F.col("end_s").alias("end_ms"))
    words = s.select("recording_id", "utt_idx", F.floor(F.col("pos") / 2).cast("int").alias("pos")).distinct().withColumn("size", F.lit(2))
    return tr.group_words(words, s, ["recording_id", "utt_idx"])


@query("spelled_sessions")
def spelled_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Numerals in documents as words."""
    return tr.spelled_text(table(spark, d, "documents").select("doc_id", "text"), "text").where("spelled <> text").select("doc_id", "spelled")


@query("cohort_model")
def cohort_model(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold probabilities that a feature row belongs to the participant, folds by recording."""
    t = table(spark, d, "feature_recording").distinct().where("speaker_id in ('PAR', 'INV')").withColumn("y", (F.col("speaker_id") == "PAR").cast("double"))
    fs = ["time_words_per_min", "time_speech_ratio", "voice_f0_mean_hz", "lex_token_ttr"]
    t = t.withColumns({f: F.when(~F.isnan(f), F.col(f)) for f in fs})
    return rounded(ev.cross_validated(t, fs, "y", "recording_id", folds=3, strengths=(0.01, 1.0)))

