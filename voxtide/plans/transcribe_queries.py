"""Queries of windows, repair, alignment, scoring and tagging, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voxtide.operators import alignment, scoring, transcription as tr, windows
from voxtide.plans.eval_queries import _PAIR, _merged_sql, _pairs
from voxtide.plans.relations import DUR_SQL, TOK_SQL, durations, tokens
from voxtide.plans.speech_queries import KEY, rounded
from voxtide.sources import tagging, tiers
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


_BARE = "trim({}, '.,!?…')"
_NORMAL = f"""{DUR_SQL}, dm AS (SELECT recording_id, round(duration_s * 1000)::BIGINT AS d FROM dur),
s0 AS (SELECT s.segment_id, s.recording_id, dm.d, CASE WHEN start_ms >= 0 AND end_ms > start_ms AND end_ms <= coalesce(d, end_ms) THEN start_ms END AS ss, CASE WHEN start_ms >= 0 AND end_ms > start_ms AND end_ms <= coalesce(d, end_ms) THEN end_ms END AS se,
    array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: {_BARE.format('x')}), lambda x: x <> ''), ' ') AS text
  FROM (SELECT DISTINCT segment_id, recording_id, start_ms, end_ms, text FROM asr_segment) s LEFT JOIN dm USING (recording_id)),
w0 AS (SELECT s.segment_id, w.word_no, {_BARE.format("coalesce(w.word, '')")} AS word, w.start_ms, w.end_ms, coalesce(w.start_ms >= 0 AND w.end_ms > w.start_ms AND w.end_ms <= coalesce(d, w.end_ms), false) AND coalesce(w.start_ms >= ss AND w.end_ms <= se, ss IS NULL) AS fits
  FROM (SELECT DISTINCT segment_id, word_no, word, start_ms, end_ms FROM word_timing WHERE segment_id IS NOT NULL) w JOIN s0 s USING (segment_id)),
w1 AS (SELECT *, max(CASE WHEN fits THEN start_ms END) OVER (PARTITION BY segment_id ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w0 WHERE word <> ''),
w AS (SELECT segment_id, word_no, word, CASE WHEN fits AND start_ms >= coalesce(before, start_ms) THEN start_ms END AS start_ms, CASE WHEN fits AND start_ms >= coalesce(before, start_ms) THEN end_ms END AS end_ms FROM w1),
sp AS (SELECT segment_id, min(start_ms) AS lo, max(end_ms) AS hi, bool_or(regexp_matches(word, '[\\p{{L}}\\p{{N}}]')) AND bool_and(NOT regexp_matches(word, '[\\p{{L}}\\p{{N}}]') OR start_ms IS NOT NULL) AS every FROM w GROUP BY ALL)"""


def _normal(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    seg = table(spark, d, "asr_segment").select("segment_id", "recording_id", "start_ms", "end_ms", "text").distinct()
    words = table(spark, d, "word_timing").where("segment_id is not null").select("segment_id", "word_no", "word", "start_ms", "end_ms").distinct()
    return windows.normalize_segments(seg, words, durations(spark, d).select("recording_id", F.round(F.col("duration_s") * 1000).cast("long").alias("duration_ms")))


@query("segment_normalized", f"WITH {_NORMAL} SELECT recording_id, segment_id, CASE WHEN ss IS NULL AND every THEN lo ELSE ss END AS start_ms, CASE WHEN ss IS NULL AND every THEN hi ELSE se END AS end_ms, text FROM s0 LEFT JOIN sp USING (segment_id)")
def segment_normalized(spark: SparkSession, d: str) -> DataFrame:
    return _normal(spark, d)[0]


@query("word_normalized", f"WITH {_NORMAL} SELECT segment_id, word_no, word, start_ms, end_ms FROM w")
def word_normalized(spark: SparkSession, d: str) -> DataFrame:
    return _normal(spark, d)[1]


@query(
    "suspected_repetition",
    f"""WITH t AS (SELECT segment_id, unnest(l) AS raw, unnest(range(len(l))) AS i FROM (SELECT DISTINCT segment_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS l FROM asr_segment WHERE text IS NOT NULL)),
b AS (SELECT *, {_BARE.format('raw')} AS tok FROM t),
r AS (SELECT *, i - row_number() OVER (PARTITION BY segment_id, tok ORDER BY i) AS run FROM (SELECT segment_id, tok, row_number() OVER (PARTITION BY segment_id ORDER BY i) AS i FROM b WHERE tok <> '')),
m AS (SELECT segment_id, max(n) AS longest FROM (SELECT segment_id, count(*) AS n FROM r GROUP BY segment_id, tok, run) GROUP BY ALL),
a AS (SELECT segment_id, count(*) AS n, count(DISTINCT raw) AS u, bool_or(tok IN ('unk', '<unk>')) AS unk FROM b GROUP BY ALL)
SELECT segment_id, n AS tokens, coalesce(longest, 0) AS longest_run, u AS different, unk OR coalesce(longest, 0) >= 8 OR (n >= 20 AND u < 0.3 * n) AS suspected FROM a LEFT JOIN m USING (segment_id)""",
)
def suspected_repetition(spark: SparkSession, d: str) -> DataFrame:
    seg = table(spark, d, "asr_segment").where("text is not null").select("segment_id", "text").distinct()
    return windows.suspected_repetition(seg.select("segment_id", F.posexplode(F.split("text", r"\s+")).alias("i", "word")), ["segment_id"], "i", "word")


# Frames: the values of a user's events in order stand for levels.
@query(
    "quiet_cuts",
    """WITH RECURSIVE f AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
c AS (SELECT user_id, v, -1::BIGINT AS no, 0::BIGINT AS s, 0::BIGINT AS e FROM f
  UNION ALL
  SELECT user_id, v, no + 1, e, CASE WHEN len(v) <= e + 20 THEN len(v) WHEN list_min(v[e + 15:e + 20]) >= v[e + 20] THEN e + 20 ELSE e + 13 + list_position(v[e + 15:e + 20], list_min(v[e + 15:e + 20])) END FROM c WHERE e < len(v))
SELECT user_id, no AS window_no, s AS first, e AS end FROM c WHERE no >= 0""",
)
def quiet_cuts(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").where("user_id is not null").withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    return windows.quiet_cuts(ev, ["user_id"], "at", "value", 20, 6)


@query(
    "fold_windows",
    f"""WITH RECURSIVE w0 AS (SELECT recording_id, start_ms, end_ms + 700 AS end_ms FROM diarization_turn WHERE end_ms > start_ms), m AS ({_merged_sql('w0', 'recording_id')}),
p AS (SELECT recording_id, greatest(0, s - 30) AS s, e - 670 AS e FROM m), c AS (SELECT *, unnest(generate_series(0, (e - s - 1) // 20000)) AS i FROM p),
w AS (SELECT recording_id, s + i * 20000 AS s, least(e, s + (i + 1) * 20000) AS e, row_number() OVER (PARTITION BY recording_id ORDER BY s + i * 20000) AS k FROM c),
f AS (SELECT recording_id, k, s, e FROM w WHERE k = 1
  UNION ALL SELECT w.recording_id, w.k, CASE WHEN w.e - f.s <= 20000 THEN f.s ELSE w.s END, CASE WHEN w.e - f.s <= 20000 THEN greatest(w.e, f.e) ELSE w.e END FROM f JOIN w ON w.recording_id = f.recording_id AND w.k = f.k + 1)
SELECT recording_id, s AS start_ms, max(e) AS end_ms FROM f GROUP BY recording_id, s""",
)
def fold_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.fold_windows(tr.window_merge(table(spark, d, "diarization_turn")), ["recording_id"], "start_ms", "end_ms", 20_000)


# An aligner's path: each token's label stands in one to three frames, behind every other token follows a blank (0).
_CTC = f"""{TOK_SQL}, tg AS (SELECT {KEY}, utt_idx, tok_idx, 1 + length(norm) % 5 AS label, 1 + token_id % 3 AS n, token_id % 2 AS z, sum(1 + token_id % 3 + token_id % 2) OVER (PARTITION BY {KEY}, utt_idx ORDER BY tok_idx) AS upto FROM tok)"""


def _path(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = Window.partitionBy("recording_id", "speaker_id", "utt_idx").orderBy("tok_idx")
    n, z = 1 + F.col("token_id") % 3, F.col("token_id") % 2
    t = tokens(spark, d).select("recording_id", "speaker_id", "utt_idx", "tok_idx", (1 + F.char_length("norm") % 5).alias("label"), n.alias("n"), z.alias("z"), F.sum(n + z).over(w).alias("upto"))
    label = F.concat(F.array_repeat("label", F.col("n").cast("int")), F.array_repeat(F.lit(0), F.col("z").cast("int")))
    frames = t.select("recording_id", "speaker_id", "utt_idx", (F.col("upto") - F.col("n") - F.col("z")).alias("from"), F.posexplode(label).alias("i", "label"))
    return frames.withColumn("frame", F.col("from") + F.col("i")), t.select("recording_id", "speaker_id", "utt_idx", F.col("tok_idx").alias("pos"), "label", F.col("tok_idx").alias("word"))


@query(
    "ctc_word_spans",
    f"""WITH {_CTC}, ok AS (SELECT {KEY}, utt_idx, bool_and(z = 1 OR nxt IS NULL OR nxt <> label) AS ok FROM (SELECT *, lead(label) OVER (PARTITION BY {KEY}, utt_idx ORDER BY tok_idx) AS nxt FROM tg) GROUP BY ALL)
SELECT {KEY}, utt_idx, tok_idx AS word, CASE WHEN ok THEN round_even((upto - n - z) * 20, 0)::BIGINT END AS start_ms, CASE WHEN ok THEN round_even((upto - z) * 20, 0)::BIGINT END AS end_ms FROM tg JOIN ok USING ({KEY}, utt_idx)""",
)
def ctc_word_spans(spark: SparkSession, d: str) -> DataFrame:
    """Two tokens of one label without a blank between them are one run, which leaves the whole utterance without times."""
    frames, targets = _path(spark, d)
    return alignment.aligned_words(frames, targets, ["recording_id", "speaker_id", "utt_idx"], 0, 20.0)


@query(
    "evaluate_report",
    f"""WITH RECURSIVE {_PAIR}, x AS (SELECT recording_id, speaker_id, utt_idx, list_filter(g, lambda w: w <> '') AS g, list_filter(coalesce(p, []), lambda w: w <> '') AS p FROM pair),
items AS (SELECT 'wer' AS metric, recording_id, utt_idx, g, p FROM x UNION ALL SELECT 'syer', recording_id, utt_idx, g, p FROM x UNION ALL SELECT 'cer', recording_id, utt_idx, string_split(array_to_string(g, ''), ''), string_split(array_to_string(p, ''), '') FROM x),
dp AS (SELECT metric, recording_id, utt_idx, g, p, 0 AS i, range(len(p) + 1) AS r FROM (SELECT metric, recording_id, utt_idx, CASE WHEN g = [''] THEN [] ELSE g END AS g, CASE WHEN p = [''] THEN [] ELSE p END AS p FROM items)
  UNION ALL
  SELECT metric, recording_id, utt_idx, g, p, i + 1, list_reduce(range(1, len(p) + 1), lambda acc, j: list_append(acc, least(acc[j] + 1, r[j + 1] + 1, r[j] + CASE WHEN g[i + 1] = p[j] THEN 0 ELSE 1 END)), [i + 1]) FROM dp WHERE i < len(g))
SELECT metric, count(*) AS sessions, round(avg(CASE WHEN len(g) = 0 THEN 0 ELSE least(1, r[len(p) + 1] / len(g)) END), 6) AS mean FROM dp WHERE i = len(g) GROUP BY ALL""",
)
def evaluate_report(spark: SparkSession, d: str) -> DataFrame:
    """Mean capped rates over utterances, each of which stands for a session."""
    pairs = scoring.plain_items(scoring.plain_items(_pairs(spark, d), "gold", "g"), "predicted", "p")
    return rounded(scoring.report(scoring.session_scores(pairs, "g", "p"), scoring.METRICS))


@query(
    "lenient_items",
    """WITH l AS (SELECT doc_id, list_transform(list_filter(string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: regexp_matches(trim(x), '^\\*[A-Za-z0-9]+:')), lambda x: regexp_replace(regexp_replace(trim(x), '^\\*[A-Za-z0-9]+:', ''), '[\\x15•]\\d+_\\d+[\\x15•]', '', 'g')) AS t FROM (SELECT DISTINCT doc_id, text FROM documents)),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(nfc_normalize(array_to_string(t, ' ')), '\\s+'), lambda x: x NOT IN ('', '.', '?', '!', ',', '...', '…')) AS w FROM l)
SELECT doc_id, len(w) AS words, coalesce(list_sum(list_transform(w, lambda x: len(string_split(x, '_')))), 0)::BIGINT AS syllables, coalesce(list_sum(list_transform(w, lambda x: length(replace(x, '_', '')))), 0)::BIGINT AS characters FROM w""",
)
def lenient_items(spark: SparkSession, d: str) -> DataFrame:
    """What a lenient scan of each document as a CHAT text finds on its speaker tiers."""
    t = scoring.lenient_items(table(spark, d, "documents").select("doc_id", "text").distinct(), "text", "w")
    total = lambda f: F.aggregate(F.transform("w", f), F.lit(0), lambda a, x: a + x).cast("long")
    return t.select("doc_id", F.size("w").cast("long").alias("words"), total(lambda x: F.size(F.split(x, "_"))).alias("syllables"), total(lambda x: F.char_length(F.translate(x, "_", ""))).alias("characters"))


@query(
    "tag_preserved",
    """WITH l AS (SELECT doc_id, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+$') AS l FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text <> '')), x AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS no FROM l),
y AS (SELECT *, sum((line LIKE '*%')::INT) OVER (PARTITION BY doc_id ORDER BY no) AS u, line LIKE ' %' OR line LIKE (chr(9) || '%') AS cont FROM x),
z AS (SELECT *, sum((NOT cont)::INT) OVER (PARTITION BY doc_id ORDER BY no) AS block FROM y),
b AS (SELECT doc_id, block, min(no) AS no, arg_min(line, no) LIKE '*%' AS own, string_agg(line, '' ORDER BY no) AS line, any_value(u) AS u FROM z GROUP BY ALL)
SELECT doc_id, md5(string_agg(line || CASE WHEN own THEN CASE WHEN line LIKE ('%' || chr(10)) THEN '' ELSE chr(10) END || '%mor:' || chr(9) || 'x|' || u || chr(10) || '%gra:' || chr(9) || '1|0|ROOT' || chr(10) ELSE '' END, '' ORDER BY no)) AS content_md5 FROM b GROUP BY doc_id""",
)
def tag_preserved(spark: SparkSession, d: str) -> DataFrame:
    """New morphology for every speaker tier of each document, all else as it was."""
    docs = table(spark, d, "documents").where("text <> ''").select(F.col("doc_id").alias("path"), F.col("text").alias("content")).distinct()
    made = docs.withColumn("n", F.size(F.filter(F.split("content", "\n"), lambda x: x.startswith("*")))).where("n > 0").select("path", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("u"))
    t = made.select("path", (F.col("u") - 1).alias("utt_idx"), F.concat(F.lit("x|"), F.col("u").cast("string")).alias("mor"), F.lit("1|0|ROOT").alias("gra"))
    return tagging.replace_morphology(docs, t)[0].select(F.col("path").alias("doc_id"), F.md5("content").alias("content_md5"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Items of the speaker tiers of documents that are CHAT texts."""
    lines = table(spark, d, "documents").select("doc_id", "text").distinct().select("doc_id", F.posexplode(F.split("text", "\n")).alias("utt_idx", "line")).where(F.col("line").rlike(r"^\*[A-Z]{3}:"))
    return lines.select("doc_id", "utt_idx", F.posexplode(F.split(F.trim(F.regexp_replace("line", r"^\*[A-Z]{3}:\s*", "")), r"\s+")).alias("tok_idx", "text"))


@query("mor_projection")
def mor_projection(spark: SparkSession, d: str) -> DataFrame:
    """The words that morphology sees on the speaker tiers of documents."""
    k = ["doc_id", "utt_idx"]
    return tiers.morphology_words(tiers.tier_roles(_items(spark, d), k), k)


@query("speaker_clusters")
def speaker_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of each label in two clusters."""
    return alignment.clusters(table(spark, d, "embeddings"), "label", "vec_id", "embedding")
