"""Measures over annotation layers, tasks and motor segments, on layers that are derived from the token ids."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voxtide.operators import annotations as ann, clinical, morphosyntax as morph, motor, tasks
from voxtide.plans.relations import TOK_SQL, tokens, utterances
from voxtide.plans.speech_queries import _TURNS, KEY, clusters, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# Fixed values, spelled out here once more so that the SQL doesn't read the operators' own.
_UPOS = ("ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X")
_TAGS = ", ".join(f"'{t}'" for t in _UPOS)
_RELS = ("nsubj", "obj", "nmod", "advmod", "ccomp", "conj", "case", "xcomp", "discourse", "acl", "obl", "obl:agent", "dobj", "nummod", "det", "clf", "compound", "nmod:poss", "dislocated", "advcl", "parataxis", "csubj", "iobj")
_REL_LIST = ", ".join(f"'{r}'" for r in _RELS)
_ERRORS = ("phonemic", "phonetic", "semantic", "visual", "morphological", "inflectional", "syntactic", "closed_class", "neologism", "perseveration", "circumlocution", "indefinite_term", "word_finding")
_ERR_LIST = ", ".join(f"'{e}'" for e in _ERRORS)

# One derivation, in words that both engines know: every layer is a function of the token's id and place.
_LAYERS = f"""
  upper(element_at({{arr}}({_TAGS}){{at}}, CAST(1 + (token_id * 7 + length(norm)) % 17 AS INT))) AS upos,
  CAST(utt_idx * 100 + tok_idx // 8 AS BIGINT) AS sentence_id, CAST(utt_idx * 100 + tok_idx // 12 AS BIGINT) AS t_unit_id, CAST(tok_idx // 4 AS BIGINT) AS clause_id,
  element_at({{arr}}('main', 'dependent', 'embedded', 'subordinate', 'coordinate'){{at}}, CAST(1 + (utt_idx + tok_idx // 4) % 5 AS INT)) AS clause_type,
  CASE WHEN (tok_idx // 2 + utt_idx) % 4 > 0 THEN element_at({{arr}}('coordinate', 'complex_nominal', 'verb_phrase'){{at}}, CAST((tok_idx // 2 + utt_idx) % 4 AS INT)) END AS phrase_type,
  element_at({{arr}}('well_formed', 'incomplete', 'reduced'){{at}}, CAST(1 + (utt_idx * 3 + tok_idx // 8) % 3 AS INT)) AS sentence_status,
  CAST(1 + token_id % 97 AS DOUBLE) AS frequency, CASE WHEN token_id % 1013 > 0 THEN CAST(token_id % 9 AS DOUBLE) END AS familiarity,
  CASE WHEN token_id % 701 > 0 THEN CAST(token_id % 2 AS INT) END AS topic_relevant, CAST(token_id % 2 AS INT) AS is_classifier,
  CASE token_id % 11 WHEN 0 THEN 'referential' WHEN 1 THEN 'temporal' WHEN 2 THEN 'causal' END AS cohesion_type, CASE WHEN token_id % 17 < 4 THEN CAST(token_id % 2 AS INT) END AS pronoun_reference_correct,
  CASE token_id % 13 WHEN 0 THEN 'marker' WHEN 1 THEN 'microproposition' WHEN 2 THEN 'macroproposition' WHEN 3 THEN 'relevant' WHEN 4 THEN 'irrelevant' END AS discourse_role,
  CASE WHEN token_id % 19 < 2 THEN concat('u', CAST(token_id % 5 AS {{str}})) END AS information_unit,
  CASE WHEN token_id % 29 < 13 THEN element_at({{arr}}({_ERR_LIST}){{at}}, CAST(1 + token_id % 29 AS INT)) END AS error_type,
  CASE WHEN norm IN ('the', 'a', 'and', 'was', 'i') THEN 'eng' WHEN token_id % 499 = 0 THEN NULL ELSE 'vie' END AS language"""


def _layers(dialect: str) -> str:
    if dialect == "spark":
        s = _LAYERS.replace("{arr}", "array").replace("{at}", "").replace("{str}", "STRING")
        return re.sub(r"(\w+) // (\d+)", r"floor(\1 / \2)", s)
    return _LAYERS.replace("element_at({arr}(", "list_extract(list_value(").replace("{at}", "").replace("{str}", "VARCHAR")


LAY_SQL = TOK_SQL + f""",
lay AS (SELECT *, {_layers('duckdb')} FROM tok),
rep AS (SELECT * FROM lay WHERE kind = 'word' QUALIFY row_number() OVER (PARTITION BY {KEY}, utt_idx, coalesce('g' || word_id, 't' || token_id) ORDER BY tok_idx) = 1)"""


def layered(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).selectExpr("*", *_split(_layers("spark")))


def _split(exprs: str) -> list[str]:
    """The expressions of a select list."""
    out, depth, cur, quoted = [], 0, "", False
    for c in exprs:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(cur.strip())
            cur = ""
        else:
            cur += c
    return [*out, cur.strip()]


def _share(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


@query(
    "upos_ratios",
    f"""WITH {LAY_SQL} SELECT {KEY}, {', '.join(f"round({_share(f"upos = '{t}'")} / count(*), 6) AS morph_upos_{t.lower()}_ratio" for t in _UPOS)},
  round({_share("upos IN ('ADJ','ADV','NOUN','PROPN','VERB')")} / count(*), 6) AS morph_content_word_ratio, round({_share("upos IN ('ADP','AUX','CCONJ','DET','PART','PRON','SCONJ')")} / count(*), 6) AS morph_function_word_ratio,
  round({_share("upos IN ('NOUN','PROPN')")} / nullif({_share("upos = 'VERB'")}, 0), 6) AS morph_noun_verb_ratio, round({_share("upos = 'PRON'")} / nullif({_share("upos IN ('NOUN','PROPN')")}, 0), 6) AS morph_pronoun_noun_ratio FROM rep GROUP BY ALL""",
)
def upos_ratios(spark: SparkSession, d: str) -> DataFrame:
    return rounded(morph.tag_ratios(ann.words(layered(spark, d))))


@query(
    "completeness_gate",
    f"""WITH {LAY_SQL} SELECT {KEY}, CASE WHEN count(topic_relevant) = count(*) THEN round(avg(topic_relevant), 6) END AS topic_mean, round(avg(is_classifier), 6) AS morph_classifier_ratio,
  CASE WHEN count(familiarity) = count(*) THEN round(avg(familiarity), 6) END AS lex_familiarity_mean, round(avg(frequency), 6) AS lex_frequency_mean, CASE WHEN count(language) = count(*) THEN round({_share("language <> 'vie'")} / count(*), 6) END AS morph_code_switch_ratio
FROM rep GROUP BY ALL""",
)
def completeness_gate(spark: SparkSession, d: str) -> DataFrame:
    w = ann.words(layered(spark, d))
    k = ["recording_id", "speaker_id"]
    out = morph.binary_means(w, {"topic_mean": "topic_relevant", "morph_classifier_ratio": "is_classifier"})
    out = out.join(clinical.numeric_layers(w, {"lex_familiarity_mean": "familiarity", "lex_frequency_mean": "frequency"}), k).join(morph.code_switching(w, "vie"), k)
    return rounded(out)


_DEP_SQL = f"""{LAY_SQL},
reps AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, utt_idx ORDER BY tok_idx) AS k, lag(token_id) OVER (PARTITION BY {KEY}, utt_idx ORDER BY tok_idx) AS prev, first_value(token_id) OVER (PARTITION BY {KEY}, utt_idx ORDER BY tok_idx) AS fst FROM rep),
dep AS (SELECT *, CASE WHEN k = 1 THEN 'root' ELSE list_extract(list_value({_REL_LIST}), (1 + token_id % {len(_RELS)})::INT) END AS rel, CASE WHEN k = 1 THEN NULL WHEN token_id % 3 = 0 THEN fst ELSE prev END AS head FROM reps)"""


def _dependency_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = layered(spark, d)
    reps = ann.words(t).select("recording_id", "token_id").withColumn("is_word", F.lit(True))


    w = Window.partitionBy("recording_id", "speaker_id", "utt_idx").orderBy("tok_idx")
    r = t.join(reps, ["recording_id", "token_id"])
    rel = F.when(F.row_number().over(w) == 1, "root").otherwise(F.element_at(F.array(*map(F.lit, _RELS)), (1 + F.col("token_id") % len(_RELS)).cast("int")))
    head = F.when(F.row_number().over(w) == 1, None).when(F.col("token_id") % 3 == 0, F.first("token_id").over(w)).otherwise(F.lag("token_id").over(w))
    heads = r.select("recording_id", "token_id", "is_word", rel.alias("dep_rel"), head.alias("dep_head"))
    return t.join(heads, ["recording_id", "token_id"], "left").fillna(False, ["is_word"])


_GROUP = """WHEN rel = 'root' THEN 'root' WHEN rel IN ('nsubj', 'nsubj:pass', 'csubj', 'csubj:pass') THEN 'subject' WHEN rel IN ('obj', 'iobj') THEN 'object'
  WHEN rel IN ('amod', 'nmod', 'nmod:poss', 'appos', 'compound') THEN 'nominal_modifier' WHEN rel IN ('advmod', 'obl', 'obl:agent', 'dislocated') THEN 'adverbial_modifier'
  WHEN rel IN ('ccomp', 'xcomp', 'advcl', 'acl', 'acl:relcl') THEN 'clausal_complement' WHEN rel IN ('conj', 'cc') THEN 'coordination' WHEN rel IN ('case', 'mark', 'det', 'aux', 'aux:pass', 'cop', 'clf') THEN 'function'"""
_GROUPS = ("root", "subject", "object", "nominal_modifier", "adverbial_modifier", "clausal_complement", "coordination", "function", "other")


@query(
    "dep_structure",
    f"""WITH RECURSIVE {_DEP_SQL},
walk(recording_id, speaker_id, utt_idx, token_id, cur, depth) AS (
  SELECT recording_id, speaker_id, utt_idx, token_id, head, 0 FROM dep
  UNION ALL SELECT w.recording_id, w.speaker_id, w.utt_idx, w.token_id, p.head, w.depth + 1 FROM walk w JOIN dep p ON p.token_id = w.cur AND p.recording_id = w.recording_id),
dp AS (SELECT {KEY}, token_id, max(depth) AS depth FROM walk GROUP BY ALL),
pos AS (SELECT recording_id, token_id, row_number() OVER (PARTITION BY {KEY}, utt_idx ORDER BY tok_idx) AS i FROM tok),
e AS (SELECT d.*, CASE {_GROUP} ELSE 'other' END AS grp, dp.depth, abs(a.i - b.i) AS edge FROM dep d JOIN dp USING ({KEY}, token_id) JOIN pos a ON a.token_id = d.token_id AND a.recording_id = d.recording_id LEFT JOIN pos b ON b.token_id = d.head AND b.recording_id = d.recording_id),
n AS (SELECT {KEY}, count(*) AS n_utt FROM utt GROUP BY ALL),
c AS (SELECT {KEY}, count(*) AS n, {', '.join(f"{_share(f"grp = '{g}'")} AS {g}_n" for g in _GROUPS)}, avg(edge) AS em, CASE WHEN count(edge) > 1 THEN stddev_pop(edge) END AS es, avg(depth) AS dm, max(depth)::BIGINT AS dx,
  {_share("rel IN ('root','csubj','csubj:pass','ccomp','xcomp','advcl','acl','acl:relcl')")} AS cl, {_share("rel IN ('csubj','csubj:pass','ccomp','xcomp','advcl','acl','acl:relcl')")} AS sub FROM e GROUP BY ALL)
SELECT {KEY}, {', '.join(f"round({g}_n / n, 6) AS morph_dep_{g}_ratio" for g in _GROUPS)}, round(em, 6) AS morph_dependency_length_mean_tokens, round(es, 6) AS morph_dependency_length_sd_tokens, round(dm, 6) AS morph_tree_depth_mean, dx AS morph_tree_depth_max,
  cl AS morph_clause_count, sub AS morph_subordinate_clause_count, round(cl / n_utt, 6) AS morph_clause_rate_per_utterance, round(sub / nullif(cl, 0), 6) AS morph_subordination_ratio FROM c JOIN n USING ({KEY})""",
)
def dep_structure(spark: SparkSession, d: str) -> DataFrame:
    return rounded(morph.dependencies(_dependency_tokens(spark, d), utterances(spark, d)))


_ST = ("well_formed", "incomplete", "reduced")


@query(
    "sentence_stats",
    f"""WITH {LAY_SQL}, b AS (SELECT {KEY}, count(*) AS n, count(DISTINCT sentence_id) AS s, count(DISTINCT t_unit_id) AS t, count(DISTINCT (sentence_id, clause_id)) AS c FROM rep GROUP BY ALL),
cl AS (SELECT {KEY}, sentence_id, clause_id, min(clause_type) AS ty, min(clause_type) = max(clause_type) AS one FROM rep GROUP BY ALL),
ct AS (SELECT {KEY}, bool_and(one) AS ok, {_share("ty = 'embedded'")} AS emb, {_share("ty IN ('dependent','embedded','subordinate')")} AS dep, count(*) AS m FROM cl GROUP BY ALL),
st AS (SELECT {KEY}, bool_and(one) AS sok, {', '.join(f"{_share(f"ss = '{x}'")} AS {x}" for x in _ST)}, count(*) AS k FROM (SELECT {KEY}, sentence_id, min(sentence_status) AS ss, min(sentence_status) = max(sentence_status) AS one FROM rep GROUP BY ALL) GROUP BY ALL)
SELECT {KEY}, s AS morph_sentence_count, t AS morph_t_unit_count, round(n / s, 6) AS morph_words_per_sentence, round(n / t, 6) AS morph_words_per_t_unit, round(n / c, 6) AS morph_words_per_clause, round(c / s, 6) AS morph_clauses_per_sentence,
  CASE WHEN ok THEN emb END AS morph_embedding_count, CASE WHEN ok THEN round(dep / m, 6) END AS morph_dependent_clause_ratio, {', '.join(f"CASE WHEN sok THEN round({x} / k, 6) END AS morph_{x}_sentence_ratio" for x in _ST)}
FROM b JOIN ct USING ({KEY}) JOIN st USING ({KEY})""",
)
def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clinical.units(ann.words(layered(spark, d))))


@query(
    "phrase_runs",
    f"""WITH {LAY_SQL}, r AS (SELECT {KEY}, phrase_type AS p, coalesce(lag(phrase_type) OVER (PARTITION BY {KEY}, utt_idx ORDER BY tok_idx) = phrase_type, false) AS same FROM rep)
SELECT {KEY}, {_share("p = 'coordinate' AND NOT same")} AS morph_coordinate_phrase_count, {_share("p = 'complex_nominal' AND NOT same")} AS morph_complex_nominal_count, {_share("p = 'verb_phrase' AND NOT same")} AS morph_verb_phrase_count FROM r GROUP BY ALL""",
)
def phrase_runs(spark: SparkSession, d: str) -> DataFrame:
    return clinical.phrase_runs(ann.words(layered(spark, d)))


@query(
    "cohesion_ratios",
    f"""WITH {LAY_SQL} SELECT {KEY}, {', '.join(f"round({_share(f"cohesion_type = '{x}'")} / nullif(count(cohesion_type), 0), 6) AS discourse_{x}_cohesion_ratio" for x in ('referential', 'temporal', 'causal'))}, round(avg(pronoun_reference_correct), 6) AS discourse_correct_pronoun_ratio FROM rep GROUP BY ALL""",
)
def cohesion_ratios(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clinical.cohesion(ann.words(layered(spark, d))))


@query(
    "jaccard_coherence",
    f"""WITH {TOK_SQL}, s AS (SELECT {KEY}, utt_idx, list(DISTINCT norm) AS l FROM tok WHERE kind = 'word' GROUP BY ALL), p AS (SELECT {KEY}, l, lag(l) OVER (PARTITION BY {KEY} ORDER BY utt_idx) AS q FROM s)
SELECT {KEY}, round(avg(len(list_intersect(l, q)) / len(list_distinct(list_concat(l, q)))), 6) AS discourse_local_lexical_coherence FROM p WHERE q IS NOT NULL GROUP BY ALL""",
)
def jaccard_coherence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clinical.lexical_coherence(tokens(spark, d).where("kind = 'word'")))


@query(
    "topic_maintenance",
    f"""WITH {LAY_SQL}, u AS (SELECT {KEY}, utt_idx, sum(topic_relevant) AS r, count(*) AS n, count(topic_relevant) AS m FROM rep GROUP BY ALL), n AS (SELECT {KEY}, count(*) AS n_utt FROM utt GROUP BY ALL)
SELECT {KEY}, CASE WHEN sum(u.m) = sum(u.n) THEN round(sum(r) / sum(u.n), 6) END AS discourse_global_coherence_ratio, CASE WHEN sum(u.m) = sum(u.n) THEN round({_share('r > 0')} / any_value(n_utt), 6) END AS discourse_topic_maintenance_ratio FROM u JOIN n USING ({KEY}) GROUP BY ALL""",
)
def topic_maintenance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clinical.topic(ann.words(layered(spark, d)), utterances(spark, d)))


@query(
    "info_units",
    f"""WITH {LAY_SQL}, sp AS (SELECT {KEY}, max(end_s) - min(start_s) AS span FROM utt GROUP BY ALL),
c AS (SELECT {KEY}, count(*) AS n, count(DISTINCT information_unit) AS u, count(DISTINCT information_unit) FILTER (WHERE information_unit IN ('u0', 'u1', 'u2')) AS hits, {', '.join(f"{_share(f"discourse_role = '{x}'")} AS {x}" for x in ('marker', 'microproposition', 'macroproposition', 'relevant', 'irrelevant'))} FROM rep GROUP BY ALL)
SELECT {KEY}, round(u / n, 6) AS semantic_idea_density, round((microproposition + macroproposition) / n, 6) AS semantic_proposition_density, round(marker / n, 6) AS discourse_marker_ratio, round(relevant / nullif(relevant + irrelevant, 0), 6) AS discourse_relevant_detail_ratio,
  round(irrelevant / nullif(relevant + irrelevant, 0), 6) AS discourse_irrelevant_detail_ratio, microproposition AS discourse_microproposition_count, macroproposition AS discourse_macroproposition_count, u AS discourse_information_unit_count,
  round(u / nullif(span / 60, 0), 6) AS discourse_information_efficiency_per_min, round(hits / nullif(u, 0), 6) AS discourse_content_accuracy_ratio FROM c LEFT JOIN sp USING ({KEY})""",
)
def info_units(spark: SparkSession, d: str) -> DataFrame:
    spans = utterances(spark, d).groupBy("recording_id", "speaker_id").agg((F.max("end_s") - F.min("start_s")).alias("span_s"))
    return rounded(clinical.information(ann.words(layered(spark, d)), spans, spark.createDataFrame([("u0",), ("u1",), ("u2",)], "unit string")))


@query(
    "error_types",
    f"""WITH {LAY_SQL} SELECT {KEY}, {', '.join(f"{_share(f"error_type = '{e}'")} AS disfluency_{e}_error_count, round({_share(f"error_type = '{e}'")} / nullif({_share("kind = 'word'")}, 0), 6) AS disfluency_{e}_error_ratio" for e in _ERRORS)} FROM lay GROUP BY ALL""",
)
def error_types(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clinical.errors(layered(spark, d)))


# A picture task's concepts, in order, with their aliases (some near-spellings of words in the tables).
ALIASES = (("window", "window"), ("window", "windows"), ("bus", "bus"), ("bridge", "bridge"), ("bridge", "bridgess"), ("corner", "corners"), ("umbrella", "umbrela"), ("photograph", "photograp"), ("trophy", "trophyy"), ("recipe", "recipes"))
CONCEPTS = tuple(dict.fromkeys(k for k, _ in ALIASES))


def _aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, CONCEPTS.index(k), a) for k, a in ALIASES], "key string, key_pos int, alias string")


_ALIAS_SQL = f"al(key, key_pos, alias) AS (VALUES {', '.join(f"('{k}', {CONCEPTS.index(k)}, '{a}')" for k, a in ALIASES)})"
_MATCH_SQL = f"""{TOK_SQL}, {_ALIAS_SQL}, v AS (SELECT DISTINCT norm FROM tok WHERE kind = 'word' AND norm <> ''),
ex AS (SELECT norm, arg_min(key, key_pos) AS key FROM v JOIN al ON alias = norm GROUP BY 1),
dp AS (SELECT norm, alias, key, key_pos, string_split(norm, '') AS g, string_split(alias, '') AS p, 0 AS i, range(length(alias) + 1) AS r FROM v, al
    WHERE norm NOT IN (SELECT norm FROM ex) AND least(length(norm), length(alias)) >= 0.85 * greatest(length(norm), length(alias))
  UNION ALL SELECT norm, alias, key, key_pos, g, p, i + 1, list_reduce(range(1, len(p) + 1), lambda acc, j: list_append(acc, least(acc[j] + 1, r[j + 1] + 1, r[j] + CASE WHEN g[i + 1] = p[j] THEN 0 ELSE 1 END)), [i + 1]) FROM dp WHERE i < len(g)),
nr AS (SELECT norm, arg_min(key, key_pos) AS key FROM dp WHERE i = len(g) AND 1 - r[len(p) + 1] / greatest(len(g), len(p)) >= 0.85 GROUP BY 1),
m AS (SELECT * FROM ex UNION ALL SELECT * FROM nr)"""


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Words of any letters."""
    return tokens(spark, d).where("kind = 'word' and norm <> ''")


@query("alias_match", f"WITH RECURSIVE {_MATCH_SQL} SELECT norm, key FROM m")
def alias_match(spark: SparkSession, d: str) -> DataFrame:
    return tasks.match_aliases(_words(spark, d), "norm", _aliases(spark))


@query(
    "picture_coverage",
    f"""WITH RECURSIVE {_MATCH_SQL}, w AS (SELECT * FROM tok WHERE kind = 'word' AND norm <> ''), n AS (SELECT {KEY}, count(*) AS n FROM w GROUP BY ALL), h AS (SELECT {KEY}, count(*) AS h, count(DISTINCT key) AS u FROM w JOIN m USING (norm) GROUP BY ALL)
SELECT {KEY}, round(coalesce(u, 0) / {len(CONCEPTS)}, 6) AS task_picture_concept_coverage, round(coalesce(u, 0) / n, 6) AS task_picture_concept_density, round((h - u) / h, 6) AS task_repeat_ratio FROM n LEFT JOIN h USING ({KEY})""",
)
def picture_coverage(spark: SparkSession, d: str) -> DataFrame:
    w = _words(spark, d)
    hits = w.join(tasks.match_aliases(w, "norm", _aliases(spark)), "norm")
    return rounded(tasks.coverage(hits, w, len(CONCEPTS), "task_picture_concept"))


@query(
    "recall_order",
    f"""WITH RECURSIVE {_MATCH_SQL}, f AS (SELECT {KEY}, key_pos, min(utt_idx * 1000000 + tok_idx) AS place FROM tok JOIN m USING (norm) JOIN (SELECT DISTINCT key, key_pos FROM al) USING (key) WHERE kind = 'word' GROUP BY ALL),
lis AS (SELECT {KEY}, key_pos, place, 1 AS n FROM f UNION SELECT f.recording_id, f.speaker_id, f.key_pos, f.place, n + 1 FROM lis JOIN f ON f.recording_id = lis.recording_id AND f.speaker_id = lis.speaker_id AND f.place > lis.place AND f.key_pos > lis.key_pos)
SELECT {KEY}, round(max(n) / {len(CONCEPTS)}, 6) AS task_recall_order_score FROM lis GROUP BY ALL""",
)
def recall_order(spark: SparkSession, d: str) -> DataFrame:
    w = _words(spark, d)
    keys = _aliases(spark).select("key", "key_pos").distinct()
    return rounded(tasks.recall_order(w.join(tasks.match_aliases(w, "norm", _aliases(spark)), "norm").join(F.broadcast(keys), "key"), len(CONCEPTS)))


_RESP = f"""{TOK_SQL}, resp AS (SELECT u.recording_id, u.speaker_id, u.utt_idx, u.start_s, u.end_s, t.norm FROM utt u JOIN (SELECT recording_id, utt_idx, arg_min(norm, tok_idx) AS norm FROM tok WHERE kind = 'word' GROUP BY ALL) t USING (recording_id, utt_idx) WHERE u.start_s IS NOT NULL AND u.end_s IS NOT NULL)"""


def _responses(spark: SparkSession, d: str) -> DataFrame:
    first = tokens(spark, d).where("kind = 'word'").groupBy("recording_id", "utt_idx").agg(F.min_by("norm", "tok_idx").alias("norm"))
    return utterances(spark, d).where("start_s is not null and end_s is not null").join(first, ["recording_id", "utt_idx"]).select("recording_id", "speaker_id", "utt_idx", "start_s", "end_s", "norm")


@query(
    "fluency",
    f"""WITH {_RESP}, r AS (SELECT *, length(norm) <= 3 AS ok, CASE WHEN length(norm) <= 3 AND norm < 'u' THEN substr(norm, 1, 1) END AS cat FROM resp),
sp AS (SELECT {KEY}, min(start_s) AS lo, max(end_s) AS hi FROM r GROUP BY ALL),
c AS (SELECT {KEY}, count(*) AS n, {_share('ok')} AS v, count(DISTINCT norm) FILTER (WHERE ok) AS u, {_share('ok AND start_s < (lo + hi) / 2')} AS f, any_value(hi - lo) AS span FROM r JOIN sp USING ({KEY}) GROUP BY ALL),
w AS (SELECT {KEY}, cat, lag(cat) OVER (PARTITION BY {KEY} ORDER BY start_s, utt_idx) AS p FROM r WHERE cat IS NOT NULL),
k AS (SELECT {KEY}, {_share('p IS NULL OR p <> cat')} AS cl, count(*) AS m, {_share('p <> cat')} AS sw FROM w GROUP BY ALL)
SELECT {KEY}, n AS task_fluency_response_count, v AS task_fluency_valid_count, u AS task_fluency_valid_unique, f AS task_fluency_first_half_valid, v - u AS task_fluency_repeats, n - v AS task_fluency_intrusions, v - f AS task_fluency_second_half_valid, v - 2 * f AS task_fluency_production_change,
  round(u / nullif(span / 60, 0), 6) AS task_fluency_rate, coalesce(cl, 0) AS task_fluency_clusters, coalesce(sw, 0) AS task_fluency_switches, round(m / nullif(cl, 0), 6) AS task_fluency_cluster_size_mean FROM c LEFT JOIN k USING ({KEY})""",
)
def fluency(spark: SparkSession, d: str) -> DataFrame:
    r = _responses(spark, d)
    valid = r.select("norm").distinct().where("length(norm) <= 3").withColumn("category", F.when(F.col("norm") < "u", F.substring("norm", 1, 1)))
    return rounded(tasks.fluency(r, valid, "norm"))


# Motor segments: diarization turns stand in; type, label and formants follow from the id and the length.
_SEG = f"""{_TURNS}, seg AS (SELECT recording_id, turn_id AS token_id, start_ms / 1000 AS start_s, end_ms / 1000 AS end_s,
  CASE turn_id % 5 WHEN 0 THEN 'vowel' WHEN 1 THEN 'stop' WHEN 2 THEN 'fricative' WHEN 3 THEN 'vowel' ELSE 'pause' END AS segment_type, CASE turn_id % 3 WHEN 0 THEN 'i' WHEN 1 THEN 'a' ELSE 'u' END AS segment_label,
  (300 + (turn_id * 37) % 500)::DOUBLE AS f1_hz, (800 + (turn_id * 91) % 1600)::DOUBLE AS f2_hz, (turn_id % 50) / 1000 AS vot_s, CASE WHEN turn_id % 997 > 0 THEN (turn_id % 20)::DOUBLE END AS spectral_moment_1,
  CASE turn_id % 7 WHEN 0 THEN 'gaping' WHEN 1 THEN 'subharmonic' ELSE 'voiced' END AS interval_type, (100 + turn_id % 80)::DOUBLE AS f0_hz, (turn_id % 30)::DOUBLE AS power_db, turn_id // 6 AS breath_group FROM turns)"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("turn_id")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (1 + i % n).cast("int"))
    return clusters(spark, d).select(
        "recording_id", i.alias("token_id"), (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"), pick(5, "vowel", "stop", "fricative", "vowel", "pause").alias("segment_type"), pick(3, "i", "a", "u").alias("segment_label"),
        (300 + (i * 37) % 500).cast("double").alias("f1_hz"), (800 + (i * 91) % 1600).cast("double").alias("f2_hz"), ((i % 50) / 1000).alias("vot_s"), F.when(i % 997 > 0, (i % 20).cast("double")).alias("spectral_moment_1"),
        pick(7, "gaping", "subharmonic", *["voiced"] * 5).alias("interval_type"), (100 + i % 80).cast("double").alias("f0_hz"), (i % 30).cast("double").alias("power_db"), F.floor(i / 6).alias("breath_group"),
    )


@query(
    "vowel_space",
    f"""WITH {_SEG}, m AS (SELECT recording_id, segment_label AS l, quantile_cont(f1_hz, 0.5) AS f1, quantile_cont(f2_hz, 0.5) AS f2 FROM seg WHERE segment_type = 'vowel' GROUP BY ALL),
p AS (SELECT recording_id, {', '.join(f"max({f}) FILTER (WHERE l = '{x}') AS {f}{x}" for x in 'iau' for f in ('f1', 'f2'))} FROM m GROUP BY ALL)
SELECT recording_id, round(abs(f1i * (f2a - f2u) + f1a * (f2u - f2i) + f1u * (f2i - f2a)) / 2, 6) AS artic_vowel_space_area_hz2, round((f2i + f1a) / (f1i + f1u + f2u + f2a), 6) AS artic_vowel_articulation_index, round((f1i + f1u + f2u + f2a) / (f2i + f1a), 6) AS artic_formant_centralization_ratio FROM p""",
)
def vowel_space(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motor.vowel_space(_segments(spark, d)))


@query(
    "within_label_sd",
    f"""WITH {_SEG}, v AS (SELECT * FROM seg WHERE segment_type = 'vowel'), c AS (SELECT recording_id, avg(f1_hz) AS c1, avg(f2_hz) AS c2 FROM v GROUP BY ALL),
s AS (SELECT recording_id, CASE WHEN count(*) > 1 THEN stddev_pop(f1_hz) END AS s1, CASE WHEN count(*) > 1 THEN stddev_pop(f2_hz) END AS s2 FROM v GROUP BY recording_id, segment_label),
w AS (SELECT recording_id, avg(s1) AS w1, avg(s2) AS w2 FROM s GROUP BY ALL),
d AS (SELECT v.*, sqrt((f1_hz - c1) ** 2 + (f2_hz - c2) ** 2) AS d, lead(start_s) OVER q - start_s AS dt, lead(f2_hz) OVER q - f2_hz AS df FROM v JOIN c USING (recording_id) WINDOW q AS (PARTITION BY recording_id ORDER BY start_s, token_id))
SELECT recording_id, round(avg(d), 6) AS artic_vowel_dispersion_mean_hz, round(CASE WHEN count(*) > 1 THEN stddev_pop(d) END, 6) AS artic_vowel_dispersion_sd_hz, round(avg(CASE WHEN dt > 0 THEN abs(df / dt) END), 6) AS artic_formant_transition_slope_mean_hz_s,
  round(any_value(w1), 6) AS artic_f1_within_vowel_sd_hz, round(any_value(w2), 6) AS artic_f2_within_vowel_sd_hz FROM d JOIN w USING (recording_id) GROUP BY recording_id""",
)
def within_label_sd(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motor.vowel_dispersion(_segments(spark, d)))


@query(
    "consonant_layers",
    f"""WITH {_SEG}, c AS (SELECT recording_id, count(*) FILTER (WHERE segment_type = 'fricative' AND spectral_moment_1 IS NULL) AS gone, avg(vot_s) FILTER (WHERE segment_type = 'stop') AS vm, CASE WHEN count(*) FILTER (WHERE segment_type = 'stop') > 1 THEN stddev_pop(vot_s) FILTER (WHERE segment_type = 'stop') END AS vs,
  avg(spectral_moment_1) FILTER (WHERE segment_type = 'fricative') AS fm, CASE WHEN count(*) FILTER (WHERE segment_type = 'fricative') > 1 THEN stddev_pop(spectral_moment_1) FILTER (WHERE segment_type = 'fricative') END AS fs,
  avg(end_s - start_s) FILTER (WHERE segment_type IN ('stop', 'fricative')) AS dm, CASE WHEN count(*) FILTER (WHERE segment_type IN ('stop', 'fricative')) > 1 THEN stddev_pop(end_s - start_s) FILTER (WHERE segment_type IN ('stop', 'fricative')) END AS ds FROM seg GROUP BY ALL)
SELECT recording_id, round(vm + 1e-9, 6) AS artic_vot_mean, round(vs + 1e-9, 6) AS artic_vot_sd, CASE WHEN gone = 0 THEN round(fm + 1e-9, 6) END AS artic_fricative_m1_mean, CASE WHEN gone = 0 THEN round(fs + 1e-9, 6) END AS artic_fricative_m1_sd, round(dm + 1e-9, 6) AS artic_consonant_duration_mean_s, round(ds + 1e-9, 6) AS artic_consonant_duration_sd_s FROM c""",
)
def consonant_layers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motor.consonants(_segments(spark, d), {"artic_vot": ("stop", "vot_s"), "artic_fricative_m1": ("fricative", "spectral_moment_1")}), nudge=1e-9)


@query(
    "rhythm_varco_pvi",
    f"""WITH {_SEG}, x AS (SELECT *, end_s - start_s AS len, CASE WHEN segment_type = 'vowel' THEN 'v' WHEN segment_type IN ('stop', 'fricative') THEN 'c' ELSE '-' END AS cls FROM seg),
n AS (SELECT *, CASE WHEN lag(cls) OVER (PARTITION BY recording_id ORDER BY start_s, token_id) = cls THEN 0 ELSE 1 END AS new FROM x),
e AS (SELECT recording_id, run, any_value(cls) AS cls, sum(len) AS d FROM (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY start_s, token_id ROWS UNBOUNDED PRECEDING) AS run FROM n) WHERE cls <> '-' GROUP BY recording_id, run),
d AS (SELECT *, lag(d) OVER (PARTITION BY recording_id, cls ORDER BY run) AS p FROM e)
SELECT recording_id, r.* EXCLUDE (recording_id) FROM (SELECT DISTINCT recording_id FROM seg) LEFT JOIN (SELECT recording_id, round(100 * sum(CASE WHEN cls = 'v' THEN d ELSE 0 END) / sum(d), 6) AS rhythm_percent_vocalic,
  {', '.join(f"round(100 * stddev_pop(d) FILTER (WHERE cls = '{c}') / avg(d) FILTER (WHERE cls = '{c}'), 6) AS rhythm_varco_{c}, round(avg(abs(d - p)) FILTER (WHERE cls = '{c}'), 6) AS rhythm_rpvi_{c}, round(100 * avg(abs(d - p) / ((d + p) / 2)) FILTER (WHERE cls = '{c}'), 6) AS rhythm_npvi_{c}" for c in 'vc')} FROM d GROUP BY ALL) r USING (recording_id)""",
)
def rhythm_varco_pvi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motor.rhythm(_segments(spark, d)))


@query(
    "ddk_intervals",
    f"""WITH {_SEG}, g AS (SELECT *, lead(start_s) OVER w - start_s AS g, lead(segment_label) OVER w AS nl, row_number() OVER w AS k, count(*) OVER (PARTITION BY recording_id) AS n FROM seg WINDOW w AS (PARTITION BY recording_id ORDER BY start_s, token_id)),
h AS (SELECT *, abs(g - lag(g) OVER (PARTITION BY recording_id ORDER BY k)) AS dg FROM g),
f AS (SELECT recording_id, any_value(n) AS n, max(end_s) FILTER (WHERE k = n) - min(start_s) AS span, avg(g) AS m, quantile_cont(g, 0.5) AS md, stddev_pop(g) AS sd, avg(dg) AS dg, regr_slope(1 / g, start_s + g / 2) FILTER (WHERE g > 0) AS acc,
  max(g) FILTER (WHERE k = 1) AS g1, max(g) FILTER (WHERE k = n - 1) AS g2, avg(end_s - start_s) AS len, avg((nl <> segment_label)::INT) AS alt, coalesce(bool_and(g > 0), false) AS rising FROM h GROUP BY ALL)
SELECT recording_id, {', '.join(f"CASE WHEN rising AND span > 0{c} THEN round({e}, 6) END AS task_ddk_{k}" for k, e, c in (("rate_syllables_s", "n / span", ""), ("inter_onset_mean_s", "m", ""), ("inter_onset_median_s", "md", ""), ("inter_onset_sd_s", "sd", ""), ("inter_onset_cv", "sd / m", ""), ("instability_s", "dg", ""), ("acceleration_syllables_s2", "acc", " AND n > 2"), ("decay_ratio", "g1 / g2", ""), ("voiced_interval_mean_s", "len", ""), ("sequential_alternating_ratio", "alt", "")))} FROM f""",
)
def ddk_intervals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motor.syllable_train(_segments(spark, d)))


@query(
    "breath_groups",
    f"""WITH {_SEG}, n AS (SELECT *, CASE WHEN lag(breath_group) OVER w = breath_group THEN 0 ELSE 1 END AS new FROM seg WINDOW w AS (PARTITION BY recording_id ORDER BY start_s, token_id)),
r AS (SELECT recording_id, min(start_s) AS s, max(end_s) AS e, count(*) FILTER (WHERE segment_type = 'pause') AS p FROM (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY start_s, token_id ROWS UNBOUNDED PRECEDING) AS run FROM n) GROUP BY recording_id, run)
SELECT recording_id, count(*) AS resp_breath_group_count, round(avg(e - s), 6) AS resp_breath_group_mean_s, round(CASE WHEN count(*) > 1 THEN stddev_pop(e - s) END, 6) AS resp_breath_group_sd_s, round(60 * count(*) / (max(e) - min(s)), 6) AS resp_rate_per_min, round(sum(p) / count(*), 6) AS resp_pauses_per_breath FROM r GROUP BY ALL""",
)
def breath_groups(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motor.breath_groups(_segments(spark, d).withColumn("is_pause", F.col("segment_type") == "pause")))


@query(
    "sustained_stats",
    f"""WITH {_SEG} SELECT recording_id, round(max(end_s - start_s), 6) AS task_max_phonation_time_s, round(60 * {_share("interval_type = 'gaping'")} / sum(end_s - start_s), 6) AS voice_gaping_interval_rate_per_min, round(sum(CASE WHEN interval_type = 'subharmonic' THEN end_s - start_s ELSE 0 END) / sum(end_s - start_s), 6) AS voice_subharmonic_interval_proportion,
  round(CASE WHEN count(*) > 1 THEN stddev_pop(12 * log2(f0_hz)) END, 6) AS voice_sustained_f0_sd_semitones, round(CASE WHEN count(*) > 1 THEN stddev_pop(power_db) END, 6) AS voice_sustained_power_sd_db FROM seg GROUP BY ALL""",
)
def sustained_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motor.sustained(_segments(spark, d)))


