"""Sentences, clauses, phrases, cohesion, information and error measures from annotation layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtide.functions.exprs import count_if, ratio
from voxtide.operators.annotations import binary, complete, consistent

KEY = ["recording_id", "speaker_id"]
# Labels that the layers use.
ERRORS = ("phonemic", "phonetic", "semantic", "visual", "morphological", "inflectional", "syntactic", "closed_class", "neologism", "perseveration", "circumlocution", "indefinite_term", "word_finding")
CLAUSE_TYPES = ("main", "independent", "coordinate", "dependent", "embedded", "subordinate")
SENTENCE_STATUSES = ("well_formed", "incomplete", "reduced")
NO_LABEL = ("", "none", "null", "na", "n/a")
PSYCHOLINGUISTIC = ("frequency", "log_frequency", "familiarity", "age_of_acquisition", "imageability", "concreteness")


def label(c: str) -> Column:
    """A label without regard to case and spaces at its ends; null where it says that there is none."""
    x = F.lower(F.trim(F.col(c).cast("string")))
    return F.when(~x.isin(list(NO_LABEL)), x)


def units(words: DataFrame) -> DataFrame:
    """Sentences, T-units and clauses with words in each; null unless the layer is complete.

    A clause is a (sentence, clause) pair; its type, and the status of a sentence, must agree inside it and be
    among the known ones: an unknown type or status makes what counts them null, as does a missing one.
    """
    words = words.withColumns({c: label(c) for c in ("sentence_id", "t_unit_id", "clause_id", "clause_type", "sentence_status")})
    s_ok, t_ok, c_ok = complete(F.col("sentence_id").isNotNull()), complete(F.col("t_unit_id").isNotNull()), complete(F.col("sentence_id").isNotNull() & F.col("clause_id").isNotNull())
    base = words.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.when(s_ok, F.count_distinct("sentence_id")).alias("morph_sentence_count"), F.when(t_ok, F.count_distinct("t_unit_id")).alias("morph_t_unit_count"),
        F.when(c_ok, F.count_distinct("sentence_id", "clause_id")).alias("clauses"),
    )
    typed = consistent(words.where("sentence_id is not null and clause_id is not null"), [*KEY, "sentence_id", "clause_id"], "clause_type").groupBy(*KEY).agg(
        complete(F.col("one") & F.col("clause_type").isin(list(CLAUSE_TYPES))).alias("ok"), count_if(F.col("clause_type") == "embedded").alias("embedded"), count_if(F.col("clause_type").isin("dependent", "embedded", "subordinate")).alias("dependent"), F.count("*").alias("m"),
    )
    status = consistent(words, [*KEY, "sentence_id"], "sentence_status").groupBy(*KEY).agg(
        complete(F.col("one") & F.col("sentence_status").isin(list(SENTENCE_STATUSES))).alias("sok"), *(count_if(F.col("sentence_status") == s).alias(s) for s in SENTENCE_STATUSES), F.count("*").alias("k")
    )
    j = base.join(typed, KEY, "left").join(status, KEY, "left")
    out = {
        "morph_words_per_sentence": ratio("n", "morph_sentence_count"), "morph_words_per_t_unit": ratio("n", "morph_t_unit_count"), "morph_words_per_clause": ratio("n", "clauses"),
        "morph_clauses_per_sentence": ratio("clauses", "morph_sentence_count"), "morph_embedding_count": F.when(F.col("ok") & F.col("clauses").isNotNull(), F.col("embedded")), "morph_dependent_clause_ratio": F.when(F.col("ok") & F.col("clauses").isNotNull(), ratio("dependent", "m")),
    } | {f"morph_{s}_sentence_ratio": F.when(F.col("sok"), ratio(s, "k")) for s in SENTENCE_STATUSES}
    return j.select(*KEY, "morph_sentence_count", "morph_t_unit_count", *(e.alias(k) for k, e in out.items()))


def phrase_runs(words: DataFrame) -> DataFrame:
    """How many runs of neighbouring words of an utterance share each phrase type."""
    w = Window.partitionBy(*KEY, "utt_idx").orderBy("tok_idx")
    start = F.col("phrase_type").isNotNull() & ~F.coalesce(F.lag("phrase_type").over(w) == F.col("phrase_type"), F.lit(False))
    t = words.withColumn("start", start)
    return t.groupBy(*KEY).agg(*(count_if(F.col("start") & (F.col("phrase_type") == p)).alias(f"morph_{n}_count") for p, n in (("coordinate", "coordinate_phrase"), ("complex_nominal", "complex_nominal"), ("verb_phrase", "verb_phrase"))))


def numeric_layers(words: DataFrame, layers: dict[str, str]) -> DataFrame:
    """Mean (and maximum, for depth) of complete number layers, by feature name."""
    return words.groupBy(*KEY).agg(*(F.when(complete(F.col(c).isNotNull() & ~F.isnan(c)), (F.max if k.endswith("_max") else F.avg)(c)).alias(k) for k, c in layers.items()))


def cohesion(words: DataFrame) -> DataFrame:
    """Shares of the sparse cohesion labels, and the mean of the sparse pronoun layer."""
    n = F.count("cohesion_type")
    return words.groupBy(*KEY).agg(
        *(ratio(count_if(F.col("cohesion_type") == c), n).alias(f"discourse_{c}_cohesion_ratio") for c in ("referential", "temporal", "causal")), F.avg("pronoun_reference_correct").alias("discourse_correct_pronoun_ratio")
    )


def lexical_coherence(words: DataFrame) -> DataFrame:
    """Mean Jaccard likeness of the word sets of neighbouring utterances of a speaker (those with words).

    Shared words meet by (utterance order, word), so no set is held: |A and B| from a join on the word, |A or B| by sizes.
    """
    order = Window.partitionBy(*KEY).orderBy("utt_idx")
    types = words.select(*KEY, "utt_idx", "norm").distinct()
    size = types.groupBy(*KEY, "utt_idx").agg(F.count("*").alias("n")).withColumns({"k": F.row_number().over(order), "p": F.lag("n").over(order)})
    numbered = types.join(size.select(*KEY, "utt_idx", "k"), [*KEY, "utt_idx"]).select(*KEY, "k", "norm")
    before = numbered.select(*KEY, (F.col("k") + 1).alias("k"), "norm")
    shared = numbered.join(before, [*KEY, "k", "norm"]).groupBy(*KEY, "k").agg(F.count("*").alias("both"))
    pairs = size.where("p is not null").join(shared, [*KEY, "k"], "left").fillna(0, ["both"])
    return pairs.groupBy(*KEY).agg(F.avg(F.col("both") / (F.col("n") + F.col("p") - F.col("both"))).alias("discourse_local_lexical_coherence"))


def topic(words: DataFrame, utterances: DataFrame) -> DataFrame:
    """Share of relevant words, and of utterances with any; null unless the layer is complete and 0/1."""
    ok = complete(binary("topic_relevant"))
    rel = words.groupBy(*KEY, "utt_idx").agg(F.sum("topic_relevant").alias("r"), F.count("*").alias("n"), ok.alias("ok"))
    n_utt = utterances.groupBy(*KEY).agg(F.count("*").alias("n_utt"))
    t = rel.groupBy(*KEY).agg(complete(F.col("ok")).alias("ok"), F.sum("r").alias("r"), F.sum("n").alias("n"), count_if(F.col("r") > 0).alias("u")).join(n_utt, KEY)
    return t.select(*KEY, F.when(F.col("ok"), ratio("r", "n")).alias("discourse_global_coherence_ratio"), F.when(F.col("ok"), ratio("u", "n_utt")).alias("discourse_topic_maintenance_ratio"))


def information(words: DataFrame, spans: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Roles, details and information units: counts, densities over words and units per minute of the speaker's span.

    ``reference``: the units (``unit``) that the task's specification knows.
    """
    role = lambda r: count_if(F.col("discourse_role") == r)
    t = words.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_distinct("information_unit").alias("units"), *(role(r).alias(r) for r in ("marker", "microproposition", "macroproposition", "relevant", "irrelevant"))).join(spans, KEY, "left")
    details = F.col("relevant") + F.col("irrelevant")
    cols = {
        "semantic_idea_density": ratio("units", "n"), "semantic_proposition_density": ratio(F.col("microproposition") + F.col("macroproposition"), F.col("n")), "discourse_marker_ratio": ratio("marker", "n"),
        "discourse_relevant_detail_ratio": ratio(F.col("relevant"), details), "discourse_irrelevant_detail_ratio": ratio(F.col("irrelevant"), details),
        "discourse_microproposition_count": F.col("microproposition"), "discourse_macroproposition_count": F.col("macroproposition"), "discourse_information_unit_count": F.col("units"),
        "discourse_information_efficiency_per_min": ratio(F.col("units"), F.col("span_s") / 60),
    }
    out = t.select(*KEY, "units", *(e.alias(k) for k, e in cols.items()))
    if reference is not None:
        hit = words.select(*KEY, F.col("information_unit").alias("unit")).distinct().join(reference.select("unit").distinct(), "unit", "left_semi").groupBy(*KEY).agg(F.count("*").alias("hits"))
        out = out.join(hit, KEY, "left").withColumn("discourse_content_accuracy_ratio", ratio(F.coalesce("hits", F.lit(0)), F.col("units"))).drop("hits")
    return out.drop("units")


def errors(tok: DataFrame) -> DataFrame:
    """Count of each sparse error label, and its ratio to tokens of kind word."""
    n = count_if(F.col("kind") == "word")
    cols = []
    for e in ERRORS:
        c = count_if(F.col("error_type") == e)
        cols += [c.alias(f"disfluency_{e}_error_count"), ratio(c, n).alias(f"disfluency_{e}_error_ratio")]
    return tok.groupBy(*KEY).agg(*cols)
