"""Feature extraction over a batch: documents, sound and task specifications to recordings, utterances and issues.

A target that can't be analysed is an issue row and stops nothing else.  Every
value that is missing has exactly one issue.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voxtide import __version__, catalog
from voxtide.operators import acoustic, annotations as ann, clinical, conversation as conv, intervals, lexical as lex, morphosyntax as morph, motor, tasks
from voxtide.sources import wav
from voxtide.session import materialise
from voxtide.sources.documents import Documents

KEY = ["recording_id", "speaker_id"]
TEXT_LAYERS = ("upos", "sentence_id", "t_unit_id", "clause_id", "clause_type", "phrase_type", "sentence_status", "lemma", "cohesion_type", "discourse_role", "information_unit", "error_type")
NUMBER_LAYERS = ("classifier", "particle", "yngve_depth", "topic_relevant", "pronoun_reference_correct", *clinical.PSYCHOLINGUISTIC)
MOTOR_TEXT = ("segment_type", "segment_label", "breath_group", "interval_type")
MOTOR_NUMBERS = ("f1_hz", "f2_hz", "vot_s", "stop_gap_s", *(f"spectral_moment_{i}" for i in (1, 2, 3, 4)), "resonance_attenuation_db", "respiration_db", "speech_db", "f0_hz", "power_db")
ISSUE_COLUMNS = ("recording_id", "speaker_id", "utterance_id", "feature", "code", "severity", "message")


@dataclass
class Bundle:
    """``recordings``: one row per target with a column per feature; ``utterances`` likewise per utterance; ``issues``; ``provenance`` as JSON text."""

    recordings: DataFrame
    utterances: DataFrame
    issues: DataFrame
    provenance: str


@dataclass(frozen=True)
class TaskSpec:
    """``kind``: picture, recall, phonemic or semantic; ``aliases``: key -> aliases, in order; groups and categories as the kind needs."""

    kind: str
    aliases: dict[str, Sequence[str]] | None = None
    entity_groups: dict[str, Sequence[str]] | None = None
    action_groups: dict[str, Sequence[str]] | None = None
    initials: Sequence[str] = ()
    exclusions: Sequence[str] = ()
    categories: dict[str, str] | None = None

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, i, a) for i, (k, names) in enumerate((self.aliases or {}).items()) for a in names]
        return spark.createDataFrame(rows, "key string, key_pos int, alias string")


def targets(docs: Documents, wanted: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Targets (recording_id, speaker_id), and issues of recordings without one.

    ``wanted``: (recording_id, speaker_id) declared; others need exactly one speaker.  A recording without speakers has ''.
    """
    n = docs.utt.select("recording_id").distinct().unionByName(docs.speakers.select("recording_id").distinct()).distinct()
    per = docs.speakers.groupBy("recording_id").agg(F.count_distinct("speaker_id").alias("n"), F.min("speaker_id").alias("only"))
    all_ = n.join(per, "recording_id", "left").fillna(0, ["n"])
    if wanted is None:
        wanted = all_.select("recording_id", F.lit(None).cast("string").alias("speaker_id")).where("false")
    undeclared = all_.join(wanted.select("recording_id").distinct(), "recording_id", "left_anti")
    inferred = undeclared.where("n <= 1").select("recording_id", F.coalesce("only", F.lit("")).alias("speaker_id"))
    known = wanted.join(docs.speakers.select(*KEY).distinct(), KEY, "left_semi")
    unknown = wanted.join(docs.speakers.select(*KEY).distinct(), KEY, "left_anti").join(n, "recording_id", "left_semi")
    bad = undeclared.where("n > 1").select("recording_id", F.lit("").alias("speaker_id"), F.lit("TARGET_SPEAKER_REQUIRED").alias("code")).unionByName(unknown.select(*KEY, F.lit("UNKNOWN_TARGET_SPEAKER").alias("code")))
    return known.distinct().unionByName(inferred), bad


def _join(base: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    """All parts beside each other; each is written first, as plans of dozens of aggregates side by side take longer than the work."""
    for p in parts:
        base = base.join(materialise(p, "part")[0], KEY, "left")
    return base


def adult_neuro(docs: Documents, spec: TaskSpec | None) -> tuple[DataFrame, DataFrame]:
    """Recording and utterance features of words, disfluency, structure, discourse and task."""
    utt, tok = docs.utt, docs.tok
    w = materialise(ann.words(ann.attach(tok, docs.ann, [*TEXT_LAYERS, *NUMBER_LAYERS], NUMBER_LAYERS)), "words")[0]
    t = ann.attach(tok, docs.ann, ["error_type"])
    words = tok.where("kind = 'word'")
    heads = w.select("recording_id", "token_id").withColumn("is_word", F.lit(True))
    dep = tok.join(heads, ["recording_id", "token_id"], "left").fillna(False, ["is_word"])
    spans = utt.groupBy(*KEY).agg((F.max("end_s") - F.min("start_s")).alias("span_s"))
    lemma = w.where("lemma is not null")
    whole = w.groupBy(*KEY).agg(ann.complete(F.col("lemma").isNotNull()).alias("ok")).where("ok").drop("ok")
    lemma = lemma.join(whole, KEY, "left_semi")
    sizes = conv.turn_sizes(utt, tok)
    groups = F.when(F.col("word_id").isNotNull(), F.concat(F.lit("g"), "word_id")).otherwise(F.concat(F.lit("t"), F.col("token_id").cast("string")))
    per = utt.select(*KEY, "utt_idx", "utterance_id").join(words.groupBy(*KEY, "utt_idx").agg(F.count_distinct(groups).alias("discourse_turn_word_count"), F.count("*").alias("discourse_turn_syllable_count")), [*KEY, "utt_idx"], "left").fillna(0)
    turn_words = per.groupBy(*KEY).agg(F.avg("discourse_turn_word_count").alias("discourse_turn_length_mean_words"), F.when(F.count("*") > 1, F.stddev_pop("discourse_turn_word_count")).alias("discourse_turn_length_sd_words"))
    shared = conv.union_lengths(conv.overlaps(utt), [*KEY, "utt_idx"]).select(*KEY, "utt_idx", F.col("length").alias("discourse_turn_overlap_s"))
    per = per.join(shared, [*KEY, "utt_idx"], "left").fillna(0.0, ["discourse_turn_overlap_s"]).join(_latencies(utt), [*KEY, "utt_idx"], "left")
    reference = docs.utt.sparkSession.createDataFrame([(k,) for k in (spec.aliases or {})], "unit string") if spec is not None and spec.aliases else None
    layers = {f"lex_{p}_mean": p for p in clinical.PSYCHOLINGUISTIC} | {"morph_yngve_depth_mean": "yngve_depth", "morph_yngve_depth_max": "yngve_depth"}
    parts = [
        lex.counts(utt, tok), lex.lengths(tok), lex.diversity(words, "norm", "lex_token"), lex.ordered_diversity(words, "norm", ["utt_idx", "tok_idx"], "lex_token"), lex.diversity(lemma, "lemma", "lex_lemma"),
        lex.ordered_diversity(lemma, "lemma", ["utt_idx", "tok_idx"], "lex_lemma"), lex.disfluency(tok), sizes, turn_words, conv.ordered_latency(utt), conv.overlap_measures(utt), morph.tag_ratios(w),
        morph.binary_means(w, {"morph_classifier_ratio": "classifier", "morph_particle_ratio": "particle"}), morph.code_switching(w, "vie"), morph.dependencies(dep, utt), clinical.units(w), clinical.phrase_runs(w),
        clinical.numeric_layers(w, layers), clinical.cohesion(w), clinical.lexical_coherence(words), clinical.topic(w, utt), clinical.information(w, spans, reference), clinical.errors(t),
    ]
    if spec is not None:
        parts.append(_task(docs, spec))
    return _join(lex.speakers(utt).select(*KEY), parts), per


def _latencies(utt: DataFrame) -> DataFrame:
    w = Window.partitionBy("recording_id").orderBy("start_s", "end_s", "utterance_id")
    other = F.lag("speaker_id").over(w) != F.col("speaker_id")
    return utt.where("start_s is not null and end_s is not null").select(*KEY, "utt_idx", F.when(other, F.greatest(F.lit(0.0), F.col("start_s") - F.lag("end_s").over(w))).alias("discourse_response_latency_s"))


def _task(docs: Documents, spec: TaskSpec) -> DataFrame:
    words = docs.tok.where("kind = 'word'")
    if spec.kind in ("picture", "recall"):
        al = spec.table(docs.utt.sparkSession)
        hits = words.join(tasks.match_aliases(words, "norm", al), "norm").join(F.broadcast(al.select("key", "key_pos").distinct()), "key")
        n = len(spec.aliases or {})
        stem = "task_picture_concept" if spec.kind == "picture" else "task_recall_idea"
        out = tasks.coverage(hits, words, n, stem).withColumnRenamed("task_repeat_ratio", f"task_{spec.kind}_repeat_ratio")
        if spec.kind == "recall":
            return out.join(tasks.recall_order(hits, n), KEY, "left")
        for name, groups in (("entity", spec.entity_groups), ("action", spec.action_groups)):
            if groups:
                table = docs.utt.sparkSession.createDataFrame([(g, k) for g, ks in groups.items() for k in ks], "grp string, key string")
                found = hits.join(F.broadcast(table), "key").groupBy(*KEY).agg((F.count_distinct("grp") / F.lit(float(len(groups)))).alias(f"task_picture_{name}_coverage"))
                out = out.join(found, KEY, "left").fillna(0.0, [f"task_picture_{name}_coverage"])
        return out
    said = words.groupBy(*KEY, "utt_idx").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "norm"))), lambda x: x["norm"])).alias("norm"))
    resp = docs.utt.where("start_s is not null and end_s is not null").join(said, [*KEY, "utt_idx"])
    types = resp.select("norm").distinct()
    if spec.kind == "phonemic":
        valid = types.where(F.substring("norm", 1, 1).isin([i.casefold() for i in spec.initials]) & ~F.col("norm").isin([x.casefold() for x in spec.exclusions])).withColumn("category", F.lit(None).cast("string"))
    else:
        keys = tasks.match_aliases(types, "norm", spec.table(docs.utt.sparkSession))
        cat = F.create_map(*(F.lit(x) for kv in (spec.categories or {"": ""}).items() for x in kv))
        valid = keys.select("norm", F.try_element_at(cat, F.col("key")).alias("category"))
    return tasks.fluency(resp, valid, "norm")


def motor_neuro(docs: Documents) -> DataFrame:
    """Motor features of labelled segments."""
    seg = ann.attach(docs.tok, docs.ann, [*MOTOR_TEXT, *MOTOR_NUMBERS], MOTOR_NUMBERS).where("start_s is not null and end_s is not null")
    layers = {"artic_vot": ("stop", "vot_s"), "artic_stop_gap": ("stop", "stop_gap_s"), "resonance": ("consonant", "resonance_attenuation_db"), **{f"artic_fricative_m{i}": ("fricative", f"spectral_moment_{i}") for i in (1, 2, 3, 4)}}
    c = motor.consonants(seg, layers, KEY).withColumnsRenamed({"artic_vot_mean": "artic_vot_mean_s", "artic_vot_sd": "artic_vot_sd_s", "artic_stop_gap_mean": "artic_stop_gap_mean_s", "artic_stop_gap_sd": "artic_stop_gap_sd_s", "resonance_mean": "artic_resonance_attenuation_mean_db"}).drop("resonance_sd", *(f"artic_fricative_m{i}_sd" for i in (1, 2, 3, 4)))
    breath = motor.breath_groups(seg.where("breath_group is not null").withColumn("is_pause", F.coalesce(F.col("segment_type").isin("pause", "silence"), F.lit(False))), KEY)
    parts = [motor.vowel_space(seg, KEY), motor.vowel_dispersion(seg, KEY), c, motor.rhythm(seg, KEY), motor.syllable_train(seg.where("segment_label is not null"), KEY), breath, motor.sustained(seg.where("interval_type is not null or f0_hz is not null or power_db is not null"), KEY)]
    return _join(lex.speakers(docs.utt).select(*KEY), parts)


def acoustic_pack(docs: Documents, audio: DataFrame, who: DataFrame) -> DataFrame:
    """Acoustic features of the targets' own stretches of their recordings; ``audio``: recording_id, path, content."""
    info = wav.info(audio).where("error_code is null").join(audio.select("recording_id", "path"), "path")
    own = docs.utt.join(who, KEY, "left_semi")
    isl = intervals.periods_and_gaps(own, KEY, "start_s", "end_s", bucket_width=600)
    dur = info.select("recording_id", F.col("audio_duration_s").alias("duration_s"))
    clip = isl.join(dur, "recording_id").where("start_s < duration_s").withColumn("end_s", F.least("end_s", "duration_s"))
    ident = F.concat_ws("\x1f", *KEY)
    regions = clip.where("kind = 'period'").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.array("start_s", "end_s"))).alias("regions"))
    todo = who.join(audio.select("recording_id", "content"), "recording_id").join(regions, KEY, "left").select(ident.alias("path"), "content", "regions")
    gaps = clip.where("kind = 'gap'").select(ident.alias("path"), "start_s", (F.col("end_s") - F.col("start_s")).alias("d"))
    length = who.join(dur, "recording_id").select(ident.alias("path"), "duration_s")
    frames, _ = materialise(acoustic.marked(wav.frame_rows(todo)), "frames")  # sound is decoded once
    gaps, length = materialise(gaps, "gaps")[0], materialise(length, "length")[0]
    rows = acoustic.features(frames, gaps, length).join(who.select(*KEY, ident.alias("path")), "path").drop("path")
    tok = docs.tok.join(who, KEY, "left_semi")
    syl = tok.where("kind = 'word' and end_s > start_s").select(*KEY, "utt_idx", "tok_idx", (F.col("end_s") - F.col("start_s")).alias("d"))
    s = conv.successive_variability(syl, KEY, ["utt_idx", "tok_idx"], "d", "time_syllable_duration").withColumnsRenamed({"time_syllable_duration_mean": "time_syllable_duration_mean_s", "time_syllable_duration_sd": "time_syllable_duration_sd_s"}).drop("time_syllable_duration_rpvi")
    quality = info.select("recording_id", "audio_duration_s", "audio_dc_offset", "audio_clipping_ratio", "audio_rms_dbfs")
    out = _join(who, [rows, conv.speech_segments(own, dur), conv.asof_latency(docs.utt), conv.island_overlap(docs.utt), conv.speech_rates(own, tok), conv.local_rate_max(own, tok), s])
    return out.join(quality, "recording_id", "left")


def _shape(df: DataFrame, ids: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The identifier columns and a double for each key, null where the pack has none."""
    there = set(df.columns)
    return df.select(*ids, *((F.col(k).cast("double") if k in there else F.lit(None).cast("double")).alias(k) for k in keys))


# Issue codes by what a key depends on.
_CODES = {"acoustic": "NO_AUDIO", "adult_neuro": "INSUFFICIENT_TOKENS", "motor_neuro": "MISSING_ANNOTATION", "standardized_acoustic": "MISSING_OPTIONAL_DEPENDENCY"}
_LAYERED = ("morph_", "semantic_", "discourse_referential", "discourse_temporal", "discourse_causal", "discourse_correct", "discourse_global", "discourse_topic", "lex_lemma", *(f"lex_{p}_" for p in clinical.PSYCHOLINGUISTIC))


def issue_code(key: str, pack: str, has_audio: bool) -> str:
    if pack == "acoustic" and has_audio:
        return "NO_SPEECH" if key.startswith("time_") else "INSUFFICIENT_VOICED_FRAMES"
    if pack == "adult_neuro":
        return "INVALID_TASK_ANNOTATION" if key.startswith("task_") else "MISSING_ANNOTATION" if key.startswith(_LAYERED) else _CODES[pack]
    return _CODES[pack]


def missing_values(table: DataFrame, keys: dict[str, str], has_audio: bool) -> DataFrame:
    """One issue per null value; ``keys``: key -> pack."""
    cells = [F.when(F.col(k).isNull(), F.struct(F.lit(k).alias("feature"), F.lit(issue_code(k, p, has_audio)).alias("code"))) for k, p in keys.items()]
    uid = F.col("utterance_id") if "utterance_id" in table.columns else F.lit(None).cast("string")
    long = table.select(*KEY, uid.alias("utterance_id"), F.explode(F.array_compact(F.array(*cells))).alias("c")) if cells else None
    if long is None:
        return table.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in ISSUE_COLUMNS))
    return long.select(*KEY, "utterance_id", "c.feature", "c.code", F.lit("warning").alias("severity"), F.concat(F.lower(F.replace("c.code", F.lit("_"), F.lit(" "))), F.lit(" for "), F.col("c.feature")).alias("message"))


def extract(docs: Documents, *, wanted: DataFrame | None = None, audio: DataFrame | None = None, packs: Sequence[str] | None = None, levels: Sequence[str] | None = None, spec: TaskSpec | None = None) -> Bundle:
    """Features of the targets of all documents.

    Packs that aren't asked for are never computed.  Without ``audio`` the acoustic pack is null throughout; the
    standardized pack needs an outside tool and is always null, with one issue per target.
    """
    packs, levels = catalog.select("packs", catalog.PACKS, packs), catalog.select("levels", catalog.LEVELS, levels)
    docs = replace(docs, **{n: materialise(getattr(docs, n), n)[0] for n in ("utt", "tok", "ann", "speakers")})
    who, refused = targets(docs, wanted)
    who, _ = materialise(who, "targets")
    rec, per = who, docs.utt.join(who, KEY, "left_semi").select(*KEY, "utterance_id", "start_s", "end_s")
    if "adult_neuro" in packs:
        a, u = adult_neuro(docs, spec)
        rec, per = rec.join(materialise(a, "pack")[0], KEY, "left"), per.join(materialise(u.drop("utt_idx"), "pack")[0], [*KEY, "utterance_id"], "left")
    if "motor_neuro" in packs:
        rec = rec.join(materialise(motor_neuro(docs), "pack")[0], KEY, "left")
    if "acoustic" in packs and audio is not None:
        rec = rec.join(materialise(acoustic_pack(docs, audio, who), "pack")[0], KEY, "left")
    by_level = {lv: {k: p for p in packs for k in catalog.keys(p, lv)} for lv in catalog.LEVELS}
    recordings = _shape(rec, KEY, sorted(by_level["recording"])).orderBy(*KEY)
    utterances = _shape(per, [*KEY, "utterance_id", "start_s", "end_s"], sorted(by_level["utterance"])).orderBy(*KEY, "start_s", "end_s", "utterance_id")
    bare = {lv: {k: p for k, p in ks.items() if p != "standardized_acoustic"} for lv, ks in by_level.items()}
    parts = []
    if "recording" in levels:
        parts.append(missing_values(recordings, bare["recording"], audio is not None))
    if "utterance" in levels:
        parts.append(missing_values(utterances, bare["utterance"], audio is not None))
    none = F.lit(None).cast("string")
    if "standardized_acoustic" in packs:
        parts.append(who.select(*KEY, none.alias("utterance_id"), none.alias("feature"), F.lit("MISSING_OPTIONAL_DEPENDENCY").alias("code"), F.lit("warning").alias("severity"), F.lit("the standardized pack needs an outside tool").alias("message")))
    parts.append(refused.select(*KEY, none.alias("utterance_id"), none.alias("feature"), "code", F.lit("error").alias("severity"), F.lit("no target speaker").alias("message")))
    parts.append(docs.errors.select("recording_id", F.lit("").alias("speaker_id"), none.alias("utterance_id"), none.alias("feature"), "code", F.lit("error").alias("severity"), "message"))
    parts.append(docs.warnings.select("recording_id", F.lit("").alias("speaker_id"), none.alias("utterance_id"), none.alias("feature"), "code", F.lit("warning").alias("severity"), F.concat_ws(" ", "tier", "line").alias("message")))
    issues = parts[0]
    for p in parts[1:]:
        issues = issues.unionByName(p)
    issues = issues.select(*ISSUE_COLUMNS).orderBy(*(F.coalesce(F.col(c), F.lit("")) for c in ISSUE_COLUMNS))
    provenance = json.dumps({"version": __version__, "packs": packs, "levels": levels, "features": sum(len(v) for v in by_level.values())}, sort_keys=True)
    return Bundle(recordings, utterances, issues, provenance)
