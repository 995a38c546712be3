"""Queries of the operators for training data, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtide.llm import mixing, nearest, packing, repetition, splits, topics, turns
from voxtide.llm.sql import SQL as _ALL_SQL
from voxtide.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _turns(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return turns.speaker_turns(t("asr_segment"), t("speaker_result"), t("diarization_turn"), t("speaker_label"), t("nonword_form"), with_text)


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d, False)


@query
def p1_turns(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d, True)


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return splits.groups(table(spark, d, "manifest_row").select("manifest_id", "participant_id", "session_id", "split"), "manifest_id", ["participant_id", "session_id"])


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.mixed_groups(_groups(spark, d), "manifest_id", "split")


def split_shares(targets: DataFrame) -> dict[str, float]:
    """A handful of splits with their shares; more than a thousand are refused."""
    rows = targets.where("split_name is not null and target_share is not null").groupBy("split_name").agg(F.max("target_share").alias("s")).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 splits")
    return {r.split_name: r.s for r in rows}


@query
def p3_split(spark: SparkSession, d: str) -> DataFrame:
    got = splits.assign_splits(_groups(spark, d), split_shares(table(spark, d, "split_target")))
    return got.select("manifest_id", "group_id", F.col("assigned_split").alias("split"))


@query
def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each split holds: groups, records, their share and the largest group."""
    shares = split_shares(table(spark, d, "split_target"))
    return splits.split_report(splits.assign_splits(_groups(spark, d), shares), shares).withColumn("actual_share", F.round("actual_share", 6))


@query
def p3_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every record has a split, and no group two of them."""
    got = p3_split(spark, d)
    broken = got.groupBy("group_id").agg(F.count_distinct("split").alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("groups_in_two_splits"))
    return got.agg(F.count("*").alias("records"), F.count(F.when(F.col("split").isNull(), 1)).alias("without_split")).join(broken)


TOLERANCE_MS = 500


def _nearest(spark: SparkSession, d: str, matched_only: bool) -> DataFrame:
    return nearest.nearest_interval(
        table(spark, d, "word_timing"), table(spark, d, "diarization_turn"), entity="recording_id", record_id="word_id", time="start_ms",
        interval_id="turn_id", start="start_ms", end="end_ms", tolerance=TOLERANCE_MS, matched_only=matched_only,
    )


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, True)


@query
def p5_words(spark: SparkSession, d: str) -> DataFrame:
    """Every timed word, with null where no turn is near enough."""
    return _nearest(spark, d, False)


def _texts(spark: SparkSession, d: str) -> tuple:
    labels = turns.vocabulary(table(spark, d, "speaker_label"), "label", "speaker_role")
    return table(spark, d, "asr_segment"), "segment_id", "text", labels, turns.vocabulary(table(spark, d, "nonword_form"), "form")


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that the rules, weighed by how far each is to be trusted, hold for repetitive rather than sound."""
    return repetition.repetition(*_texts(spark, d)).where("p_repetitive >= 0.5").select("segment_id")


@query
def p6_share(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repeated_share(*_texts(spark, d)).select("segment_id", "n_words", "repeated_words", F.round("share", 9).alias("share"))


@query
def p6_quality(spark: SparkSession, d: str) -> DataFrame:
    """The posterior that each text is sound."""
    return repetition.repetition(*_texts(spark, d)).select("segment_id", F.round("share", 9).alias("share"), F.round("p_sound", 6).alias("p_sound"))


@query
def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "text", packing.read_specs(table(spark, d, "container_spec")))


@query
def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each capacity are."""
    specs = packing.read_specs(table(spark, d, "container_spec"))
    each = p7_pack(spark, d).groupBy("spec_name", "container_id").agg(F.sum("n_tokens").alias("n"))
    cap = F.create_map(*(F.lit(x) for kv in specs.items() for x in kv))
    return each.groupBy("spec_name").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest")).withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.try_element_at(cap, F.col("spec_name"))), 6))


@query
def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """No container is overfull, each token of a document lies in one place, and only documents beyond the capacity are cut."""
    specs = packing.read_specs(table(spark, d, "container_spec"))
    cap = F.try_element_at(F.create_map(*(F.lit(x) for kv in specs.items() for x in kv)), F.col("spec_name"))
    rows = p7_pack(spark, d)
    full = rows.groupBy("spec_name", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("spec_name").agg(F.count(F.when(F.col("n") > cap, 1)).alias("overfull"))
    size = packing.described(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", packing.VOCABULARY).dropDuplicates(["doc_id"]).select("doc_id", F.col("n_tokens").alias("size"))
    docs = rows.groupBy("spec_name", "doc_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("last"), F.count_distinct("first_token").alias("starts")).join(size, "doc_id", "full")
    sound = F.coalesce((F.col("n") == F.col("size")) & (F.col("last") == F.col("size")) & (F.col("starts") == F.col("parts")), F.lit(False))
    out = docs.groupBy("spec_name").agg(F.count("*").alias("documents"), F.count(F.when(~sound, 1)).alias("holes_or_overlaps"), F.count(F.when((F.col("parts") > 1) & (F.col("size") <= cap), 1)).alias("cut_without_need"))
    return out.join(full, "spec_name").select("spec_name", "documents", "overfull", "holes_or_overlaps", "cut_without_need")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, d, "documents"), "doc_id", "source", "text", mixing.read_targets(table(spark, d, "mix_target")))


@query
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


@query
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].withColumns({c: F.round(c, 6) for c in ("rate", "actual_share")})


@query
def p8_whole(spark: SparkSession, d: str) -> DataFrame:
    """No document is repeated beyond its source's cap, copies are numbered without holes, and each source has the tokens
    that its rate promises, to four standard errors of the drawn copies."""
    chosen, report = _mix(spark, d)
    doc = chosen.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.max("copy_no").alias("top"))
    by = doc.groupBy("source").agg(F.max("n").alias("most"), F.bool_and(F.col("n") == F.col("top")).alias("whole"))
    tokens = mixing.token_counts(table(spark, d, "documents").select("doc_id", "source", "text"), "text", packing.VOCABULARY).dropDuplicates(["doc_id"])
    squares = tokens.groupBy("source").agg(F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens")).alias("squares"))
    j = report.join(by, "source", "left").join(squares, "source", "left")
    f = F.col("rate") - F.floor("rate")
    error = F.sqrt(f * (1 - f) * F.coalesce("squares", F.lit(0.0)))
    cap = F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True))
    return j.select("source", cap.alias("within_cap"), F.coalesce("whole", F.lit(True)).alias("copies_without_holes"), (F.abs(F.col("selected_tokens") - F.col("rate") * F.col("available_tokens")) <= 4 * error + 1).alias("near_target"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    names = sorted(n for n, *_ in turns.vocabulary(table(spark, d, "subject_area"), "subject"))
    fillers = topics.filler_pattern([f for f, *_ in turns.vocabulary(table(spark, d, "nonword_form"), "form")])
    return topics.subjects(table(spark, d, "documents"), "doc_id", "text", names, 0.25, fillers=fillers)


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


@query
def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """How many documents are about each subject, and the mean share of their sentences that is."""
    return _subjects(spark, d).groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.avg("share"), 4).alias("mean_share"))


SQL = {k: v for k, v in _ALL_SQL.items() if k in QUERIES}
