"""Clean, ordered speaker turns from raw segments, speaker entries and diarization turns."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtide.llm.transcript import CLUSTER_PREFIXES, Cleaner, fold
from voxtide.operators.intervals import carry_in
from voxtide.session import materialise

#: Segments of one recording that a window sees at once; a longer recording is cut and its cuts are joined again.
SEGMENTS_PER_BUCKET = 4096
#: Keys that one recording becomes in joins with its entries, roles or classes.
SALTS = 16
#: Time buckets of the overlap ranks.
BUCKET_MS = 600_000
#: Labels and forms are configuration: more than this many are refused.
MAX_FORMS = 10_000


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast: Spark estimates it from compressed files, before lists are exploded, and a few hundred KB of those may be GB."""
    return df.hint("merge")


def vocabulary(df: DataFrame, *columns: str) -> list[tuple]:
    """Rows of a small vocabulary table; refuses one that isn't small."""
    rows = df.select(*columns).distinct().limit(MAX_FORMS + 1).collect()
    if len(rows) > MAX_FORMS:
        raise ValueError(f"more than {MAX_FORMS} forms")
    return [tuple(r) for r in rows if r[0] is not None]


def cleaned(segments: DataFrame, text: str, labels: list[tuple], nonwords: list[tuple], with_text: bool = True) -> DataFrame:
    """The segments with ``label`` (role, '#cluster' or null), ``n_words`` and, if wanted, ``words`` (spoken pieces)."""

    @F.pandas_udf("label string, n_words int" + ", words string" * with_text)
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cleaner = Cleaner(labels, [f for f, *_ in nonwords])
        for texts in batches:
            got = [cleaner.split(t) for t in texts]
            cols = {"label": pd.Series([g[0] for g in got], dtype=object), "n_words": pd.Series([len(g[1]) for g in got], dtype="int32")}
            yield pd.DataFrame(cols | ({"words": [" ".join(g[1]) for g in got]} if with_text else {}))

    return segments.withColumn("__clean", clean(F.col(text)))


def cluster(c: Column, bare: bool = True) -> Column:
    """The cluster number of a spelling, as in ``transcript.cluster_number``."""
    prefix = "(?:" + "|".join(CLUSTER_PREFIXES) + ")[ _-]*"
    n = F.regexp_extract(F.trim(F.lower(F.regexp_replace(c, r"[\s\x{a0}]+", " "))), rf"\A(?:{prefix}){'?' if bare else ''}([0-9]{{1,9}})\z", 1)
    return F.when(n != "", n.cast("long").cast("string"))


def named_role(entry: Column, roles: dict[str, str], cluster_roles: Column) -> Column:
    """The role that an entry of utterance_speakers names itself or through its cluster; null if neither."""
    plain = F.trim(F.lower(F.regexp_replace(F.regexp_replace(entry, r"[\s\x{a0}]+", " "), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    table = F.create_map(*(F.lit(x) for kv in roles.items() for x in kv)) if roles else F.lit(None).cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, plain), F.try_element_at(cluster_roles, cluster(plain)))


def overlap_by_class(spans: DataFrame, turns: DataFrame) -> DataFrame:
    """(id, class, overlap): how long the turns of each class of the entity lie over each span.

    ``spans``: id, entity, start, end; ``turns``: entity, class, start, end with end > start.
    No span meets a turn: the time covered up to x is a sum over the starts and
    ends before x, so prefix sums at both ends of a span give its overlap.
    """
    classes = turns.select("entity", "class").distinct().groupBy("entity").agg(F.collect_set("class").alias("classes"))
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    q = spans.withColumn("salt", F.pmod("id", F.lit(SALTS)).cast("int")).join(by_shuffle(classes), ["entity", "salt"])
    q = q.select("id", "entity", F.explode("classes").alias("class"), "start", "end")
    point = lambda t, sign: F.struct(F.col(t).alias("t"), F.lit(sign).alias("sign"))
    ask = q.select("entity", "class", "id", F.explode(F.array(point("start", -1), point("end", 1))).alias("p")).select("entity", "class", "id", "p.*")
    tell = turns.select("entity", "class", F.lit(None).cast("long").alias("id"), F.explode(F.array(point("start", 1), point("end", -1))).alias("p")).select("entity", "class", "id", "p.*")
    ev = ask.unionByName(tell).withColumn("__b", F.floor(F.col("t") / BUCKET_MS))
    is_turn = F.col("id").isNull()
    # covered(x) = x * open(x) - (sum of starts - sum of ends before x)
    n, st = F.when(is_turn, F.col("sign")).otherwise(0), F.when(is_turn, F.col("sign") * F.col("t")).otherwise(F.lit(0).cast("long"))
    ev = ev.withColumns({"n": n.cast("long"), "st": st})
    ev = carry_in(by_shuffle(ev), ["entity", "class"], "__b", {"n0": F.sum("n"), "st0": F.sum("st")})
    w = Window.partitionBy("entity", "class", "__b").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    covered = F.col("t") * (F.col("n0") + F.sum("n").over(w)) - (F.col("st0") + F.sum("st").over(w))
    at = ev.withColumn("covered", covered).where(~is_turn)
    return at.groupBy("id", "class").agg(F.sum(F.col("sign") * F.col("covered")).alias("overlap")).where("overlap > 0")


def speaker_turns(segments: DataFrame, results: DataFrame, diarization: DataFrame, labels: DataFrame, nonwords: DataFrame, with_text: bool = True) -> DataFrame:
    """(recording_id, turn_no, speaker, first_segment_no, last_segment_no, n_words) of every recording.

    ``with_text`` gives the turns in parts with ``part_no`` and ``text``, the other columns being the whole turn's: a part holds the
    words of one stretch of SEGMENTS_PER_BUCKET numbers, so a turn without end is no row without end.

    - Repeated segments and turns (rows alike in what is read) count once; segments without words (null or blank text too) are left out.
    - The speaker is named by the label at the head, failing that by the entry of the segment, failing that by the
      cluster whose turns overlap the segment longest (a tie goes to the smaller number); a null time has no overlap.
    - A role that no label has counts as none.  A segment whose speaker nothing names is left out, as is one without recording or number; the turn around it goes on.
    - Two segments of the same number stand in order of segment_id.
    - A recording without entries, roles or turns keeps what its labels name; empty tables give an empty result.
    """
    roles = vocabulary(labels, "label", "speaker_role")
    cl = cleaned(segments.select("segment_id", "recording_id", "segment_no", "start_ms", "end_ms", "text").where("text is not null and recording_id is not null and segment_no is not null"), "text", roles, vocabulary(nonwords, "form"), with_text)
    keep = ["segment_id", "recording_id", "segment_no", "start_ms", "end_ms", F.col("__clean.label").alias("label"), F.col("__clean.n_words").alias("n_words")]
    seg, _ = materialise(cl.select(*keep, *([F.col("__clean.words").alias("words")] if with_text else [])).where("n_words > 0"), "segments")
    seg = seg.distinct()  # repeated rows are alike; all columns as keys let the hash aggregate do it

    # A recording's roles and entries meet its segments by recording and salt, so a hot recording is many keys; each
    # salted row holds the entries of its own segments only.
    by_label = {form: r for a, r in roles for form in (fold(a), unicodedata.normalize("NFD", fold(a)))}
    res = results.where("recording_id is not null").dropDuplicates(["recording_id"])
    res = res.select("recording_id", "cluster_to_role", "utterance_speakers", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    res = res.select("recording_id", "cluster_to_role", "salt", F.filter("utterance_speakers", lambda _, i: i % SALTS == F.col("salt")).alias("entries"))
    named = seg.withColumn("salt", F.pmod("segment_no", F.lit(SALTS)).cast("int")).join(by_shuffle(res), ["recording_id", "salt"], "left")
    entry = F.get("entries", F.floor(F.col("segment_no") / SALTS).cast("int"))
    number = F.when(F.col("label").startswith("#"), F.substring("label", 2, 20))
    speaker = F.coalesce(F.when(number.isNull(), F.col("label")), F.try_element_at("cluster_to_role", number), named_role(entry, by_label, F.col("cluster_to_role")))
    cols = ["segment_id", "recording_id", "segment_no", "start_ms", "end_ms", "n_words", *(["words"] if with_text else [])]
    named = named.select(*cols, speaker.alias("speaker"), "cluster_to_role")
    named, _ = materialise(named.withColumn("cluster_to_role", F.when(F.col("speaker").isNull(), F.col("cluster_to_role"))), "named")

    mute = named.where("speaker is null and end_ms > start_ms")
    turns = diarization.select("turn_id", F.col("recording_id").alias("entity"), cluster(F.col("cluster_id")).alias("class"), F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    turns = turns.where("end > start and class is not null").distinct().join(by_shuffle(mute.select(F.col("recording_id").alias("entity")).distinct()), "entity", "left_semi")
    heard = overlap_by_class(mute.select(F.col("segment_id").alias("id"), F.col("recording_id").alias("entity"), F.col("start_ms").alias("start"), F.col("end_ms").alias("end")), turns)
    best = heard.groupBy("id").agg(F.max(F.struct("overlap", (-F.col("class").cast("long")).alias("order"))).alias("m")).select(F.col("id").alias("segment_id"), (-F.col("m.order")).cast("string").alias("number"))
    found = named.where("speaker is null").drop("speaker").join(by_shuffle(best), "segment_id").withColumn("speaker", F.try_element_at("cluster_to_role", F.col("number")))
    done = named.where("speaker is not null").select(*cols, "speaker").unionByName(found.where("speaker is not null").select(*cols, "speaker"))
    # Roles as numbers: windows and hash aggregates carry them without sorting by text.
    names = sorted({r for _, r in roles})
    known = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    done = done.drop("start_ms", "end_ms").withColumn("speaker", F.array_position(known, F.col("speaker")).cast("int")).where("speaker > 0")
    return build_turns(materialise(done, "spoken")[0], with_text).withColumn("speaker", F.get(known, F.col("speaker") - 1))


def build_turns(seg: DataFrame, with_text: bool) -> DataFrame:
    """Runs of the same speaker in order of segment_no; windows see a bucket of numbers, and bucket ends carry the rest."""
    seg = seg.withColumn("__b", F.floor(F.col("segment_no") / SEGMENTS_PER_BUCKET))
    order = [F.col("segment_no"), F.col("segment_id")]
    w = Window.partitionBy("recording_id", "__b").orderBy(*order)
    new = F.lag("speaker").over(w)
    seg = seg.withColumn("__new", F.when(new.isNull() | (new == F.col("speaker")), 0).otherwise(1))
    ends = seg.groupBy("recording_id", "__b").agg(
        F.min_by("speaker", F.struct(*order)).alias("first"), F.max_by("speaker", F.struct(*order)).alias("last"), F.sum("__new").alias("inside")
    )
    wb = Window.partitionBy("recording_id").orderBy("__b")
    ends = ends.withColumn("opens", F.when(F.lag("last").over(wb) == F.col("first"), 0).otherwise(1))
    base = (F.sum(F.col("opens") + F.col("inside")).over(wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("inside")).alias("base")
    seg = seg.join(by_shuffle(ends.select("recording_id", "__b", base)), ["recording_id", "__b"])
    turn = F.col("base") + F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seg = seg.withColumn("turn_no", turn.cast("int"))
    figures = [F.first("speaker").alias("speaker"), F.min("segment_no").alias("first_segment_no"), F.max("segment_no").alias("last_segment_no"), F.sum("n_words").cast("int").alias("n_words")]
    if not with_text:
        return seg.groupBy("recording_id", "turn_no").agg(*figures)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "words"))), lambda x: x["words"]), " ").alias("text")
    parts = seg.groupBy("recording_id", "turn_no", "__b").agg(*figures, text)
    turn = Window.partitionBy("recording_id", "turn_no")
    part = F.row_number().over(turn.orderBy("__b")).alias("part_no")
    whole = (F.min("first_segment_no").over(turn).alias("first_segment_no"), F.max("last_segment_no").over(turn).alias("last_segment_no"), F.sum("n_words").over(turn).cast("int").alias("n_words"))
    return parts.select("recording_id", "turn_no", part, "speaker", *whole, "text")
