"""Sequence operators of transcription: roles, nearest turns, loops, retraces, commas, windows, word grouping, numbers."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from voxtide.functions.streams import each_group
from voxtide.operators.intervals import meet, nearest_values, periods_and_gaps

LOOP = 8
RETRACE = 4


def roles(turns: DataFrame) -> DataFrame:
    """The role of each cluster of a recording: the one that talks longest is PAR, all others INV (a tie goes to the smaller name)."""
    t = turns.groupBy("recording_id", "cls").agg(F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("talk_ms"))
    w = Window.partitionBy("recording_id").orderBy(F.desc("talk_ms"), "cls")
    return t.withColumn("role", F.when(F.row_number().over(w) == 1, "PAR").otherwise("INV"))


def overlap_argmax(spans: DataFrame, turns: DataFrame, slice_ms: int = 60_000) -> DataFrame:
    """(id, cls, overlap_ms): the cluster whose turns overlap each span longest (a tie goes to the smaller number)."""
    t = turns.select("recording_id", "cls", F.col("start_ms").alias("ts"), F.col("end_ms").alias("te"))
    o = meet(spans.select("recording_id", "id", "start_ms", "end_ms"), t, ["recording_id"], ("start_ms", "end_ms"), ("ts", "te"), slice_ms).groupBy("id", "cls").agg(F.sum(F.col("hi") - F.col("lo")).alias("overlap_ms"))
    return o.groupBy("id").agg(F.max_by("cls", F.struct("overlap_ms", -F.col("cls"))).alias("cls"), F.max("overlap_ms").alias("overlap_ms"))


def nearest_midpoint(spans: DataFrame, turns: DataFrame) -> DataFrame:
    """(id, turn_id): the turn whose midpoint is nearest to the span's (ties go to the smaller id).

    Midpoints are doubled, so that they stay whole numbers.  The nearest is the last before or the first after.
    """
    t = turns.groupBy("recording_id", (F.col("start_ms") + F.col("end_ms")).alias("m")).agg(F.min("turn_id").alias("turn_id"))
    t = t.select("recording_id", "m", F.lit(0).alias("side"), F.struct("m", "turn_id").alias("turn"), F.lit(None).cast("long").alias("id"))
    s = spans.where("start_ms is not null and end_ms is not null").select("recording_id", (F.col("start_ms") + F.col("end_ms")).alias("m"), F.lit(1).alias("side"), F.lit(None).cast(t.schema["turn"].dataType).alias("turn"), "id")
    j = nearest_values(t.unionByName(s), ["recording_id"], "m", [F.col("side"), F.col("id")], "turn", 1_200_000, "a", "b").where("side = 1")
    da, db = F.col("m") - F.col("a.m"), F.col("b.m") - F.col("m")
    pick = F.when(F.col("a").isNull(), F.col("b.turn_id")).when(F.col("b").isNull() | (da < db), F.col("a.turn_id")).when(db < da, F.col("b.turn_id")).otherwise(F.least("a.turn_id", "b.turn_id"))
    return j.select("id", pick.alias("turn_id"))


def loops(tok: DataFrame, keys: Sequence[str], order: str, value: str, least: int = LOOP) -> DataFrame:
    """Runs of one value of at least ``least``: keys, the value, where the run begins, how long it is."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    r = tok.withColumn("__n", new).withColumn("__r", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*keys, "__r").agg(F.first(value).alias(value), F.min(order).alias("first"), F.count("*").alias("length")).where(F.col("length") >= least).drop("__r")


def _retraces(key: tuple, rows: list[dict]) -> list[dict]:
    """``again[n][i]``: how many words from the i-th on equal the word n further; a retrace of n words is n of them in a row."""
    words = [r["norm"] if r["kind"] == "word" else None for r in rows]
    size = len(words)
    again = {}
    for n in range(1, RETRACE + 1):
        run, col = 0, [0] * size
        for i in range(size - n - 1, -1, -1):
            run = run + 1 if words[i] is not None and words[i] == words[i + n] else 0
            col[i] = run
        again[n] = col
    base = dict(zip(("recording_id", "speaker_id", "utt_idx"), key))
    out, skip_to = [], 0
    for i in range(size):
        n = max((n for n, col in again.items() if col[i] >= n), default=0)
        if n and i >= skip_to:
            out.append(base | {"tok_idx": rows[i]["tok_idx"], "n": n, "text": " ".join(words[i : i + n])})
            skip_to = i + n
    return out


def retraces(tok: DataFrame) -> DataFrame:
    """Sequences of up to four words said again at once, longest first, each utterance from left to right.

    Fillers between don't matter; a token that is neither word nor filler ends a sequence.
    """
    t = tok.where("kind <> 'filler'").select("recording_id", "speaker_id", "utt_idx", "tok_idx", "norm", "kind")
    return each_group(t, ["recording_id", "speaker_id", "utt_idx"], ["tok_idx"], _retraces, "recording_id string, speaker_id string, utt_idx int, tok_idx int, n int, text string")


def comma_cleanup(items: DataFrame, keys: Sequence[str], order: str, is_comma: str) -> DataFrame:
    """The items without commas that lead or follow another comma."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.max(F.when(~F.col(is_comma), 1)).over(w.rowsBetween(Window.unboundedPreceding, -1)).isNotNull()
    double = F.coalesce(F.lag(is_comma).over(w), F.lit(False))
    return items.withColumn("__keep", ~F.col(is_comma) | (before & ~double)).where("__keep").drop("__keep")


def window_merge(windows: DataFrame, gap_ms: int = 700, pad_ms: int = 30, cap_ms: int = 20_000, sound: DataFrame | None = None) -> DataFrame:
    """Windows of speech joined over short gaps, padded, kept within the sound and cut into pieces of at most ``cap_ms``.

    ``sound``: (recording_id, sound_ms); a recording without one has no end.
    """
    wide = windows.where("end_ms > start_ms").withColumn("end_ms", F.col("end_ms") + gap_ms)
    p = periods_and_gaps(wide, ["recording_id"], "start_ms", "end_ms").where("kind = 'period'")
    p = p.select("recording_id", F.greatest(F.lit(0), F.col("start_ms") - pad_ms).alias("s"), (F.col("end_ms") - gap_ms + pad_ms).alias("e"))
    if sound is not None:
        p = p.join(sound.groupBy("recording_id").agg(F.max("sound_ms").alias("sound_ms")), "recording_id", "left").withColumn("e", F.least("e", F.coalesce("sound_ms", "e"))).where("e > s")
    n = F.ceil((F.col("e") - F.col("s")) / cap_ms)
    c = p.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return c.select("recording_id", (F.col("s") + F.col("i") * cap_ms).alias("start_ms"), F.least(F.col("e"), F.col("s") + (F.col("i") + 1) * cap_ms).alias("end_ms"))


def group_words(words: DataFrame, syllables: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Times of words of several syllables: word i takes the next ``size`` syllables of its key, by running offsets.

    ``words``: keys, pos, size; ``syllables``: keys, pos, start_ms, end_ms, both from 0 without holes.  A key whose sizes don't
    add up to its syllables has null times and ``aligned`` false.
    """
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = words.withColumn("hi", F.sum("size").over(w)).withColumn("lo", F.col("hi") - F.col("size"))
    spread = g.withColumn("at", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1))).select(*keys, F.col("pos").alias("word"), "at")
    t = spread.join(syllables.withColumnRenamed("pos", "at"), [*keys, "at"], "left").groupBy(*keys, "word").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    n = words.groupBy(*keys).agg(F.sum("size").alias("a")).join(syllables.groupBy(*keys).agg(F.count("*").alias("b")), list(keys), "left")
    ok = n.select(*keys, (F.col("a") == F.coalesce("b", F.lit(0))).alias("aligned"))
    return t.join(ok, list(keys)).select(*keys, F.col("word").alias("pos"), F.when(F.col("aligned"), F.col("start_ms")).alias("start_ms"), F.when(F.col("aligned"), F.col("end_ms")).alias("end_ms"), "aligned")


# Vietnamese digits.
DIGITS = ("không", "một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín")


def spell_number(n: int) -> str:
    """A whole number of up to twelve digits in Vietnamese words."""
    if n == 0:
        return DIGITS[0]
    parts, scale = [], ["", "nghìn", "triệu", "tỷ"]
    groups = []
    while n:
        n, r = divmod(n, 1000)
        groups.append(r)
    for i in range(len(groups) - 1, -1, -1):
        g = groups[i]
        if not g:
            continue
        h, t, u = g // 100, g // 10 % 10, g % 10
        words = []
        if h or parts:
            words += [DIGITS[h], "trăm"]
        if t > 1:
            words += [DIGITS[t], "mươi"]
        elif t == 1:
            words.append("mười")
        elif u and words:
            words.append("lẻ")
        if u:
            after_tens = {1: "mốt", 4: "tư", 5: "lăm"} if t > 1 else {5: "lăm"} if t else {}
            words.append(after_tens.get(u, DIGITS[u]))
        parts.append(" ".join([*words, scale[i]]).strip())
    return " ".join(parts)


def spelled(df: DataFrame, number: str, out: str = "spelled") -> DataFrame:
    """The numbers (of up to twelve digits) in words; null for a null, negative or longer one."""

    @F.pandas_udf("string")
    def spell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ns in batches:
            yield pd.Series([spell_number(int(n)) if n is not None and n == n and 0 <= n < 10**12 else None for n in ns], dtype=object)

    return df.withColumn(out, spell(F.col(number)))


_NUMERAL = re.compile(r"(?<!\S)(0|[1-9][0-9]{0,11})?(%?)(?=[.,!?…]*(?:\s|$))")


def spelled_text(df: DataFrame, text: str, out: str = "spelled") -> DataFrame:
    """Texts with bare whole numbers, and a % behind them, in words; decimals and numbers with leading zeros stay."""

    def words(m: re.Match) -> str:
        return " ".join(([spell_number(int(m[1]))] if m[1] else []) + (["phần trăm"] if m[2] else []))

    @F.pandas_udf("string")
    def spell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ts in batches:
            yield pd.Series([None if t is None else _NUMERAL.sub(words, t) for t in ts], dtype=object)

    return df.withColumn(out, spell(F.col(text)))
