"""Windows of sound for recognition: quiet cuts, folding; and the repair of what a recognizer returns.

Cuts and folds depend on the one before, so they are one pass over sorted rows that holds a search span or a
window at most, never a recording.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxtide.functions.exprs import count_if

# Sentence punctuation at the edges of a recognized word; what a recognizer writes for a token it doesn't know.
EDGES = ".,!?…"
UNKNOWN = ("unk", "<unk>")
#: A run of one token from this length on is a loop; a text of MANY tokens is suspect below this share of different ones.
LOOP, MANY, DIFFERENT = 8, 20, 0.3


class Pass:
    """What is held of one key: ``add`` takes a row and ``close`` ends the key; both yield result rows."""

    def add(self, row: tuple) -> Iterator[tuple]:
        raise NotImplementedError

    def close(self) -> Iterator[tuple]:
        return iter(())


def _passes(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], state: Callable[[], Pass], schema: str, flush: int = 20_000) -> DataFrame:
    """Rows of each key, in order, through a state of its own; results are the keys and ``schema``."""
    kinds = dict(df.dtypes)
    out = T._parse_datatype_string(", ".join([*(f"{k} {kinds[k]}" for k in keys), schema]))
    arrow, n = to_arrow_schema(out), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, None, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(arrow)], schema=arrow)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held is None or row[:n] != key:
                    if held is not None:
                        done.extend((*key, *r) for r in held.close())
                    key, held = row[:n], state()
                done.extend((*key, *r) for r in held.add(row[n:]))
                if len(done) >= flush:
                    yield batch()
                    done = []
        if held is not None:
            done.extend((*key, *r) for r in held.close())
        yield batch()

    return df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


class _Cuts(Pass):
    def __init__(self, cap: int, search: int) -> None:
        self.cap, self.search, self.start, self.no, self.last, self.tail = cap, search, None, 0, None, deque()

    def _end(self, end: int) -> tuple:
        row = (self.no, self.start, end)
        self.no, self.start = self.no + 1, end
        return row

    def add(self, row: tuple) -> Iterator[tuple]:
        i, level = row
        if self.start is None:
            self.start = i
        while i >= self.start + self.cap:
            hard = self.start + self.cap
            low = max(self.start + 1, hard - self.search)
            span = [(x, k) for k, x in self.tail if low <= k < hard]
            quiet = min(span, default=None)
            # The hard end stands where its own last frame is as quiet as any.
            yield self._end(hard if quiet is None or quiet[0] >= span[-1][0] else quiet[1])
        self.tail.append((i, float("inf") if level is None or level != level else level))
        while self.tail[0][0] < i - self.search - 1:
            self.tail.popleft()
        self.last = i

    def close(self) -> Iterator[tuple]:
        yield self._end(self.last + 1)


def quiet_cuts(frames: DataFrame, keys: Sequence[str], at: str, level: str, cap: int, search: int) -> DataFrame:
    """(keys, window_no, first, end): frames in windows of at most ``cap``, each cut before the quietest of the last ``search`` frames.

    Among equally quiet frames the first is cut before; where the last one is as quiet as any, the window keeps ``cap`` frames.
    ``at`` numbers a key's frames; numbers that are missing belong to the window around them.  A null or NaN level is never quietest;
    rows without a number are left out.
    """
    if not 0 < search < cap:
        raise ValueError("the search span must be shorter than the window")
    f = frames.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("long").alias("__at"), F.col(level).cast("double").alias("__level"))
    return _passes(f, keys, ["__at", "__level"], ["__at", "__level"], lambda: _Cuts(cap, search), "window_no long, first long, end long")


def quietest_sample(sound: np.ndarray, low: int, high: int, frame: int, hop: int) -> int:
    """Where to cut ``sound`` in [low, high): the middle of its quietest frame, or ``high`` if that is the last one or none fits.

    Energies of all frames come from one running sum of squares.
    """
    room = high - low - frame
    if room < 0:
        return high
    at = np.unique(np.r_[0 : room + 1 : hop, room])
    run = np.r_[0.0, np.square(sound[low:high].astype(np.float64)).cumsum()]
    energy = run[at + frame] - run[at]
    best = int(energy.argmin())
    return high if energy[best] >= energy[-1] else low + int(at[best]) + frame // 2


class _Fold(Pass):
    def __init__(self, cap: float) -> None:
        self.cap, self.now = cap, None

    def add(self, row: tuple) -> Iterator[tuple]:
        start, end = row
        if self.now is not None and end - self.now[0] <= self.cap:
            self.now = (self.now[0], max(end, self.now[1]))
        else:
            if self.now is not None:
                yield self.now
            self.now = (start, end)

    def close(self) -> Iterator[tuple]:
        yield self.now


def fold_windows(windows: DataFrame, keys: Sequence[str], start: str, end: str, cap: float) -> DataFrame:
    """Windows folded from the first on as long as they end within ``cap`` of where it began, whatever lies between them.

    A window longer than ``cap`` stays as it is; windows without both ends are left out; ties go by end.
    """
    kind = dict(windows.dtypes)[start]
    w = windows.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    return _passes(w, keys, [start, end], [start, end], lambda: _Fold(cap), f"{start} {kind}, {end} {kind}")


def bare(c: Column) -> Column:
    """A word without sentence punctuation at its edges."""
    return F.btrim(c, F.lit(EDGES))


def _span(s: str, e: str, duration: str) -> Column:
    """Whether both ends are there, in order and within the recording (which has no end if its length is unknown)."""
    return F.coalesce((F.col(s) >= 0) & (F.col(e) > F.col(s)) & (F.col(e) <= F.coalesce(duration, e)), F.lit(False))


def normalize_segments(segments: DataFrame, words: DataFrame, durations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments and their words with bare texts and believable times only.

    ``segments``: recording_id, segment_id, start_ms, end_ms, text; ``words``: segment_id, word_no, word, start_ms, end_ms;
    ``durations``: recording_id, duration_ms.  Times of a word that leave the recording or its segment, or begin before those of a word
    before it, become null; words of punctuation only go.  A segment whose own times aren't believable takes those of its
    words, if every word with a letter or digit has some; else null ones.
    """
    d = durations.groupBy("recording_id").agg(F.max("duration_ms").alias("duration_ms"))
    text = F.array_join(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\s+"), bare), lambda x: x != ""), " ")
    s = segments.join(d, "recording_id", "left").withColumn("ok", _span("start_ms", "end_ms", "duration_ms"))
    s = s.select("recording_id", "segment_id", "duration_ms", F.when(F.col("ok"), F.col("start_ms")).alias("seg_start"), F.when(F.col("ok"), F.col("end_ms")).alias("seg_end"), text.alias("text"))
    w = words.withColumn("word", bare(F.coalesce("word", F.lit("")))).where("word <> ''").join(s.drop("text", "recording_id"), "segment_id")
    fits = _span("start_ms", "end_ms", "duration_ms") & F.coalesce((F.col("start_ms") >= F.col("seg_start")) & (F.col("end_ms") <= F.col("seg_end")), F.col("seg_start").isNull())
    w = w.withColumn("__at", F.when(fits, F.col("start_ms")))
    before = F.max("__at").over(Window.partitionBy("segment_id").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1))
    keep = F.col("__at").isNotNull() & (F.col("__at") >= F.coalesce(before, F.col("__at")))
    w = w.select("segment_id", "word_no", "word", F.when(keep, F.col("start_ms")).alias("start_ms"), F.when(keep, F.col("end_ms")).alias("end_ms"))
    lexical = F.col("word").rlike(r"[\p{L}\p{N}]")
    spans = w.groupBy("segment_id").agg(F.min("start_ms").alias("lo"), F.max("end_ms").alias("hi"), (count_if(lexical) > 0).alias("some"), F.bool_and(~lexical | F.col("start_ms").isNotNull()).alias("all"))
    s = s.join(spans, "segment_id", "left")
    inferred = F.col("seg_start").isNull() & F.col("some") & F.col("all")
    s = s.select("recording_id", "segment_id", F.when(inferred, F.col("lo")).otherwise(F.col("seg_start")).alias("start_ms"), F.when(inferred, F.col("hi")).otherwise(F.col("seg_end")).alias("end_ms"), "text")
    return s, w


def suspected_repetition(words: DataFrame, keys: Sequence[str], order: str, word: str) -> DataFrame:
    """(keys, tokens, longest_run, different, suspected): whether a decoded text looks like a loop of the decoder or an unknown token.

    So it does with an unknown token, a run of LOOP equal tokens, or at least MANY tokens of which fewer than DIFFERENT
    are different (these with their punctuation).  Blank words don't count.
    """
    ks = list(keys)
    t = words.select(*ks, order, F.lower(F.trim(F.col(word))).alias("raw")).where("raw <> ''").withColumn("tok", bare(F.col("raw")))
    w = Window.partitionBy(*ks).orderBy(order)
    said = t.where("tok <> ''").withColumn("__new", F.when(F.lag("tok").over(w) == F.col("tok"), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = said.groupBy(*ks, "__run").agg(F.count("*").alias("n")).groupBy(*ks).agg(F.max("n").alias("longest_run"))
    all_ = t.groupBy(*ks).agg(F.count("*").alias("tokens"), F.count_distinct("raw").alias("different"), F.max(F.col("tok").isin(list(UNKNOWN))).alias("unknown"))
    j = all_.join(runs, ks, "left").fillna(0, ["longest_run"])
    suspected = F.col("unknown") | (F.col("longest_run") >= LOOP) | ((F.col("tokens") >= MANY) & (F.col("different") < DIFFERENT * F.col("tokens")))
    return j.select(*ks, "tokens", "longest_run", "different", suspected.alias("suspected"))
