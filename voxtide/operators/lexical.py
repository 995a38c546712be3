"""Lexical, length, diversity and disfluency measures per recording and speaker.

Relations: ``utt`` (recording_id, speaker_id, utt_idx, ...) with a row for every
utterance, empty ones too; ``tok`` (recording_id, speaker_id, utt_idx, tok_idx,
token_id, norm, kind, word_id).  Counts are over kinds; diversity is over
normalized tokens of kind ``word``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from voxtide.functions.exprs import count_if, ratio, sd

KEY = ["recording_id", "speaker_id"]
UTT = [*KEY, "utt_idx"]
MAZE = ("filler", "fragment", "retracing", "revision")
HDD_DRAW = 42
MATTR_WINDOW = 20
MTLD_LEVEL = 0.72


def speakers(utt: DataFrame) -> DataFrame:
    return utt.groupBy(*KEY).agg(F.count("*").alias("lex_utterance_count"))


def counts(utt: DataFrame, tok: DataFrame) -> DataFrame:
    """Utterances, tokens, words, syllables, characters, types and mean lengths of utterances."""
    word = F.col("kind") == "word"
    group = F.when(word, F.struct("utt_idx", F.when(F.col("word_id").isNotNull(), F.struct(F.lit(1).alias("g"), F.col("word_id").alias("i"))).otherwise(F.struct(F.lit(0).alias("g"), F.col("token_id").cast("string").alias("i")))))
    t = tok.groupBy(*KEY).agg(
        F.count("*").alias("lex_token_count"), F.count_distinct(group).alias("lex_word_count"), count_if(word).alias("lex_syllable_count"),
        F.sum(F.when(word, F.char_length("norm")).otherwise(0)).cast("long").alias("lex_character_count"), F.count_distinct(F.when(word, F.col("norm"))).alias("lex_unique_token_count"),
    )
    out = speakers(utt).join(t, KEY, "left").fillna(0, [c for c in t.columns if c not in KEY])
    return out.withColumns({"lex_mlu_words": ratio("lex_word_count", "lex_utterance_count"), "lex_mlu_syllables": ratio("lex_syllable_count", "lex_utterance_count")})


def lengths(tok: DataFrame) -> DataFrame:
    """Mean and spread of token lengths in characters and of word lengths in syllables."""
    w = tok.where("kind = 'word'")
    chars = w.groupBy(*KEY).agg(F.avg(F.char_length("norm")).alias("lex_token_length_mean_characters"), sd(F.char_length("norm")).alias("lex_token_length_sd_characters"))
    group = F.when(F.col("word_id").isNotNull(), F.concat(F.lit("g"), "word_id")).otherwise(F.concat(F.lit("t"), F.col("token_id").cast("string")))
    per = w.groupBy(*UTT, group.alias("w")).agg(F.count("*").alias("n"))
    return chars.join(per.groupBy(*KEY).agg(F.avg("n").alias("lex_word_length_mean_syllables"), sd("n").alias("lex_word_length_sd_syllables")), KEY)


def diversity(items: DataFrame, value: str, prefix: str) -> DataFrame:
    """Type-token ratio, hapax ratio, Brunet's W, Honore's R, entropy and HD-D of ``value``, from type frequencies."""
    types = items.where(F.col(value).isNotNull()).groupBy(*KEY, value).agg(F.count("*").alias("f"))
    total = types.groupBy(*KEY).agg(F.sum("f").alias("n"), F.count("*").alias("v"), count_if(F.col("f") == 1).alias("v1"))
    # HD-D: a type's chance to be among HDD_DRAW drawn tokens; equal frequencies have equal chances.
    spectrum = types.groupBy(*KEY, "f").agg(F.count("*").alias("types")).join(total, KEY)
    absent = F.aggregate(F.sequence(F.lit(0), F.lit(HDD_DRAW - 1)), F.lit(1.0), lambda a, k: a * F.greatest(F.col("n") - F.col("f") - k, F.lit(0)) / (F.col("n") - k))
    p = F.col("f") / F.col("n")
    sums = spectrum.groupBy(*KEY).agg(
        F.sum(F.when(F.col("n") >= HDD_DRAW, F.col("types") * (1 - absent) / HDD_DRAW)).alias("hdd"), F.sum(-F.col("types") * p * F.log(p)).alias("h")
    )
    n, v, v1 = F.col("n"), F.col("v"), F.col("v1")
    return total.join(sums, KEY).select(
        *KEY,
        ratio(v, n).alias(f"{prefix}_ttr"), F.col("hdd").alias(f"{prefix}_hdd_42"), ratio(v1, n).alias(f"{prefix}_hapax_ratio"),
        F.pow(n, F.pow(v, F.lit(-0.165))).alias(f"{prefix}_brunet_w"), F.when(v != v1, 100 * F.log(n) / (1 - v1 / v)).alias(f"{prefix}_honore_r"),
        F.when(v == 1, 0.0).otherwise(F.col("h") / F.log(v)).alias(f"{prefix}_entropy"),
    )


class _Factors:
    """Factors of one direction: a new one begins when the type-token ratio has come down to the level."""

    def __init__(self) -> None:
        self.types: set[str] = set()
        self.n = 0
        self.factors = 0.0

    def add(self, w: str) -> None:
        self.types.add(w)
        self.n += 1
        if self.n > 1 and len(self.types) / self.n <= MTLD_LEVEL:
            self.factors += 1
            self.types, self.n = set(), 0

    def total(self) -> float:
        rest = (1 - len(self.types) / self.n) / (1 - MTLD_LEVEL) if self.n else 0.0
        return self.factors + rest


def ordered_diversity(items: DataFrame, value: str, order: list[str], prefix: str) -> DataFrame:
    """MTLD (mean of both directions) and MATTR, by one pass over each direction of the sorted tokens.

    A pass holds the types of the running factor and one window, never a recording.
    """
    cols = [*KEY, value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, f, window, seen, n, total = None, _Factors(), deque(), {}, 0, 0.0
        rows: list[tuple] = []

        def close() -> None:
            if key is not None:
                rows.append((*key, n, f.total(), total / (n - MATTR_WINDOW + 1) if n >= MATTR_WINDOW else None))

        for b in batches:
            for r, s, w in zip(*(b.column(c).to_pylist() for c in cols)):
                if (r, s) != key:
                    close()
                    key, f, window, seen, n, total = (r, s), _Factors(), deque(), {}, 0, 0.0
                f.add(w)
                n += 1
                window.append(w)
                seen[w] = seen.get(w, 0) + 1
                if len(window) > MATTR_WINDOW:
                    old = window.popleft()
                    seen[old] -= 1
                    if not seen[old]:
                        del seen[old]
                if n >= MATTR_WINDOW:
                    total += len(seen) / MATTR_WINDOW
        close()
        if rows:
            k, s, m, t, a = zip(*rows)
            yield pa.RecordBatch.from_pydict({"recording_id": pa.array(k, pa.string()), "speaker_id": pa.array(s, pa.string()), "n": pa.array(m, pa.int64()), "factors": pa.array(t, pa.float64()), "mattr": pa.array(a, pa.float64())})

    kept = items.where(F.col(value).isNotNull()).withColumns({k: F.col(k).cast("string") for k in KEY})
    placed = kept.repartition(*KEY)
    schema = "recording_id string, speaker_id string, n long, factors double, mattr double"
    there = placed.sortWithinPartitions(*KEY, *order).select(*cols).mapInArrow(run, schema)
    back = placed.sortWithinPartitions(*KEY, *(F.col(c).desc() for c in order)).select(*cols).mapInArrow(run, schema)
    both = there.join(back.select(*KEY, F.col("factors").alias("back")), KEY)
    mtld = (F.when(F.col("factors") > 0, F.col("n") / F.col("factors")) + F.when(F.col("back") > 0, F.col("n") / F.col("back"))) / 2
    return both.select(*KEY, F.col("mattr").alias(f"{prefix}_mattr_20"), mtld.alias(f"{prefix}_mtld"))


def disfluency(tok: DataFrame) -> DataFrame:
    """Fillers, fragments, immediate repetitions, retracings, revisions, mazes and marked errors."""
    w = Window.partitionBy(*UTT, F.col("kind") == "word").orderBy("tok_idx")
    t = tok.withColumn("rep", (F.col("kind") == "word") & F.coalesce(F.lag("norm").over(w) == F.col("norm"), F.lit(False)))
    kinds = ("filler", "fragment", "retracing", "revision", "error")
    out = t.groupBy(*KEY).agg(F.count("*").alias("n"), count_if(F.col("kind") == "word").alias("words"), count_if(F.col("rep")).alias("disfluency_immediate_repetition_count"), *(count_if(F.col("kind") == k).alias(k) for k in kinds))
    maze = F.col("disfluency_immediate_repetition_count") + sum((F.col(k) for k in MAZE[1:]), F.col(MAZE[0]))
    cols = {}
    for k in kinds:
        name = "annotated_error" if k == "error" else k
        cols[f"disfluency_{name}_count"], cols[f"disfluency_{name}_ratio"] = F.col(k), ratio(k, "n")
    cols |= {"disfluency_immediate_repetition_ratio": ratio("disfluency_immediate_repetition_count", "words"), "disfluency_maze_count": maze, "disfluency_maze_ratio": ratio(maze, "n")}
    return out.withColumns(cols).drop("n", "words", *kinds)
