"""How much of each text only repeats what the same text said before.

One pass measures a text in several ways.  Rules turn the measures into votes
(repetitive, sound, or none at all); expectation-maximisation finds how far each
rule is to be trusted from where the rules agree and differ over all texts; the
posterior that a text is sound replaces a filter that every rule must pass: a text is
repetitive where the posterior says so, whatever any single rule voted.
Votes are few patterns, so EM sees counts of patterns: at most 3 to the number of
rules, however many texts there are.  A text without words gets no vote and no part in EM.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from voxtide.llm.transcript import Cleaner, bare_words
from voxtide.session import materialise

RUN = 3
#: What packing nothing takes.
_EMPTY = len(zlib.compress(b"", 1))
MEASURES = "n_words int, repeated_words int, distinct_words int, top_run int, period_words int, repeated_sentences double, packed double"


def measures(words: Sequence[str], run: int = RUN) -> tuple[int, int, int, int, int]:
    """Words; words in a run of ``run`` that began earlier as well; distinct words; how often the commonest run
    stands; words that follow at the distance of the word before (loops of any period)."""
    n = len(words)
    first: dict[tuple[str, ...], int] = {}
    times: dict[tuple[str, ...], int] = {}
    repeated = done = 0
    for i, gram in enumerate(zip(*(words[k:] for k in range(run)))):
        if first.setdefault(gram, i) < i:
            times[gram] = times.get(gram, 1) + 1
            repeated += i + run - max(i, done)  # words already marked by the run before count once
            done = i + run
    seen: dict[str, int] = {}
    period = gap = 0
    for i, w in enumerate(words):
        d = i - seen.get(w, i)
        period += d > 0 and d == gap
        gap, seen[w] = d, i
    return n, repeated, len(seen), max(times.values(), default=min(1, max(0, n - run + 1))), period


def repeated_sentences(words: str) -> float:
    """Share of the words that lie in sentences which stood before."""
    seen: set[str] = set()
    again = total = 0
    part: list[str] = []
    pieces = words.split()
    for i, w in enumerate(pieces):
        part.append(w.strip(".,!?…;:"))
        if w[-1] in ".!?…" or i + 1 == len(pieces):
            s = " ".join(part)
            total += len(part)
            again += len(part) if s in seen else 0
            seen.add(s)
            part = []
    return again / total if total else 0.0


def measured(texts: DataFrame, text: str, labels: list[tuple], nonwords: list[tuple], run: int = RUN) -> DataFrame:
    """The texts with ``m``, the struct of their measures; words are the spoken ones, without punctuation at their edges."""

    @F.pandas_udf(MEASURES)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cleaner = Cleaner(labels, [f for f, *_ in nonwords])
        for ts in batches:
            rows = []
            for t in ts:
                pieces = cleaner.split(t)[1]
                words = bare_words(pieces)
                joined = " ".join(words)
                raw = joined.encode()
                packed = (len(zlib.compress(raw, 1)) - _EMPTY) / len(raw) if raw else float("nan")
                rows.append((*measures(words, run), repeated_sentences(" ".join(pieces)), packed))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURES.split(", ")])

    return texts.withColumn("m", measure(F.col(text)))


def votes() -> dict[str, Column]:
    """1: repetitive, -1: sound, 0: the rule abstains."""
    n = F.col("m.n_words")

    def rule(high: Column, low: Column) -> Column:
        return F.when(n <= 0, 0).when(high, 1).when(low, -1).otherwise(0)

    return {
        "runs": rule(F.col("m.repeated_words") * 3 >= n, F.col("m.repeated_words") * 3 < n),
        "loops": rule(F.col("m.period_words") * 4 >= n, F.col("m.period_words") * 20 <= n),
        "distinct": rule(F.col("m.distinct_words") * 3 <= n * 2, F.col("m.distinct_words") * 5 >= n * 4),
        "commonest": rule(F.col("m.top_run") * 3 * 4 >= n + 9, F.col("m.top_run") <= 1),
        "sentences": rule(F.col("m.repeated_sentences") >= 0.3, F.lit(False)),
        "packed": rule(F.col("m.packed") < 0.45, F.col("m.packed") > 0.65),
    }


def agreement(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """Posterior of 'repetitive' for each vote pattern, by expectation-maximisation over pattern counts.

    Classes: repetitive, sound.  A rule has, in each class, a chance of each of
    its three votes, smoothed by one pseudo-count on the side that it is meant
    for; EM starts from the majority of the votes.  No patterns, no posteriors.
    """
    if not patterns:
        return {}
    k = len(next(iter(patterns)))
    post = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v in patterns}
    for _ in range(rounds):
        weight = {1: 1.0, -1: 1.0}
        chance = {c: [{1: 0.2 + (c == 1), 0: 0.2, -1: 0.2 + (c == -1)} for _ in range(k)] for c in (1, -1)}
        for v, n in patterns.items():
            for c, p in ((1, post[v]), (-1, 1 - post[v])):
                weight[c] += n * p
                for j, x in enumerate(v):
                    chance[c][j][x] += n * p
        for c in (1, -1):
            for j in range(k):
                s = sum(chance[c][j].values())
                chance[c][j] = {x: y / s for x, y in chance[c][j].items()}
        fresh = {}
        for v in patterns:
            # Votes speak for a class only by how much likelier that class makes them; abstaining says nothing.
            a = math.log(weight[1] / weight[-1]) + sum(math.log(chance[1][j][x] / chance[-1][j][x]) for j, x in enumerate(v) if x)
            fresh[v] = 1 / (1 + math.exp(-max(-60.0, min(60.0, a))))
        moved = max(abs(fresh[v] - post[v]) for v in patterns)
        post = fresh
        if moved < 1e-9:
            break
    return post


def repeated_share(texts: DataFrame, key: str, text: str, labels: list[tuple], nonwords: list[tuple], run: int = RUN) -> DataFrame:
    """(key, n_words, repeated_words, share, votes): one row per key.

    - ``share`` is repeated_words / n_words, 0 without words; whole texts are measured, however long.
    - Null and blank texts have no words.  A null key is left out; repeated rows (same key) count once.
    """
    v = votes()
    rows = measured(texts.select(key, text).where(F.col(key).isNotNull()), text, labels, nonwords, run)
    share = F.when(F.col("m.n_words") > 0, F.col("m.repeated_words") / F.col("m.n_words")).otherwise(0.0)
    return rows.select(key, "m.n_words", "m.repeated_words", share.alias("share"), F.array(*(F.coalesce(c, F.lit(0)).cast("byte") for c in v.values())).alias("votes")).dropDuplicates([key])


def repetition(texts: DataFrame, key: str, text: str, labels: list[tuple], nonwords: list[tuple], run: int = RUN) -> DataFrame:
    """(key, n_words, repeated_words, share, p_repetitive, p_sound): the rows of ``repeated_share`` with their posterior.

    A text without words is sound (``p_repetitive`` 0).  An empty table gives an empty result.
    """
    rows, _ = materialise(repeated_share(texts, key, text, labels, nonwords, run), "votes")
    counts = rows.where("n_words > 0").groupBy("votes").count()  # at most 3 ** len(votes()) rows
    post = agreement({tuple(r["votes"]): r["count"] for r in counts.collect()})
    table = texts.sparkSession.createDataFrame([(list(p), float(x)) for p, x in post.items()], "votes array<byte>, p_repetitive double")
    p = F.when(F.col("n_words") > 0, F.col("p_repetitive")).otherwise(0.0)
    return rows.join(F.broadcast(table), "votes", "left").select(key, "n_words", "repeated_words", "share", p.alias("p_repetitive"), (1 - p).alias("p_sound"))
