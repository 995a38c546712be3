"""Scoring of transcripts, diarization and study arms: edit rates, coverage, gates, selection, bootstrap, classification."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtide.functions.exprs import count_if, ratio
from voxtide.operators.intervals import meet, periods_and_gaps, shared_length

#: Participants of a study are few; more rows than this are refused by the driver-side statistics.
MAX_PARTICIPANTS = 100_000


#: Tokens of a pair are numbered from here on and written as characters, of which there are so many.
FIRST_CODE, CODES = 0x10000, 0x100000


def token_edits(a: Column, b: Column) -> Column:
    """Edit distance of two token lists: each distinct token becomes a character, and the texts of these are compared."""
    known = F.array_distinct(F.concat(a, b))

    def coded(x: Column) -> Column:
        char = lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, t) - 1 + FIRST_CODE), 8, "0")), "UTF-32")
        return F.array_join(F.transform(x, char), "")

    too_many = F.raise_error(F.lit(f"more than {CODES} different tokens in a pair of texts"))
    return F.when(F.size(known) > CODES, too_many.cast("int")).otherwise(F.levenshtein(coded(a), coded(b))).cast("long")


def edit_counts(pairs: DataFrame, gold: str, predicted: str, kinds: Sequence[str] = ("syer", "cer")) -> DataFrame:
    """The pairs with edits and reference sizes: ``syer`` over white-space tokens, ``cer`` over characters without spaces,
    ``wer`` over words, whose syllables are joined by ``_``.

    For ``syer`` a word counts as its syllables, for ``cer`` the mark between them is no character.
    Null texts count as empty; whole texts are compared.
    """
    split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")
    syllables = lambda c: F.translate(F.coalesce(F.col(c), F.lit("")), "_", " ")
    out = {}
    for k in kinds:
        if k == "cer":
            g, p = (F.regexp_replace(syllables(c), r"\s+", "") for c in (gold, predicted))
            out |= {"cer_edits": F.levenshtein(g, p).cast("long"), "cer_ref": F.char_length(g).cast("long")}
        else:
            g, p = (split(syllables(c) if k == "syer" else F.col(c)) for c in (gold, predicted))
            out |= {f"{k}_edits": token_edits(g, p), f"{k}_ref": F.size(g).cast("long")}
    return pairs.withColumns(out)


def pooled_and_macro(sessions: DataFrame, participant: str, edits: str, ref: str, groups: Sequence[str] = ()) -> DataFrame:
    """Pooled rate of each participant (sum / sum) and their unweighted mean; participants without reference have none."""
    per = sessions.groupBy(*groups, participant).agg(F.sum(edits).alias("e"), F.sum(ref).alias("r"))
    rate = ratio("e", "r")
    return per.groupBy(*groups).agg(ratio(F.sum("e"), F.sum("r")).alias("pooled_rate"), F.avg(rate).alias("macro_rate"), F.count(rate).alias("participants"), F.sum("e").alias("edits"), F.sum("r").alias("ref_count"))


def diarization_error(reference: DataFrame, hypothesis: DataFrame, collar: int = 250) -> DataFrame:
    """Share of each recording's reference time, less a collar at both ends of each interval, that the hypothesis gives to another speaker or none.

    Both sides: recording_id, speaker, start_ms, end_ms.  Each interval is matched by the sum of what it shares with every
    hypothesis of its speaker, so overlapping hypotheses count twice, up to its length, and repeated rows count each time.
    False alarms don't count and the rate is at most 1; it is 0 for a recording without reference time.
    """
    ref = reference.select("recording_id", "speaker", (F.col("start_ms") + collar).alias("start_ms"), (F.col("end_ms") - collar).alias("end_ms")).where("end_ms > start_ms")
    each = shared_length(ref, hypothesis.select("recording_id", "speaker", "start_ms", "end_ms"), ["recording_id", "speaker"], "start_ms", "end_ms")
    length = F.col("end_ms") - F.col("start_ms")
    sums = each.groupBy("recording_id").agg(F.sum(F.col("n") * length).alias("reference_ms"), F.sum(F.col("n") * F.greatest(F.lit(0), length - F.col("shared"))).alias("uncovered_ms"))
    out = reference.select("recording_id").union(hypothesis.select("recording_id")).distinct().join(sums, "recording_id", "left").fillna(0, ["reference_ms", "uncovered_ms"])
    return out.withColumn("der", F.when(F.col("reference_ms") > 0, F.least(F.lit(1.0), ratio("uncovered_ms", "reference_ms"))).otherwise(0.0))


def retention(reference: DataFrame, windows: DataFrame, slice_ms: int = 60_000) -> DataFrame:
    """Per recording: merged reference time, how much of it the merged windows retain, and utterances retained by half or more.

    ``reference``: recording_id, start_ms, end_ms per utterance; ``windows`` likewise.  Utterances meet windows in time slices.
    """
    w = periods_and_gaps(windows, ["recording_id"], "start_ms", "end_ms").where("kind = 'period'").select("recording_id", F.col("start_ms").alias("ws"), F.col("end_ms").alias("we"))

    def covered(d: DataFrame, keys: list[str]) -> DataFrame:
        return meet(d, w, ["recording_id"], ("start_ms", "end_ms"), ("ws", "we"), slice_ms).groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).alias("kept"))

    utt = reference.where("end_ms > start_ms").select("recording_id", "start_ms", "end_ms").distinct()
    merged = periods_and_gaps(utt, ["recording_id"], "start_ms", "end_ms").where("kind = 'period'").drop("kind")
    total = merged.groupBy("recording_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("reference_ms"))
    kept = covered(merged, ["recording_id"]).withColumnRenamed("kept", "retained_ms")
    by = covered(utt, ["recording_id", "start_ms", "end_ms"])
    n = utt.join(by, ["recording_id", "start_ms", "end_ms"], "left").groupBy("recording_id").agg(F.count("*").alias("utterances"), count_if(2 * F.coalesce("kept", F.lit(0)) >= F.col("end_ms") - F.col("start_ms")).alias("retained_utterances"))
    return total.join(n, "recording_id").join(kept, "recording_id", "left").fillna(0, ["retained_ms"]).withColumn("coverage", ratio("retained_ms", "reference_ms"))


def gate(part: Column, whole: Column, numerator: int = 95, denominator: int = 100) -> Column:
    """part / whole >= numerator / denominator in whole numbers; null where there is nothing to judge."""
    return F.when(whole > 0, part * denominator >= whole * numerator)


def select_arm(arms: DataFrame, groups: Sequence[str], rate: str, baseline: str, eligible: str, ties: Sequence[Column], tie_points: float = 1.0) -> DataFrame:
    """The eligible arm, no worse than the baseline's rate, of the lowest rate.

    Arms within ``tie_points`` percentage points of the lowest are decided by ``ties``, in order.  A null rate is no candidate.
    """
    e = arms.where(F.col(eligible) & (F.col(rate) <= F.col(baseline)))
    best = e.groupBy(*groups).agg(F.min(rate).alias("__best"))
    j = e.join(best, list(groups)).where(F.round((F.col(rate) - F.col("__best")) * 100, 9) <= tie_points)
    w = Window.partitionBy(*groups).orderBy(*ties)
    return j.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__best")


def paired_difference(arms: DataFrame, arm: str, baseline: str, participant: str, rate: str) -> DataFrame:
    """Per arm: mean of its participants' rates less the baseline's, and how many differences have the sign of the mean."""
    base = arms.where(F.col(arm) == baseline).select(participant, F.col(rate).alias("__b"))
    d = arms.where(F.col(arm) != baseline).join(base, participant).withColumn("__d", F.col(rate) - F.col("__b")).where("__d is not null")
    m = d.groupBy(arm).agg(F.avg("__d").alias("mean_difference"), F.count("*").alias("participants"))
    return d.join(m, arm).groupBy(arm).agg(F.first("mean_difference").alias("mean_difference"), F.first("participants").alias("participants"), count_if(F.signum("__d") == F.signum("mean_difference")).alias("sign_agreement"))


def complete_rate(value: Column, per: Column) -> Column:
    """Aggregate: sum over sum, null if any value is missing."""
    return F.when(F.count(value) == F.count("*"), ratio(F.sum(value), F.sum(per)))


def auroc(df: DataFrame, score: str, positive: str, groups: Sequence[str] = ()) -> DataFrame:
    """Area under the curve by rank sums, ties at their average rank, from counts of distinct scores."""
    c = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(*groups, score).agg(count_if(F.col(positive)).alias("p"), count_if(~F.col(positive)).alias("n"))
    w = Window.partitionBy(*groups).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    r = c.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return r.groupBy(*groups).agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / F.when(F.sum("p") * F.sum("n") > 0, F.sum("p") * F.sum("n"))).alias("auroc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def confusion(df: DataFrame, truth: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    """Counts of the four outcomes, sensitivity, specificity and balanced accuracy of booleans."""
    t, p = F.col(truth), F.col(predicted)
    a = df.where(t.isNotNull() & p.isNotNull()).groupBy(*groups).agg(count_if(t & p).alias("tp"), count_if(~t & p).alias("fp"), count_if(t & ~p).alias("fn"), count_if(~t & ~p).alias("tn"))
    s, c = ratio("tp", F.col("tp") + F.col("fn")), ratio("tn", F.col("tn") + F.col("fp"))
    return a.withColumns({"sensitivity": s, "specificity": c, "balanced_accuracy": (s + c) / 2})


def bootstrap(values: Sequence[float], statistic: Callable[[Sequence[float]], float] = lambda v: sum(v) / len(v), *, resamples: int = 1000, seed: int = 0, level: float = 0.95) -> tuple[float, float] | None:
    """Percentile interval of a statistic of participants' values, resampled with a seeded generator; None without values."""
    v = [x for x in values if x is not None and x == x]
    if not v:
        return None
    if len(v) > MAX_PARTICIPANTS:
        raise ValueError(f"more than {MAX_PARTICIPANTS} participants")
    rng = random.Random(seed)
    got = sorted(statistic(rng.choices(v, k=len(v))) for _ in range(resamples))
    lo = int((1 - level) / 2 * resamples)
    return got[lo], got[resamples - 1 - lo]


def cross_validated(cohort: DataFrame, features: Sequence[str], label: str, group: str, *, folds: int = 5, strengths: Sequence[float] = (0.01, 0.1, 1.0)) -> DataFrame:
    """Out-of-fold probability of a logistic model, folds assigned by a hash of the group so that none is split.

    Medians fill missing values and features are standardized, both from the training folds; the ridge strength is
    the best of ``strengths`` on an inner fold.  Columns that are constant or empty are left out.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    finite = {c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)) for c in features}  # NaN sorts above all numbers, so it fails too
    cohort = cohort.withColumns(finite)
    usable = cohort.agg(*(F.count_distinct(F.round(F.col(c), 12)).alias(c) for c in features)).first()
    cols = [c for c in features if usable[c] >= 2]
    data = cohort.select(group, F.col(label).cast("double").alias("label"), *(F.col(c).cast("double") for c in cols)).withColumn("fold", F.pmod(F.xxhash64(group), F.lit(folds)))
    score = BinaryClassificationEvaluator(metricName="areaUnderROC")

    def model(train: DataFrame, c: float):
        steps = [Imputer(strategy="median", inputCols=cols, outputCols=[f"{x}_" for x in cols]), VectorAssembler(inputCols=[f"{x}_" for x in cols], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(regParam=c, elasticNetParam=0.0)]
        return Pipeline(stages=steps).fit(train)

    out = None
    for k in range(folds):
        train, test = data.where(F.col("fold") != k), data.where(F.col("fold") == k)
        inner = (k + 1) % folds
        fit = train.where(F.col("fold") != inner)
        best = max(strengths, key=lambda c: score.evaluate(model(fit, c).transform(train.where(F.col("fold") == inner))))
        p = model(train, best).transform(test).select(group, "label", "fold", F.get(vector_to_array("probability"), F.lit(1)).alias("probability"))
        out = p if out is None else out.unionByName(p)
    return out
