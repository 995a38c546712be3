"""Mixing sources to target shares of all tokens.

Tokens are summed per source.  The total is the largest at which every source
can reach its share within its cap, which fixes how often each source repeats:
rate = share * total / tokens.  Each document then comes floor(rate) times, plus
once more with the remaining fraction as probability, drawn by a hash of its id,
so that the draw is the same on every run and executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from voxtide.llm.tokens import VOCABULARY, encoding
from voxtide.session import materialise

#: Target lists are configuration: more sources than this are refused.
MAX_SOURCES = 10_000


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: float


def read_targets(df: DataFrame) -> list[Target]:
    """Targets from (source, target_share, max_repeats); a repeated source counts once, null or zero shares not at all."""
    rows = df.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("m")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return [Target(r.source, float(r.s), float("inf") if r.m is None else float(r.m)) for r in rows]


def token_counts(docs: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents with ``n_tokens`` of the whole text (0 for a null or empty one)."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(vocabulary)
        for ts in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in ts], dtype="int64")

    return docs.withColumn("n_tokens", count(F.col(text)))


def rates(available: dict[str, int], targets: list[Target]) -> dict[str, float]:
    """How often each source repeats.  A source without tokens can't be served: the others keep their proportions."""
    served = [t for t in targets if available.get(t.source, 0) > 0]
    if not served:
        return {}
    total = min(t.max_repeats * available[t.source] / t.share for t in served)
    if total == float("inf"):  # no cap at all: nothing has to be dropped
        total = max(available[t.source] / t.share for t in served)
    # The source that sets the total repeats exactly at its cap, whatever the rounding of the division.
    return {t.source: float(min(t.max_repeats, t.share * total / available[t.source])) for t in served}


def _counted(docs: DataFrame, key: str, source: str, text: str, vocabulary: str) -> DataFrame:
    counted = token_counts(docs.select(key, source, text).where(F.col(key).isNotNull()), text, vocabulary)
    return materialise(counted.select(key, source, "n_tokens").dropDuplicates([key]), "tokens")[0]


def _by_source(counted: DataFrame, source: str, targets: list[Target]) -> dict[str, int]:
    names = [t.source for t in targets]
    rows = counted.where(F.col(source).isin(names)).groupBy(source).agg(F.sum("n_tokens").alias("n")).collect()  # one row a target at most
    return {r[source]: int(r["n"]) for r in rows}


def _emit(counted: DataFrame, key: str, source: str, rate: dict[str, float], seed: int) -> DataFrame:
    table = F.create_map(*(F.lit(x) for kv in rate.items() for x in kv)) if rate else F.lit(None).cast("map<string,double>")
    r = F.coalesce(F.try_element_at(table, F.col(source)), F.lit(0.0))
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(2**52)) / F.lit(float(2**52))
    copies = (F.floor(r) + F.when(u < r - F.floor(r), 1).otherwise(0)).cast("int")
    return counted.withColumn("copies", copies).where("copies > 0")


def mix(docs: DataFrame, key: str, source: str, text: str, targets: list[Target], *, seed: int = 0, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The selection (key, source, copy_no from 1, n_tokens) and its report, one row per target.

    - Documents of sources without a target, or of none, are not selected; a repeated key counts once, a null key is left out.
    - A source is never repeated more often than ``max_repeats``; a null cap is none.
    - Documents without tokens are selected like others of their source and add nothing to a share.
    - The report has the share of the tokens selected; it is null where nothing is selected.
    """
    counted = _counted(docs, key, source, text, vocabulary)
    available = _by_source(counted, source, targets)
    rate = rates(available, targets)
    emitted = _emit(counted, key, source, rate, seed)
    chosen = emitted.select(key, source, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens")
    got = emitted.groupBy(F.col(source).alias("source")).agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("selected_tokens"), F.count("*").alias("documents"))
    spark = docs.sparkSession
    rows = [(t.source, float(t.share), float(t.max_repeats), available.get(t.source, 0), rate.get(t.source, 0.0)) for t in targets]
    plan = spark.createDataFrame(rows, "source string, target_share double, max_repeats double, available_tokens long, rate double")
    both = plan.join(got, "source", "left").fillna(0, ["selected_tokens", "documents"])
    total = F.sum("selected_tokens").over(Window.partitionBy())  # one row a target, so one task is enough
    return chosen, both.withColumn("actual_share", F.when(total > 0, F.col("selected_tokens") / total))
