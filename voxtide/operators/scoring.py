"""Items of transcripts that are scored, and the report of an evaluation over sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voxtide.functions.exprs import count_if, ratio
from voxtide.operators.evaluation import bootstrap, edit_counts
from voxtide.sources.documents import nfc

# Items that are punctuation only; codes of items that scoring can't settle.
PUNCTUATION = (".", "?", "!", ",", "...", "…")
REPLACEMENT, FRAGMENT, UNTRANSCRIBED, NO_LENGTH = "REPLACEMENT_ANNOTATION", "NONWORD_FRAGMENT", "UNTRANSCRIBED_SPAN", "ZERO_DURATION_UTTERANCE"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: ~x.isin("", *PUNCTUATION))


def plain_items(df: DataFrame, text: str, out: str = "items") -> DataFrame:
    """``out``: the composed words of a plain text, an array; none for a null text."""
    return df.withColumn(out, _words(nfc(F.coalesce(F.col(text), F.lit("")))))


def lenient_items(df: DataFrame, text: str, out: str = "items") -> DataFrame:
    """``out``: the composed words of all speaker tiers of a CHAT text, however broken the rest of it, without media bullets."""
    lines = F.filter(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n"), "\n"), lambda x: F.trim(x).rlike(r"^\*[A-Za-z0-9]+:"))
    said = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^\*[A-Za-z0-9]+:", ""), r"[\x15•]\d+_\d+[\x15•]", ""))
    return df.withColumn(out, _words(nfc(F.array_join(said, " "))))


def strict_items(tok: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, items): the words that are spoken, in order, from items with ``tier_role`` (as from ``tiers.tier_roles``), ``utt_idx`` and ``tok_idx``.

    Fillers lose their mark and scopes theirs; skipped and untranscribed items are not scored.
    """
    surface = F.regexp_replace(F.regexp_replace("text", "^<+|>+$", ""), "^&-", "")
    w = tok.where(~F.col("tier_role").isin("skip", "untranscribed")).withColumn("w", surface).where(~F.col("w").isin("", *PUNCTUATION))
    # A session's words, which the edit distance needs all of.
    return w.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("utt_idx", "tok_idx", "w"))), lambda x: x["w"]).alias("items"))


def uncertainty(tok: DataFrame, utterances: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, utt_idx, code): what scoring can't settle in an utterance, each code once."""
    text = F.col("text")
    code = F.when(F.col("tier_role") == "untranscribed", UNTRANSCRIBED).when(F.col("tier_role") != "skip", None).when(text.startswith("[") & text.contains(":"), REPLACEMENT).when(text.startswith("&"), FRAGMENT)
    told = tok.select(*keys, "utt_idx", code.alias("code")).where("code is not null")
    return told.union(utterances.where("end_s <= start_s").select(*keys, "utt_idx", F.lit(NO_LENGTH).alias("code"))).distinct()


METRICS = ("syer", "cer", "wer")


def session_scores(pairs: DataFrame, gold: str, predicted: str) -> DataFrame:
    """The pairs of item arrays with edits and sizes of each of METRICS, and its uncapped rate (0 where the gold has no item)."""
    text = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")
    s = edit_counts(pairs.withColumns({"__g": text(gold), "__p": text(predicted)}), "__g", "__p", METRICS).drop("__g", "__p")
    return s.withColumns({f"{m}_rate": F.coalesce(ratio(f"{m}_edits", f"{m}_ref"), F.lit(0.0)) for m in METRICS})


def layer_agreement(gold: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, compared, pos_correct, uas_correct, las_correct): tags, heads and relations that agree place by place, up to the shorter side.

    Both sides: keys, place, pos, head, rel.
    """
    p = predicted.select(*keys, "place", *(F.col(c).alias(f"p_{c}") for c in ("pos", "head", "rel")))
    same = lambda c: F.coalesce(F.lower(c) == F.lower(f"p_{c}"), F.lit(False))
    return gold.join(p, [*keys, "place"]).groupBy(*keys).agg(F.count("*").alias("compared"), count_if(same("pos")).alias("pos_correct"), count_if(same("head")).alias("uas_correct"), count_if(same("head") & same("rel")).alias("las_correct"))


def _capped(metric: str) -> Column:
    rate = F.col(f"{metric}_rate")
    return F.when(rate > 1, 1.0).otherwise(rate)


def report(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, sessions, mean): the mean over sessions of each rate, capped at 1; null rates are sessions that the metric leaves out."""
    capped = scores.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), _capped(m).alias("rate")) for m in metrics))).alias("x")).select("x.*")
    return capped.groupBy("metric").agg(F.count("rate").alias("sessions"), F.avg("rate").alias("mean"))


def intervals_of_means(scores: DataFrame, metrics: Sequence[str], samples: int = 2000, seed: int = 42) -> dict[str, tuple[float, float] | None]:
    """Bootstrap interval (2.5 to 97.5 %) of each metric's mean over sessions, of which ``bootstrap`` bounds the number."""
    rows = scores.select(*(_capped(m).alias(m) for m in metrics)).limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100000 sessions")
    return {m: bootstrap([r[m] for r in rows], resamples=samples, seed=seed) for m in metrics}
