"""Task scores: matching words to aliases (exact, then near), recall order, fluency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from voxtide.functions.exprs import count_if, ratio

KEY = ["recording_id", "speaker_id"]
NEAR = 0.85
#: Alias lists belong to a task's specification: larger ones are refused, as they are broadcast.
MAX_ALIASES = 10_000


def similarity(a, b):
    """1 - edits / the longer length, over characters."""
    n = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(n > 0, 1 - F.levenshtein(a, b) / n)


def match_aliases(types: DataFrame, value: str, aliases: DataFrame, least: float = NEAR) -> DataFrame:
    """(value, key): the first key (in order) with an equal alias, else the first key with an alias at least ``least`` alike.

    ``aliases``: key, key_pos, alias; null and empty aliases match nothing.  Only distinct values that no alias
    equals meet all aliases, and lengths that rule a match out go before any edit distance is computed.
    """
    if aliases.limit(MAX_ALIASES + 1).count() > MAX_ALIASES:
        raise ValueError(f"more than {MAX_ALIASES} aliases")
    al = F.broadcast(aliases.where("alias is not null and alias <> ''"))  # bounded above
    v = types.select(F.col(value).alias("v")).where("v is not null and v <> ''").distinct()
    exact = v.join(al, F.col("v") == F.col("alias")).groupBy("v").agg(F.min_by("key", F.struct("key_pos", "key")).alias("key"))
    left = v.join(exact.select("v"), "v", "left_anti")
    short = F.least(F.char_length("v"), F.char_length("alias")) / F.greatest(F.char_length("v"), F.char_length("alias"))
    near = left.join(al, (short >= least) & (similarity(F.col("v"), F.col("alias")) >= least)).groupBy("v").agg(F.min_by("key", F.struct("key_pos", "key")).alias("key"))
    return exact.unionByName(near).withColumnRenamed("v", value)


def coverage(hits: DataFrame, words: DataFrame, n_keys: int, prefix: str) -> DataFrame:
    """Distinct matched keys over all keys and over words, and the share of repeated hits; ``hits``: a row per matched word with ``key``."""
    n = words.groupBy(*KEY).agg(F.count("*").alias("n"))
    h = hits.groupBy(*KEY).agg(F.count("*").alias("h"), F.count_distinct("key").alias("u"))
    j = n.join(h, KEY, "left").fillna(0, ["h", "u"])
    return j.select(*KEY, (F.col("u") / F.lit(float(n_keys))).alias(f"{prefix}_coverage"), ratio("u", "n").alias(f"{prefix}_density"), ratio(F.col("h") - F.col("u"), F.col("h")).alias("task_repeat_ratio"))


def recall_order(hits: DataFrame, n_keys: int) -> DataFrame:
    """Longest common subsequence of first mentions with the reference order, over all ideas.

    First mentions are distinct, so it is the longest rising subsequence of key positions; there are at most ``n_keys`` of them.
    """
    first = hits.groupBy(*KEY, "key_pos").agg(F.min(F.struct("utt_idx", "tok_idx")).alias("at"))
    seq = first.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", "key_pos"))).alias("s"))
    # The smallest last key of a rising run of each length, kept sorted: each key replaces the first that is no smaller.
    tails = F.aggregate(
        F.transform("s", lambda x: x["key_pos"].cast("long")), F.array().cast("array<bigint>"),
        lambda a, k: F.concat(F.filter(a, lambda y: y < k), F.array(k), F.slice(F.filter(a, lambda y: y >= k), 2, F.lit(n_keys))),
    )
    return seq.select(*KEY, (F.size(tails) / F.lit(float(n_keys))).alias("task_recall_order_score"))


def fluency(responses: DataFrame, valid: DataFrame, value: str) -> DataFrame:
    """Valid, repeated and intruding responses, their halves in time and rate, and runs of one subcategory.

    ``responses``: a row per response with ``value``, start_s, end_s and utt_idx; ``valid``: value, category (null for none).
    """
    r = responses.join(valid.withColumn("ok", F.lit(True)), value, "left").fillna(False, ["ok"])
    span = r.groupBy(*KEY).agg(F.min("start_s").alias("lo"), F.max("end_s").alias("hi"))
    r = r.join(span, KEY)
    first = F.col("ok") & (F.col("start_s") < (F.col("lo") + F.col("hi")) / 2)
    v = F.when(F.col("ok"), F.col(value))
    out = r.groupBy(*KEY).agg(
        F.count("*").alias("task_fluency_response_count"), count_if(F.col("ok")).alias("task_fluency_valid_count"), F.count_distinct(v).alias("task_fluency_valid_unique"), count_if(first).alias("task_fluency_first_half_valid"),
        (F.first("hi") - F.first("lo")).alias("span"),
    )
    w = Window.partitionBy(*KEY).orderBy("start_s", "utt_idx")
    c = r.where("ok and category is not null").withColumn("p", F.lag("category").over(w))
    runs = c.groupBy(*KEY).agg(count_if(F.col("p").isNull() | (F.col("p") != F.col("category"))).alias("task_fluency_clusters"), F.count("*").alias("categorised"), count_if(F.col("p") != F.col("category")).alias("task_fluency_switches"))
    j = out.join(runs, KEY, "left").fillna(0, ["task_fluency_clusters", "task_fluency_switches", "categorised"])
    return j.withColumns({
        "task_fluency_repeats": F.col("task_fluency_valid_count") - F.col("task_fluency_valid_unique"), "task_fluency_intrusions": F.col("task_fluency_response_count") - F.col("task_fluency_valid_count"),
        "task_fluency_second_half_valid": F.col("task_fluency_valid_count") - F.col("task_fluency_first_half_valid"),
        "task_fluency_production_change": F.col("task_fluency_valid_count") - 2 * F.col("task_fluency_first_half_valid"),
        "task_fluency_rate": ratio(F.col("task_fluency_valid_unique"), F.col("span") / 60), "task_fluency_cluster_size_mean": ratio("categorised", "task_fluency_clusters"),
    }).drop("span", "categorised")
