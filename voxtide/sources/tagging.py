"""Putting new morphology into CHAT texts of which everything else stays as it is, byte for byte."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# The tiers that are replaced.
REPLACED = r"^%(mor|gra):"


def replace_morphology(files: DataFrame, tiers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, content) with new %mor and %gra tiers, and (path, code) of files whose utterances are not those of ``tiers``.

    ``files``: path, content; ``tiers``: path, utt_idx (from 0), mor, gra, a row an utterance, null where it has no tier.
    Old %mor and %gra tiers go with their continuation lines; the new ones follow the speaker tier and its
    continuations, with its kind of line end.  Lines are split at line feeds only, so media bullets and
    carriage returns stay.  A file whose count of utterances differs is not written.
    """
    # Each line keeps its end; a text without one at its end keeps that, too.
    pieces = F.regexp_extract_all("content", F.lit(r"[^\n]*\n|[^\n]+\z"), F.lit(0))
    lines = files.where("content is not null").select("path", F.posexplode(pieces).alias("no", "line"))
    w = Window.partitionBy("path").orderBy("no")
    to = w.rowsBetween(Window.unboundedPreceding, 0)
    follows = F.col("line").rlike("^[ \t]")
    lines = lines.withColumn("head", ~follows).withColumn("block", F.sum(F.col("head").cast("int")).over(to))
    first = F.first("line").over(Window.partitionBy("path", "block").orderBy("no"))
    lines = lines.withColumn("first", first).where(~F.coalesce(F.col("first").rlike(REPLACED), F.lit(False)))
    lines = lines.withColumn("utt_idx", F.sum((F.col("head") & F.col("line").startswith("*")).cast("int")).over(to) - 1)
    own = lines.where(F.col("first").startswith("*")).groupBy("path", "utt_idx").agg(F.max("no").alias("no"), F.max_by("line", "no").alias("tail"), F.min_by("line", "no").alias("line"))
    counts = lines.groupBy("path").agg((F.max("utt_idx") + 1).alias("a")).join(tiers.groupBy("path").agg(F.count("*").alias("b")), "path", "left")
    odd = counts.where(F.col("a") != F.coalesce("b", F.lit(0))).select("path", F.lit("UTTERANCE_COUNT_MISMATCH").alias("code"))
    end = F.when(F.col("line").endswith("\r\n"), "\r\n").otherwise("\n")
    tier = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"%{name}:\t"), F.col(c), end))
    # A last line without an end gets one before what follows it.
    gap = F.when(~F.col("tail").endswith("\n"), end).otherwise("")
    said = F.concat(F.coalesce(tier("mor", "mor"), F.lit("")), F.coalesce(tier("gra", "gra"), F.lit("")))
    new = own.join(tiers, ["path", "utt_idx"]).select("path", "no", F.lit(1).alias("side"), F.when(said != "", F.concat(gap, said)).otherwise("").alias("line"))
    every = lines.select("path", "no", F.lit(0).alias("side"), "line").unionByName(new).join(odd.select("path"), "path", "left_anti")
    # A file is one row of text, as it was.
    whole = every.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "side", "line"))), lambda x: x["line"]), "").alias("content"))
    return whole, odd
