"""What dependent tiers make of the items of main tiers: roles, retraced scopes, and the words that morphology sees.

Items are rows (an utterance's keys, ``tok_idx``, ``text``); everything is told by windows over an
utterance's places, so no text is walked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# The kind of an item by its marks, and its role in dependent tiers; the first pattern that fits holds.
KINDS = (("^&=", "noise"), ("^&", "filler"), (".-$", "fragment"), (r"^\[/\]$", "retracing"), (r"^\[//\]$", "revision"), (r"^\[\*\]$", "error"))
ROLES = ((r"^\((\.+|\d+(\.\d+)?)\)$", "skip"), ("^&-", "filler"), ("^&", "skip"), (".-$", "skip"), ("(?i)^[.,!?…]*(xxx|yyy|www)[.,!?…]*$", "untranscribed"))
RETRACE = ("[/]", "[//]")


def _first(c: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    return F.coalesce(*(F.when(c.rlike(p), F.lit(v)) for p, v in rules), F.lit(otherwise))


def item_kind(c: Column) -> Column:
    """The kind of an item of a main tier; a word where no mark says otherwise."""
    return _first(c, KINDS, "word")


def _windows(keys: Sequence[str]) -> tuple:
    w = Window.partitionBy(*keys).orderBy("tok_idx")
    return w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)


def tier_roles(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The items with ``tier_role``: word, filler, retraced, untranscribed or skip; and ``opened``, where the annotation that an item lies in begins.

    An annotation runs from an item that begins with [ to the next that ends with ].  A mark of retracing takes
    the last item before it that is not skipped, or all from the last < on where that item ends with >.
    """
    to, before, after = _windows(keys)
    at = F.col("tok_idx")
    opened, closed = F.max(F.when(F.col("text").startswith("["), at)).over(to), F.max(F.when(F.col("text").endswith("]"), at)).over(before)
    t = items.withColumn("opened", F.when(F.coalesce(closed, F.lit(-1)) < opened, opened))
    t = t.withColumn("tier_role", F.when(F.col("opened").isNotNull(), "skip").otherwise(_first(F.col("text"), ROLES, "word")))
    t = _with_target(t, keys)
    # A mark behind a > without any < has nothing but the item right before it.
    first = F.when(F.col("target.closes"), F.coalesce("target.group", at - 1)).otherwise(F.col("target.at"))
    t = t.withColumn("__from", F.when(F.col("text").isin(*RETRACE) & (first <= F.col("target.at")), first))
    scoped = F.min("__from").over(after) <= at
    return t.withColumn("tier_role", F.when((F.col("tier_role") == "word") & scoped, "retraced").otherwise(F.col("tier_role"))).drop("__from", "target")


def _with_target(t: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target``: of the last item before that is not skipped, its place, whether a group closes there, where that began, and its role."""
    to, before, _ = _windows(keys)
    t = t.withColumn("__group", F.max(F.when(F.col("text").startswith("<"), F.col("tok_idx"))).over(to))
    here = F.struct(F.col("tok_idx").alias("at"), F.col("text").endswith(">").alias("closes"), F.col("__group").alias("group"), F.col("tier_role").alias("role"))
    return t.withColumn("target", F.max(F.when(F.col("tier_role") != "skip", here)).over(before)).drop("__group")


def morphology_words(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, source, part, surface): the words that morphology sees, in order of (source, part).

    ``items`` as ``tier_roles`` gives them.  Words lose the marks of scopes.  A correction ``[: ..]`` behind a word puts its own
    words in place of that one, or of all of the group in angle brackets that ends there, at the place where that begins;
    a later correction of the same place replaces an earlier one.  Retraced, skipped and untranscribed items have no word.
    """
    ks = list(keys)
    _, _, after = _windows(ks)
    t = _with_target(items, ks)
    begins = F.when(F.col("target.closes"), F.coalesce("target.group", "target.at")).otherwise(F.col("target.at"))
    corrects = (F.col("opened") == F.col("tok_idx")) & F.col("text").startswith("[:") & (F.col("target.role") == "word")
    t = t.withColumn("begins", F.when(corrects, begins)).withColumn("later", F.min("begins").over(after))
    surface = F.regexp_replace("text", "^[<>]+|[<>]+$", "")
    words = t.where((F.col("tier_role") == "word") & ~F.coalesce(F.col("later") <= F.col("tok_idx"), F.lit(False))).select(*ks, F.col("tok_idx").alias("source"), F.lit(0).alias("part"), surface.alias("surface"))
    # The words of a correction lie in the items of its annotation, an utterance's at most.
    inside = t.where("opened is not null").groupBy(*ks, "opened").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "text"))), lambda x: x["text"]), " ").alias("said"), F.max("begins").alias("begins"), F.max_by("later", -F.col("tok_idx")).alias("later"))
    inside = inside.where(F.col("begins").isNotNull() & ~F.coalesce(F.col("later") <= F.col("begins"), F.lit(False)))
    said = F.split(F.trim(F.regexp_replace("said", r"^\[:|\]$", "")), r"\s+")
    put = inside.select(*ks, F.col("begins").alias("source"), F.posexplode(said).alias("part", "surface")).withColumn("part", F.col("part") + 1)
    return words.unionByName(put).where("surface <> ''")
