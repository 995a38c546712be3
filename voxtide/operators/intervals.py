"""Continuous periods and gaps of intervals per entity.

Starts and ends are sorted and ranked independently of each other.  A gap lies where
the start of rank i + 1 exceeds the end of rank i; the first start and the last end
stand alone.  Each such boundary closes one period and opens the next, so a period
runs from what the boundary before opened to what this one closes.

Equal times are counted together before ranks are given: a start then carries the rank
before it, an end the rank that it reaches, and the two meet by equal ranks, for among
equal ends only the last can lie before a gap, and among equal starts only the first
after one.

The ranking never puts an entity into one task: time is cut into buckets, ranks
run inside a bucket, and per-bucket totals (one row a bucket) carry them over.
With integer times a bucket has at most ``bucket_width`` distinct times; boundaries
are cut into buckets by rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtide.session import materialise


def carry_in(df: DataFrame, keys: Sequence[str], bucket: str, totals: dict[str, Column]) -> DataFrame:
    """Add, for each name in ``totals``, its sum over all earlier buckets of the same keys (0 in the first)."""
    sums = df.groupBy(*keys, bucket).agg(*(e.alias(n) for n, e in totals.items()))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        *(F.col(k).alias(f"__b_{k}") for k in (*keys, bucket)),
        *(F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in totals),
    )
    cond = F.lit(True)
    for k in (*keys, bucket):
        cond = cond & df[k].eqNullSafe(before[f"__b_{k}"])
    return df.join(before, cond).drop(*(f"__b_{k}" for k in (*keys, bucket)))


def nearest_values(df: DataFrame, keys: Sequence[str], at: str, tie: Sequence[Column], value: str, width: float, before: str, after: str | None = None) -> DataFrame:
    """``df`` with ``before``: the last non-null ``value`` at or before each row in order of (``at``, *tie) among its keys' rows; and ``after``, if named: the next one behind it.

    Windows see a bucket of ``at``; what lies in other buckets is carried by a row each.  ``at`` is a number without nulls.
    """
    ks = list(keys)
    order = F.struct(F.col(at).alias("o"), *(c.alias(f"t{i}") for i, c in enumerate(tie)))
    df = df.withColumns({"__b": F.floor(F.col(at) / width), "__o": order})
    there = F.when(F.col(value).isNotNull(), F.col("__o"))
    per = df.groupBy(*ks, "__b").agg(F.max_by(value, there).alias("__last"), F.min_by(value, there).alias("__first"))
    line = Window.partitionBy(*ks).orderBy("__b")
    per = per.select(
        *(F.col(k).alias(f"__k_{k}") for k in (*ks, "__b")), F.last("__last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.first("__first", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("__after"),
    )
    cond = F.lit(True)
    for k in (*ks, "__b"):
        cond = cond & df[k].eqNullSafe(per[f"__k_{k}"])
    w = Window.partitionBy(*ks, "__b").orderBy("__o")
    out = df.join(per, cond).withColumn(before, F.coalesce(F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__before"))
    if after:
        out = out.withColumn(after, F.coalesce(F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), "__after"))
    return out.drop("__b", "__o", "__before", "__after", *(f"__k_{k}" for k in (*ks, "__b")))


#: Ranks in a bucket of boundaries.
RANKS = 100_000


def boundaries(df: DataFrame, keys: Sequence[str], start: str, end: str, bucket_width: int = 600_000) -> DataFrame:
    """(k0.., i, closes, opens): per entity, the boundary behind rank i, with the end it closes (null before the
    first period) and the start it opens (null behind the last)."""
    ks = [f"__k{i}" for i in range(len(keys))]
    iv = df.select(*(F.col(k).alias(a) for k, a in zip(keys, ks)), F.col(start).alias("__s"), F.col(end).alias("__e")).where("__e > __s")
    times = (
        iv.select(*ks, F.explode(F.array(F.struct(F.lit(True).alias("is_start"), F.col("__s").alias("t")), F.struct(F.lit(False).alias("is_start"), F.col("__e").alias("t")))).alias("x"))
        .groupBy(*ks, "x.is_start", "x.t")
        .agg(F.count("*").alias("c"))
        .withColumn("__b", F.floor(F.col("t") / bucket_width))
    )
    times, _ = materialise(times, "times")
    side = [*ks, "is_start"]
    buckets = times.groupBy(*side, "__b").agg(F.sum("c").alias("c"))
    over = Window.partitionBy(*side)
    buckets = buckets.select(*(F.col(k).alias(f"__o{k}") for k in (*side, "__b")), F.coalesce(F.sum("c").over(over.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(over).alias("n"))
    cond = F.lit(True)
    for k in (*side, "__b"):
        cond = cond & times[k].eqNullSafe(buckets[f"__o{k}"])
    inside = Window.partitionBy(*side, "__b").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = times.join(buckets, cond).select(*side, "t", "c", "n", (F.col("before") + F.sum("c").over(inside)).alias("rank"))
    # The start of rank i + 1 meets the end of rank i.
    met = ranked.select(*ks, F.when(F.col("is_start"), F.col("rank") - F.col("c")).otherwise(F.col("rank")).alias("i"), "n", F.when(F.col("is_start"), F.col("t")).alias("opens"), F.when(~F.col("is_start"), F.col("t")).alias("closes"))
    met = met.groupBy(*ks, "i").agg(F.max("n").alias("n"), F.max("closes").alias("closes"), F.max("opens").alias("opens"))
    first, last = F.col("i") == 0, F.col("i") == F.col("n")
    return met.where(first | last | (F.col("opens") > F.col("closes"))).select(*ks, "i", "closes", "opens")


def _opened(edges: DataFrame, ks: Sequence[str]) -> DataFrame:
    """The boundaries with ``since``: the start that the boundary before opened.  Starts rise with ranks, so it is the largest before."""
    edges = edges.withColumn("__b", F.floor(F.col("i") / RANKS))
    tops = edges.groupBy(*ks, "__b").agg(F.max("opens").alias("top"))
    tops = tops.select(*(F.col(k).alias(f"__o{k}") for k in (*ks, "__b")), F.max("top").over(Window.partitionBy(*ks).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("top"))
    cond = F.lit(True)
    for k in (*ks, "__b"):
        cond = cond & edges[k].eqNullSafe(tops[f"__o{k}"])
    before = Window.partitionBy(*ks, "__b").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return edges.join(tops, cond).select(*ks, "closes", "opens", F.greatest(F.max("opens").over(before), "top").alias("since"))


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, *, max_gap: int | None = None, bucket_width: int = 600_000) -> DataFrame:
    """Periods and gaps per entity: the keys, ``kind`` ('period' or 'gap'), ``start`` and ``end``.

    - Counted are intervals with both ends (null and NaN ends fail) and end > start; the rest add nothing.
    - Overlapping, nested and touching intervals join into one period; repeated rows change nothing.
    - A gap runs from a period's end to the next start of the same entity; one longer than ``max_gap`` is left out.
    - A null in a key is an entity of its own; an empty table gives an empty result; other columns are ignored.
    """
    ks = [f"__k{i}" for i in range(len(keys))]
    edges, _ = materialise(boundaries(df.where(~F.isnan(F.col(start).cast("double")) & ~F.isnan(F.col(end).cast("double"))), keys, start, end, bucket_width), "edges")
    gap = F.col("opens").isNotNull()
    if max_gap is not None:
        gap = gap & (F.col("opens") - F.col("closes") <= max_gap)
    rows = _opened(edges, ks).where("closes is not null").select(
        *ks,
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.lit("period").alias("kind"), F.col("since").alias("s"), F.col("closes").alias("e")),
                    F.when(gap, F.struct(F.lit("gap").alias("kind"), F.col("closes").alias("s"), F.col("opens").alias("e"))),
                )
            )
        ).alias("x"),
    )
    return rows.select(*(F.col(a).alias(k) for k, a in zip(keys, ks)), F.col("x.kind").alias("kind"), F.col("x.s").alias(start), F.col("x.e").alias(end))


def shared_length(a: DataFrame, b: DataFrame, keys: Sequence[str], start: str, end: str, bucket_width: int = 600_000) -> DataFrame:
    """(keys, start, end, n, shared): each distinct interval of ``a``, how often it stands, and the sum of what it shares with each of ``b``.

    What all intervals of ``b`` hold before a time is open * time - (sum of open starts), so both ends of an interval
    need running sums only, and no pair is made.  Intervals of ``b`` count as often as they stand; those without
    length, on either side, are left out.  Null keys meet null keys.
    """
    ks = list(keys)
    q = a.where(F.col(end) > F.col(start)).groupBy(*ks, F.col(start).alias("__s"), F.col(end).alias("__e")).agg(F.count("*").alias("n"))
    zero = F.col("__s") * 0
    points = q.select(*ks, "__s", "__e", "n", F.explode(F.array(F.struct(F.col("__s").alias("t"), F.lit(-1).alias("sign")), F.struct(F.col("__e").alias("t"), F.lit(1).alias("sign")))).alias("x"), F.lit(0).cast("long").alias("open"), zero.alias("since"))
    points = points.select(*ks, "__s", "__e", "n", "x.t", "x.sign", "open", "since")
    ends = F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))
    ev = b.where(F.col(end) > F.col(start)).select(*ks, F.explode(ends).alias("x")).groupBy(*ks, F.col("x.t").alias("t")).agg(F.sum("x.d").alias("open"), F.sum(F.col("x.d") * F.col("x.t")).alias("since"))
    both = points.unionByName(ev, allowMissingColumns=True).withColumn("__b", F.floor(F.col("t") / bucket_width))
    w = Window.partitionBy(*ks, "__b").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = carry_in(both, ks, "__b", {"__open": F.sum("open"), "__since": F.sum("since")})
    held = (F.col("__open") + F.sum("open").over(w)) * F.col("t") - (F.col("__since") + F.sum("since").over(w))
    return both.withColumn("held", held).where("sign is not null").groupBy(*ks, F.col("__s").alias(start), F.col("__e").alias(end), "n").agg(F.sum(F.col("sign") * F.col("held")).alias("shared"))


def meet(a: DataFrame, b: DataFrame, keys: Sequence[str], a_ends: tuple[str, str], b_ends: tuple[str, str], width: float) -> DataFrame:
    """All columns of both sides, and ``lo`` and ``hi``, for each pair of intervals with the same keys that share a stretch of time.

    Both sides are laid into slices of time, of ``width`` or of the smallest doubling of it that is not
    shorter than the interval, so even an interval with a wrong end lies in two slices at most.  A pair meets at
    the level of its longer interval, in the slice of its later start.  Other columns' names must differ.
    """
    ks = list(keys)

    def own(ends: tuple[str, str]) -> Column:
        return F.greatest(F.lit(0), F.ceil(F.log2((F.col(ends[1]) - F.col(ends[0])) / F.lit(width)))).cast("int")

    a, b = (x.where(F.col(e[1]) > F.col(e[0])).withColumn(n, own(e)) for x, e, n in ((a, a_ends, "__la"), (b, b_ends, "__lb")))
    # At most one row for each doubling of time.
    there = sorted(r[0] for r in a.select("__la").distinct().union(b.select("__lb").distinct()).distinct().collect())
    if not there:
        return a.join(b, ks).withColumns({"lo": F.col(a_ends[0]), "hi": F.col(a_ends[1])}).drop("__la", "__lb")

    def laid(x: DataFrame, ends: tuple[str, str], level: str) -> DataFrame:
        x = x.withColumn("__level", F.explode(F.array(*map(F.lit, there)))).where(F.col("__level") >= F.col(level))
        size = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("__level"))
        return x.withColumn("__slice", F.explode(F.sequence(F.floor(F.col(ends[0]) / size), F.floor(F.col(ends[1]) / size))))

    lo, hi = F.greatest(a_ends[0], b_ends[0]), F.least(a_ends[1], b_ends[1])
    size = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("__level"))
    at = (F.col("__level") == F.greatest("__la", "__lb")) & (lo < hi) & (F.floor(lo / size) == F.col("__slice"))
    j = laid(a, a_ends, "__la").join(laid(b, b_ends, "__lb"), [*ks, "__level", "__slice"]).where(at)
    return j.withColumns({"lo": lo, "hi": hi}).drop("__la", "__lb", "__level", "__slice")
