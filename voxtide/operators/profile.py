"""Column profiles of loads, and what changed since the load before.

Every profiled cell is unpivoted to (load, column, value) and counted, with
map-side combine; all figures come from those value counts: null share, distinct
values, range, violations (each distinct value is tested once), exact quartiles
and, against the load before, total variation, chi-square and population
stability index.  No figure gathers a load's values in one task: quartiles are
found by rank, narrowed to the value buckets that hold the wanted ranks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from voxtide.session import materialise

#: Rules are configuration: more than this many are refused, as each becomes part of the plan.
MAX_RULES = 2_000
#: Rows of a few dozen bytes that may be broadcast: some 10 MB.
BROADCAST_ROWS = 100_000


#: Types whose values are compared as numbers; all others as text.
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean", "timestamp")
#: A profiled column of a load.
KEYS = ["table_name", "load_id", "column_name"]


@dataclass(frozen=True)
class Rule:
    """What a column must hold: a text pattern for whole values, or an inclusive range."""

    table: str
    column: str
    pattern: str | None = None
    low: float | None = None
    high: float | None = None


def read_rules(rules: DataFrame, table: str) -> list[Rule]:
    """Rules of one table from (table_name, column_name, value_pattern, min_value, max_value); NaN limits are none."""
    rows = rules.where(F.col("table_name") == table).dropDuplicates(["column_name"]).orderBy("column_name").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} column rules")
    ok = lambda x: None if x is None or x != x else float(x)
    return [Rule(table, r.column_name, r.value_pattern or None, ok(r.min_value), ok(r.max_value)) for r in rows]


def value_counts(df: DataFrame, table: str, load: str, rules: Sequence[Rule]) -> DataFrame:
    """(table_name, load_id, column_name, num, s, x, n): how often each value stands in each column of each load.

    ``s`` holds text values, ``x`` numbers; both are null for a null or NaN cell.
    -0.0 counts as 0.0.  Rows as they lie: repeated rows count each time.
    """
    kinds = dict(df.dtypes)
    there = [r for r in rules if r.column in kinds]
    cells = []
    for i, r in enumerate(there):  # a column is a number while its values are counted
        c, i = F.col(f"`{r.column}`"), F.lit(i).cast("short").alias("i")
        if not kinds[r.column].startswith(NUMBERS):
            cells.append(F.struct(i, F.lit(False).alias("num"), c.cast("string").alias("s"), F.lit(None).cast("double").alias("x")))
        else:
            v = c.cast("double")
            cells.append(F.struct(i, F.lit(True).alias("num"), F.lit(None).cast("string").alias("s"), F.when(~F.isnan(v), v + F.lit(0.0)).alias("x")))
    if not cells:
        return df.select(F.lit(table).alias("table_name"), F.col(load).alias("load_id"), F.lit("").alias("column_name"), F.lit(False).alias("num"), F.lit("").alias("s"), F.lit(0.0).alias("x"), F.lit(1).cast("long").alias("n")).where("false")
    name = F.element_at(F.array(*(F.lit(r.column) for r in there)), F.col("i") + 1)
    return (
        df.select(F.col(load).alias("load_id"), F.explode(F.array(*cells)).alias("c"))
        .groupBy("load_id", "c.i", "c.num", "c.s", "c.x")
        .agg(F.count("*").alias("n"))
        .select(F.lit(table).alias("table_name"), "load_id", name.alias("column_name"), "num", "s", "x", "n")
    )


#: A bucket of more distinct values than this is cut into CUTS even parts of its range, until none is.
BUCKET_VALUES, CUTS = 100_000, 1024


def quartiles(counts: DataFrame) -> DataFrame:
    """(table_name, load_id, column_name, q1, q2, q3) of the number columns, exact and linearly interpolated.

    Rank p*(n-1) lies between two neighbouring values.  Values are first counted
    by bucket (sign, exponent and leading bits, in order); only the buckets that
    hold a wanted rank are ranked value by value, and one that holds too many
    values, as where a column lies within one per cent, is cut until it doesn't.
    """
    keys = KEYS
    v = counts.where("num and x is not null").select(*keys, "x", "n")
    # Order-preserving bucket: about three decimal digits of the value.
    mag = F.when(F.col("x") == 0, F.lit(0)).otherwise(F.floor(F.least(F.log2(F.abs("x")), F.lit(2000.0)) * 64) + 80_000)
    v = v.withColumn("__b", (F.signum("x") * mag).cast("long").cast("string"))
    # log2 rounds alike for equal values and never decreases, so buckets never cross.
    figures = (F.sum("n").alias("m"), F.count("*").alias("d"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    upto = lambda w: F.sum("m").over(w.orderBy("x0").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per = v.groupBy(*keys, "__b").agg(*figures)
    per = per.withColumn("hi", upto(Window.partitionBy(*keys))).withColumn("lo", F.col("hi") - F.col("m"))
    tot = per.groupBy(*keys).agg(F.sum("m").alias("total"))
    want = tot.select(*keys, F.explode(F.array(*(F.struct(F.lit(i).alias("q"), ((F.col("total") - 1) * p).alias("at")) for i, p in ((1, 0.25), (2, 0.5), (3, 0.75))))).alias("w"))
    want = want.select(*keys, "w.q", F.floor("w.at").alias("below"), (F.col("w.at") - F.floor("w.at")).alias("frac"))
    want = want.select(*keys, "q", "frac", F.explode(F.array(F.col("below"), F.when(F.col("frac") > 0, F.col("below") + 1))).alias("r"), F.col("below")).where("r is not null")
    # Six ranks a group at most, so these tables grow with loads and columns only.
    rank = ["q", "frac", "r", "below"]
    hits, _ = materialise(per.join(want, keys).where("r >= lo and r < hi").select(*keys, "__b", "lo", "d", "x0", "x1", *rank), "ranks")
    wide = (F.col("d") > BUCKET_VALUES) & (F.col("x0") < F.col("x1"))
    while hits.where(wide).limit(1).count():
        need = hits.where(wide).select(*keys, "__b", "lo", "x0", "x1").distinct()
        part = F.least(F.floor((F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0")) * CUTS), F.lit(CUTS - 1))
        inner = v.join(_small(need), [*keys, "__b"]).select(*keys, F.col("__b").alias("was"), F.col("lo").alias("base"), "x", "n", F.concat_ws("/", "__b", part.cast("string")).alias("__b"))
        inner, _ = materialise(inner, "cut")
        finer = inner.groupBy(*keys, "was", "base", "__b").agg(*figures)
        finer = finer.withColumn("hi", F.col("base") + upto(Window.partitionBy(*keys, "was"))).withColumn("lo", F.col("hi") - F.col("m")).drop("base", "m")
        asked = hits.where(wide).select(*keys, F.col("__b").alias("was"), *rank)
        again = finer.join(asked, [*keys, "was"]).where("r >= lo and r < hi").select(*hits.columns)
        rest = v.join(_small(hits.where(~wide).select(*keys, "__b").distinct()), [*keys, "__b"], "left_semi").select(*keys, "x", "n", "__b")
        v = rest.unionByName(inner.select(*keys, "x", "n", "__b"))
        hits, _ = materialise(hits.where(~wide).unionByName(again), "ranks")
    need = hits.select(*keys, "__b", F.col("lo").alias("n0")).distinct()
    w = Window.partitionBy(*keys, "__b").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = v.join(_small(need), [*keys, "__b"]).withColumn("hi", F.col("n0") + F.sum("n").over(w))
    got = ranked.join(hits.drop("lo", "d", "x0", "x1"), [*keys, "__b"]).where("r < hi and r >= hi - n")
    got = got.groupBy(*keys, "q").agg(F.first("frac").alias("f"), F.max(F.when(F.col("r") == F.col("below"), F.col("x"))).alias("a"), F.max(F.when(F.col("r") > F.col("below"), F.col("x"))).alias("b"))
    value = F.when(F.col("f") > 0, F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).otherwise(F.col("a"))
    return got.groupBy(*keys).agg(*(F.max(F.when(F.col("q") == i, value)).alias(f"q{i}") for i in (1, 2, 3)))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if its rows, once counted, are at most BROADCAST_ROWS; else as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def column_figures(counts: DataFrame, rules: Sequence[Rule], texts: bool = False) -> DataFrame:
    """One row per load and column with its figures; violations count rows, tested once per distinct value.

    With ``texts`` the first and the last text by code point too (``min_text``, ``max_text``).
    """
    bad_pattern = bad_range = F.lit(False)
    for r in rules:
        here = (F.col("table_name") == r.table) & (F.col("column_name") == r.column)
        if r.pattern is not None:
            bad_pattern = F.when(here, ~F.col("s").rlike(rf"\A(?:{r.pattern})\z")).otherwise(bad_pattern)
        if r.low is not None or r.high is not None:
            out = F.lit(False)
            if r.low is not None:
                out = out | (F.col("x") < r.low)
            if r.high is not None:
                out = out | (F.col("x") > r.high)
            bad_range = F.when(here, out).otherwise(bad_range)
    there = F.col("s").isNotNull() | F.col("x").isNotNull()
    return counts.groupBy(*KEYS).agg(
        F.first("num").alias("num"),
        F.sum("n").alias("n_rows"),
        F.sum(F.when(~there, F.col("n")).otherwise(0)).alias("n_null"),
        F.count(F.when(there, F.lit(1))).alias("n_distinct"),
        F.min("x").alias("min_value"),
        F.max("x").alias("max_value"),
        *([F.min("s").alias("min_text"), F.max("s").alias("max_text")] if texts else []),
        F.sum(F.when(there & F.coalesce(bad_pattern, F.lit(False)), F.col("n")).otherwise(0)).alias("n_pattern"),
        F.sum(F.when(there & F.coalesce(bad_range, F.lit(False)), F.col("n")).otherwise(0)).alias("n_range"),
    )


def previous_loads(runs: DataFrame) -> DataFrame:
    """(load_id, prev_id): the load with the next lower seq in the same stream, for all that have one.

    Of loads with the same stream and seq the highest load_id stands for the others as predecessor.
    """
    by_seq = runs.where("load_id is not null and seq is not null and stream_name is not null").groupBy("stream_name", "seq").agg(F.max("load_id").alias("prev_id"))
    w = Window.partitionBy("stream_name").orderBy("seq")
    lagged = by_seq.select("stream_name", "seq", F.lag("prev_id").over(w).alias("prev_id"))
    return runs.select("load_id", "stream_name", "seq").distinct().join(lagged, ["stream_name", "seq"]).where("prev_id is not null").groupBy("load_id").agg(F.max("prev_id").alias("prev_id"))


def distribution_changes(counts: DataFrame, figures: DataFrame, before: DataFrame, numbers: bool = True) -> DataFrame:
    """(table_name, load_id, column_name, tv, chi2, psi) against the load before.

    Text columns compare the shares of every value; number columns the shares of
    the four ranges cut at the quartiles of the load before.  PSI counts a share
    of 0 as 0.0001.  Null where either load has no values.  Without ``numbers``
    only text columns are compared.
    """
    if not numbers:
        counts, figures = counts.where("not num"), figures.where("not num")
    qb = figures.select("table_name", F.col("load_id").alias("prev_id"), "column_name", F.col("q1").alias("c1"), F.col("q2").alias("c2"), F.col("q3").alias("c3"))
    cuts = before.join(qb, "prev_id").select("table_name", "load_id", "prev_id", "column_name", "c1", "c2", "c3")
    values = counts.where("s is not null or x is not null")
    # Each count once as its own load's and once as "before" of the next load.
    role_cur = cuts.select("table_name", "load_id", F.col("load_id").alias("in_load"), "column_name", "c1", "c2", "c3", F.lit(False).alias("prev"))
    role_prev = cuts.select("table_name", "load_id", F.col("prev_id").alias("in_load"), "column_name", "c1", "c2", "c3", F.lit(True).alias("prev"))
    roles = role_cur.unionByName(role_prev)
    both = values.withColumnRenamed("load_id", "in_load").join(_small(roles), ["table_name", "in_load", "column_name"])
    cell = F.when(F.col("num"), ((F.col("x") > F.col("c1")).cast("int") + (F.col("x") > F.col("c2")).cast("int") + (F.col("x") > F.col("c3")).cast("int")).cast("string")).otherwise(F.col("s"))
    cells = both.groupBy(*KEYS, cell.alias("cell")).agg(F.sum(F.when(~F.col("prev"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("prev"), F.col("n")).otherwise(0)).alias("b"))
    tot = figures.select(*KEYS, (F.col("n_rows") - F.col("n_null")).alias("m"))
    sizes = tot.withColumnRenamed("m", "ma").join(cuts.select("table_name", "load_id", "prev_id", "column_name"), KEYS)
    sizes = sizes.join(tot.select("table_name", F.col("load_id").alias("prev_id"), "column_name", F.col("m").alias("mb")), ["table_name", "prev_id", "column_name"]).drop("prev_id")
    cells = cells.join(sizes, KEYS)
    cells = cells.where("ma > 0 and mb > 0")
    pa, pb = F.col("a") / F.col("ma"), F.col("b") / F.col("mb")
    ga, gb = F.greatest(pa, F.lit(1e-4)), F.greatest(pb, F.lit(1e-4))
    # Two-sample chi-square with unequal sizes; whole numbers inside, so tv is exact up to the last division.
    k = F.sqrt(F.col("mb") / F.col("ma"))
    return cells.groupBy(*KEYS).agg(
        (F.sum(F.abs(F.col("a") * F.col("mb") - F.col("b") * F.col("ma"))) / (2 * F.first("ma") * F.first("mb"))).alias("tv"),
        F.sum(F.pow(k * F.col("a") - F.col("b") / k, F.lit(2)) / (F.col("a") + F.col("b"))).alias("chi2"),
        F.sum((ga - gb) * F.log(ga / gb)).alias("psi"),
    )


def profile(tables: dict[str, DataFrame], load: str, rules: DataFrame, runs: DataFrame, drift_of_numbers: bool = True, every: bool = False) -> DataFrame:
    """Profile of every ruled column of every load of the tables, with the figures of the load before as ``prev_*``.

    With ``every``, of all columns but the load's own, ruled or not, and with the ranges of texts.

    - Null and NaN are both null, and left out of everything but the null share.
    - Rows without a load id belong to no load and are left out; loads missing in ``runs`` have no load before.
    - Columns without a rule are profiled with ``every`` only, and have no violations; ruled columns that a table lacks never.
    - An empty table has no rows here.  Numbers are compared as doubles, so whole numbers beyond 2**53 may fall together.
    - ``tv``, ``chi2`` and ``psi`` compare distributions; those of number columns can be left out.
    """
    known = {t: read_rules(rules, t) for t in tables}
    if every:
        for name, df in tables.items():
            ruled = {r.column for r in known[name]}
            known[name] = known[name] + [Rule(name, c) for c in df.columns if c != load and c not in ruled]
    counts = None
    for name, df in tables.items():
        c = value_counts(df.where(F.col(load).isNotNull()), name, load, known[name])
        counts = c if counts is None else counts.unionByName(c)
    counts, _ = materialise(counts, "counts")
    figures, _ = materialise(column_figures(counts, [r for rs in known.values() for r in rs], every).join(quartiles(counts), KEYS, "left"), "figures")
    before = previous_loads(runs)
    changes = distribution_changes(counts, figures, before, drift_of_numbers)
    was = ["n_rows", "n_null", "n_distinct", "q1", "q2", "q3"]
    if every:
        was += ["n_pattern", "n_range", "min_value", "max_value", "min_text", "max_text"]
    prev = before.join(figures.select("table_name", F.col("load_id").alias("prev_id"), "column_name", *(F.col(c).alias(f"prev_{c}") for c in was)), "prev_id").drop("prev_id")
    return figures.join(prev, KEYS, "left").join(changes, KEYS, "left")


def findings(prof: DataFrame, no_mix: Sequence[str] = ()) -> DataFrame:
    """(table_name, load_id, column_name, finding) from a profile."""
    iqr, prev_iqr = F.col("q3") - F.col("q1"), F.col("prev_q3") - F.col("prev_q1")
    rules = {
        "pattern": F.col("n_pattern") > 0,
        "range": F.col("n_range") > 0,
        # As whole numbers, so a difference of exactly 0.10 is none.
        "null_rate": (F.col("n_null") * F.col("prev_n_rows") - F.col("prev_n_null") * F.col("n_rows")) * 10 > F.col("n_rows") * F.col("prev_n_rows"),
        "distinct": (F.col("n_distinct") * 2 < F.col("prev_n_distinct")) | (F.col("n_distinct") > F.col("prev_n_distinct") * 2),
        "centre": F.col("num") & (F.abs(F.col("q2") - F.col("prev_q2")) > F.least(iqr, prev_iqr)),
        "spread": F.col("num") & ((iqr * 2 < prev_iqr) | (iqr > prev_iqr * 2)),
        "mix": ~F.col("num") & ~F.col("column_name").isin(list(no_mix)) & (F.col("tv") > 0.25) if no_mix else ~F.col("num") & (F.col("tv") > 0.25),
    }
    return (
        prof.select("table_name", "load_id", "column_name", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))).alias("finding"))
    )
