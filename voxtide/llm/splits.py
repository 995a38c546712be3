"""Groups of related records, and splits that keep each group whole.

Nodes are the linking values themselves (an author, a session), so no record is
needed to find a component: each distinct pair of values that one record holds
is an edge.  Hash-to-min joins them: every node sends its cluster to the
smallest of it and that smallest to all of it, until nothing changes.  Clusters
are rows (node, member), never lists, and each round is a written table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtide.operators.lookup import lookup
from voxtide.session import drop_path, materialise

#: Stand-ins for a missing id, without case, white space, hyphens and underscores: the default of ``missing``.  Where one of
#: them is somebody's name, pass a list without it, or that author's records aren't tied.
MISSING = ("", "na", "n/a", "none", "null", "nil", "nan", "unknown", "unk", "tbd", "tba", "missing", "notavailable", "undefined", "unassigned")
#: Hash-to-min needs about the logarithm of the longest path; this many rounds mean that something is wrong.
MAX_ROUNDS = 60


def canonical_id(c: Column, missing: Sequence[str] = MISSING) -> Column:
    """Without case, white space, hyphens and underscores; null for a stand-in and for what holds no letter or digit."""
    v = F.regexp_replace(F.lower(c), r"[\s\p{Z}_\-‐-―]+", "")
    return F.when(~v.isin(["", *missing]) & v.rlike(r"[\p{L}\p{N}]"), v)


def _fingerprint(t: DataFrame) -> tuple:
    return tuple(t.agg(F.count("*"), F.sum(F.xxhash64("node", "member").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("member", "node"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node linked to each node of ``edges`` (a, b), directly or through others.

    Nulls link nothing.  Nodes compare as strings or numbers, whatever they are.
    """
    e = edges.where("a is not null and b is not null")
    both = e.select(F.col("a").alias("node"), F.col("b").alias("member")).union(e.select("b", "a"))
    both = both.union(e.select("a", F.col("a"))).union(e.select("b", F.col("b"))).distinct()
    now, path = materialise(both, "clusters")
    mark = _fingerprint(now)
    for _ in range(MAX_ROUNDS):
        least = now.groupBy("node").agg(F.min("member").alias("least"))
        told = lookup(now, least, "node")  # a giant component's smallest node holds all its members
        sent = told.select(F.explode(F.array(F.struct(F.col("least").alias("node"), "member"), F.struct(F.col("member").alias("node"), F.col("least").alias("member")))).alias("x")).select("x.*").distinct()
        nxt, nxt_path = materialise(sent, "clusters")
        drop_path(now.sparkSession, path)
        now, path = nxt, nxt_path
        fresh = _fingerprint(now)
        if fresh == mark:
            return now.groupBy("node").agg(F.min("member").alias("component"))
        mark = fresh
    raise RuntimeError("hash-to-min did not settle")


def groups(df: DataFrame, record: str, links: Sequence[str], missing: Sequence[str] = MISSING) -> DataFrame:
    """The distinct records of ``df`` with ``group_id``: the smallest record id of all records tied through ``links``.

    - Values of a link tie if alike without case, white space, hyphens and underscores; null, empty and stand-ins tie nothing.
    - Records without any link are groups of their own; repeated rows (same record id) count once; null record ids are left out.
    """
    ids = [canonical_id(F.col(c), missing) for c in links]
    vals = [F.when(v.isNotNull(), F.concat(F.lit(f"{i}:"), v)) for i, v in enumerate(ids)]
    rows = df.where(F.col(record).isNotNull()).dropDuplicates([record]).withColumn("__links", F.array_compact(F.array(*vals)))
    rows, _ = materialise(rows, "linked")
    # A record ties its first link to each of its others; the first alone stands for itself.
    edges = rows.where(F.size("__links") > 0).select(F.element_at("__links", 1).alias("a"), F.explode("__links").alias("b")).distinct()
    comp = components(edges)
    tied = lookup(rows.withColumn("__node", F.get("__links", F.lit(0))), comp.withColumnRenamed("node", "__node"), "__node").drop("__links", "__node")
    tied, _ = materialise(tied, "tied")
    ids = tied.where("component is not null").groupBy("component").agg(F.min(record).alias("group_id"))
    return lookup(tied, ids, "component").withColumn("group_id", F.coalesce("group_id", F.col(record))).drop("component")


def split_report(assigned: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """(split, target_share, groups, records, actual_share, largest_group): what each split holds; ``actual_share`` is that of the records.

    Groups are hashed whole, so shares hold for groups; a group with a large part of the records moves those of records, as it must.
    """
    by_group = assigned.groupBy("assigned_split", "group_id").agg(F.count("*").alias("n"))
    got = by_group.groupBy(F.col("assigned_split").alias("split")).agg(F.count("*").alias("groups"), F.sum("n").alias("records"), F.max("n").alias("largest_group"))
    plan = assigned.sparkSession.createDataFrame([(k, float(v or 0)) for k, v in sorted(shares.items())], "split string, target_share double")
    out = plan.join(F.broadcast(got), "split", "left").fillna(0, ["groups", "records", "largest_group"])  # a row a split
    total = F.sum("records").over(Window.partitionBy())
    return out.withColumn("actual_share", F.when(total > 0, F.col("records") / total))


def mixed_groups(grouped: DataFrame, record: str, split: str) -> DataFrame:
    """(record, group_id) of each record in a group whose records hold more than one split."""
    s = canonical_id(F.col(split))
    seen = grouped.groupBy("group_id").agg(F.min(s).alias("lo"), F.max(s).alias("hi"))
    mixed = seen.where("lo <> hi").select("group_id", F.lit(True).alias("mixed"))
    return lookup(grouped.select(record, "group_id"), mixed, "group_id").where("mixed").select(record, "group_id")


def rendezvous(key: Column, shares: Mapping[str, float], seed: int = 0) -> Column:
    """The split of ``key``: highest -share / ln(u), u being the hash of key and split in (0, 1).

    Adding or reweighting a split moves only the keys that it wins or loses.
    """
    best = None
    for name, share in sorted(shares.items()):
        if not share or share <= 0:
            continue
        u = (F.pmod(F.xxhash64(key, F.lit(name), F.lit(seed)), F.lit(2**52)) + F.lit(0.5)) / F.lit(float(2**52))
        s = F.struct((-F.lit(float(share)) / F.log(u)).alias("score"), F.lit(name).alias("name"))
        best = s if best is None else F.greatest(best, s)
    if best is None:
        raise ValueError("no split has a positive share")
    return best["name"]


def assign_splits(grouped: DataFrame, shares: Mapping[str, float], seed: int = 0) -> DataFrame:
    """The records with ``split``; all records of a group share one, and splits near their shares of the groups."""
    return grouped.withColumn("assigned_split", rendezvous(F.col("group_id"), shares, seed))
