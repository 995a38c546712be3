"""The interval nearest in time to each record of the same entity, within a tolerance.

Records and intervals are partitioned by entity and time slice and sorted by
time; one pass over each partition merges them, holding only the intervals that
are still open (each one nested in the next) or ended last, and the records
that wait for the next start.  A hot entity is spread over its slices; an
interval goes to every slice in which a record could be near it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Length of a slice; with integer milliseconds it bounds the distinct times that a slice can hold.
SLICE = 600_000
#: An interval over more slices than this meets only those slices that hold records.
WIDE = 32
#: Stands for "no end", as records have none.
NO_END = -(2**63)


class _Merge:
    """The state of one entity's slice: what is open, and who waits for the next start."""

    def __init__(self, tolerance: int) -> None:
        self.tol = tolerance
        self.ids: list[int] = []
        self.near: list[int | None] = []
        self.reset()

    def reset(self) -> None:
        self.stack: list[tuple[int, int, int]] = []  # (start, end, id): starts ascending, ends descending
        self.wait: list[tuple[int, int, int | None, int]] = []  # (time, record, candidate, its distance)

    def flush(self) -> None:
        for _, r, c, _ in self.wait:
            self.ids.append(r)
            self.near.append(c)
        self.wait = []

    def interval(self, s: int, e: int, i: int) -> None:
        if self.wait:  # the next start: nearer to a waiting record than an ended interval, if not further away
            for t, r, c, d in self.wait:
                near = s - t
                self.ids.append(r)
                self.near.append(i if near <= self.tol and (c is None or near <= d) else c)
            self.wait = []
        stack, kept = self.stack, []
        while stack and stack[-1][0] == s:  # equal starts come by id, and the smaller id is first choice
            kept.append(stack.pop())
        if not any(x[1] >= e for x in kept):
            while stack and stack[-1][1] <= e:  # starts further off and ends no later: never nearer again
                stack.pop()
            stack.append((s, e, i))
        stack.extend(reversed(kept))

    def record(self, t: int, r: int) -> None:
        if self.wait and t - self.wait[0][0] > self.tol:
            k, last = 0, t - self.tol
            while k < len(self.wait) and self.wait[k][0] < last:
                self.ids.append(self.wait[k][1])
                self.near.append(self.wait[k][2])
                k += 1
            del self.wait[:k]
        stack = self.stack
        while len(stack) > 1 and stack[-1][1] < t:
            stack.pop()
        if stack:
            _, e, i = stack[-1]
            if e >= t:
                self.ids.append(r)
                self.near.append(i)
                return
            d = t - e
            if d <= self.tol:
                self.wait.append((t, r, i, d))
                return
        self.wait.append((t, r, None, 0))


def _runs(b: pa.RecordBatch) -> list[int]:
    """Where a new entity or slice begins in a batch, its first row left out."""
    ent, sl = b.column("entity"), b.column("slice").to_numpy(zero_copy_only=False)
    if len(sl) < 2:
        return []
    new = pc.fill_null(pc.not_equal(ent[1:], ent[:-1]), False).to_numpy(zero_copy_only=False) | (sl[1:] != sl[:-1])
    if ent.null_count:
        gone = ent.is_null().to_numpy(zero_copy_only=False)
        new |= gone[1:] != gone[:-1]
    return (np.flatnonzero(new) + 1).tolist()


def _merged(tolerance: int):
    schema = pa.schema([("record", pa.int64()), ("near", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, key, last = _Merge(tolerance), None, None
        for b in batches:
            if not b.num_rows:
                continue
            ends = pc.fill_null(b.column("e"), NO_END).to_pylist()
            times, ids = b.column("t").to_pylist(), b.column("id").to_pylist()
            edges = [0, *_runs(b), b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                here = (b.column("entity")[lo].as_py(), b.column("slice")[lo].as_py())
                if here != key:
                    m.flush()
                    m.reset()
                    key, last = here, None
                record, interval = m.record, m.interval
                for k in range(lo, hi):
                    if ends[k] != NO_END:
                        interval(times[k], ends[k], ids[k])
                    elif ids[k] != last:  # repeated rows follow each other
                        last = ids[k]
                        record(times[k], last)
            if len(m.ids) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(m.ids, pa.int64()), pa.array(m.near, pa.int64())], schema=schema)
                m.ids.clear()
                m.near.clear()
        m.flush()
        yield pa.RecordBatch.from_arrays([pa.array(m.ids, pa.int64()), pa.array(m.near, pa.int64())], schema=schema)

    return run


def nearest_interval(records: DataFrame, intervals: DataFrame, *, entity: str, record_id: str, time: str, interval_id: str, start: str, end: str, tolerance: int, matched_only: bool = False) -> DataFrame:
    """(record_id, interval_id): every timed record with the nearest interval, null where none is within ``tolerance``.

    - The distance is 0 within an interval and on its ends, else that to its nearer end; among equals the interval
      whose start is nearer wins, then the smaller id.
    - Intervals count only with both ends and end > start; records without a time are left out.
    - Repeated rows (same id, entity and time) count once.  A null entity matches nothing, so its records come out with null.
    - Times and ids are whole numbers; other columns are ignored, and so may bear any name.
    """
    rec = records.select(F.col(entity).alias("entity"), F.col(time).cast("long").alias("t"), F.col(record_id).cast("long").alias("id")).where("t is not null")
    rec = rec.withColumn("slice", F.floor(F.col("t") / SLICE))
    iv = intervals.select(F.col(entity).alias("entity"), F.col(start).cast("long").alias("t"), F.col(end).cast("long").alias("e"), F.col(interval_id).cast("long").alias("id")).where("e > t and entity is not null")
    first, last = F.floor((F.col("t") - tolerance) / SLICE), F.floor((F.col("e") + tolerance) / SLICE)
    iv = iv.withColumns({"a": first, "z": last})
    short = iv.where(F.col("z") - F.col("a") < WIDE).select("entity", F.explode(F.sequence("a", "z")).alias("slice"), "t", "e", "id")
    # Where a wide interval holds: only slices with records, so its copies are bounded by what is there.
    wide = iv.where(F.col("z") - F.col("a") >= WIDE)
    there = rec.where("entity is not null").select(F.col("entity").alias("e2"), F.col("slice").alias("slice")).distinct()
    wide = wide.join(there, (F.col("entity") == F.col("e2")) & F.col("slice").between(F.col("a"), F.col("z"))).select("entity", "slice", "t", "e", "id")
    every = rec.select("entity", "slice", "t", F.lit(None).cast("long").alias("e"), "id").unionByName(short).unionByName(wide)
    # At equal times intervals come before records.
    lined = every.repartition("entity", "slice").sortWithinPartitions("entity", "slice", "t", F.col("e").isNull(), "id")
    out = lined.mapInArrow(_merged(tolerance), "record long, near long")
    if matched_only:
        out = out.where("near is not null")
    return out.select(F.col("record").alias(record_id), F.col("near").alias(interval_id))
