"""Filling containers of fixed capacity with neighbouring documents.

Documents become hashed vectors of their tokens, projected to a few dimensions
and put in order along a Hilbert curve, so that documents near each other in
content are near on the curve.  The curve is cut into ranges of items; each range
is packed by one task in a single pass that looks at a window of neighbours:
largest first, each into the fullest open container that still has room.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from voxtide.llm.tokens import VOCABULARY, encoding
from voxtide.session import materialise

DIMENSIONS = 4
#: Bits of the curve in each dimension; all together must fit a long.
BITS = 12
HASHED = 4096
#: Items of the curve seen together, and containers kept open from window to window.  Both are small, so that what shares a
#: container was near on the curve: wider windows fill a little better (README) and mix what is far apart.
WINDOW = 256
OPEN = 32
#: Items (documents or parts of them) of one range, which is one task's work.
RANGE = 150_000
#: Capacities are configuration: more of them are refused.
MAX_SPECS = 100


def projection(seed: int = 7) -> np.ndarray:
    """Random signs for each hashed token."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), size=(HASHED, DIMENSIONS))


def hashed_vector(ids: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The projected, length-normalized vector of a document's token counts, damped by their logarithm."""
    if not len(ids):
        return np.zeros(DIMENSIONS)
    n = np.bincount((ids.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(7)).astype(np.int64) % HASHED, minlength=HASHED)
    at = np.flatnonzero(n)
    w = 1 + np.log(n[at])
    return w @ signs[at] / np.sqrt(w @ w)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows), by Skilling's transform of coordinates to its transpose."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def described(docs: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, n_tokens, v): token count and projected vector of each whole text."""

    @F.pandas_udf("n_tokens long, v array<double>")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc, signs = encoding(vocabulary), projection()
        for ts in batches:
            ids = [np.array(enc.encode_ordinary(t), np.uint32) if t else np.empty(0, np.uint32) for t in ts]
            yield pd.DataFrame({"n_tokens": pd.Series([len(i) for i in ids], dtype="int64"), "v": [hashed_vector(i, signs) for i in ids]})

    return docs.withColumn("__d", describe(F.col(text))).select(key, "__d.n_tokens", "__d.v")


def on_curve(described_docs: DataFrame) -> DataFrame:
    """The documents with ``place`` on the curve: vectors standardized by the corpus and cut into even cells by the normal law."""
    each = [F.get("v", F.lit(i)) for i in range(DIMENSIONS)]
    m = described_docs.where("n_tokens > 0").agg(*(F.avg(e).alias(f"m{i}") for i, e in enumerate(each)), *(F.stddev_pop(e).alias(f"s{i}") for i, e in enumerate(each))).first()
    mean = np.array([m[f"m{i}"] or 0.0 for i in range(DIMENSIONS)])
    sd = np.array([m[f"s{i}"] or 1.0 for i in range(DIMENSIONS)])

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vs in batches:
            z = (np.stack(vs.to_numpy()) - mean) / sd if len(vs) else np.empty((0, DIMENSIONS))
            even = 1 / (1 + np.exp(-1.702 * z))  # the logistic curve stands in for the normal law
            yield pd.Series(hilbert_key(np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)))

    return described_docs.withColumn("place", place("v")).drop("v")


class Packer:
    """Containers of one capacity, filled from a stream of items."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.open: list[tuple[int, int]] = []  # (room, container), by room
        self.made = 0

    def pack(self, sizes: Sequence[int]) -> list[int]:
        """The container of each item of one window: largest items first, each where least room is left."""
        where = [0] * len(sizes)
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            n = sizes[k]
            at = bisect.bisect_left(self.open, (n, -1))
            if at < len(self.open):
                room, c = self.open.pop(at)
            else:
                room, c = self.capacity, self.made
                self.made += 1
            where[k] = c
            if room - n:
                bisect.insort(self.open, (room - n, c))
        if len(self.open) > OPEN:  # the fullest are closed
            del self.open[: len(self.open) - OPEN]
        return where


def _packed(specs: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        packers = {s: Packer(c) for s, c in specs.items()}
        held: dict[str, list[tuple]] = {s: [] for s in specs}

        def emit(spec: str) -> pa.RecordBatch:
            rows, held[spec] = held[spec], []
            where = packers[spec].pack([r[3] for r in rows])
            doc, part, first, n = (list(x) for x in zip(*rows))
            return pa.RecordBatch.from_pydict(
                {"spec_name": [spec] * len(rows), "container_id": pa.array([base + c for c in where], pa.int64()), "doc": pa.array(doc, pa.int64()), "part_no": pa.array(part, pa.int32()), "first_token": pa.array(first, pa.int64()), "n_tokens": pa.array(n, pa.int64())}
            )

        for b in batches:
            spec, *cols = (b.column(c).to_pylist() for c in ("spec_name", "doc", "part_no", "first_token", "n_tokens"))
            for s, *row in zip(spec, *cols):
                held[s].append(row)
                if len(held[s]) >= WINDOW:
                    yield emit(s)
        for s in specs:
            if held[s]:
                yield emit(s)

    return run


def read_specs(df: DataFrame) -> dict[str, int]:
    """Capacities from (spec_name, capacity_tokens); those that can hold nothing are refused."""
    rows = df.where("spec_name is not null").groupBy("spec_name").agg(F.max("capacity_tokens").alias("c")).limit(MAX_SPECS + 1).collect()
    if len(rows) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} capacities")
    if bad := [r.spec_name for r in rows if r.c is None or r.c < 1]:
        raise ValueError(f"no capacity: {bad}")
    return {r.spec_name: int(r.c) for r in rows}


def pack(docs: DataFrame, key: str, text: str, specs: dict[str, int], *, vocabulary: str = VOCABULARY) -> DataFrame:
    """(spec_name, container_id, key, part_no, first_token, n_tokens): where each document, or part of one, lies.

    - A document is cut only if longer than the capacity: into full parts and a last one that is packed like a document.
    - Every document is placed once for each capacity; one without tokens (null or empty text) takes no room in a container.
    - A repeated key counts once, a null key is left out; keys are whole numbers.  An empty table gives an empty result.
    - Container ids are unique within a capacity, and neither dense nor ordered.
    """
    d, _ = materialise(described(docs.select(key, text).where(F.col(key).isNotNull()), key, text, vocabulary).dropDuplicates([key]), "described")
    d, _ = materialise(on_curve(d).withColumnRenamed(key, "doc"), "curve")
    caps = F.array(*(F.struct(F.lit(s).alias("spec_name"), F.lit(c).cast("long").alias("cap")) for s, c in sorted(specs.items())))
    items = d.select(F.col("doc").cast("long").alias("doc"), "n_tokens", "place", F.explode(caps).alias("c")).select("c.spec_name", "c.cap", "doc", "n_tokens", "place")
    parts = F.greatest(F.ceil(F.col("n_tokens") / F.col("cap")), F.lit(1)).cast("int")
    items = items.select("spec_name", "cap", "doc", "n_tokens", "place", F.explode(F.sequence(F.lit(1), parts)).alias("part_no"))
    first = (F.col("part_no") - 1) * F.col("cap")
    items = items.select("spec_name", "doc", "place", "part_no", first.alias("first_token"), F.least(F.col("cap"), F.col("n_tokens") - first).alias("n_tokens"))
    # A document is as many items as it has parts, in each capacity.
    each = d.agg(*(F.sum(F.greatest(F.ceil(F.col("n_tokens") / F.lit(c)), F.lit(1))).alias(f"n{i}") for i, c in enumerate(specs.values()))).first() if specs else ()
    n = max(1, -(-sum(int(x or 0) for x in each) // RANGE))
    lined = items.repartitionByRange(n, "spec_name", "place", "doc", "part_no").sortWithinPartitions("spec_name", "place", "doc", "part_no")
    out = lined.mapInArrow(_packed(specs), "spec_name string, container_id long, doc long, part_no int, first_token long, n_tokens long")
    return out.withColumnRenamed("doc", key)
