"""Passes over sorted partitions: groups of bounded size come one after the other, and only one is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def each_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[tuple, list[dict]], list[dict]], schema: str, flush: int = 20_000) -> DataFrame:
    """Apply ``fn(key, rows)`` to the rows of each key, in order; it returns rows of ``schema``.

    For groups that are bounded by nature (the tokens of an utterance).  One
    shuffle by key serves all groups; a hot prefix of the key is spread.
    """
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, [], []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(len(names)))):
                r = dict(zip(names, row))
                k = tuple(r[x] for x in keys)
                if k != key:
                    if held:
                        done.extend(fn(key, held))
                    key, held = k, []
                    if len(done) >= flush:
                        yield pa.RecordBatch.from_pylist(done, schema=arrow)
                        done = []
                held.append(r)
        if held:
            done.extend(fn(key, held))
        yield pa.RecordBatch.from_pylist(done, schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)
