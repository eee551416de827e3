"""Whole runs of rows in Arrow batches: many small groups share one call, and a group waits for its last row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def run_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of every run of equal keys, and the number of rows."""
    new = np.ones(t.num_rows, bool)
    if t.num_rows:
        new[1:] = False
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def map_runs(df: DataFrame, keys: list[str], order: list[str], each, schema: str, parts: int | None = None) -> DataFrame:
    """``each(table)`` on whole runs of rows with equal ``keys`` (no nulls), sorted by ``keys`` and ``order``; it gives a table, or
    tables in turn where much comes out of few rows. ``parts`` fixes the number of tasks, which else follows the bytes shuffled.

    Unlike a grouped call, a table holds as many runs as a batch has, so that small groups cost no call of their own, and
    whatever their ids are they spread evenly; only the last run of a batch waits for the next batch.
    """
    def out(t):
        got = each(t)
        for one in [got] if isinstance(got, pa.Table) else got:
            yield from one.to_batches()

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            cut = int(run_starts(t, keys)[-2]) if t.num_rows else 0
            rest = t.slice(cut)
            if cut:
                yield from out(t.slice(0, cut).combine_chunks())
        if rest is not None and rest.num_rows:
            yield from out(rest.combine_chunks())
    dealt = df.repartition(*keys) if parts is None else df.repartition(parts, *keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
