"""Ordered work on groups that may be far too long for one task.

A window over ``PARTITION BY key ORDER BY t`` sorts a whole group in one task. A single
device, scan or run may hold a large share of all rows, so every ordered operator here
cuts its groups into chunks (by dense index or by time), works inside
``(key, chunk)``, and carries one summary row per chunk across the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INDEX_CHUNK = 65536
TIME_CHUNK_S = 86400


def index_chunk(i, rows: int = INDEX_CHUNK) -> Column:
    """Chunk number of a dense index."""
    return F.floor(F.col(i) / F.lit(rows)) if isinstance(i, str) else F.floor(i / F.lit(rows))


def epoch_us(ts) -> Column:
    """Microseconds since the epoch of a timestamp, with or without zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def time_chunk(ts, seconds: int = TIME_CHUNK_S) -> Column:
    """Chunk number of a timestamp. Choose ``seconds`` so that one key in one chunk fits a task."""
    return F.floor(epoch_us(ts) / F.lit(seconds * 1_000_000))


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null, keeping the left key columns."""
    names = {k: f"__r_{k}" for k in keys}
    r = right.withColumnsRenamed(names)
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[names[k]])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*names.values())


def group_totals(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Attach whole-group aggregates to every row: aggregate first, then join the small result."""
    return join_same(df, df.groupBy(*keys).agg(*aggs), keys)


def with_halo(df: DataFrame, i: str, rows: int, before: int = 0, after: int = 0,
              n: str | None = None, chunk: str = "_chunk") -> DataFrame:
    """Cut a dense index into chunks and copy the border rows a sliding window needs.

    Chunk ``c`` receives the indexes ``c*rows - before .. (c+1)*rows - 1 + after``. Use
    :func:`own_rows` to drop the copies again. ``n`` names the group length, which stops
    copies into a chunk that has no rows of its own.
    """
    c = F.col(i)
    lo = F.floor((c - after) / F.lit(rows))
    hi = F.floor((c + before) / F.lit(rows))
    if n is not None:
        hi = F.least(hi, F.floor((F.col(n) - 1) / F.lit(rows)))
    return df.withColumn(chunk, F.explode(F.sequence(F.greatest(lo, F.lit(0).cast("bigint")), hi)))


def own_rows(df: DataFrame, i: str, rows: int, chunk: str = "_chunk") -> DataFrame:
    return df.filter(F.col(chunk) == F.floor(F.col(i) / F.lit(rows))).drop(chunk)


_TOTAL = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, carry: Column, here: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(here, F.lit(0))
    if kind == "max":
        return F.when(carry.isNull(), here).when(here.isNull(), carry) \
                .otherwise(F.when(here > carry, here).otherwise(carry))
    if kind == "min":
        return F.when(carry.isNull(), here).when(here.isNull(), carry) \
                .otherwise(F.when(here < carry, here).otherwise(carry))
    return F.coalesce(here, carry)  # last


def running(df: DataFrame, keys: list[str], order: list[str], chunk: str,
            specs: dict[str, tuple[str, Column]], exclusive: bool = False) -> DataFrame:
    """Running ``sum``, ``max``, ``min`` or ``last`` (last non-null) per key in the given order.

    ``order`` must be unique within a key. ``chunk`` must not decrease along ``order``.
    """
    k = [*keys, chunk]
    src = df.withColumns({f"__v_{n}": v for n, (_, v) in specs.items()})
    pos = F.struct(*order)
    end = -1 if exclusive else Window.currentRow
    inside = Window.partitionBy(*k).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    across = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)

    def total(kind, c):
        if kind == "last":
            return F.max_by(c, F.when(c.isNotNull(), pos))
        return _TOTAL[kind](c)

    def over(kind, c, w):
        return (F.last(c, ignorenulls=True) if kind == "last" else _TOTAL[kind](c)).over(w)

    sums = src.groupBy(*k).agg(*[total(kind, F.col(f"__v_{n}")).alias(f"__c_{n}")
                                 for n, (kind, _) in specs.items()])
    carry = sums.select(*k, *[over(kind, F.col(f"__c_{n}"), across).alias(f"__c_{n}")
                              for n, (kind, _) in specs.items()])
    # first chunks carry nothing; for groups of one chunk no row is left to join
    carry = carry.filter(F.coalesce(*[F.when(F.col(f"__c_{n}").isNotNull(), F.lit(True)) for n in specs], F.lit(False)))
    rows = src.withColumns({f"__h_{n}": over(kind, F.col(f"__v_{n}"), inside)
                            for n, (kind, _) in specs.items()})
    out = join_same(rows, carry, k)
    out = out.withColumns({n: _combine(kind, F.col(f"__c_{n}"), F.col(f"__h_{n}"))
                           for n, (kind, _) in specs.items()})
    return out.drop(*[f"__{p}_{n}" for n in specs for p in "vch"])


def neighbour(df: DataFrame, keys: list[str], order: list[str], chunk: str,
              name: str, value: Column, step: int) -> DataFrame:
    """The value of the previous (``step=-1``) or next (``step=1``) row of the key."""
    k = [*keys, chunk]
    src = df.withColumn("__v", F.struct(value.alias("v")))
    pos = F.struct(*order)
    inside = Window.partitionBy(*k).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(chunk)
    edge = F.max_by("__v", pos) if step < 0 else F.min_by("__v", pos)
    move = F.lag if step < 0 else F.lead
    carry = src.groupBy(*k).agg(edge.alias("__e")) \
               .select(*k, move("__e").over(across).alias("__e")).filter("__e IS NOT NULL")
    rows = src.withColumn("__h", move("__v").over(inside))
    return join_same(rows, carry, k) \
        .withColumn(name, F.coalesce("__h", "__e")["v"]).drop("__v", "__h", "__e")


def row_index(df: DataFrame, keys: list[str], order: list[str], chunk: str,
              name: str = "i") -> DataFrame:
    """Dense index from 0 in the given order."""
    return running(df, keys, order, chunk, {name: ("sum", F.lit(1).cast("bigint"))}) \
        .withColumn(name, F.col(name) - 1)
