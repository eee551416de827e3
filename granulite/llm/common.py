"""Helpers of the corpus operators: stored tables, run-wise Arrow functions, word hashes."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulite.operators.lineage import shared_folder

#: Bytes hashed at a time; texts of any length pass in slices that end between words.
SLICE = 1 << 18
#: Setting that bounds the bytes of an Arrow batch, and the bound set where there is none.
BATCH_LIMIT, BATCH_MOST = "spark.sql.execution.arrow.maxBytesPerBatch", 2_000_000


def stored(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lineage is cut, lost executors lose nothing,
    and joins know the size of what they read. ``options`` go to the writer."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that no later job reads: what was made of them is written itself."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of this session by bytes, unless it was given a bound: ten thousand long texts are too much for a batch, on
    either side of a Python worker. Rows of any length still pass, one a batch if need be."""
    if BATCH_LIMIT not in spark.conf.getAll:
        spark.conf.set(BATCH_LIMIT, str(BATCH_MOST))


@contextmanager
def bounded_batches(spark: SparkSession):
    """``small_batches`` for the jobs that run inside, and the session as it was afterwards."""
    given = BATCH_LIMIT in spark.conf.getAll
    small_batches(spark)
    try:
        yield
    finally:
        if not given:
            spark.conf.unset(BATCH_LIMIT)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the n + 1 offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def cuts(column: pa.Array, size: int) -> list[tuple[int, int]]:
    """Slices (first row, rows) of a text column with about ``size`` bytes each, one row at least."""
    out, lo, held = [], 0, 0
    for i, n in enumerate(pa.compute.binary_length(column).fill_null(0).to_pylist()):
        held += n
        if held >= size:
            out.append((lo, i + 1 - lo))
            lo, held = i + 1, 0
    if lo < len(column):
        out.append((lo, len(column) - lo))
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants from a seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_table(b: np.ndarray, off: np.ndarray, lower: bool, white: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than space and tab to carriage return, or than those that ``white`` marks) of a batch of texts.

    Returns start and end byte of each word, its 64-bit hash, and the n + 1 word offsets of the texts. ``lower`` folds
    A-Z only. Work goes in slices that end at a white byte or a text's end, so memory follows the slice.
    """
    byte = np.arange(256)
    if white is None:
        white = (byte == 32) | ((byte >= 9) & (byte <= 13))
    folded = np.where((byte >= 65) & (byte <= 90), byte + 32, byte) if lower else byte
    code = constants(256, 11)[folded]
    code[white] = 0
    edge = np.zeros(len(b) + 1, bool)
    edge[off] = True
    powers = np.ones(1, np.uint64)
    base = constants(1, 12)[0]
    starts, ends, hashes = [], [], []
    at = 0
    while at < len(b):
        end = min(len(b), at + SLICE)
        while end < len(b) and not (edge[end] or white[b[end]]):
            end += 1
        s = b[at:end]
        dark = ~white[s]
        cut = edge[at:end]
        first = dark.copy()
        first[1:] &= ~dark[:-1] | cut[1:]
        st = np.flatnonzero(first)
        if len(st):
            last = dark.copy()
            last[:-1] &= ~dark[1:] | cut[1:]
            en = np.flatnonzero(last) + 1
            length = np.diff(np.append(st, len(s)))
            if length.max() + st[0] > len(powers):
                more = np.full(int(length.max() + st[0]), base, np.uint64)
                more[0] = 1
                powers = np.multiply.accumulate(more)
            place = np.arange(len(s)) - np.repeat(np.append(0, st), np.append(st[0], length))
            starts.append(st + at)
            ends.append(en + at)
            hashes.append(np.add.reduceat(code[s] * powers[place], st))
        at = end
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    start, end = np.concatenate(starts), np.concatenate(ends)
    h = mix(np.concatenate(hashes) + (end - start).astype(np.uint64) * base)
    return start, end, h, np.searchsorted(start, off)


def shingles(h: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each text, and the n + 1 offsets of the texts.

    A text with fewer than k words, but at least one, has its whole sequence as one shingle.
    """
    c = constants(k, 13)
    n = np.diff(woff)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_off = np.append(0, np.cumsum(count))
    if out_off[-1] == 0:
        return np.zeros(0, np.uint64), out_off
    full = max(0, len(h) - k + 1)
    run = np.zeros(full, np.uint64)
    for i in range(k):
        run += h[i:i + full] * c[i]
    out = np.empty(out_off[-1], np.uint64)
    at = np.repeat(woff[:-1] - out_off[:-1], count) + np.arange(out_off[-1])
    whole = np.repeat(n >= k, count)
    out[whole] = run[at[whole]]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        first = np.append(0, np.cumsum(n[few]))
        place = np.arange(first[-1]) - np.repeat(first[:-1], n[few])
        part = h[np.repeat(woff[few], n[few]) + place] * c[place]
        out[out_off[few]] = np.add.reduceat(part, first[:-1]) + n[few].astype(np.uint64) * constants(1, 14)
    return mix(out), out_off


def runs_in_arrow(batches, keys: list[str], each):
    """Call ``each(table)`` on the whole runs of rows with equal keys, in order; rows come sorted by the keys.

    Only the last run of a batch waits for the next one, so memory holds a batch and one run.
    """
    rest = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        same = np.ones(t.num_rows - 1, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            same &= v[1:] == v[:-1]
        cut = np.flatnonzero(~same)
        if len(cut) == 0:
            rest = t
            continue
        done = int(cut[-1]) + 1
        yield from each(t.slice(0, done).combine_chunks())
        rest = t.slice(done)
    if rest is not None:
        yield from each(rest.combine_chunks())


def run_bounds(t: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of each run, and the number of rows at the end."""
    new = np.ones(t.num_rows, bool)
    for i, k in enumerate(keys):
        v = t.column(k).to_numpy()
        d = v[1:] != v[:-1]
        new[1:] = d if i == 0 else new[1:] | d
    return np.append(np.flatnonzero(new), t.num_rows)


def in_block_pairs(df: DataFrame, key: str, size: str, seed: str) -> DataFrame:
    """Give each row every pair of blocks of its group that holds its block.

    ``size`` is the number of blocks of the group. Rows get columns ``bi <= bj`` and ``mine`` (its own block); a task
    that takes one (key, bi, bj) sees two blocks at most, however large the group is.
    """
    mine = F.pmod(F.xxhash64(seed), F.col(size))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col(size) - 1),
                        lambda c: F.struct(F.least(c, F.col("mine")).alias("bi"), F.greatest(c, F.col("mine")).alias("bj")))
    return (df.withColumn("mine", mine).withColumn("pair", F.explode(pairs))
            .withColumns({"bi": F.col("pair.bi"), "bj": F.col("pair.bj")}).drop("pair"))


def blobs(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column."""
    return text_bytes(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)


class Groups:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were apart."""
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def give_back() -> None:
    """Hand the freed memory of this worker back to the system; workers live on for later tasks, and so would their peaks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def per_worker(key, make):
    """An object made once in a Python worker and kept over its tasks."""
    kept = sys.modules.setdefault("_granulite_kept", types.ModuleType("_granulite_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def let_go() -> None:
    """Drop what ``per_worker`` keeps here; for operators that keep nothing, so that they do not carry the tables of one that ran before."""
    kept = sys.modules.pop("_granulite_kept", None)
    if kept is not None:
        kept.__dict__.clear()
        give_back()
