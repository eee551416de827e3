"""Benchmark items inside documents: size-partitioned MinHash containment search, exact shingle containment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulite.llm.common import blobs, constants, cuts, give_back, let_go, mix, shingles, stored, text_bytes, word_table
from granulite.llm.minhash_dedup import K, shingle_sets

#: Hash functions of a sketch. An item of n shingles, more than half its class size u, of which 80 % lie in a window of 2u shingles
#: has a similarity of 0.19 or more with that window, so all 48 minima differ with chance 4e-5 at most, and 1e-6 for a whole copy. Where the
#: 80 % are strewn over a document, each minimum of the item is that of its window with chance 0.16 or more: missed with 2.3e-4 at most.
HASHES = 48
#: Smallest size class; 1, so that the shortest item is more than half its class as well.
LEAST = 1
#: Bits of the filter on sketch values that documents test before anything is shuffled: half a megabyte whatever the items.
FILTER_BITS = 1 << 22
#: Text hashed at a time.
BATCH_BYTES = 1_000_000


def size_class(n: np.ndarray) -> np.ndarray:
    """The power of two, ``LEAST`` at least, that is not below n."""
    return np.maximum(LEAST, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def _hash(low: np.ndarray, i: int) -> np.ndarray:
    a, b = constants(2 * HASHES, 31)[2 * i:2 * i + 2].astype(np.uint32)
    return (low ^ a) * (b | np.uint32(1))


def _low(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)


def _key(least: np.ndarray, i: int, u) -> np.ndarray:
    """One 64-bit key for (class, hash function, minimum)."""
    return mix(least.astype(np.uint64) << np.uint64(32) | np.uint64(i << 8) | np.log2(u).astype(np.uint64)).view(np.int64)


def _item_sets(batches):
    for batch in batches:
        sets, off = shingle_sets(batch.column(1))
        n = np.diff(off)
        u = size_class(n)
        blob = pa.array([sets[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(u), blob], ["ik", "item_id", "n_item", "u", "hashes"])


def _item_sketches(batches):
    for batch in batches:
        data, off = blobs(batch.column(2))
        low, off = _low(data.view(np.uint64)), off // 8
        u = batch.column(1).to_numpy()
        keys = [_key(np.minimum.reduceat(_hash(low, i), off[:-1]), i, u) for i in range(HASHES)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.concat_arrays([batch.column(0)] * HASHES)], ["key", "ik"])


def _blocks(count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of blocks of ``size`` over consecutive groups of ``count`` entries, and the offsets of the groups' blocks."""
    n = -(-count // size)
    off = np.append(0, np.cumsum(n))
    first = np.append(0, np.cumsum(count))[:-1]
    return np.repeat(first - off[:-1] * size, n) + np.arange(off[-1]) * size, off


def _probe(classes: list[int], bits: bytes):
    """Keys of the windows of each document that pass the filter.

    For class u a document is covered by windows of 2u shingles, u apart, so a run of u shingles lies in one of them.
    """
    def probe(batches):
        let_go()
        passed = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        base = classes[0]
        for batch in batches:
            t = pa.table(batch)
            for lo, n in cuts(batch.column(2), BATCH_BYTES):
                b, off = text_bytes(batch.column(2).slice(lo, n))
                _, _, h, woff = word_table(b, off, lower=True)
                s, soff = shingles(h, woff, K)
                count = np.diff(soff)
                rows = np.flatnonzero(count)
                if not len(rows):
                    continue
                low, count = _low(s), count[rows]
                starts, boff = _blocks(count, base)
                levels = []
                for u in classes:
                    up, uoff = _blocks(np.diff(boff), u // base)
                    owner = np.repeat(np.arange(len(rows)), np.diff(uoff))
                    last = np.zeros(len(up), bool)
                    last[uoff[1:] - 1] = True
                    keep = ~last | (np.diff(uoff)[owner] == 1)  # the last block is part of the window before it
                    levels.append((u, up, last, keep, owner[keep]))
                docs, keys = [], []
                for i in range(HASHES):
                    least = np.minimum.reduceat(_hash(low, i), starts)
                    for u, up, last, keep, owner in levels:
                        m = np.minimum.reduceat(least, up)
                        two = m.copy()
                        two[:-1] = np.where(last[:-1], m[:-1], np.minimum(m[:-1], m[1:]))
                        k = _key(two[keep], i, np.int64(u))
                        hit = np.flatnonzero(passed[k & (FILTER_BITS - 1)])
                        docs.append(owner[hit])
                        keys.append(k[hit])
                at = pa.array(rows[np.concatenate(docs)] + lo)
                yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().take(at) for c in ("id", "tk")] + [pa.array(np.concatenate(keys))], ["id", "tk", "key"])
            give_back()
    return probe


def _contained(batches):
    """Shared shingles of each candidate pair, on whole sets; the set of a document is kept while its rows follow each other."""
    seen, doc = None, None
    for batch in batches:
        out = []
        for tk, text, blob in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            if doc is None or tk != seen:
                seen, doc = tk, shingle_sets(pa.array([text.as_py()], pa.string()))[0]
            item = np.frombuffer(blob.as_buffer(), np.uint64)
            at = np.searchsorted(doc, item)
            at[at == len(doc)] = 0
            out.append(int((doc[at] == item).sum()) if len(doc) else 0)
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in (0, 1, 4, 5)] + [pa.array(out, pa.int64())], ["id", "tk", "item_id", "n_item", "n_shared"])


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", percent: int = 80) -> DataFrame:
    """``(id, tk, item_id, n_item, n_shared)`` for each row of ``docs`` and item that it holds; ``tk`` tells rows of one id apart.

    A document holds an item if 100 * shared shingles >= ``percent`` * shingles of the item (five words, A-Z folded; fewer
    words: the whole sequence). Search: items fall into classes by size; their MinHash sketches are one key a hash function and class.
    Documents are covered by windows that fit each class, whose minima are the keys they probe with, so a short item is
    compared with passages of its own size however long the document is. Keys that a filter of fixed size rejects never
    leave the task. Candidates are checked on the whole set of the document. An item is looked for within windows of twice its
    class size and missed with chance 4e-5 at most; one whose shingles are strewn wider over a document is missed with 2.3e-4 at most.
    """
    i = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).distinct()
    i = i.select(F.xxhash64("item_id", "text").alias("ik"), "text", "item_id")
    sets = stored(i.mapInArrow(_item_sets, "ik long, item_id long, n_item long, u long, hashes binary").where("n_item > 0"))
    none = docs.sparkSession.createDataFrame([], "id long, tk long, item_id long, n_item long, n_shared long")
    classes = sorted(r.u for r in sets.select("u").distinct().collect())  # one for each power of two
    if not classes:
        return none
    sketches = stored(sets.select("ik", "u", "hashes").mapInArrow(_item_sketches, "key long, ik long"))
    spot = F.expr(f"(key & {FILTER_BITS - 1}) + 1")
    parts = sketches.groupBy(F.bitmap_bucket_number(spot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits")).collect()
    bits = bytearray(FILTER_BITS // 8)  # 128 parts of 4 KB at most
    for r in parts:
        bits[(r.part - 1) * 4096:r.part * 4096] = r.bits
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("tk"), F.col(text_col).cast("string").alias("text"))
    hits = d.mapInArrow(_probe(classes, bytes(bits)), "id long, tk long, key long")
    cand = stored(hits.distinct().join(sketches, "key").select("id", "tk", "ik").distinct())
    same = F.col("d.tk").eqNullSafe(F.col("c.tk")) & F.col("d.id").eqNullSafe(F.col("c.id"))
    pairs = d.alias("d").join(cand.alias("c"), same).select("d.id", "d.tk", "d.text", "ik").join(sets, "ik").select("id", "tk", "text", "hashes", "item_id", "n_item")
    found = pairs.mapInArrow(_contained, "id long, tk long, item_id long, n_item long, n_shared long")
    return found.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """One row per (document, item) held: ``id_col``, ``item_id``, ``n_item``, ``n_shared``, ``containment``.

    Rows of one id with other texts count as one document, with their largest share. Null or empty texts and items hold
    nothing; a null id is an id of its own. Extra columns are dropped; empty tables give no rows.
    """
    c = contaminated(docs, items, id_col=id_col, **kw).groupBy("id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
    return c.select(F.col("id").alias(id_col), "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; rows are judged by their own text."""
    bad = contaminated(docs, items, id_col=id_col, text_col=text_col, **kw).select(F.col("id").alias("bad_id"), F.col("tk").alias("bad_tk")).distinct()
    on = F.col(id_col).cast("long").eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("bad_tk"))
    return docs.join(stored(bad), on, "left_anti")
