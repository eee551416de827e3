"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, exact shingle sets."""

from __future__ import annotations

from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulite.llm.common import Groups, blobs, constants, cuts, give_back, in_block_pairs, let_go, mix, run_bounds, runs_in_arrow, shingles, stored, text_bytes, word_table
from granulite.llm.graph import components

#: Words of a shingle.
K = 5
#: Symbols of 16 bits in a chunk of the indexed part of a signature, and symbols of 8 bits in the rest.
WIDTH, REST = 4, 64
#: Chances that a pair on the threshold lies beyond the distance of the indexed part, and beyond that of the whole signature.
MISS_NEAR, MISS_FAR = 4e-6, 1e-6
#: Documents, and shingles, of a block.
BLOCK, BLOCK_SHINGLES = 256, 2_000_000
#: Rows of a bucket that one block holds.
BUCKET = 2048
#: Text hashed at a time.
BATCH_BYTES = 1_000_000


class Plan(NamedTuple):
    """Chunks of the indexed part and wrong symbols allowed in one; differences allowed in the indexed part and in both parts."""

    chunks: int
    errors: int
    near: int
    far: int

    @property
    def indexed(self) -> int:
        return WIDTH * self.chunks


def _beyond(n: int, p: float, k: int) -> float:
    return sum(comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1, n + 1))


def plan(percent: int) -> Plan:
    """The smallest signature that finds pairs on the threshold but for ``MISS_NEAR``.

    A symbol of such a pair differs with chance 1 - ``percent`` / 100. By the pigeonhole, two indexed parts that differ in at most
    ``near`` symbols agree but for ``errors`` in one chunk. 85 takes 8 chunks (near 15, missed with chance 3.5e-6), 80 takes 12
    (near 23, 3.3e-6).
    """
    p = 1 - min(max(percent, 1), 100) / 100
    for errors in range(1, WIDTH):
        for chunks in range(8, 17 if errors < WIDTH - 1 else 4096):
            near = chunks * (errors + 1) - 1
            if _beyond(WIDTH * chunks, p, near) <= MISS_NEAR:
                n = WIDTH * chunks + REST
                return Plan(chunks, errors, near, next(k for k in range(n + 1) if _beyond(n, p, k) < MISS_FAR))
    raise ValueError(f"no signature for {percent} percent")


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z folded) and their offsets."""
    b, off = text_bytes(column)
    _, _, h, woff = word_table(b, off, lower=True)
    s, soff = shingles(h, woff, K)
    sets = [np.unique(s[x:y]) for x, y in zip(soff[:-1], soff[1:])]
    return np.concatenate(sets) if sets else s, np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int64)


def set_keys(sets: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set of hashes."""
    full = np.flatnonzero(np.diff(off))
    out = np.zeros((2, len(off) - 1), np.uint64)
    if len(full):
        out[0, full] = np.add.reduceat(mix(sets), off[full])
        out[1, full] = np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), off[full])
    return out[0].view(np.int64), out[1].view(np.int64)


def signatures(sets: np.ndarray, off: np.ndarray, indexed: int) -> np.ndarray:
    """MinHash symbols of each set as bytes; empty sets get zeros."""
    full = np.flatnonzero(np.diff(off))
    first = np.zeros((len(off) - 1, indexed), np.uint16)
    rest = np.zeros((len(off) - 1, REST), np.uint8)
    if len(full):
        low = (sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32)
        seeds = constants(2 * (indexed + REST), 21).astype(np.uint32) | np.uint32(1)
        for i in range(indexed + REST):
            least = np.minimum.reduceat((low ^ seeds[2 * i]) * seeds[2 * i + 1], off[full])
            least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            if i < indexed:
                first[full, i] = least >> np.uint32(16)
            else:
                rest[full, i - indexed] = least >> np.uint32(24)
    return np.hstack([first.view(np.uint8).reshape(len(first), -1), rest])


def _facts(indexed: int):
    def facts(batches):
        let_go()
        for batch in batches:
            for lo, n in cuts(batch.column(1), BATCH_BYTES):
                sets, off = shingle_sets(batch.column(1).slice(lo, n))
                one, two = set_keys(sets, off)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(np.diff(off)), pa.array(one), pa.array(two), _binary(signatures(sets, off, indexed))], ["id", "n", "k1", "k2", "sig"])
            give_back()
    return facts


def _binary(m: np.ndarray) -> pa.Array:
    offsets = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(m))])


def _symbols(column, indexed: int) -> tuple[np.ndarray, np.ndarray]:
    m = blobs(column)[0].reshape(-1, 2 * indexed + REST)
    return np.ascontiguousarray(m[:, :2 * indexed]).view(np.uint16), m[:, 2 * indexed:]


def _bucket_keys(plan: Plan):
    def bucket_keys(batches):
        """Keys of a signature: each chunk with each choice of ``errors`` symbols left out, which covers all their values."""
        kept = list(combinations(range(WIDTH), WIDTH - plan.errors))
        c = constants(WIDTH + 1, 22)
        for batch in batches:
            first, _ = _symbols(batch.column(1), plan.indexed)
            keys = np.empty((len(first), plan.chunks * len(kept)), np.uint64)
            for j in range(plan.chunks):
                for e, places in enumerate(kept):
                    h = np.full(len(first), (j * len(kept) + e + 1), np.uint64) * c[-1]
                    for p, place in enumerate(places):
                        h = mix(h + (first[:, j * WIDTH + place].astype(np.uint64) + np.uint64(1)) * c[p])
                    keys[:, j * len(kept) + e] = h
            ids = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["key", "id"])
    return bucket_keys


def _near(plan: Plan, first, rest, x, y) -> tuple[np.ndarray, np.ndarray]:
    """Whether pairs are under both distance thresholds, and their whole distance."""
    d = (first[x] != first[y]).sum(1)
    whole = d + (rest[x] != rest[y]).sum(1)
    return (d <= plan.near) & (whole <= plan.far), whole


def _candidates(plan: Plan):
    def candidates(table: pa.Table):
        """Pairs of a bucket under the distance thresholds; pairs that others already connect are left out."""
        ids = table.column("id").to_numpy()
        first, rest = _symbols(table.column("sig"), plan.indexed)
        bounds = run_bounds(table, ["key", "bi", "bj"])
        run_end = np.repeat(bounds[1:], np.diff(bounds))
        mine = table.column("mine").to_numpy()
        cross = table.column("bi").to_numpy() != table.column("bj").to_numpy()
        label = np.arange(len(ids))
        at = np.arange(len(ids))
        out = []
        d = 0
        while True:
            d += 1
            at = at[at + d < run_end[at]]
            if not len(at):
                break
            x = at[(label[at] != label[at + d]) & (~cross[at] | (mine[at] != mine[at + d]))]
            for part in np.array_split(x, len(x) // 65_536 + 1):
                near, _ = _near(plan, first, rest, part, part + d)
                p = part[near]
                if not len(p):
                    continue
                out.append(np.stack([ids[p], ids[p + d]]))
                while True:  # hook roots, then follow
                    lx, ly = label[p], label[p + d]
                    apart = lx != ly
                    if not apart.any():
                        break
                    np.minimum.at(label, np.maximum(lx, ly)[apart], np.minimum(lx, ly)[apart])
                    while True:
                        low = label[label]
                        if (low == label).all():
                            break
                        label = low
        pairs = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.min(0)), pa.array(pairs.max(0))], ["a", "b"])
    return lambda batches: runs_in_arrow(batches, ["key", "bi", "bj"], candidates)


def _sets(batches):
    """Full sets of the documents that stand for candidate classes; other rows with the same id have other keys and go."""
    for batch in batches:
        t = pa.table(batch)
        for lo, n in cuts(batch.column(1), BATCH_BYTES):
            sets, off = shingle_sets(batch.column(1).slice(lo, n))
            one, two = set_keys(sets, off)
            part = t.slice(lo, n)
            keep = np.flatnonzero((one == part.column("k1").to_numpy()) & (two == part.column("k2").to_numpy()))
            blob = pa.array([sets[off[i]:off[i + 1]].tobytes() for i in keep], pa.binary())
            cols = [part.column(c).combine_chunks().take(pa.array(keep)) for c in ("id", "component", "sig", "blocks")]
            yield pa.RecordBatch.from_arrays([*cols, blob], ["id", "component", "sig", "blocks", "hashes"])
        give_back()


def _verifier(percent: int, plan: Plan):
    def verify(table: pa.Table):
        """Links of a block pair on full sets, nearest signatures first, until what is near is connected or refuted."""
        ids = table.column("id").to_numpy()
        first, rest = _symbols(table.column("sig"), plan.indexed)
        data, off = blobs(table.column("hashes"))
        bounds = run_bounds(table, ["component", "bi", "bj"])
        mine = table.column("mine").to_numpy()
        cross = table.column("bi").to_numpy() != table.column("bj").to_numpy()
        out = []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            x, y = np.triu_indices(hi - lo, 1)
            x, y = x + lo, y + lo
            if cross[lo]:
                apart = mine[x] != mine[y]
                x, y = x[apart], y[apart]
            found = []
            for part in np.array_split(np.arange(len(x)), len(x) // 65_536 + 1):
                near, dist = _near(plan, first, rest, x[part], y[part])
                found.append(np.stack([dist[near], x[part][near], y[part][near]]))
            found = np.concatenate(found, 1)
            groups = Groups(hi - lo)
            for _, i, j in found[:, np.argsort(found[0], kind="stable")].T.tolist():
                if groups.find(i - lo) == groups.find(j - lo):
                    continue
                p, q = (data[off[k]:off[k + 1]].view(np.uint64) for k in (i, j))
                if len(p) > len(q):
                    p, q = q, p
                if 100 * len(p) < percent * len(q):
                    continue
                spot = np.searchsorted(q, p)
                spot[spot == len(q)] = 0
                both = int((q[spot] == p).sum())
                if 100 * both >= percent * (len(p) + len(q) - both):
                    groups.join(i - lo, j - lo)
                    out.append((ids[i], ids[j]))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], ["a", "b"])
    return lambda batches: runs_in_arrow(batches, ["component", "bi", "bj"], verify)


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_shingles``, ``component_id``, ``kept``.

    Words are runs of bytes other than space and tab to carriage return, A-Z folded; the set of a document holds its
    distinct runs of five words, or its whole sequence if it has fewer. Documents link if 100 * intersection >= ``percent`` * union.

    1. Each distinct set becomes one class with a MinHash signature; a set copied a billion times goes on as one row.
    2. Multi-index Hamming join: the indexed symbols fall into chunks, and each chunk is a key once for each choice of symbols
       that may be wrong. Every pair that differs in at most ``near`` indexed symbols shares a key (``plan``). Buckets are taken in pairs
       of bounded blocks; pairs under both distance thresholds connect candidate groups.
    3. In each candidate group, again in pairs of bounded blocks, near pairs that are not yet connected are confirmed on full sets,
       nearest first. No pair that is near is skipped unless its ends are connected already, so components are those of all links.

    Documents without words have an empty set and link with nothing. Null ids take no part: ``component_id`` null, ``kept`` true.
    Repeated ids give a row each. Extra columns are dropped; an empty table gives no rows. Sets are held as 64-bit hashes.
    """
    p = plan(percent)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    facts = stored(d.mapInArrow(_facts(p.indexed), "id long, n long, k1 long, k2 long, sig binary"))
    classes = stored(facts.where("n > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.any_value("sig").alias("sig"), F.any_value("n").alias("n")))
    # one document may stand for two classes if its id repeats with other text, so classes get numbers of their own
    cid = F.xxhash64("k1", "k2")
    sigs = classes.select(cid.alias("id"), "sig")
    keys = sigs.mapInArrow(_bucket_keys(p), "key long, id long")
    many = stored(keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / BUCKET).alias("blocks")))
    rows = keys.join(many, "key").join(sigs, "id")
    rows = in_block_pairs(rows, "key", "blocks", "id").select("key", "bi", "bj", "mine", "id", "sig")
    rows = rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    near = rows.mapInArrow(_candidates(p), "a long, b long")
    groups = components(near)
    cand = classes.withColumn("cid", cid).join(groups.withColumnRenamed("id", "cid"), "cid")
    sizes = cand.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("s")).select(
        "component", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).alias("blocks"))
    cand = stored(cand.join(sizes, "component").select("id", "component", "sig", "blocks", "k1", "k2"))
    sets = d.join(cand, "id").select("id", "text", "component", "sig", "blocks", "k1", "k2").withColumn("id", cid)
    sets = sets.select("id", "text", "component", "sig", "blocks", "k1", "k2").mapInArrow(_sets, "id long, component long, sig binary, blocks long, hashes binary")
    pairs = in_block_pairs(sets, "component", "blocks", "id").select("component", "bi", "bj", "mine", "id", "sig", "hashes")
    pairs = pairs.repartition("component", "bi", "bj").sortWithinPartitions("component", "bi", "bj")
    links = components(pairs.mapInArrow(_verifier(percent, p), "a long, b long"))
    named = classes.select("k1", "k2", "id", cid.alias("cid")).join(links.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = stored(named.join(least, "component").select("k1", "k2", "component_id"))
    linked = F.col("id").isNotNull() & (F.col("n") > 0)
    out = facts.select("id", "n", F.when(linked, F.col("k1")).alias("k1"), F.when(linked, F.col("k2")).alias("k2")).join(named, ["k1", "k2"], "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
