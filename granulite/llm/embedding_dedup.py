"""Near-duplicate vectors: sign hashes of random hyperplanes, exact cosine, connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulite.llm.common import in_block_pairs, run_bounds, runs_in_arrow, stored
from granulite.llm.graph import components

#: Vectors of a bucket that one block holds.
BLOCK = 1024
#: Vectors a bucket should hold on average; sets the number of hyperplanes.
BUCKET = 256
#: Chance to miss a pair that lies exactly on the threshold.
MISS = 1e-3


def tables_for(n: int, threshold: float) -> tuple[int, int]:
    """Bits a table and tables: buckets of about ``BUCKET`` vectors, and a recall of 1 - ``MISS`` at the threshold."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(6, math.ceil(math.log2(max(n, 1) / BUCKET))) if n > BUCKET else 6
    if agree >= 1:
        return bits, 1
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-agree**bits)))


def _signer(bits: int, tables: int, seed: int):
    """Arrow function: unit test, norm and one code a table for each vector."""

    def sign(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            col = batch.column(1)
            n = len(col)
            off = np.asarray(col.offsets).astype(np.int64)
            flat = col.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            valid = np.asarray(col.is_valid())
            size = np.where(valid, np.diff(off), 0)
            codes = np.zeros((n, tables), np.int32)
            good = np.zeros(n, bool)
            for d in np.unique(size[size > 0]):
                rows = np.flatnonzero(size == d)
                m = flat[off[rows][:, None] + np.arange(d)]
                ok = np.isfinite(m).all(1)
                top = np.abs(np.where(ok[:, None], m, 0)).max(1)
                ok &= top > 0
                rows, m = rows[ok], m[ok] / top[ok][:, None]
                good[rows] = True
                if d not in planes:
                    planes[d] = np.random.default_rng((seed, int(d))).standard_normal((d, bits * tables))
                s = (m @ planes[d] > 0).reshape(len(rows), tables, bits)
                codes[rows] = (s * (1 << np.arange(bits, dtype=np.int64))).sum(2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * tables + 1, tables), pa.int32()), pa.array(codes.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), col, pa.array(good), lists], ["id", "v", "good", "codes"])

    return sign


def _linker(threshold: float):
    """Arrow function on runs of (t, code, dim, bi, bj): links counted per vector, and edges of a spanning forest.

    A pair that meets in several tables counts in the first of them only.
    """

    def link(table):
        bounds = run_bounds(table, ["t", "code", "dim", "bi", "bj"])
        ids, mine = table.column("id").to_numpy(), table.column("mine").to_numpy()
        copies, ts = table.column("n").to_numpy(), table.column("t").to_numpy()
        bi, bj = table.column("bi").to_numpy(), table.column("bj").to_numpy()
        v, codes = table.column("v").combine_chunks(), table.column("codes").combine_chunks()
        voff, flat = np.asarray(v.offsets), v.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
        width = len(codes.values) // max(1, len(codes))
        first = np.asarray(codes.offsets)[0] if len(codes) else 0
        code = codes.values.to_numpy(zero_copy_only=False)[first:first + len(codes) * width].reshape(-1, width)
        out_id, out_n, out_to = [], [], []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo < 2:
                continue
            d = voff[lo + 1] - voff[lo]
            m = flat[voff[lo]:voff[hi]].reshape(hi - lo, d)
            m = m / np.abs(m).max(1)[:, None]
            m /= np.sqrt((m * m).sum(1))[:, None]
            t = int(ts[lo])
            c = code[lo:hi]
            left = np.flatnonzero(mine[lo:hi] == bi[lo])
            right = left if bi[lo] == bj[lo] else np.flatnonzero(mine[lo:hi] == bj[lo])
            if not len(left) or not len(right):
                continue
            x, y = np.nonzero(m[left] @ m[right].T >= threshold)
            x, y = left[x], right[y]
            keep = x < y if bi[lo] == bj[lo] else np.ones(len(x), bool)
            for s in range(t):
                keep &= c[x, s] != c[y, s]
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            n = copies[lo:hi]
            links = np.bincount(x, n[y], hi - lo) + np.bincount(y, n[x], hi - lo)
            at = np.flatnonzero(links)
            label = np.arange(hi - lo)
            while True:  # hook to the smallest neighbour, then follow
                low = label.copy()
                np.minimum.at(low, x, label[y])
                np.minimum.at(low, y, label[x])
                low = low[low]
                if (low == label).all():
                    break
                label = low
            out_id.append(ids[lo:hi][at])
            out_n.append(links[at].astype(np.int64))
            out_to.append(ids[lo:hi][label[at]])
        empty = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or empty), pa.int64()) for x in (out_id, out_n, out_to)], ["id", "links", "to"])

    return lambda batches: runs_in_arrow(batches, ["t", "code", "dim", "bi", "bj"], link)


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, seed: int = 7) -> DataFrame:
    """One row per vector: ``id_col``, ``n_links``, ``component_id``, ``kept``, ``usable``.

    Vectors are hashed by the signs of random hyperplanes in several tables; vectors that share a code are compared by exact
    cosine in double precision, in blocks of a bounded size whatever the bucket holds; links at or above ``threshold``
    make components. Equal vectors are taken once, with their number, so a vector copied a billion times costs one row; all
    copies of a vector link with each other. Hyperplanes and tables follow the number of distinct vectors so that buckets stay
    near ``BUCKET`` rows and a pair on the threshold is missed with chance ``MISS`` at most.

    Null, zero or non-finite vectors, and vectors with null components, link with nothing: ``n_links`` 0, own component.
    Vectors of different lengths do not link. Repeated ids give a row each; they count as vectors of their own. Rows with a
    null id take part as copies, but ``component_id`` never names them. Extra columns are dropped; an empty table gives no rows.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    # -0.0 and 0.0 are one value; a vector with a null component is no vector
    v = v.select("id", F.when(F.exists("v", lambda x: x.isNull()), F.lit(None)).otherwise(F.transform("v", lambda x: x + F.lit(0.0).cast(v.schema["v"].dataType.elementType))).alias("v"))
    v = stored(v.withColumn("vkey", F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256)))
    usable = v.where("v is not null and size(v) > 0 and exists(v, x -> x != 0) and forall(v, x -> x = x and abs(x) < double('infinity'))")
    classes = usable.groupBy("vkey").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    classes = stored(classes)
    bits, tables = tables_for(classes.count(), threshold)
    element = classes.schema["v"].dataType.elementType.simpleString()
    # classes are numbered by their key, since ids may be null or repeat
    named = classes.select(F.xxhash64("vkey").alias("cid"), "v")
    signed = named.mapInArrow(_signer(bits, tables, seed), f"id long, v array<{element}>, good boolean, codes array<int>").where("good").drop("good")
    signed = stored(signed.join(classes.select(F.xxhash64("vkey").alias("id"), "n"), "id").withColumn("dim", F.size("v")))
    spots = signed.select("id", F.posexplode("codes").alias("t", "code"), "dim")
    sizes = spots.groupBy("t", "code", "dim").agg(F.count("*").alias("m")).where("m > 1").select("t", "code", "dim", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    rows = signed.select("*", F.posexplode("codes").alias("t", "code")).join(sizes, ["t", "code", "dim"])
    rows = in_block_pairs(rows, "code", "blocks", "id").select("t", "code", "dim", "bi", "bj", "mine", "id", "n", "v", "codes")
    keys = ["t", "code", "dim", "bi", "bj"]
    found = rows.repartition(*keys).sortWithinPartitions(*keys)
    found = stored(found.mapInArrow(_linker(threshold), "id long, links long, to long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    facts = classes.select("vkey", F.xxhash64("vkey").alias("cid"), F.col("id").alias("first"), "n")
    facts = facts.join(comp.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = facts.groupBy("component").agg(F.min("first").alias("component_id"))
    facts = stored(facts.join(least, "component").join(links.withColumnRenamed("id", "cid"), "cid", "left")
                   .select("vkey", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    usable_row = F.col("n_links").isNotNull()
    out = v.select("id", "vkey").join(facts, "vkey", "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(usable_row, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.when(usable_row, F.col("id").eqNullSafe(F.col("component_id"))).otherwise(F.lit(True)).alias("kept"),
        usable_row.alias("usable"))
