"""Toxicity: bags of subword embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulite.llm.common import constants, cuts, give_back, let_go, mix, stored
from granulite.llm.pretokens import Memo

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of subwords, buckets they are hashed into, and embedding size.
SHORTEST, LONGEST, BUCKETS, DIM = 3, 6, 1 << 18, 8
#: Labelled rows of each class that a fit takes at most; they are the first by a hash of the id, so the choice has no bias.
FIT_TOXIC, FIT_CLEAN = 4000, 8000
#: Buckets get a vector if their share in the two classes differs by this many standard errors and they occur in so many rows; at most
#: so many buckets get one.
Z, LEAST_ROWS, VOCABULARY = 4.0, 3, 20_000
#: Full-batch Adam.
EPOCHS, RATE = 100, 0.05
#: Words whose buckets a worker keeps, and text taken at a time.
MEMO, BATCH_BYTES = 80_000, 500_000
#: Entries of bags that a step of the fit gathers vectors for at a time; a row's or a bucket's entries stay together.
GATHER = 1 << 17


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of all words, their ends marked, and the word each belongs to, in order of the words."""
    points = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(points))  # characters to the end of the word
    owners, buckets = [], []
    for n in range(SHORTEST, LONGEST + 1):
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k, c in enumerate(constants(n, 50 + n)):
            h += points[at + k] * c
        owners.append(owner[at])
        buckets.append((mix(h) % np.uint64(BUCKETS)).astype(np.int64))
    owners, buckets = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owners, kind="stable")
    return owners[order], buckets[order]


def _bags(kept: np.ndarray | None):
    """The distinct buckets of each text, all of them or those in ``kept``; passes the first two columns through."""
    def bag(batches):
        let_go()
        allowed = np.ones(BUCKETS, bool)
        if kept is not None:
            allowed[:] = False
            allowed[kept] = True
        memo = Memo(MEMO)
        for batch in batches:
            for lo, n in cuts(batch.column(2), BATCH_BYTES):
                texts = [set(WORD.findall((text or "").lower())) for text in batch.column(2).slice(lo, n).to_pylist()]
                memo.room()
                new = memo.missing(set().union(*texts))
                if new:
                    memo.update(dict.fromkeys(new, ()))
                    owner, bucket = word_buckets(new)
                    hit = allowed[bucket]
                    owner, bucket = owner[hit], bucket[hit]
                    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
                    memo.update((new[owner[a]], bucket[a:b].astype(np.int32)) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(owner)]))
                out = []
                for words in texts:
                    found: set[int] = set()
                    for b in map(memo.__getitem__, words):
                        if len(b):
                            found.update(b.tolist())
                    out.append(np.fromiter(sorted(found), np.int32, len(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(out, pa.list_(pa.int32()))], ["id", "toxic", "bag"])
            give_back()
    return bag


def _bucket_counts(batches):
    """Rows that hold each bucket, by class, summed over the task."""
    n = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        bag = batch.column(2)
        y = np.repeat(batch.column(1).to_numpy(), np.diff(np.asarray(bag.offsets)))
        flat = bag.flatten().to_numpy()
        for c in (0, 1):
            n[c] += np.bincount(flat[y == c], minlength=BUCKETS)
    at = np.flatnonzero(n.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0, at]), pa.array(n[1, at])], ["bucket", "n0", "n1"])


def _cut_to(kept: np.ndarray):
    """Bags without the buckets that got no vector."""
    def cut(batches):
        for batch in batches:
            bags = [x[np.isin(x, kept)] for x in batch.column(2).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.list_(pa.int32()))], ["id", "toxic", "bag"])
    return cut


def _pieces(first: np.ndarray, total: int) -> list[tuple[int, int, int, int]]:
    """Groups of entries that begin at ``first``, dealt in pieces of about ``GATHER`` entries: first and last group, first and last entry."""
    end = np.append(first[1:], total)
    out, lo = [], 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(end, first[lo] + GATHER, "right")))
        out.append((lo, hi, int(first[lo]), int(end[hi - 1])))
        lo = hi
    return out


def fit(bags: list[np.ndarray], y: np.ndarray, size: int, seed: int = 1, weight: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and bias; bags hold numbers below ``size``. A row counts by the ``weight`` of its class."""
    rng = np.random.default_rng(seed)
    e, w, b = rng.standard_normal((size, DIM)) * 0.1, rng.standard_normal((DIM, 2)) * 0.1, np.zeros(2)
    n = np.array([len(x) for x in bags])
    rows, flat = np.flatnonzero(n), np.concatenate([*bags, np.zeros(0, np.int32)]).astype(np.int32)
    first = np.append(0, np.cumsum(n))[:-1][rows]
    share = 1 / np.maximum(n, 1)
    part = np.asarray(weight, float)[y]
    part /= part.sum()
    order = np.argsort(flat, kind="stable")
    holder = np.repeat(np.arange(len(bags), dtype=np.int32), n)[order]
    used, start = np.unique(flat[order], return_index=True)
    del order
    by_row, by_bucket = _pieces(first, len(flat)), _pieces(start, len(flat))
    m, v = ([np.zeros_like(p) for p in (e, w, b)] for _ in range(2))
    for epoch in range(1, EPOCHS + 1):
        h = np.zeros((len(bags), DIM))
        for lo, hi, a, z in by_row:
            h[rows[lo:hi]] = np.add.reduceat(e[flat[a:z]], first[lo:hi] - a) * share[rows[lo:hi], None]
        z = h @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= part[:, None]
        de = np.zeros_like(e)
        back = (p @ w.T) * share[:, None]
        for lo, hi, a, z in by_bucket:
            de[used[lo:hi]] = np.add.reduceat(back[holder[a:z]], start[lo:hi] - a)
        for i, (param, grad) in enumerate(((e, de + 1e-6 * e), (w, h.T @ p + 1e-4 * w), (b, p.sum(0)))):
            m[i] += 0.1 * (grad - m[i])
            v[i] += 0.01 * (grad * grad - v[i])
            param -= RATE * (m[i] / (1 - 0.9**epoch)) / (np.sqrt(v[i] / (1 - 0.99**epoch)) + 1e-10)
    return e, w, b


def _fitter(kept: np.ndarray, weight: tuple[float, float]):
    def one(rows: pa.Table) -> pa.Table:
        let_go()
        rows = rows.sort_by([("id", "ascending"), ("toxic", "ascending")])
        bags = [np.searchsorted(kept, x).astype(np.int32) for x in rows["bag"].combine_chunks().to_numpy(zero_copy_only=False)]
        e, w, b = fit(bags, rows["toxic"].to_numpy().astype(np.int64), len(kept), weight=weight)
        give_back()
        vectors = [*e.tolist(), w[:, 0].tolist(), w[:, 1].tolist(), b.tolist()]
        return pa.table([pa.array([*kept.tolist(), -1, -2, -3], pa.int64()), pa.array(vectors, pa.list_(pa.float64()))], names=["bucket", "vector"])
    return one


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: int = 5) -> dict:
    """A model from labelled rows whose crc32 of the id as text is not divisible by ``held_out``.

    The fit takes ``FIT_TOXIC`` and ``FIT_CLEAN`` rows at most; each stands for its share of all training labels of its class, so the
    ratio of the classes, and with it the meaning of a score, does not change with the size of the table. Subwords are hashed, counted by class, and those that tell
    the classes apart get vectors; vectors and softmax are trained together. The model is small whatever the tables
    hold: at most ``VOCABULARY`` vectors. Without rows of both classes it is a constant.
    """
    y = labels.where(F.col(label_col).isin(0, 1) & (F.crc32(F.col(id_col).cast("string").cast("binary")) % held_out != 0))
    y = y.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    y = stored(y.join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi"))
    pick = [y.where(f"toxic = {c}").orderBy(F.xxhash64("id"), "id").limit(n) for c, n in ((1, FIT_TOXIC), (0, FIT_CLEAN))]
    chosen = stored(pick[0].unionByName(pick[1]))
    share = {r.toxic: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    if len(share) < 2:
        return {"constant": float(max(share, default=0))}
    total = {r.toxic: r["count"] for r in y.groupBy("toxic").count().collect()}
    weight = (total[0] / share[0], total[1] / share[1])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, toxic int, bag array<int>"
    bags = stored(rows.select("id", "toxic", "text").repartition("id").mapInArrow(_bags(None), schema))
    n0, n1 = (bags.where(f"toxic = {c}").count() for c in (0, 1))
    p = (F.col("n0") + F.col("n1")) / (n0 + n1)
    z = F.abs(F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n0 + 1 / n1))
    counts = bags.mapInArrow(_bucket_counts, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    best = counts.withColumn("z", z).where((F.col("z") >= Z) & (F.col("n0") + F.col("n1") >= LEAST_ROWS)).orderBy(F.desc("z"), "bucket").limit(VOCABULARY)
    kept = np.array(sorted(r.bucket for r in best.select("bucket").collect()), np.int64)
    few = bags.mapInArrow(_cut_to(kept), schema)
    got = few.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_fitter(kept, weight), "bucket long, vector array<double>").collect()
    model = {r.bucket: r.vector for r in got}
    w, b = np.array([model[-1], model[-2]]).T, np.array(model[-3])
    return {"kept": kept, "vectors": np.array([model[int(k)] for k in kept]).reshape(-1, DIM), "w": w, "b": b}


def _scorer(model: dict):
    def score(batches):
        at = {int(k): i for i, k in enumerate(model["kept"])}
        margin = model["vectors"] @ (model["w"][:, 1] - model["w"][:, 0])  # the softmax of two classes needs their difference
        bias = model["b"][1] - model["b"][0]
        for batch in _bags(model["kept"])(batches):
            bag = batch.column(2)
            n = np.diff(np.asarray(bag.offsets))
            flat = margin[[at[x] for x in bag.flatten().to_pylist()]] if n.sum() else np.zeros(0)
            total = np.bincount(np.repeat(np.arange(len(n)), n), flat, len(n))
            p = 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p)], ["id", "held_out", "score"])
    return score


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", held_out: int = 5) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``held_out``, ``score``, ``predicted``.

    Only the text counts. A document without known subwords, an empty or a null text gets the score of the bias. A null id is never held
    out. Repeated ids give a row each; extra columns are dropped; an empty table gives no rows. No shuffle.
    """
    out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % held_out == 0, F.lit(False))
    d = docs.select(F.col(id_col).alias("id"), out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    if "constant" in model:
        d = d.select("id", "held_out", F.lit(model["constant"]).alias("score"))
    else:
        d = d.mapInArrow(_scorer(model), f"id {d.schema['id'].dataType.simpleString()}, held_out boolean, score double")
    return d.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose predicted label is not toxic."""
    if "constant" in model:
        return docs.where(F.lit(model["constant"] < 0.5))
    kept = _keeper(model, docs.columns.index(text_col))
    return docs.mapInArrow(kept, docs.schema)


def _keeper(model: dict, place: int):
    """Rows that are not toxic, a slice of text at a time, so that a task holds its input batch and little else."""
    scorer = _scorer(model)

    def keep(batches):
        held = deque()

        def feed():
            for batch in batches:
                text = batch.column(place).cast(pa.string())
                for lo, n in cuts(text, BATCH_BYTES):
                    held.append(batch.slice(lo, n))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.zeros(n, bool)), text.slice(lo, n)], ["id", "held_out", "text"])
        # a slice is one slice to the scorer too
        for scored in scorer(feed()):
            yield held.popleft().filter(pa.array(scored.column(2).to_numpy() < 0.5))
    return keep
