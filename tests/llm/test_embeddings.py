"""Near-equal embeddings against all pairs: clusters around the threshold, copies, odd vectors, repeated and null ids."""

import numpy as np

from granulite.llm.embedding_dedup import embedding_dedup
from granulite.llm.queries import QUERIES
from tests.llm.brute import smallest_reachable

SCHEMA = "vec_id long, embedding array<double>, label string, n_links long"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def plain(rows, threshold=0.95):
    """Links per row and component per row, from all pairs."""
    n, links = np.zeros(len(rows), int), []
    for size in {len(v) for _, v in rows if usable(v)}:
        at = [i for i, (_, v) in enumerate(rows) if usable(v) and len(v) == size]
        m = np.array([rows[i][1] for i in at], float)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        x, y = np.nonzero(np.triu(m @ m.T >= threshold - 1e-12, 1))
        links += [(at[a], at[b]) for a, b in zip(x, y)]
    for a, b in links:
        n[a] += 1
        n[b] += 1
    group = smallest_reachable(range(len(rows)), links)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[group[i]] = min(k, least.get(group[i], k))
    return n, [least.get(group[i]) for i in range(len(rows))], links


def clusters(rng, count, dim):
    """Clusters whose pairs lie on both sides of the threshold."""
    out = []
    for _ in range(count):
        c = rng.standard_normal(dim)
        c /= np.linalg.norm(c)
        for _ in range(int(rng.integers(2, 7))):
            d = rng.standard_normal(dim)
            d -= (d @ c) * c
            d /= np.linalg.norm(d)
            cos = rng.uniform(0.972, 0.9999)
            out.append((rng.uniform(0.1, 9) * (cos * c + np.sqrt(1 - cos * cos) * d)).tolist())
    return out


def test_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    vectors = clusters(rng, 250, 64) + rng.standard_normal((600, 64)).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(5000 + i, vectors[i % 7]) for i in range(300)]  # copies, some of them many
    rows += [(9000, None), (9001, [0.0] * 64), (9002, [float("nan")] + [1.0] * 63), (9003, [float("inf")] + [1.0] * 63), (9004, [None] + [1.0] * 63), (9005, []),
             (9006, vectors[0][:32]), (9007, vectors[0][:32]), (9008, [-x for x in vectors[0]])]
    df = spark.createDataFrame([(k, v, "same", 1) for k, v in rows], SCHEMA).repartition(6)
    got = {r.vec_id: r for r in embedding_dedup(df).collect()}
    n, comp, links = plain(rows)
    assert len(got) == len(rows) and len(links) > 1000
    found = sum(got[k].n_links for k, _ in rows)
    assert found <= n.sum() and found / n.sum() >= 0.999  # none below the threshold, recall of links
    wrong = [k for i, (k, _) in enumerate(rows) if got[k].component_id != comp[i] or got[k].kept != (comp[i] == k)]
    assert len(wrong) <= 2
    assert all(got[k].n_links == 0 and got[k].kept for k in range(9000, 9006))
    assert got[9006].n_links == got[9007].n_links == 1 and got[9007].component_id == 9006


def test_ids_and_empty(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -2.0, 1.0]
    rows = [(3, v), (3, v), (None, v), (4, w), (4, [30.0, -20.0, 10.0]), (1, [0.0, 0.0, 0.0])]
    got = sorted((repr(r.vec_id), r.n_links, r.component_id, r.kept) for r in embedding_dedup(spark.createDataFrame([(k, x, None, None) for k, x in rows], SCHEMA)).collect())
    assert got == sorted([("3", 2, 3, True), ("3", 2, 3, True), ("None", 2, 3, False), ("4", 1, 4, True), ("4", 1, 4, True), ("1", 0, 1, True)])
    assert embedding_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_shared_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, comp, _ = plain(rows)
    got = {r.vec_id: r for r in QUERIES["op2_embedding_dedup"](spark, sf).collect()}
    assert [(got[k].n_links, got[k].component_id) for k, _ in rows] == list(zip(n.tolist(), comp))
