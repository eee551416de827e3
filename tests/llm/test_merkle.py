"""Merkle manifest against plain recursion, with odd rows and several fan-outs."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from granulite.llm.merkle import fold, leaf_digest, manifest_nodes, merkle_manifest, merkle_proofs, proof_digest

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, leaf string, g int"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def climb(digests, k):
    """Top of the tree and, for each leaf, its (left, right) siblings from the bottom up."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // k * k:a // k * k + k]
            paths[i].append(("".join(run[:a % k]), "".join(run[a % k + 1:])))
            at[i] = a // k
        level = [H(*level[j:j + k]) for j in range(0, len(level), k)]
    return (level or [None])[0], paths


def plain(rows, k):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, inner = [], {}
    for s in names:
        here = sorted(((r[0] is not None, r[0] or 0, leaf(r)) for r in groups[s]))
        top, paths = climb([x[2] for x in here], k)
        tops.append(top)
        inner[s] = [(x[1] if x[0] else None, x[2], top, p) for x, p in zip(here, paths)]
    root, outer = climb(tops, k)
    out = []
    for s, up in zip(names, outer):
        for d, lf, top, p in inner[s]:
            full = p + up
            out.append((d, lf, top, root, H(*[a + b for a, b in full])))
    return sorted(out, key=repr)


def table(n, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, *range(n)]) if r.random() < 0.2 else i, "hot" if r.random() < 0.4 else r.choice([None, "", "a", "a ", "é", "z", "Z"]), r.choice([None, "en", "de"]),
             r.choice([None, 3, -1]), r.choice([None, "", "Hello World", "ÄÖ x\n", "q" * 5000]), "clash", 7) for i in range(n)]
    return rows + rows[:3]


@pytest.mark.parametrize("n,k", [(0, 16), (1, 16), (16, 16), (17, 16), (300, 16), (90, 2), (100, 3)])
def test_proofs(spark, n, k):
    rows = table(n, n * 31 + k)[:n] if n < 20 else table(n, n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    later = leaf_digest(*[F.lower(F.col(c)) if c == "text" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    m = merkle_manifest(df, carry={"seen": later}, fanout=k)
    p = merkle_proofs(m).withColumns({"proof": proof_digest(F.col("path")), "whole": fold(F.col("leaf"), F.col("path")), "bad": fold(F.col("seen"), F.col("path"))}).collect()
    assert sorted([(x.doc_id, x.leaf, x.subroot, x.root, x.proof) for x in p], key=repr) == plain(rows, k)
    assert all(x.whole == x.root and (x.bad == x.root) == (x.seen == x.leaf) for x in p)
    nodes = manifest_nodes(m).collect()
    assert len([x for x in nodes if x.tree == "group" and x.level == 0]) == len(rows)
    assert all(x.lo <= x.hi for x in nodes) and (not rows or max(x.hi - x.lo + 1 for x in nodes if x.tree == "group") == max(sum(r[1] == s for r in rows) for s in {r[1] for r in rows}))


def test_one_source(spark):
    rows = [(i, None, "en", 1, str(i), "", 0) for i in range(40)]
    p = merkle_proofs(merkle_manifest(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(p) == 40 and all(x.subroot == x.root and len(x.path) == 2 for x in p)
