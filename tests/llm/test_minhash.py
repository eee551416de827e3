import random

import pandas as pd
from pyspark.sql import functions as F

from granulite.llm.minhash_dedup import minhash_dedup
from tests.llm.brute import near_duplicates

SCHEMA = "doc_id long, text string, id string, n int, component string"


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in minhash_dedup(df).collect()), key=repr)


def near_copies(rnd, n_groups, words):
    rows, at = [], 0
    for g in range(n_groups):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice(words))]
        for _ in range(rnd.randrange(1, 12)):
            t = list(base)
            for _ in range(rnd.randrange(0, max(2, len(t) // 40))):
                t[rnd.randrange(len(t))] = rnd.choice(["zz", "Q", f"n{rnd.randrange(99)}"])
            rows.append((at, rnd.choice([" ", "\n", "  "]).join(x.upper() if rnd.random() < .1 else x for x in t)))
            at += 1
    rnd.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


def test_against_all_pairs(spark):
    rnd = random.Random(4)
    rows = near_copies(rnd, 60, [3, 5, 8, 60, 150, 400])
    rows += [(900, ""), (901, None), (902, "  \t"), (903, "a b"), (904, "A  b"), (905, "a b c d e"), (906, "a b c d e"), (906, "other text"), (906, "other text"), (None, "a b"), (None, None)]
    assert run(spark, rows) == near_duplicates(rows)


def test_hot_group_and_blocks(spark, monkeypatch):
    import granulite.llm.minhash_dedup as m
    monkeypatch.setattr(m, "BLOCK", 8)
    monkeypatch.setattr(m, "BUCKET", 16)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base)) for i in range(40)]
    for i in range(40, 160):  # near the base, not always near each other
        t = list(base)
        for p in rnd.sample(range(5, 190), 3):
            t[p] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    assert run(spark, rows) == near_duplicates(rows)


def test_eighty_percent(spark):
    import corpus_pipeline as c
    from granulite.llm.minhash_dedup import plan
    assert plan(85) == (8, 1, 15, 33) and plan(80)[:3] == (12, 1, 23)
    rnd = random.Random(11)
    rows = near_copies(rnd, 40, [60, 150])
    for g in range(300):  # pairs a little above 0.80, each with words of its own
        base = [f"p{g}x{i}" for i in range(120)]
        other = list(base)
        for at in (20, 60):
            other[at] = f"q{g}"
        rows += [(10_000 + 2 * g, " ".join(base)), (10_001 + 2 * g, " ".join(other[:-2]))]
    want = near_duplicates(rows, percent=80)
    assert want != near_duplicates(rows)
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    assert sorted((tuple(r) for r in minhash_dedup(df, percent=80).collect()), key=repr) == want
    docs = df.select(F.col("doc_id"), "text")
    assert sorted(r.doc_id for r in c.near_duplicates(spark, docs, "").collect()) == sorted(i for i, _, _, k in want if k)


def test_pipeline_stage_on_the_shared_table(spark):
    import corpus_pipeline as c
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in c.near_duplicates(spark, docs, "").collect()) == sorted(i for i, _, _, k in near_duplicates(rows, percent=80) if k)


def test_empty(spark):
    assert run(spark, []) == []


def test_shared_table(spark):
    from granulite.llm.queries import QUERIES
    d = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op4_minhash_dedup"](spark, "/root/testdata/sf0.01").collect()), key=repr)
    assert got == near_duplicates(list(zip(d.doc_id.tolist(), d.text.tolist())))
