import sys
import tracemalloc
import zlib

import numpy as np
import pandas as pd

from granulite.llm import common, toxicity
from granulite.llm.queries import QUERIES
from granulite.llm.toxicity import drop_toxic, score, train


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op10_toxicity"](spark, sf).toPandas()
    d, y = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/labels.parquet")
    assert sorted(got.doc_id) == sorted(d.doc_id) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= .5)).all()
    m = got.merge(y, on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m.toxic).mean() > 0.95
    assert m[m.toxic == 1].predicted.mean() > 0.8 and m[m.toxic == 0].predicted.mean() < 0.03


def test_labels_that_are_held_out_never_count(spark):
    rows = [(i, "a vile grobnix here" if i % 3 == 0 else "a fine day there", "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    truth = [(i, int(i % 3 == 0)) for i in range(60)]
    lied = [(i, 1 - y if i in out else y) for i, y in truth]
    a, b = ({r.doc_id: r.score for r in score(docs, train(docs, spark.createDataFrame(x, "doc_id long, toxic int"))).collect()} for x in (truth, lied))
    assert a == b and all((a[i] >= .5) == (i % 3 == 0) for i in range(60))


def test_misspelling_odd_rows_and_drop(spark):
    rows = [(i, f"some {i} grobnixes text" if i % 2 else f"other {i} plain text") for i in range(80)]
    odd = [(None, None), (7, "grobnixed"), (7, "GROBNIX"), (900, ""), (901, "12 34"), (902, "x" * 100_000)]
    docs = spark.createDataFrame([(i, t, 1.5, i) for i, t in rows + odd], "doc_id long, text string, score double, id long")
    model = train(docs.where("doc_id is not null and doc_id < 80"), spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int"))
    got = score(docs, model)
    assert got.count() == len(rows) + len(odd)
    s = {(r.doc_id, r.predicted) for r in got.where("doc_id is null or doc_id >= 900 or doc_id = 7").collect()}
    assert (7, 1) in s and (7, 0) not in s and len({x for x, _ in s}) == 5
    left = drop_toxic(docs, model)
    assert left.schema == docs.schema and {r.doc_id for r in left.collect()} >= {i for i in range(0, 80, 2)} and not left.where("doc_id = 7").count()


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [tuple(r)[2:] for r in score(docs, train(docs, none)).collect()] == [(0.0, 0)]
    assert score(docs.limit(0), train(docs, none)).count() == 0 and drop_toxic(docs, train(docs, none)).count() == 1


def test_caps_keep_the_ratio_of_the_classes(spark, monkeypatch):
    import granulite.llm.toxicity as m
    kind = lambda i: int(i % 9 == 0)
    # the doubtful word stands in most toxic and in a few clean rows, yet more clean rows than toxic ones hold it
    word = lambda i: "grobnix" if (i // 9 % 4 if kind(i) else i % 9 in (4, 5)) else "plain"
    rows = [(i, f"{word(i)} text") for i in range(1800)] + [(9000, "grobnix text"), (9001, "plain text"), (9002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, kind(i)) for i in range(1800)], "doc_id long, toxic int")

    def scores():
        return {r.doc_id: r.score for r in score(docs, train(docs, labels)).where("doc_id >= 9000").collect()}
    whole = scores()
    monkeypatch.setattr(m, "FIT_TOXIC", 100)
    monkeypatch.setattr(m, "FIT_CLEAN", 200)
    capped = scores()
    assert all(whole[i] < .5 and capped[i] < .5 and abs(whole[i] - capped[i]) < .1 for i in whole), (whole, capped)


def test_fit_gathers_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    bags = [np.unique(rng.integers(0, 3000, rng.integers(0, 400))) for _ in range(4000)]
    y = rng.integers(0, 2, len(bags))
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    monkeypatch.setattr(toxicity, "GATHER", 1 << 40)
    whole = toxicity.fit(bags, y, 3000, weight=(2.0, 1.0))
    monkeypatch.setattr(toxicity, "GATHER", 1 << 12)
    tracemalloc.start()
    pieces = toxicity.fit(bags, y, 3000, weight=(2.0, 1.0))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(whole, pieces))
    # all vectors at once would take 64 bytes an entry
    assert most < 45 * sum(map(len, bags))


def test_what_other_operators_keep_is_dropped():
    common.per_worker("test", lambda: object())
    list(toxicity._bags(None)(iter([])))
    assert "_granulite_kept" not in sys.modules
