import hashlib
import random
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest

import granulite.llm.substring_dedup as m
from granulite.llm.queries import QUERIES
from tests.llm.brute import WORD


def plain(rows, w=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(x[i:i + w]) for x in words for i in range(len(x) - w + 1))
    out = []
    for (d, _), x in zip(rows, words):
        gone = set()
        for i in range(len(x) - w + 1):
            if seen[tuple(x[i:i + w])] > 1:
                gone.update(range(i, i + w))
        kept = " ".join(y for i, y in enumerate(x) if i not in gone)
        out.append((d, len(x), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def make(seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(400)}"
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 40, 52, 80, 200)]
    rows = []
    for i in range(150):
        t = []
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p)) if rnd.random() < .4 else 0
            t += [word() for _ in range(rnd.choice([0, 1, 30, 300]))] + p[a:]
        rows.append((i, rnd.choice([" ", "\n ", "\t"]).join(t)))
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[10][1]), (None, None), (300, ""), (301, "same " * 90), (302, "same " * 35), (303, "a b " * 60), (304, "Same " * 36)]
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, rk int, kept string").repartition(4)
    return sorted((tuple(r) for r in m.substring_dedup(df, text=False).collect()), key=repr)


@pytest.mark.parametrize("group", [4096, 3])
def test_against_all_windows(spark, monkeypatch, group):
    monkeypatch.setattr(m, "GROUP", group)
    rows = make(group)
    assert run(spark, rows) == plain(rows)


def test_empty_and_text(spark):
    df = spark.createDataFrame([(1, "a  b\nc")], "doc_id long, text string")
    assert m.substring_dedup(df).collect()[0].kept == "a b c"
    assert m.substring_dedup(df.limit(0)).count() == 0


def test_shared_table(spark):
    d = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op6_substring_dedup"](spark, "/root/testdata/sf0.01").collect()), key=repr)
    assert got == plain(list(zip(d.doc_id.tolist(), d.text.tolist())))


def test_copies_are_one_text_with_a_count(spark):
    own = lambda k: " ".join(f"{k}x{i}" for i in range(60))
    near = own("a").replace("ax5 ", "zz ")
    rows = [(i % 3, own("a")) for i in range(200)] + [(9, near), (10, own("b")), (11, own("c") + "\n" + own("c")), (None, own("d")), (None, own("d")), (12, "x " * 34)]
    got = run(spark, rows)
    assert got == plain(rows)


@pytest.mark.parametrize("seen", [0, 200_000])
def test_words_go_with_the_first_row_of_a_context(monkeypatch, seen):
    monkeypatch.setattr(m, "SEEN", seen)
    texts = [" ".join(f"w{i}" for i in range(50))] * 3 + ["short"]
    places = pa.array([list(range(200))] * 4, pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts), places, pa.array([1, 2, 1, 1])], ["rk", "text", "places", "copies"])
    got = pa.Table.from_batches(list(m._contexts([batch, batch]))).to_pylist()
    assert sum(r["copies"] for r in got) == 4 * len(got) / 3 and {r["rk"] for r in got} == {0, 1, 2}
    first = {}
    for r in got:
        first.setdefault(r["ctx"], []).append(r["words"])
        if r["words"] is not None:
            assert r["words"].decode().split() == texts[0].split()[r["start"]:r["start"] + r["windows"] + m.WINDOW - 1]
    for words in first.values():
        # forgotten contexts are told again, at most once a slice
        assert words[0] is not None and sum(w is not None for w in words) == (1 if seen else 2)
