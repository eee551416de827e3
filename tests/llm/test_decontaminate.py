import random

from granulite.llm.decontaminate import contaminated, contamination, decontaminate
from tests.llm.brute import shingle_set


def test_against_all_pairs(spark):
    rnd = random.Random(6)
    word = lambda: f"w{rnd.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 5, 6, 9, 12, 20, 20, 33, 50, 64, 65, 200])]
    items += [(50, None), (51, ""), (None, " ".join(word() for _ in range(30)))]
    docs = [(900, ""), (901, None), (902, items[0][1]), (903, items[1][1].upper()), (None, items[9][1])]
    for d in range(300):
        t = [word() for _ in range(rnd.choice([0, 3, 40, 3000]))]
        for _ in range(rnd.randrange(3)):
            p = (items[rnd.randrange(16)][1] or "").split()
            if len(p) > 25 and rnd.random() < .5:
                p[rnd.randrange(len(p))] = "other"
            if rnd.random() < .2:
                p = p[:rnd.randrange(len(p) + 1)]
            at = rnd.randrange(len(t) + 1)
            t[at:at] = p
        docs.append((d % 280, " ".join(t)))
    docs += docs[:20]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, tk int, key string").repartition(3)
    it = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, n_item int")
    want, bad = {}, set()
    for k, (i, t) in enumerate(docs):
        s = shingle_set(t)
        for j, x in items:
            q = shingle_set(x)
            if q and 100 * len(q & s) >= 80 * len(q):
                want[i, j] = (len(q), max(len(q & s), want.get((i, j), (0, 0))[1]))
                bad.add(k)
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in contamination(df, it).collect()}
    assert got == want
    left = sorted(((r.doc_id, r.text) for r in decontaminate(df, it).collect()), key=repr)
    assert left == sorted((d for k, d in enumerate(docs) if k not in bad), key=repr)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(docs, none).count() == 0 and decontaminate(docs, none).count() == 1
    assert contamination(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_items_of_one_shingle(spark):
    texts = [[f"d{i}w{j}" for j in range(12)] for i in range(5000)]  # eight shingles: one window of the fourth class, similarity 1/8
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(t[4:9])) for i, t in enumerate(texts)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in contamination(docs, items).collect()}
    assert got == {(i, i, 1, 1) for i in range(len(texts))}
