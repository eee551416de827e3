"""Fingerprints against a plain one-permutation MinHash, and their estimates against exact similarities."""

import random
from hashlib import sha256

import xxhash
from pyspark.sql import functions as F

from granulite.llm.fingerprints import document_fingerprints, fingerprint, likeness
from granulite.llm.queries import QUERIES
from tests.llm.brute import WORD, fold, shingle_set


def chained(words):
    h = 42
    for w in words:
        h = xxhash.xxh64(w.encode(), seed=h).intdigest()
    return h


def plain(text, bins=256, bits=4):
    sets = shingle_set(text)
    if not sets:
        return ""
    least = {}
    for s in sets:
        h = chained(s)
        signed = h - (1 << 64) if h >= 1 << 63 else h
        b = (signed >> (64 - bins.bit_length() + 1)) + bins // 2
        least[b] = min(least.get(b, signed), signed)
    out = []
    for i in range(bins):
        if i not in least:
            h = xxhash.xxh64(i.to_bytes(4, "little"), seed=42).intdigest()
            h = h - (1 << 64) if h >= 1 << 63 else h
            start, step = (h >> 16) & (bins - 1), (h & (bins - 1)) | 1
            i = next(j for j in ((start + a * step) % bins for a in range(1, bins + 1)) if j in least)
        out.append(f"{least[i] & ((1 << bits) - 1):0{bits // 4}x}")
    return "".join(out)


def plain_rows(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda x: -x[0])
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        k = len(t) // 3
        e = t[:len(t) - k] + nxt[:k]
        out.append((d, len(t), sha256(e.encode()).hexdigest(), plain(t), plain(e)))
    return sorted(out)


def text(r, n):
    return "".join(r.choice(["Ab", "cé", "word", "x", "lorem"]) + str(r.randint(0, 40)) + r.choice([" ", "  ", "\n", "\t"]) for _ in range(n))


def test_against_plain(spark):
    r = random.Random(3)
    rows = [(i, text(r, r.choice([1, 3, 5, 6, 9, 20, 80, 300, 900]))) for i in range(60)] + [(100, None), (101, ""), (102, " \n "), (103, "😀" * 50), (104, "one " * 20000)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fingerprint string, n long")
    got = document_fingerprints(df.repartition(4)).collect()
    assert sorted((x.doc_id, x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint) for x in got) == plain_rows(rows)


def test_other_sizes(spark):
    r = random.Random(4)
    rows = [text(r, n) for n in (1, 7, 30, 200)]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    for bins, bits in ((64, 8), (128, 4), (256, 16)):
        got = [x[0] for x in df.select(fingerprint(F.col("t"), bins=bins, bits=bits)).collect()]
        assert got == [plain(t, bins, bits) for t in rows]


def test_repeats_nulls_and_order(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words here"), (2, "p q r s t u v w x y z"), (None, "null id text"), (2, "p q r s t u v w x y z"), (2, "p q r s t u v w x y z")]
    got = document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((repr(x.doc_id), x.n_chars) for x in got) == sorted((repr(d), len(t)) for d, t in rows)
    twice = [x for x in got if x.doc_id == 2]
    assert sum(x.near_next == 1.0 for x in twice) == 2  # two of three copies are followed by a copy
    own = sha256("p q r s t u v w x y z".encode()).hexdigest()
    assert len({x.fingerprint for x in twice}) == 1 and all(x.edited_sha256 != own for x in twice)
    one = document_fingerprints(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == sha256(b"abcdab").hexdigest() and one[0].near_next == 1.0
    assert document_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimates(spark):
    """On the shared table the estimates follow the exact similarity: no bias, and the error that 256 bins promise."""
    sf = "/root/testdata/sf0.001"
    got = {x.doc_id: x for x in QUERIES["op12_fingerprints"](spark, sf).collect()}
    rows = sorted(((x.doc_id, x.text or "") for x in spark.read.parquet(f"{sf}/documents.parquet").collect()), key=lambda x: -x[0])
    assert len(got) == len(rows)
    off = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        k = len(t) // 3
        a, b, c = shingle_set(t), shingle_set(t[:len(t) - k] + nxt[:k]), shingle_set(nxt)
        for x, est in ((b, got[d].near_edited), (c, got[d].near_next)):
            exact = len(a & x) / len(a | x) if a | x else 1.0
            if len(a | x) > 64:
                off.append(est - exact)
    assert abs(sum(off) / len(off)) < 0.01 and sum(abs(o) for o in off) / len(off) < 0.03 and max(map(abs, off)) < 0.2


def test_likeness_ends(spark):
    f = plain("a b c d e f g h")
    r = spark.createDataFrame([(f, f), ("", ""), ("", f), (f, "")], "a string, b string").select(likeness(F.col("a"), F.col("b"))).collect()
    assert [x[0] for x in r] == [1.0, 1.0, 0.0, 0.0]
    assert WORD.findall(fold("A\x0bB")) == ["a", "b"]
