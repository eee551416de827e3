"""Collocations against a plain count, with tiny slices and ranges."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from granulite.llm import collocations as module
from granulite.llm.collocations import collocations
from granulite.llm.common import BATCH_LIMIT
from tests.llm.brute import fold


def plain(rows, least, top, percent=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    found = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    inside = set()
    for (lang, w), b in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                part = (lang, w[i:i + k])
                if 100 * b >= percent * found[part]:
                    inside.add(part)
    out = {}
    for (lang, w), a in found.items():
        if (lang, w) in inside:
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, w[:k]], f[lang, w[k:]]
            cuts.append((2000000 * a // (left + right), k, left, right))
        s, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s)
                  for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top], 1))


def rows_of(df, **kw):
    return sorted(tuple(r) for r in collocations(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("seed,slice_bytes,range_counts", [(1, 4 << 20, 1 << 19), (2, 3000, 4000)])
def test_against_plain(spark, seed, slice_bytes, range_counts):
    r = random.Random(seed)
    words = ["New", "york", "CITY", "é", "ab", "a", "it's", "x" * 40, "日本", "-"]
    def text():
        return "".join(r.choice(words[:r.choice([3, 10])]) + r.choice([" "] * 9 + ["\t", "  ", ". ", ",", "\n", "\x0b", "?!", "\x0c"]) for _ in range(r.choice([0, 1, 4, 30, 200])))
    rows = [(r.choice([None, "und", "", "en", "en", "en", "de"]), r.choice([None, "", "new york city", text(), text(), text()])) for _ in range(200)]
    rows += [("en", "hot pair " * 3000), ("en", "hot,pair " * 50)]
    df = spark.createDataFrame([(a, b, "z", 1, 2) for a, b in rows], "lang string, text string, phrase string, n long, rank int").repartition(3)
    got = rows_of(df, least=3, top=40, slice_bytes=slice_bytes, range_counts=range_counts)
    assert got == plain(rows, 3, 40) and got


def test_great_counts(spark):
    """Products beyond 64 bits: the score is exact whatever the counts are."""
    from granulite.llm.collocations import scored
    big = 9_000_000_000_000
    grams = spark.createDataFrame([([1], big + 1), ([2], big + 2), ([1, 2], big)], "gram array<long>, f long")
    x = scored(grams).collect()
    assert [(r.a, r.l, r.r, r.score) for r in x] == [(big, big + 1, big + 2, 2_000_000 * big // (2 * big + 3))]


def test_nothing(spark):
    for rows in ([], [("en", None)], [(None, "one two three")]):
        assert rows_of(spark.createDataFrame(rows, "lang string, text string")) == []


def test_slices_hold_their_size_whatever_the_batches(spark):
    """Small Arrow batches bound a worker and the buffers beside the heap; they must not cut the slices small, as each slice sends its pairs."""
    rows = [("en" if i % 3 else "de", f"word{i} common pair, common pair " * 3) for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    total = sum(len(t) for _, t in rows)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "5")
    try:
        got = df.mapInArrow(module._slices(4000), module._SLICE).where("toks is not null").count()
        assert got <= total // 4000 + 1
        assert rows_of(df, least=3, top=40, slice_bytes=4000) == plain(rows, 3, 40)
    finally:
        spark.conf.set(setting, before)
    assert BATCH_LIMIT not in spark.conf.getAll


@pytest.mark.parametrize("held", [1, 40, 1 << 20])
def test_words_are_added_up_before_they_leave(spark, held, monkeypatch):
    """A task adds up the words of its slices as far as it may hold them; the counts are the same however often they leave."""
    rows = [("en" if i % 3 else "de", f"word{i % 30} common pair, é common pair " * 3) for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    monkeypatch.setattr(module, "HELD", held)
    got = df.mapInArrow(module._slices(1000), module._SLICE).where("h is not null").select("lang", "word", "c").collect()
    want = Counter((lang, w) for lang, t in rows for w in re.findall(r"[^ ,]+", t))
    total = Counter()
    for x in got:
        total[x.lang, x.word] += x.c
    assert total == want
    assert len(got) == len(want) if held > 1000 else len(got) > len(want)


def test_phrases_leave_in_pieces(monkeypatch):
    """A slice's phrases leave the worker in batches of ``OUT`` rows, and are the same ones."""
    monkeypatch.setattr(module, "OUT", 7)
    r = random.Random(3)
    words = [r.choice([0, 1, 1, 2, 3, 4, 5]) for _ in range(600)]
    toks, h = np.array(words, np.int32), np.arange(100, 105, dtype=np.uint64)
    both, key = module._pair_keys(toks, h)
    batches = list(module._phrases(0, toks, h, np.unique(module._short(key[both], 0))))
    assert max(b.num_rows for b in batches) == 7
    want = Counter()
    for n in (2, 3, 4):
        for i in range(len(words) - n + 1):
            if all(words[i:i + n]):
                want[tuple(w + 99 for w in words[i:i + n]) + (0,) * (4 - n)] += 1
    got = [tuple(x.values()) for b in batches for x in b.to_pylist()]
    assert {x[:4]: x[4] for x in got} == want and len(got) == len(want)


def test_small_results_go_to_few_files(spark):
    """Frequent words and phrases are few: they are not written to a file for each partition of all words."""
    rows = [("en", " ".join(f"w{(i * j) % 997}" for j in range(200)) + " hot pair") for i in range(200)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    sizes = {setting: "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        _, vocabulary, _ = module.count_streams(df, least=100)
        assert len(vocabulary.inputFiles()) == 1 and vocabulary.count() > 0
    finally:
        for k in sizes:
            spark.conf.unset(k)
