import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from granulite.llm.bpe_automaton import Automaton, bpe_decode, bpe_encode
from tests.llm.test_tokens import ODD, texts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def auto():
    return Automaton(PATH, PATTERN)


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def test_automaton_equals_library(auto, tok):
    rnd = random.Random(1)
    rows = [t or "" for t in ODD] + texts(100, 60, seed=8) + ["a" * 700, "ab" * 300, "=" * 999, "\n" * 77, "e" * 3 + "s" * 90]
    rows += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0x250), rnd.randrange(0x3040, 0x3100), 0x1F600])) for _ in range(rnd.randrange(80))) for _ in range(300)]
    rows += ["".join(rnd.choice("aaabthe ") for _ in range(rnd.randrange(200))) for _ in range(300)]
    for t, got in zip(rows, auto.encode(rows)):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == ids, t
        assert auto.decode(np.array(ids)) == tok.decode(ids, skip_special_tokens=False) == t


def test_arcs_are_the_pairs_that_stay_apart(auto, tok):
    rnd = random.Random(2)
    checked = 0
    while checked < 3000:
        a, b = rnd.randrange(50256), rnd.randrange(3000)
        try:
            x, y = auto.labels[a].decode(), auto.labels[b].decode()
        except UnicodeDecodeError:
            continue
        if len(auto.piece.findall(x + y)) != 1:
            continue
        checked += 1
        assert auto.arc(a, b) == (tok.encode(x + y).ids == [a, b])


def test_operator(spark, tok):
    rows = ODD + texts(50, 30, seed=4)
    df = spark.createDataFrame([(i % 20, t, 3) for i, t in enumerate(rows)], "doc_id long, text string, n_tokens int").repartition(3)
    got = sorted(tuple(r) for r in bpe_encode(df, PATH, PATTERN, ids=False).collect())
    want = []
    for i, t in enumerate(rows):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i % 20, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    back = bpe_decode(bpe_encode(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((i % 20, t or "") for i, t in enumerate(rows))
    assert bpe_encode(df.limit(0), PATH, PATTERN).count() == 0
