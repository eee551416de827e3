import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from granulite.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "  \n a", "a\n \nb", "x<|endoftext|>y", "a  <|endoftext|> b", "don't  we'll 'S ''s", "é" * 9, "a\x1cb\x85c\xa0d", "日本語 テキスト　x", "1²½ ٣x", "🙂🙂 ‍", "\t\t\nend  "]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def texts(n, size, seed=3):
    rnd = random.Random(seed)
    parts = ["the", " the", " ", "  ", "\n", "\n\n", "'s", "'", "<|endoftext|>", "<|end", "é", "日本", "12", "...", " x", "aaaa", "\t"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, size))) for _ in range(n)]


def check(spark, tok, rows, **kw):
    df = spark.createDataFrame([(i % 50, t, 5) for i, t in enumerate(rows)], "doc_id long, text string, n_tokens long").repartition(4)
    got = sorted(tuple(r) for r in token_counts(df, PATH, **kw).collect())
    want = []
    for i, t in enumerate(rows):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((i % 50, len((t or "").encode()), n, n > 512))
    assert got == sorted(want)


def test_counts_whole(spark, tok):
    check(spark, tok, ODD + texts(100, 40))


def test_counts_spliced_and_widened(spark, tok):
    check(spark, tok, ODD + texts(60, 600) + ["a" * 3000, " " * 2000 + "b", "no space" * 300, "x y " * 700], huge=200, step=160, overlap=80)


def test_counts_empty(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
