import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as c
from granulite.llm.line_dedup import line_dedup
from granulite.llm.queries import QUERIES
from granulite.llm.toxicity import score, train
from tests.llm.brute import near_duplicates, shingle_set

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def test_stages_against_plain_counterparts(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = []
    for i, (_, stage) in enumerate(c.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(c.STAGES) - 1:
            assert out.columns == docs.columns
        frames.append((docs, out))
        docs = out
    (d0, d1), (_, d2), (_, d3), (_, d4), (_, d5) = frames
    model = train(d0, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in score(d0, model).where("predicted = 1").collect()}
    assert rows(d1) == [r for r in rows(d0) if r[0] not in bad] and bad
    kept = {r.doc_id: (r.text, r.n_removed) for r in line_dedup(d1).collect()}
    assert dict(rows(d2)) == {i: t for i, (t, n) in kept.items() if n == 0 or re.search(r"[^\x20\x09-\x0D]", t)}
    text = dict(rows(d2))
    assert rows(d3) == sorted(((i, text[i]) for i, _, _, k in near_duplicates(rows(d2), c.SIMILAR) if k), key=repr)
    items = [shingle_set(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda t: any(q and 100 * len(q & s) >= 80 * len(q) for s in [shingle_set(t)] for q in items)
    assert rows(d4) == [r for r in rows(d3) if not holds(r[1])] and len(rows(d4)) < len(rows(d3))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = dict(rows(d4))
    got = d5.collect()
    assert len(got) == len(text)
    for r in got:
        ids = tok.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert sorted(r.ids_sha256 for r in QUERIES["pipeline"](spark, SF).collect()) == sorted(r.ids_sha256 for r in got)


def test_stages_on_odd_rows(spark):
    text = "\n".join(f"line {i} of a text that is long enough" for i in range(5))
    data = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text + " more", "en", "s", 1), (None, text, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (1, "other words here", "en", "s", 3)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = c.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert rows(got) == sorted([(None, text), (1, "other words here"), (3, None), (4, "")], key=repr)
    # columns of the input that a stage uses as names of its own come back as they were
    clash = docs.select("*", docs.n_chars.alias("n_lines"), docs.n_chars.alias("n_removed"))
    kept = c.lines(spark, clash, SF)
    assert kept.columns == clash.columns and all(r.n_lines == r.n_removed == r.n_chars for r in kept.collect())
    for _, stage in c.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        stage(spark, docs, SF).collect()


def test_batches_are_bounded_by_bytes(spark):
    from granulite.llm.common import BATCH_LIMIT, BATCH_MOST, small_batches

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([sum(len(x) for x in b.column(0).to_pylist())])], ["n", "size"])
    df = spark.range(0, 300, numPartitions=1).select(F.repeat(F.lit("x"), F.when(F.col("id") == 7, 9_000_000).otherwise(50_000).cast("int")).alias("text"))
    try:
        small_batches(spark)
        assert spark.conf.get(BATCH_LIMIT) == str(BATCH_MOST)
        got = df.mapInArrow(count, "n long, size long").collect()
        assert sum(r.n for r in got) == 300 and max(r.size for r in got) < 9_000_000 + 2 * BATCH_MOST and len(got) >= 4
        spark.conf.set(BATCH_LIMIT, "1000000")
        small_batches(spark)
        assert spark.conf.get(BATCH_LIMIT) == "1000000"
    finally:
        spark.conf.unset(BATCH_LIMIT)
