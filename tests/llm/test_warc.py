import base64
import hashlib
import random
import tempfile

import pytest

from granulite.llm.warc import MAGIC, read_warc, write_warc

SCHEMA = "page_id long, url string, html string, block long, note string"


def b32(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def through(spark, rows, **kw):
    path = tempfile.mkdtemp(dir=spark.conf.get("spark.checkpoint.dir", None) or None) + "/warc"
    write_warc(spark.createDataFrame(rows, SCHEMA).repartition(3), path, **kw)
    return path, read_warc(spark, path, payload=True).collect()


def test_round_trip_with_magic_in_payloads_and_small_splits(spark):
    rnd = random.Random(5)
    inner = f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    texts = ["", None, "x", "x", inner, inner * 3, MAGIC, MAGIC + MAGIC, "WAR" + MAGIC, "é\r\n\r\nü" * 40, "a" * 5000 + MAGIC + "b" * 3000, "\r\n\r\n", MAGIC[:-1]]
    texts += ["".join(rnd.choice(["word ", MAGIC, "\r\n", "ß", inner]) for _ in range(rnd.randrange(60))) for _ in range(60)]
    rows = [(i, None if i % 7 == 0 else f"http://h/{i}\r\nX: y", t, 3, "n") for i, t in enumerate(texts)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in ("700", "4k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            _, got = through(spark, rows)
            assert len(got) == len(rows)
            first = {}
            for i, t in enumerate(texts):
                first.setdefault((t or "").encode(), i)
            for r in got:
                i = int(r.record_id.removeprefix("<urn:page:").removesuffix(">"))
                body = (texts[i] or "").encode()
                assert r.declared_digest == "sha1:" + b32(body) and r.http_length == len(body) and r.complete
                if first[body] == i:
                    assert r.type == "response" and bytes(r.payload) == body and r.payload_sha1 == b32(body) and r.payload_bytes == len(body), i
                else:
                    assert r.type == "revisit" and r.refers_to == f"<urn:page:{first[body]}>" and r.payload_bytes == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_threshold_null_ids_and_repeated_rows(spark):
    rows = [(5, "u", "aa", 1, ""), (3, "u", "aa", 1, ""), (3, "u", "aa", 1, ""), (None, "u", "aa", 1, ""), (8, "u", "b", 1, ""), (9, "u", "b", 1, "")]
    _, got = through(spark, rows, min_revisit=2)
    assert sorted((r.record_id, r.type) for r in got) == [
        ("<urn:page:3>", "response"), ("<urn:page:3>", "response"), ("<urn:page:5>", "revisit"), ("<urn:page:8>", "response"), ("<urn:page:9>", "response"), ("<urn:page:>", "revisit")]
    assert through(spark, [])[1] == []


@pytest.mark.parametrize("cut", [10, 400])
def test_broken_archives(spark, cut, tmp_path):
    rows = [(i, "u", f"text {i} " * 30, 1, "") for i in range(4)]
    path, _ = through(spark, [])
    write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "w"))
    data = next((tmp_path / "w").glob("part-*.txt")).read_bytes()
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.warc").write_bytes(data[:-cut])
    (tmp_path / "c" / "b.warc").write_bytes(b"junk" + data)  # starts with no record
    got = read_warc(spark, str(tmp_path / "c")).collect()
    assert sorted(r.complete for r in got) == ([False, True, True, True] if cut == 10 else [True] * 3)  # a cut header is no record
