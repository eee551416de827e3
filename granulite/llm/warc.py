"""WARC archives: writing with revisit records, and reading by verified chains of record boundaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granulite.llm.common import run_bounds, runs_in_arrow, stored

MAGIC = "WARC/1.0\r\n"
GAP = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 20 bits at a time from the hex form."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
               min_revisit: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row to WARC files below ``path``.

    The payload is the body in UTF-8 (null: empty) behind an HTTP head. Of rows with equal payloads of at least
    ``min_revisit`` bytes, those with the smallest id are responses; the others are revisit records that refer to it and hold
    the HTTP head only. Repeated rows of the smallest id are all responses. A null id is written as an empty one. Line
    breaks in urls become spaces. Payloads stay where they are: only digests are shuffled, and the join that marks revisits
    moves payloads only if the table of repeated digests is too large to broadcast by Spark's own measure.
    """
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "[\r\n]+", " ").alias("url"),
                     F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body"))
    p = p.select("*", base32_sha1(F.col("body").cast("binary")).alias("digest"), F.octet_length("body").cast("long").alias("size"))
    copies = p.where(F.col("size") >= min_revisit).groupBy("digest", "size").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    copies = stored(copies.where("n > 1").drop("n"))
    p = p.join(copies, ["digest", "size"], "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(GAP))
    block = F.when(again, head).otherwise(F.concat(head, "body"))
    record = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name("id"),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), "url", F.lit("\r\nWARC-Payload-Digest: sha1:"), "digest",
        F.when(again, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name("first"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(GAP), block)
    # records end with two line breaks, which the text writer puts behind each row
    p.select(record.alias("value")).write.option("lineSep", GAP).text(path)


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """Text between magics; files are cut into splits, and each magic starts a fragment wherever it stands."""
    f = spark.read.option("lineSep", MAGIC).text(path)
    return f.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("seq"))


def _field(header: Column, name: str) -> Column:
    return F.regexp_extract(header, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)


def _parse(f: DataFrame) -> DataFrame:
    """Header fields and payload facts of a fragment, as if a record started with it."""
    header = F.substring_index("value", GAP, 1)
    f = f.withColumn("header", F.when(F.instr("value", GAP) > 0, header))
    length = F.expr("try_cast(nullif(regexp_extract(header, '(?i)(?:^|\\r\\n)Content-Length:[ \\t]*([0-9]+)', 1), '') as bigint)")
    f = f.withColumn("length", length).withColumn("lead", F.octet_length("header") + 4)
    f = f.withColumn("declared", F.lit(len(MAGIC) + 4) + F.col("lead") + F.col("length"))
    block = F.expr("substring(cast(value as binary), lead + 1, cast(least(length, 2147483647) as int))")
    f = f.withColumn("block_bytes", block)
    http = _field(F.col("header"), "Content-Type").startswith("application/http")
    f = f.withColumn("http", F.when(http, F.substring_index(F.col("block_bytes").cast("string"), GAP, 1)))
    f = f.withColumn("payload", F.expr("case when http is null then block_bytes else substring(block_bytes, octet_length(http) + 5, 2147483647) end"))
    return f


def _facts(f: DataFrame, extra: list[str]) -> DataFrame:
    h = F.col("header")
    return f.select(
        *extra, F.col("declared"), _field(h, "WARC-Type").alias("type"), _field(h, "WARC-Record-ID").alias("record_id"),
        _field(h, "WARC-Target-URI").alias("uri"), _field(h, "WARC-Refers-To").alias("refers_to"), _field(h, "WARC-Payload-Digest").alias("declared_digest"),
        F.expr("try_cast(nullif(regexp_extract(http, '(?i)\\r\\nContent-Length:[ \\t]*([0-9]+)', 1), '') as bigint)").alias("http_length"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_sha1"))


def _exits(table: pa.Table):
    """For each candidate of a (file, block) the first offset of its chain beyond the block, or -1 if the chain breaks."""
    off, succ = table.column("off").to_numpy(), table.column("succ").to_numpy()
    exits = np.full(len(off), -1, np.int64)
    bounds = run_bounds(table, ["file", "block"])
    ends = table.column("block_end").to_numpy()
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        seen: dict[int, int] = {}
        for i in range(hi - 1, lo - 1, -1):
            to = int(succ[i])
            exits[i] = to if to >= ends[i] else seen.get(to, -1)
            seen[int(off[i])] = int(exits[i])
    yield pa.RecordBatch.from_arrays([table.column("file").combine_chunks(), table.column("off").combine_chunks(), pa.array(exits)], ["file", "at", "to"])


def _marks(table: pa.Table):
    """Candidates on the chain that starts at the entry of their (file, block)."""
    off, succ, entry = (table.column(c).to_numpy() for c in ("off", "succ", "entry"))
    on = np.zeros(len(off), bool)
    bounds = run_bounds(table, ["file", "block"])
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        want = entry[lo]
        for i in range(lo, hi):
            if off[i] == want:
                on[i] = True
                want = succ[i]
    yield pa.RecordBatch.from_arrays(
        [table.column(c).combine_chunks() for c in ("file", "block", "seq", "off", "succ")] + [pa.array(on)], ["file", "block", "seq", "off", "succ", "on"])


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Records of the WARC files below ``path``: file, offset, length, complete, type, record_id, uri, refers_to, declared_digest,
    http_length, payload_bytes, payload_sha1 (base32) and, on demand, the payload.

    Files are read in splits. Every magic is a candidate with the offset of its successor by its own Content-Length; chains are
    first followed inside a split, then pointers between splits are doubled from the start of each file. Only candidates that a
    file's start reaches are records, so a magic inside a payload is none. A record that holds other magics is put together
    from its fragments. A file that does not start with a record gives none; behind a broken length nothing is reached; a
    cut last record has ``complete`` false, one cut inside its header is none. Empty files give no rows.
    """
    spot = ["file", "block", "seq"]
    parsed = _parse(_fragments(spark, path)).withColumn("span", F.octet_length("value").cast("long") + len(MAGIC))
    whole = F.coalesce(F.col("declared") == F.col("span"), F.lit(False))
    facts = _facts(parsed.withColumn("payload", F.when(whole, F.col("payload"))), [*spot, "span"])
    facts = stored(facts)
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    blocks = facts.groupBy("file", "block").agg(F.sum("span").alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", (F.coalesce(F.sum("bytes").over(before), F.lit(0)) - len(MAGIC)).alias("base"), "bytes",
                           (F.sum("bytes").over(Window.partitionBy("file")) - len(MAGIC)).alias("file_end"))
    c = facts.select(*spot, "declared", F.coalesce(F.sum("span").over(inside), F.lit(0)).alias("rel")).join(blocks, ["file", "block"])
    c = c.select(*spot, (F.col("base") + F.col("rel")).alias("off"), (F.col("base") + F.col("bytes")).alias("block_end"), "file_end",
                 F.coalesce(F.col("base") + F.col("rel") + F.col("declared"), F.lit(-1)).alias("succ")).where("off >= 0")
    c = stored(c)
    keys = ["file", "block"]
    jump = c.select("file", "block", "off", "succ", "block_end").repartition(*keys).sortWithinPartitions(*keys, "off")
    jump = stored(jump.mapInArrow(lambda it: runs_in_arrow(it, ["file", "block"], _exits), "file string, at long, to long").where("to >= 0"))
    targets = jump.select("file", F.col("to").alias("at")).distinct()
    step = stored(jump.join(targets, ["file", "at"], "left_semi").unionByName(jump.join(targets, ["file", "at"], "left_anti").where("at = 0")))
    reach = stored(c.where("off = 0").select("file", F.col("off").alias("at")))
    while True:
        new = stored(reach.join(step, ["file", "at"]).select("file", F.col("to").alias("at")).join(reach, ["file", "at"], "left_anti").distinct())
        if new.isEmpty():
            break
        reach = reach.unionByName(new)
        far = step.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        step = stored(step.join(far, ["file", "to"]).select("file", "at", F.col("beyond").alias("to")))
    entries = c.join(reach.withColumnRenamed("at", "off"), ["file", "off"], "left_semi").groupBy("file", "block").agg(F.min("off").alias("entry"))
    marked = c.join(entries, keys).select(*spot, "off", "succ", "entry").repartition(*keys).sortWithinPartitions(*keys, "off")
    marked = stored(marked.mapInArrow(lambda it: runs_in_arrow(it, ["file", "block"], _marks), "file string, block long, seq long, off long, succ long, on boolean").where("on").drop("on"))
    ends = c.select("file", "file_end").distinct()
    heads = marked.join(ends, "file").join(facts, spot)
    one = heads.where("succ = off + span or (succ = file_end and declared = span)")
    several = stored(heads.where("not (succ = off + span or (succ = file_end and declared = span))").select("file", "off", "succ", "file_end"))
    cols = ["type", "record_id", "uri", "refers_to", "declared_digest", "http_length", "payload_bytes", "payload_sha1"]
    place = [F.col("off").alias("offset"), (F.col("succ") - F.col("off")).alias("length"), (F.col("succ") <= F.col("file_end")).alias("complete")]
    out = one.select("file", *place, *cols, *([*spot[1:]] if payload else []))
    if payload:
        bytes_of = parsed.select(*spot, "payload")
        out = out.join(bytes_of, spot).drop("block", "seq")
    if several.isEmpty():
        return out
    owned = c.select(*spot, "off", "file_end").withColumn("at", F.col("off"))
    owner = F.last(F.col("head"), True).over(Window.partitionBy("file").orderBy("off"))
    owned = owned.join(marked.select("file", "off", F.col("off").alias("head")), ["file", "off"], "left").withColumn("owner", owner)
    pieces = owned.join(several.select("file", F.col("off").alias("owner"), "succ"), ["file", "owner"]).where("off < succ").select(*spot, "owner", "off", "succ", "file_end")
    pieces = _fragments(spark, path).join(pieces, spot)
    joined = pieces.groupBy("file", "owner", "succ", "file_end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", "value"))), lambda x: x.value), MAGIC).alias("value"))
    rest = _parse(joined.withColumnRenamed("owner", "off"))
    rest = _facts(rest, ["file", "off", "succ", "file_end", *(["payload"] if payload else [])])
    return out.unionByName(rest.select("file", *place, *cols, *(["payload"] if payload else [])))
