"""Token counts of whole documents; huge ones in overlapping pieces that are spliced where both sides agree."""

from __future__ import annotations

import json
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulite.llm.common import cuts, per_worker, stored
from granulite.llm.pretokens import Memo, chunks_of

#: Characters of a document that is still encoded whole.
HUGE = 65_536
#: Characters between the starts of two pieces, and of their overlap at first.
STEP, OVERLAP = 32_768, 512
#: Characters before the end of a piece whose boundaries count as unsure: pattern look-ahead, contractions, cut special strings.
MARGIN = 64
#: Chunks whose counts a worker keeps.
MEMO = 300_000
#: Texts encoded at a time.
BATCH_CHARS = 2_000_000


def _library(path: str):
    """The tokenizer, the strings of its added tokens, and whether its pieces depend on the text of a chunk alone."""
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre = said.get("pre_tokenizer") or {}
        local = (said["model"]["type"] == "BPE" and said.get("normalizer") is None and pre.get("type") == "ByteLevel"
                 and pre.get("use_regex", True) and not pre.get("add_prefix_space"))
        added = [a.content for a in t.get_added_tokens_decoder().values()]
        return t, added, local
    return per_worker(("tokenizer", path), make)


def _counter(path: str):
    def count(batches):
        tok, added, local = _library(path)
        memo = per_worker(("counts", path), lambda: Memo(MEMO))
        for batch in batches:
            out = []
            for lo in cuts(batch.column(1), BATCH_CHARS):
                texts = [x or "" for x in batch.column(1).slice(lo[0], lo[1]).to_pylist()]
                whole = [i for i, t in enumerate(texts) if not local or any(a in t for a in added)]
                n = dict(zip(whole, (len(e.ids) for e in tok.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)))) if whole else {}
                memo.room()
                split, new = chunks_of(["" if i in n else t for i, t in enumerate(texts)], memo)
                memo.update(zip(new, (len(e.ids) for e in tok.encode_batch_fast(new, add_special_tokens=False))))
                out += [n[i] if i in n else sum(map(memo.__getitem__, s)) for i, s in enumerate(split)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["key", "n_tokens"])
    return count


def _piecer(step: int, overlap: int):
    """Cut each huge text into overlapping pieces."""
    def cut(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts = range(0, max(1, len(text) - overlap), step)
                for k, s in enumerate(starts):
                    last = s == starts[-1]
                    piece = text[s:] if last else text[s:s + step + overlap]
                    yield pa.RecordBatch.from_pylist([{"key": key, "k": k, "start": s, "last": last, "text": piece}],
                                                     pa.schema([("key", pa.int64()), ("k", pa.int64()), ("start", pa.int64()), ("last", pa.bool_()), ("text", pa.string())]))
    return cut


_SPOTS = pa.list_(pa.struct([("p", pa.int64()), ("i", pa.int64())]))


def _encoder(path: str, step: int, overlap: int):
    """Tokens of each piece, and where its pre-token starts lie in the overlaps with its neighbours (position, tokens before)."""
    def encode(batches):
        tok, _, _ = _library(path)
        for batch in batches:
            for key, k, start, last, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                e = tok.encode(text, add_special_tokens=False)
                head, tail = [], []
                sure = len(text) if last else len(text) - MARGIN
                before = object()
                for i, (w, (p, _)) in enumerate(zip(e.word_ids, e.offsets)):
                    if w is None or w != before:
                        if p < overlap and k:
                            head.append({"p": start + p, "i": i})
                        if p >= step and not last and p < sure:
                            tail.append({"p": start + p, "i": i})
                    before = w
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k]), pa.array([len(e.ids)]), pa.array([last]), pa.array([head], _SPOTS), pa.array([tail], _SPOTS)],
                                                 ["key", "k", "n", "last", "head", "tail"])
    return encode


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512,
                 huge: int = HUGE, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    Counts equal the library's for the whole text without added special tokens; special strings inside a text are handled
    as by default. ``path`` names a ``tokenizers`` file that the executors can read.

    Documents of up to ``huge`` characters are counted whole, distinct chunks between white space once per worker. Longer
    ones are cut into pieces that overlap and are spread over tasks. Two neighbours are spliced at the first position
    in their overlap that starts a pre-token in both: matching goes on from a match start without looking back, so a
    start that is right in the left piece, well before its end, and also a start in the right piece makes all that follows in the
    right piece right. By induction the sum is that of the whole text. Where neighbours share no start, the document's overlap
    and step grow fourfold and it is encoded again, in the end in one piece.

    Null or empty texts count 0; repeated ids give a row each; extra columns are dropped; an empty table gives no rows. A vocabulary
    without the byte-level pattern has no proven boundaries, so its documents are encoded whole.
    """
    if not path.endswith(".json"):
        raise ValueError("token_counts takes a tokenizers .json file")
    local = _library(path)[2]
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    long = F.coalesce(F.char_length("text"), F.lit(0)) > (huge if local else 2**31 - 1)
    # id and size ride along as one value, so the Arrow function passes them through untouched
    key = F.struct("id", "n_bytes").alias("key")
    kind = d.select(key).schema["key"].dataType.simpleString()
    out = d.where(~long).select(key, "text").mapInArrow(_counter(path), f"key {kind}, n_tokens long").select("key.*", "n_tokens")
    pending = stored(d.where(long).select(F.monotonically_increasing_id().alias("key"), "id", "n_bytes", "text"))
    done = []
    while not pending.isEmpty():
        pieces = stored(pending.select("key", "text").mapInArrow(_piecer(step, overlap), "key long, k long, start long, last boolean, text string").repartition("key", "k"))
        spots = "array<struct<p: long, i: long>>"
        enc = stored(pieces.mapInArrow(_encoder(path, step, overlap), f"key long, k long, n long, last boolean, head {spots}, tail {spots}"))
        right = enc.select("key", (F.col("k") - 1).alias("k"), F.col("head").alias("next"))
        join = enc.join(right, ["key", "k"], "left").withColumn("p", F.array_min(F.array_intersect(F.transform("tail", lambda x: x.p), F.transform("next", lambda x: x.p))))
        at = lambda spots: F.get(F.filter(spots, lambda x: x.p == F.col("p")), 0).i
        # tokens up to the splice on the left, less those before the splice on the right
        join = join.select("key", F.when(F.col("last"), F.col("n")).otherwise(at("tail") - at("next")).alias("part"), (~F.col("last") & F.col("p").isNull()).alias("failed"))
        sums = stored(join.groupBy("key").agg(F.sum("part").alias("n_tokens"), F.max("failed").alias("failed")))
        done.append(pending.join(sums.where("not failed"), "key").select("id", "n_bytes", "n_tokens"))
        pending = pending.join(sums.where("failed").select("key"), "key", "left_semi")
        step, overlap = 4 * step, 4 * overlap
    for part in done:
        out = out.unionByName(part)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
