"""Phrase collocations from sorted count streams: n-grams are counted in merged streams and meet their parts in prefix and suffix order."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granulite.llm.common import blobs, bounded_batches, constants, give_back, mix, run_bounds, runs_in_arrow, stored, text_bytes, word_table

#: Words of the longest phrase.
LONGEST = 4
#: Occurrences a phrase needs.
LEAST = 30
#: A longer candidate with this percentage of the occurrences takes the place of the phrases in it.
PERCENT = 80
#: Phrases reported for each language.
TOP = 2000
#: Bytes of text that are counted together, and counts that are merged together.
SLICE_BYTES, RANGE_COUNTS = 3 << 20, 1 << 19
#: Rows that leave a worker at once, and counts of words that a task holds to add up those of several slices.
OUT, HELD = 1 << 15, 1 << 20
#: Parquet looks at the size of a page after 100 rows at the soonest, and compresses a page as a whole outside the heap: a row of tokens has
#: a megabyte, and several of them come behind many rows of words, so each row is looked at.
PAGES = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(64 << 20)}

_BYTE = np.arange(256)
_BREAK = np.isin(_BYTE, list(b".,;:!?")) | ((_BYTE >= 10) & (_BYTE <= 13))
_WHITE = _BREAK | (_BYTE == 32) | (_BYTE == 9)
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)

_SLICE = "slice bigint, toks binary, own binary, h bigint, word string, lang string, c bigint"
_SLICE_TYPE = pa.schema([("slice", pa.int64()), ("toks", pa.binary()), ("own", pa.binary()), ("h", pa.int64()), ("word", pa.string()), ("lang", pa.string()), ("c", pa.int64())])


def _ranges(b: np.ndarray, off: np.ndarray, size: int):
    """Cut texts into byte ranges of about ``size`` that end at a text's end or after a break, so no phrase is cut."""
    at = 0
    while at < len(b):
        end = at + size
        if end < len(b):
            edge = int(off[np.searchsorted(off, end)])
            while end < edge:
                hit = np.flatnonzero(_BREAK[b[end:min(edge, end + (1 << 16))]])
                if len(hit):
                    edge = end + int(hit[0]) + 1
                    break
                end += 1 << 16
            end = edge
        end = min(end, len(b))
        yield at, end
        at = end


def _rows(schema: pa.Schema, n: int, **columns):
    """Batches of n rows with these columns, the others null."""
    t = pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)
    return [t.slice(i, OUT) for i in range(0, n, OUT)]


def _added(parts: list) -> list:
    """One part of words (hash, count, number of the language, word) from several, each word once."""
    if len(parts) < 2:
        return parts
    h, c, lang, word = zip(*parts)
    own, at, place = np.unique(np.concatenate(h), return_index=True, return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, place, np.concatenate(c))
    return [(own, total, np.concatenate(lang)[at], pa.concat_arrays(word).take(pa.array(at)))]


def _word_rows(parts: list, names: list):
    """Rows of the words of a part."""
    for h, c, lang, word in parts:
        for i in range(0, len(h), OUT):
            langs = pa.DictionaryArray.from_arrays(pa.array(lang[i:i + OUT]), pa.array(names, pa.string())).dictionary_decode()
            yield from _rows(_SLICE_TYPE, len(langs), h=h[i:i + OUT].view(np.int64), word=word.slice(i, OUT), lang=langs, c=c[i:i + OUT])


def _slices(size: int):
    """Token streams of about ``size`` bytes of text, whatever the batches are: numbers of the words of a slice's own vocabulary, 0 between
    pieces, in two bytes each where they suffice, in one row with the vocabulary's hashes; besides a row for each word and its count in
    some slices. A word of another language is another word."""
    def one(b, off, which, salt, number, parts):
        start, end, h, woff = word_table(b, off, True, _WHITE)
        if not len(start):
            return
        doc = np.repeat(np.arange(len(which)), np.diff(woff))
        h = mix(h + salt[which[doc]])
        piece = np.cumsum(_BREAK[b], dtype=np.int32)[start]
        new = np.append(False, (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1]))
        own, at, place, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        toks = np.zeros(len(h) + int(new.sum()), np.uint16 if len(own) < 1 << 16 else np.uint32)
        toks[np.arange(len(h)) + np.cumsum(new)] = place + 1
        yield from _rows(_SLICE_TYPE, 1, slice=[number], toks=[toks.tobytes()], own=[own.tobytes()])
        low = _LOWER[b].tobytes()
        words = [low[x:y].decode("utf-8", "replace") for x, y in zip(start[at].tolist(), end[at].tolist())]
        parts.append((own, count, which[doc[at]], pa.array(words, pa.string())))

    def run(batches):
        task, k, names, salt = TaskContext.get().partitionId(), 0, {}, np.zeros(0, np.uint64)
        b, off, which, parts = np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64), []
        for batch in chain(batches, [None]):
            if batch is not None:
                lang = batch.column(0).dictionary_encode()
                known = [n or "" for n in lang.dictionary.to_pylist()]
                fresh = [n for n in known if n not in names]
                names.update(zip(fresh, range(len(names), len(names) + len(fresh))))
                salt = np.append(salt, np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in fresh], np.uint64))
                more, more_off = text_bytes(batch.column(1))
                which = np.append(which, np.array([names[n] for n in known], np.int64)[lang.indices.to_numpy()])
                b, off = np.concatenate([b, more]), np.append(off, more_off[1:] + len(b))
            done = 0
            for lo, hi in _ranges(b, off, size):
                if hi == len(b) and batch is not None:
                    break
                first, last = np.searchsorted(off, lo, "right") - 1, np.searchsorted(off, hi, "left")
                yield from one(b[lo:hi], np.clip(off[first:last + 1] - lo, 0, hi - lo), which[first:last], salt, (task << 33) + k, parts)
                k += 1
                done = hi
                if sum(len(x[0]) for x in parts) > HELD:
                    parts = _added(parts)
                    if len(parts[0][0]) > HELD // 2:
                        yield from _word_rows(parts, list(names))
                        parts = []
                give_back()
            first = np.searchsorted(off, done, "right") - 1
            b, off, which = b[done:], np.maximum(off[first:] - done, 0), which[first:]
        yield from _word_rows(_added(parts), list(names))
    return run


def _pair_keys(toks: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a pair of words begins at a token, and its 64-bit key."""
    c = constants(2, 31)
    both = (toks[:-1] > 0) & (toks[1:] > 0)
    return both, mix(h[toks[:-1] - 1] * c[0] + h[toks[1:] - 1] * c[1])


def _tokens(toks: bytes, own: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(own, np.uint64)
    return np.frombuffer(toks, np.uint16 if len(h) < 1 << 16 else np.uint32).astype(np.int32), h


def _short(key: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits + 32`` bits of keys: their range, and 32 bits within it. They only choose what is counted further, so that two pairs
    in one short key (a chance of one in 8,000, as a range holds half a million counts at any size) cost a few rows and no exactness."""
    return key >> np.uint64(32 - bits)


def _pair_counts(bits: int):
    """Counts of the pairs of words of each slice as sorted streams, one row per range of keys."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                toks, h = _tokens(batch.column("toks")[i].as_py(), batch.column("own")[i].as_py())
                both, key = _pair_keys(toks, h)
                keys, n = np.unique(_short(key[both], bits), return_counts=True)
                if not len(keys):
                    continue
                rng = (keys >> np.uint64(32)).astype(np.int64)
                keys = keys.astype(np.uint32)
                cut = np.flatnonzero(np.append(True, rng[1:] != rng[:-1]))
                ends = np.append(cut[1:], len(keys))
                n = n.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(rng[cut]), pa.array(np.full(len(cut), batch.column("slice")[i].as_py())),
                    pa.array([keys[x:y].tobytes() for x, y in zip(cut, ends)], pa.binary()), pa.array([n[x:y].tobytes() for x, y in zip(cut, ends)], pa.binary())],
                    ["rng", "slice", "keys", "n"])
                give_back()
    return run


def _merge_ranges(least: int):
    """Merge the streams of a range, and give each slice the keys among its own that reach ``least`` in all."""
    def each(t: pa.Table):
        bounds = run_bounds(t, ["rng"])
        for a, z in zip(bounds[:-1], bounds[1:]):
            run = t.slice(a, z - a)
            raw, off = blobs(run.column("keys"))
            keys, n = raw.view(np.uint32), blobs(run.column("n"))[0].view(np.uint32)
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
            total = np.add.reduceat(n[order].astype(np.int64), first)
            keep = np.zeros(len(keys), bool)
            keep[order] = np.repeat(total >= least, np.diff(np.append(first, len(keys))))
            off = off // 4
            rng = np.uint64(t.column("rng")[int(a)].as_py() << 32)
            some = [i for i in range(len(off) - 1) if keep[off[i]:off[i + 1]].any()]
            if some:
                yield pa.RecordBatch.from_arrays([run.column("slice").combine_chunks().take(pa.array(some, pa.int64())),
                                                  pa.array([(keys[off[i]:off[i + 1]][keep[off[i]:off[i + 1]]] + rng).tobytes() for i in some], pa.binary())], ["slice", "keys"])
    return lambda batches: runs_in_arrow(batches, ["rng"], each)


_GRAMS = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("w3", pa.int64()), ("w4", pa.int64()), ("c", pa.int64())])


def _phrases(bits: int, toks: np.ndarray, h: np.ndarray, known: np.ndarray):
    """Phrases of two to four words of a slice whose pairs are all frequent, with their counts; words are 64-bit numbers, 0 past the end."""
    both, key = _pair_keys(toks, h)
    pair = np.searchsorted(known, _short(key, bits))
    pair[pair == len(known)] = 0
    good = both & (known[pair] == _short(key, bits))
    # pairs are numbered by their whole keys
    pair = np.unique(key, return_inverse=True)[1]
    at = np.flatnonzero(good)
    code = pair[at]
    for n in range(2, LONGEST + 1):
        _, first, number, count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        for i in range(0, len(first), OUT):
            begin = at[first[i:i + OUT]]
            words = [h[toks[begin + j] - 1].view(np.int64) if j < n else np.zeros(len(begin), np.int64) for j in range(LONGEST)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in [*words, count[i:i + OUT]]], schema=_GRAMS)
        # the next longer phrase goes on with the pair that begins at its last but one word
        nxt = at + n - 1
        ok = nxt < len(key)
        ok[ok] = good[nxt[ok]]
        code, at = number[ok] * len(pair) + pair[nxt[ok]], at[ok]


def _grams(bits: int):
    """``_phrases`` of the slices; the rows of a slice stand together, its frequent pairs before its tokens."""
    def run(batches):
        known = []
        for batch in batches:
            toks, own, keys = (batch.column(c) for c in ("toks", "own", "keys"))
            for i in range(batch.num_rows):
                if not toks[i].is_valid:
                    known.append(np.frombuffer(keys[i].as_py(), np.uint64))
                elif known:
                    yield from _phrases(bits, *_tokens(toks[i].as_py(), own[i].as_py()), np.sort(np.concatenate(known)))
                    known = []
                    give_back()
    return run


def count_streams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST,
                  slice_bytes: int = SLICE_BYTES, range_counts: int = RANGE_COUNTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables ``grams(gram, f)``, ``vocabulary(h, word, lang, f)``, both with f >= ``least`` only, and ``totals(lang, n)``.

    ``gram`` is the array of its words' 64-bit numbers, and a word is told apart by language. Texts become token streams once. Pairs of
    words are counted per slice of text, and these sorted streams merged by ranges of keys; each slice then gets back which of its own pairs are
    frequent, and only phrases made of such pairs are counted further, as no phrase is more frequent than its pairs.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    with bounded_batches(docs.sparkSession):
        slices = stored(docs.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(_slices(slice_bytes), _SLICE), **PAGES)
        words = slices.where(F.col("h").isNotNull()).select("h", "word", "lang", "c")
        totals = stored(words.groupBy("lang").agg(F.sum("c").alias("n")))
        # of many words few are left, they go to few files
        vocabulary = stored(words.groupBy("lang", "word").agg(F.first("h").alias("h"), F.sum("c").alias("f")).where(F.col("f") >= least).hint("rebalance"))
        size = totals.agg(F.sum("n")).first()[0] or 0
        bits = min(32, (size // range_counts).bit_length())
        tokens = slices.where(F.col("toks").isNotNull()).select("slice", "toks", "own")
        streams = tokens.mapInArrow(_pair_counts(bits), "rng bigint, slice bigint, keys binary, n binary")
        frequent = streams.repartition("rng").sortWithinPartitions("rng").mapInArrow(_merge_ranges(least), "slice bigint, keys binary")
        both = tokens.unionByName(frequent, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", F.col("toks").isNotNull())
        grams = both.mapInArrow(_grams(bits), "w1 bigint, w2 bigint, w3 bigint, w4 bigint, c bigint")
        grams = grams.groupBy("w1", "w2", "w3", "w4").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
        length = sum(((F.col(f"w{i}") != 0).cast("int") for i in range(1, LONGEST + 1)), F.lit(0))
        grams = grams.select(F.slice(F.array("w1", "w2", "w3", "w4"), F.lit(1), length).alias("gram"), "f")
        return stored(grams.unionByName(vocabulary.select(F.array("h").alias("gram"), "f")).hint("rebalance")), vocabulary, totals


def scored(grams: DataFrame) -> DataFrame:
    """``(gram, a, l, r, score)`` of the phrases that no longer candidate takes in.

    The counts stand twice, in prefix order and in suffix order (the words reversed). A cut of a phrase meets its first part in the
    first stream and its rest in the second; the extensions of a phrase by a word stand behind it in one stream and, by a word before it, in
    the other. All are merge joins of sorted streams. A candidate that takes a phrase in over several words does so over one word first,
    as its parts are no less frequent. Products go in decimals, so that nothing overflows.
    """
    prefix = grams.select(F.col("gram").alias("p_gram"), F.col("f").alias("l"))
    suffix = grams.select(F.reverse("gram").alias("s_gram"), F.col("f").alias("r"))
    found = grams.where(F.size("gram") > 1).withColumnRenamed("f", "a")
    longer = found.where(F.size("gram") > 2)
    size = F.size("gram")
    behind = longer.groupBy(F.slice("gram", F.lit(1), size - 1).alias("b_gram")).agg(F.max("a").alias("behind"))
    before = longer.groupBy(F.slice(F.reverse("gram"), F.lit(1), size - 1).alias("f_gram")).agg(F.max("a").alias("before"))
    kept = found.join(behind.hint("merge"), F.col("gram") == F.col("b_gram"), "left").join(before.hint("merge"), F.reverse("gram") == F.col("f_gram"), "left")
    most = F.greatest(F.coalesce("behind", F.lit(0)), F.coalesce("before", F.lit(0)))
    kept = kept.where(F.lit(100).cast("decimal(10)") * most.cast("decimal(20)") < F.lit(PERCENT).cast("decimal(10)") * F.col("a").cast("decimal(20)")).select("gram", "a")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"left": F.slice("gram", F.lit(1), F.col("k")), "right": F.reverse(F.slice("gram", F.col("k") + 1, size - F.col("k")))})
    cuts = cuts.join(prefix.hint("merge"), F.col("left") == F.col("p_gram")).join(suffix.hint("merge"), F.col("right") == F.col("s_gram"))
    score = F.expr("cast((cast(2000000 as decimal(10)) * cast(a as decimal(20))) div (cast(l as decimal(20)) + cast(r as decimal(20))) as bigint)")
    worst = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return cuts.withColumn("score", score).groupBy("gram").agg(F.first("a").alias("a"), worst.alias("w")).select("gram", "a", "w.l", "w.r", "w.score")


def _spelled(found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``phrase`` and ``lang`` of each gram."""
    words = vocabulary.select("h", "word", "lang").hint("merge")
    each = found.select("gram", F.posexplode("gram").alias("at", "h")).join(words, "h")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x.word), " ")
    return found.join(each.groupBy("gram").agg(F.min("lang").alias("lang"), text.alias("phrase")), "gram")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP,
                 slice_bytes: int = SLICE_BYTES, range_counts: int = RANGE_COUNTS) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts are lowered (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words at spaces and tabs. Phrases are two to four words of a
    piece with ``least`` occurrences or more, counted per language; n is the number of all words of the language. Cut after its
    first words, a phrase scores floor(2,000,000 a / (l + r)) with the counts a of itself and l, r of the parts; its lowest cut counts, of
    equal ones the first. Phrases inside a longer candidate with ``PERCENT`` of their count or more are left out.

    Null texts are empty, a null language is ``und``; repeated rows count as often as they stand; ties in score and count go by the phrase in
    byte order; columns that are not named stay out; without phrases there are no rows. Words and pairs are told apart by 64-bit hashes.
    """
    grams, vocabulary, totals = count_streams(docs, lang_col, text_col, least, slice_bytes, range_counts)
    found = _spelled(scored(grams), vocabulary).join(totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    whole: list[Column] = [F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")]
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *whole)
