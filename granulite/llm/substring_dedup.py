"""Repeated word windows across a corpus: suffixes split by prefix into groups that fit memory, a suffix tree for each group."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulite.llm.common import constants, cuts, mix, released, runs_in_arrow, stored, text_bytes, word_table

#: Words of a window, and of the shortest prefix that splits suffixes.
WINDOW, PREFIX = 35, 6
#: Prefixes that start in a window; a window goes with the one of least hash.
SPAN = WINDOW - PREFIX + 1
#: Longer prefixes: words of the halves, forward and backward from the place of the short one, one of which any window holds.
HALF = (WINDOW + PREFIX) // 2
#: Contexts that a group holds at most; larger groups go on by the longest prefix, the window itself.
GROUP = 4096
#: Text taken at a time.
BATCH_BYTES = 4_000_000
#: Contexts that a task remembers to have handed on with their words.
SEEN = 200_000
#: Bytes of the shortest text with a window.
LEAST_BYTES = 2 * WINDOW - 1


def _rolling(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each run of k words."""
    c = constants(k, seed)
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += h[i:i + n] * c[i]
    return mix(out)


def _places(h: np.ndarray, woff: np.ndarray):
    """Windows of a batch by the prefix they go with.

    Returns for each place: its text, the word where its prefix starts, and the first and last window start that go with it. Each
    window of a text belongs to one place, chosen by its words alone, so equal windows have equal prefixes at equal distance.
    """
    g = _rolling(h, PREFIX, 41)
    if len(g) < SPAN:
        return (np.zeros(0, np.int64),) * 4
    least = np.concatenate([np.lib.stride_tricks.sliding_window_view(g[i:i + 65_536 + SPAN - 1], SPAN).argmin(1) for i in range(0, len(g) - SPAN + 1, 65_536)])
    s = np.arange(len(least))
    doc = np.searchsorted(woff, s, "right") - 1
    ok = s + WINDOW <= woff[doc + 1]
    s, doc = s[ok], doc[ok]
    a = s + least[ok]
    if not len(s):
        return (np.zeros(0, np.int64),) * 4
    new = np.ones(len(s), bool)
    new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    return doc[first], a[first], s[first], s[last]


def _halves(batches):
    """Hashes of the longer prefixes of each text: (hash, row key, place); the side is part of the hash."""
    for batch in batches:
        for lo, n in cuts(batch.column(1), BATCH_BYTES):
            b, off = text_bytes(batch.column(1).slice(lo, n))
            _, _, h, woff = word_table(b, off, lower=False)
            doc, a, s0, s1 = _places(h, woff)
            if not len(a):
                continue
            r = _rolling(h, HALF, 42)
            keys = batch.column(0).slice(lo, n).to_numpy()[doc]
            place = a - woff[doc]
            right = s1 >= a - (WINDOW - HALF)
            left = s0 < a - (WINDOW - HALF)
            hashes = np.concatenate([r[a[right]], mix(r[a[left] + PREFIX - HALF] ^ np.uint64(0xABCDEF1234567))])
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.concatenate([keys[right], keys[left]])),
                                              pa.array(np.concatenate([place[right] * 2, place[left] * 2 + 1]).astype(np.int32))], ["half", "rk", "place"])


def _contexts(batches):
    """The words around each surviving place: prefix, hash of the context, text, first window start, windows, copies of the text.

    The words themselves go with the first row of a context in the task only.
    """
    seen: set[int] = set()
    for batch in batches:
        t = pa.table(batch)
        for lo, n in cuts(batch.column(1), BATCH_BYTES):
            b, off = text_bytes(batch.column(1).slice(lo, n))
            st, en, h, woff = word_table(b, off, lower=False)
            doc, a, s0, s1 = _places(h, woff)
            lists = t.column("places").combine_chunks().slice(lo, n)
            held = lists.flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets)))
            survived = np.sort(owner << 40 | held)

            def has(side):
                k = doc << 40 | (a - woff[doc]) * 2 + side
                i = np.searchsorted(survived, k)
                i[i == len(survived)] = 0
                return survived[i] == k if len(survived) else np.zeros(len(k), bool)
            right, left = has(0), has(1)
            middle = a - (WINDOW - HALF)
            s0 = np.where(left, s0, np.maximum(s0, middle))
            s1 = np.where(right, s1, np.minimum(s1, middle - 1))
            keep = np.flatnonzero((s0 <= s1) & (left | right))
            if not len(keep):
                continue
            doc, a, s0, s1 = doc[keep], a[keep], s0[keep], s1[keep]
            size = s1 - s0 + WINDOW
            ends = np.cumsum(size)
            words = h[np.repeat(s0 - np.append(0, ends[:-1]), size) + np.arange(ends[-1])]
            c = constants(2 * WINDOW, 43)
            spot = np.arange(ends[-1]) - np.repeat(np.append(0, ends[:-1]), size)
            ctx = mix(np.add.reduceat(words * c[spot], np.append(0, ends[:-1])) + (a - s0).astype(np.uint64) * c[-1] + size.astype(np.uint64)).view(np.int64)
            raw, said = b.tobytes(), []
            for x, p, q in zip(ctx.tolist(), st[s0].tolist(), en[s1 + WINDOW - 1].tolist()):
                said.append(None if x in seen else raw[p:q])
                seen.add(x)
            if len(seen) > SEEN:
                seen.clear()
            gid = _rolling(h, PREFIX, 41)[a]
            row = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(gid.view(np.int64)), pa.array(ctx), t.column("rk").combine_chunks().slice(lo, n).take(row), t.column("copies").combine_chunks().slice(lo, n).take(row),
                                              pa.array((s0 - woff[doc]).astype(np.int32)), pa.array((s1 - s0 + 1).astype(np.int32)), pa.array(said, pa.binary())], ["gid", "ctx", "rk", "copies", "start", "windows", "words"])


def _deep_nodes(table: pa.Table):
    """Windows of each group whose suffix shares its first ``WINDOW`` words with another suffix of the group.

    The nodes of the suffix tree are found depth by depth, as suffix arrays are by prefix doubling: suffixes that agree in 2d words
    are those that agree in d words and again d words on. Nodes of depth ``WINDOW`` with two suffixes or more are the deep ones.
    """
    _, _, words, off = word_table(*text_bytes(table.column("words").combine_chunks()), lower=False)
    gid = table.column("gid").to_numpy()
    size = np.diff(off)
    owner = np.repeat(np.arange(len(size)), size)
    _, group = np.unique(gid, return_inverse=True)
    _, node = np.unique(words, return_inverse=True)
    _, node = np.unique(group[owner].astype(np.int64) * (node.max() + 1) + node, return_inverse=True)
    ends = off[1:][owner]
    at = np.arange(len(words))
    depth = 1
    while depth < WINDOW:
        step = min(depth, WINDOW - depth)
        live = at + step + depth <= ends
        pair = np.full(len(words), -1, np.int64)
        p = at[live]
        _, pair[p] = np.unique(node[p].astype(np.int64) * (node.max() + 1) + node[p + step], return_inverse=True)
        node = pair
        depth += step
    start = node >= 0
    count = np.bincount(node[start])
    deep = np.zeros(len(words), bool)
    deep[start] = count[node[start]] > 1
    spot = at - off[:-1][owner]
    mask = np.zeros(len(size), np.int64)
    np.bitwise_or.at(mask, owner[deep], np.int64(1) << spot[deep])
    some = np.flatnonzero(mask)
    yield pa.RecordBatch.from_arrays([table.column("gid").combine_chunks().take(pa.array(some)), table.column("ctx").combine_chunks().take(pa.array(some)), pa.array(mask[some])], ["gid", "ctx", "mask"])


def _window_hashes(batches):
    """Each window of a context of an oversize group, under its longest prefix."""
    for batch in batches:
        _, _, words, off = word_table(*text_bytes(batch.column(2)), lower=False)
        r = _rolling(words, WINDOW, 44)
        n = np.diff(off) - WINDOW + 1
        owner = np.repeat(np.arange(len(n)), n)
        spot = np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n))[:-1], n)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(spot), pa.array(r[off[:-1][owner] + spot].view(np.int64))], ["gid", "ctx", "spot", "window"])


def _remover(text_out: bool):
    def remove(batches):
        """Words of each text outside the covered windows."""
        for batch in batches:
            t = pa.table(batch)
            for lo, n in cuts(batch.column(1), BATCH_BYTES):
                part = batch.column(1).slice(lo, n)
                b, off = text_bytes(part)
                st, en, _, woff = word_table(b, off, lower=False)
                raw = b.tobytes()
                starts, masks = (t.column(c).combine_chunks().slice(lo, n).to_pylist() for c in ("starts", "masks"))
                removed, digests, texts = [], [], []
                for i in range(n):
                    x, y = woff[i], woff[i + 1]
                    gone = np.zeros(y - x + 1, np.int32)
                    for s, m in zip(starts[i] or (), masks[i] or ()):
                        bits = np.flatnonzero((m >> np.arange(SPAN)) & 1) + s
                        np.add.at(gone, bits, 1)
                        np.add.at(gone, bits + WINDOW, -1)
                    keep = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + x
                    kept = b" ".join([raw[p:q] for p, q in zip(st[keep].tolist(), en[keep].tolist())])
                    removed.append(int(y - x - len(keep)))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if text_out:
                        texts.append(kept)
                cols = [batch.column(0).slice(lo, n), pa.array(np.diff(woff)), pa.array(removed, pa.int64()), pa.array(digests)]
                names = ["id", "n_words", "n_removed", "kept_sha256"]
                if text_out:
                    cols.append(pa.array(texts, pa.binary()).cast(pa.string()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(cols, names)
    return remove


def repeated_windows(d: DataFrame) -> DataFrame:
    """``(rk, starts, masks)`` of the texts ``(rk, text)`` with repeated windows: bit j of a mask stands for the window at start + j.

    ``rk`` tells texts apart; rows with equal text are one text with a number of copies.

    1. Every window goes with the prefix of least hash in it. Of its two halves around that prefix it holds one whole; only
       places whose half occurs twice in the corpus go on.
    2. The words around these places, a suffix for each window, are split by prefix. Equal contexts are one row with a count; their
       words go from each task once.
    3. Groups that fit memory get a suffix tree; nodes of window depth with two suffixes mark repeated windows. Groups beyond
       ``GROUP`` contexts are split further by the longest prefix, the window itself, where counts suffice, combined before the shuffle.
       A context alone in its group shares its prefix with its own copies only and goes into no tree.
    """
    d = d.where(F.octet_length("text") >= LEAST_BYTES).select("rk", "text")
    halves = d.mapInArrow(_halves, "half long, rk long, place int")
    twice = stored(halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half"))
    places = halves.join(twice, "half").select("rk", "place").groupBy("rk").agg(F.collect_set("place").alias("places"))
    # grouped by the key of the join, so texts are shuffled once
    texts = d.groupBy("rk").agg(F.any_value("text").alias("text"), F.count("*").alias("copies"))
    found = texts.join(places, "rk").select("rk", "text", "places", "copies").mapInArrow(_contexts, "gid long, ctx long, rk long, copies long, start int, windows int, words binary")
    found = stored(found)
    contexts = stored(found.groupBy("gid", "ctx").agg(F.sum("copies").alias("n"), F.any_value("windows").alias("windows"), F.any_value("words", True).alias("words")))
    sizes = stored(contexts.groupBy("gid").agg(F.count("*").alias("m")).where("m > 1"))
    several = contexts.select("gid", "ctx", "words").join(sizes, "gid")
    small = several.where(F.col("m") <= GROUP).select("gid", "ctx", "words").repartition("gid").sortWithinPartitions("gid")
    deep = small.mapInArrow(lambda it: runs_in_arrow(it, ["gid"], _deep_nodes), "gid long, ctx long, mask long")
    exploded = several.where(F.col("m") > GROUP).select("gid", "ctx", "words").mapInArrow(_window_hashes, "gid long, ctx long, spot long, window long")
    repeated = exploded.groupBy("window").agg(F.count("*").alias("k")).where("k > 1")
    wide = exploded.join(repeated, "window").groupBy("gid", "ctx").agg(F.bit_or(F.expr("shiftleft(1L, cast(spot as int))")).alias("mask"))
    whole = contexts.where("n > 1").select("gid", "ctx", F.expr("shiftleft(1L, windows) - 1").alias("mask"))
    # stored, so that the join below deals both sides anew and adaptive execution can split a context that a third of all texts share
    masks = stored(deep.unionByName(wide).unionByName(whole).groupBy("gid", "ctx").agg(F.bit_or("mask").alias("mask")))
    cover = found.select("gid", "ctx", "rk", "start").join(masks, ["gid", "ctx"])
    one = F.collect_list(F.struct("start", "mask"))
    cover = stored(cover.groupBy("rk").agg(one.alias("c")).select("rk", F.col("c.start").alias("starts"), F.col("c.mask").alias("masks")))
    released(twice, found, contexts, sizes, masks)
    return cover


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_words``, ``n_removed``, ``kept_sha256`` and, on demand, the ``kept`` text.

    Words are runs of bytes other than space and tab to carriage return, unchanged. A word goes if a window of ``WINDOW`` words of
    one document covers it whose words also start anywhere else, the same document included; windows are judged on the input. Kept
    words are joined by one space. Null or short texts have no windows. Repeated rows are documents of their own, so their windows repeat.
    Extra columns are dropped; an empty table gives no rows. Words are compared as 64-bit hashes.
    """
    t = F.col(text_col).cast("string")
    d = docs.select(F.col(id_col).alias("id"), t.alias("text"), F.xxhash64(t).alias("rk"))
    cover = repeated_windows(d)
    rows = d.join(cover, "rk", "left").select("id", "text", "starts", "masks")
    schema = f"id {d.schema['id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" + (", kept string" if text else "")
    return rows.mapInArrow(_remover(text), schema).withColumnRenamed("id", id_col)
