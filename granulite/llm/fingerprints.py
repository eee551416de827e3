"""Document fingerprints by one-permutation MinHash with optimal densification and packed low bits. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulite.llm.common import stored
from granulite.operators.ordered import neighbour
from granulite.operators.planes import let

#: Words of a shingle.
WORDS = 5
#: Bins of the one permutation (a power of two, 256 at most) and low bits kept of each bin's minimum (4, 8, 12 or 16).
BINS, BITS = 256, 4
#: Probes of an empty bin that are tried one by one before all filled bins are compared at once; the result is the same.
TRIES = 8

_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r"
_TO = "abcdefghijklmnopqrstuvwxyz     "


def _words(text: Column) -> Column:
    """Runs of characters other than space and tab to carriage return, A-Z lowered."""
    return F.array_remove(F.split(F.translate(text, _FROM, _TO), " ", -1), "")


def _shingles(words: Column, k: int) -> Column:
    """64-bit hashes of all runs of k words; of the whole sequence where there are fewer, none without words."""
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return let(words, lambda w: F.when(F.size(w) >= k, runs(w)).when(F.size(w) > 0, F.array(F.xxhash64(w)))
               .otherwise(F.array().cast("array<bigint>")))


def _bins(hashes: Column, bins: int, bits: int) -> Column:
    """The low bits of the least hash of each bin, null where a bin is empty. Bins are ranges of the hash, so one sort fills them all.

    One mark per bin, greater than its hashes, sorts with them; what stands first in a bin is its minimum, or the mark if it is empty.
    """
    shift = 64 - (bins.bit_length() - 1)
    marks = F.array(*[F.lit(((b + 1 - bins // 2) << shift) - 1) for b in range(bins)])
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(s, i - 1), shift)))
    mark = F.lit((1 << shift) - 1)
    value = lambda x: F.when(x.bitwiseAND(mark) != mark, x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))
    return F.transform(let(F.sort_array(F.concat(hashes, marks)), first), value)


def _densified(minima: Column, bins: int, bits: int) -> Column:
    """Empty bins take the value of the first filled bin in a probe order of their own.

    Bin i probes ``start + a * step`` for a = 1, 2, ... modulo the number of bins, with a start and an odd step hashed from i; the order
    visits every bin once, so each filled bin is as likely, and all documents probe alike. Where ``TRIES`` probes fail, the place of
    every filled bin in that order is worked out from the inverse of the step, and the least taken.
    """
    low = F.lit(bins - 1)

    def fill(m: Column) -> Column:
        filled = F.filter(F.transform(m, lambda v, j: F.shiftleft(j, bits) + v), lambda p: p.isNotNull())

        def donor(i: Column, full: Column) -> Column:
            h = F.xxhash64(i)
            start, step = F.shiftright(h, 16).bitwiseAND(low).cast("int"), h.bitwiseAND(low).bitwiseOR(F.lit(1)).cast("int")
            probe = [F.get(m, (start + step * F.lit(a)).bitwiseAND(low)) for a in range(1, TRIES + 1)]
            inverse = (step * (2 - step * step)).bitwiseAND(low)
            inverse = (inverse * (2 - step * inverse)).bitwiseAND(low)
            place = lambda p: ((F.shiftright(p, bits) - start - step) * inverse).bitwiseAND(low)
            nearest = F.array_min(F.transform(full, lambda p: F.shiftleft(place(p), bits) + p.bitwiseAND(F.lit((1 << bits) - 1))))
            return F.coalesce(*probe, nearest.bitwiseAND(F.lit((1 << bits) - 1)))
        return let(filled, lambda full: F.when(F.size(full) > 0, F.transform(m, lambda v, i: F.coalesce(v, donor(i, full)))))
    return let(minima, fill)


def fingerprint(text: Column, k: int = WORDS, bins: int = BINS, bits: int = BITS) -> Column:
    """Packed fingerprint of a text as hex: ``bits / 4`` digits a bin. Equal sets of shingles have equal fingerprints; without words it is empty."""
    digit = lambda v: F.lpad(F.lower(F.hex(v)), bits // 4, "0")
    dense = _densified(_bins(_shingles(_words(F.coalesce(text, F.lit(""))), k), bins, bits), bins, bits)
    return F.coalesce(F.array_join(F.transform(dense, digit), ""), F.lit(""))


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Estimate of the Jaccard similarity of two texts from their fingerprints.

    The share of equal bins, corrected for low bits that are equal by chance (2 to the power of minus ``bits``), 0 at least. Equal fingerprints
    have likeness 1, also two empty ones; an empty one is like no other.
    """
    chance = 2.0 ** -bits
    parts = lambda c: F.split(c, f"(?<=\\G.{{{bits // 4}}})", -1) if bits > 4 else F.split(c, "", -1)
    equal = F.size(F.filter(F.zip_with(parts(a), parts(b), lambda x, y: x == y), lambda e: e))
    n = F.char_length(a) / (bits // 4)
    share = F.greatest((equal / n - chance) / (1 - chance), F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.least(share, F.lit(1.0)))


def _followers(nodes: DataFrame) -> DataFrame:
    """``(id, tk, n, times, next_id, next_tk)``: what follows each (id, text) in descending order of ids, the first after the last.

    A text that stands m times under one id is followed by itself m - 1 times. Only ids and lengths are cut by ranges and ordered.
    """
    d = nodes.repartitionByRange("id", "tk").withColumns({"part": F.spark_partition_id(), "one": F.lit(0)})
    d = stored(d)
    own = F.struct("id", "tk")
    last = d.groupBy("one").agg(F.max_by(own, own).alias("last"))
    d = neighbour(d, ["one"], ["id", "tk"], "part", "next", own, -1).join(last, "one").withColumn("next", F.coalesce("next", "last"))
    steps = F.array(F.struct(F.col("next").alias("to"), F.lit(1).cast("long").alias("times")), F.struct(own.alias("to"), (F.col("m") - 1).alias("times")))
    d = d.select("id", "tk", "n", F.explode(steps).alias("s")).where("s.times > 0")
    return stored(d.select("id", "tk", "n", "s.times", F.col("s.to.id").alias("next_id"), F.col("s.to.tk").alias("next_tk")))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_chars`` (code points), ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document in descending order of ids
    (after the last comes the first; a lone document follows itself). Fingerprints cover whole texts: each shingle is hashed once, bins are
    ranges of the hash.

    Whole texts are shuffled once and read from that shuffle twice: to cut the beginnings that go to the document before, and to meet the one that
    comes from the next. Null texts are empty; a null id is the last; rows of one id go by the hash of their texts, and a text that stands
    several times under an id is worked on once and follows itself. Columns of the input that are not named stay out. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tk"), text.alias("text"))
    nodes = base.groupBy("id", "tk").agg(F.count("*").alias("m"), F.first(F.char_length("text")).cast("long").alias("n"))
    after = _followers(nodes)
    if not after.where("times > 1 or id <=> next_id and tk = next_tk").isEmpty():
        base = base.dropDuplicates(["id", "tk"])
    meets = lambda i, t: F.col("id").eqNullSafe(F.col(i)) & (F.col("tk") == F.col(t))
    # merge joins at every size, so that what is shuffled grows with the input and does not jump where a broadcast would end
    asked = after.withColumnsRenamed({"id": "r_id", "tk": "r_tk"}).hint("merge")
    begin = base.join(asked, meets("next_id", "next_tk")).select("r_id", "r_tk", "n", "times", "next_id", "next_tk", F.expr("left(text, cast(n div 3 as int))").alias("begin"))
    met = base.join(begin.hint("merge"), meets("r_id", "r_tk")).withColumn("edited", F.concat(F.expr("left(text, cast(n - n div 3 as int))"), "begin"))
    prints = stored(met.select("id", "tk", "n", "times", "next_id", "next_tk", F.sha2("edited", 256).alias("sha"),
                               fingerprint(F.col("text"), k, bins, bits).alias("fp"), fingerprint(F.col("edited"), k, bins, bits).alias("e_fp")))
    other = prints.groupBy("id", "tk").agg(F.first("fp").alias("n_fp")).withColumnsRenamed({"id": "o_id", "tk": "o_tk"})
    out = prints.join(other.hint("merge"), F.col("next_id").eqNullSafe(F.col("o_id")) & (F.col("next_tk") == F.col("o_tk")))
    out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"), F.col("fp").alias("fingerprint"),
                      F.col("e_fp").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("e_fp"), bits).alias("near_edited"),
                      likeness(F.col("fp"), F.col("n_fp"), bits).alias("near_next"))
