"""Repeated runs of lines by winnowing: window minima of line hashes as fingerprints, matched places extended both ways, later runs deleted.

DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulite.llm.common import stored
from granulite.operators.planes import let

#: Lines of the shortest run that is deleted whatever its length in words, and of the winnowing window.
LEAST_RUN = 3
#: Words from which a run of fewer lines is deleted; such runs are windows of their own.
LEAST_WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _fingerprints(s: Column) -> Column:
    """``(fp, runs)`` of the lines that are the leftmost minimum of a window, with the windows they are that of.

    A window is a run of LEAST_RUN lines, or of fewer that hold LEAST_WORDS words. Whether a line is the minimum of a window follows
    from the window's lines alone, so equal windows have the same fingerprint at the same distance. ``runs`` are the extensions of the
    fingerprint to both sides that make up these windows: ``(pos, key, at)``, first line, hash of the lines, their numbers in the text.
    """
    def line(i: Column) -> Column:
        def extend(n: int, left: int) -> Column:
            places = [i + (j - left) for j in range(n)]
            # beyond the text's ends lines are null, and so is the comparison
            least = [F.get(s, p).h > F.get(s, i).h if j < left else F.get(s, p).h >= F.get(s, i).h for j, p in enumerate(places) if j != left]
            if n < LEAST_RUN:
                least.append(sum((F.get(s, p).w for p in places), F.lit(0)) >= LEAST_WORDS)
            run = F.struct((i - left).alias("pos"), F.xxhash64(F.lit(n), *[F.get(s, p).h for p in places]).alias("key"), F.array(*[F.get(s, p).at for p in places]).alias("at"))
            return F.when(reduce(and_, least), run)
        runs = F.filter(F.array(*[extend(n, left) for n in range(1, LEAST_RUN + 1) for left in range(n)]), lambda r: r.isNotNull())
        return F.struct(F.get(s, i).h.alias("fp"), runs.alias("runs"))
    return F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), line), lambda x: F.size(x.runs) > 0)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, tk, gone)``: for each text with deleted lines their numbers from 0. ``tk`` tells rows of one id apart.

    1. Lines that are not blank are hashed, and the minimum of every window of them is a fingerprint: any run of a window's length that
       two places share has a fingerprint there at the same distance. The lines themselves go no further.
    2. Places are joined by fingerprint; those whose fingerprint stands nowhere else are done.
    3. What is left is extended both ways to the windows that the fingerprint is the minimum of. Of the places that agree along the
       extension, all but the first in order of (id, position) are later ones, whatever stands around the first; a longer run is
       matched at each of its fingerprints, and the matches on it overlap or touch until its ends.
    4. The lines of later places are deleted. Each stands earlier, and a first place is never deleted for its own run, so a copy stays.

    No places are paired: agreement is an equal key and first places are minima, combined before the shuffle. A fingerprint or run that
    a third of all places share is dealt anew by adaptive execution, as both sides of the joins are written tables.
    """
    text = F.col(text_col).cast("string")
    # number, hash and words of each line
    marked = F.transform(_lines(text), lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("w")))
    d = docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tk"), F.filter(marked, lambda s: s.w > 0).alias("lines"))
    d = stored(d.where(F.size("lines") > 0))
    seeds = stored(d.select("id", "tk", F.inline(_fingerprints(F.col("lines")))))
    shared = stored(seeds.groupBy("fp").agg(F.count("*").alias("m")).where("m > 1").select("fp"))
    runs = stored(seeds.join(shared, "fp").select("id", "tk", F.inline("runs")))
    place = F.struct("id", "tk", "pos")
    first = stored(runs.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").drop("last"))
    later = runs.join(first, "key").where(place != F.col("first"))
    # a set, so that rows that repeat an id and text add nothing
    return later.groupBy("id", "tk").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with repeated runs of lines taken out of ``text_col``, and ``n_lines``, ``n_removed``.

    See ``repeated_lines`` for what counts. Blank lines break no run and stay. Rows with equal id and text are one document and
    fare alike. Null texts stay null with 0 lines; a null id comes first in order; columns of the input called n_lines or n_removed are
    replaced; an empty table gives no rows.
    """
    gone = stored(repeated_lines(docs, id_col, text_col)).select(F.col("id").alias("__id"), F.col("tk").alias("__tk"), F.col("gone").alias("__gone"))
    text = F.col(text_col).cast("string")
    # always a merge join, so that what is shuffled grows with the input and does not jump where a broadcast would end
    out = docs.join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__tk")), "left")
    def rest(lines: Column) -> Column:
        left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone")))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    out = out.withColumns({"n_lines": F.coalesce(breaks + 1, F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
                           text_col: F.when(F.col("__gone").isNull(), text).otherwise(let(_lines(text), rest))})
    return out.drop("__id", "__tk", "__gone")
