"""Secrets in documents, and how widely each value is copied. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granulite.llm.common import stored
from granulite.operators.planes import let

#: Kinds in their fixed order, and their patterns. A run of hex digits, and what follows AKIA, is taken whole by either form of
#: the pattern, so the least length can stand in it; a short assignment must still use up its text, so its length is tested later.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
LEAST_VALUE = 6
#: Owners from which on a value counts as a widely copied example.
WIDE = 3


def _matches(text: Column, kind: str, order: int, pattern: str) -> Column:
    """Matches of a kind with the number of characters between them, in order."""
    p = F.lit(pattern)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    return let(gaps, lambda g: F.transform(hits, lambda m, i: F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("o"), i.alias("i"), F.get(g, i).alias("gap"), m.alias("match"))))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str | None = None, wide: int = WIDE) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``spans`` (array of kind, start, end, owners, live), in order of start and kind.

    Spans are in code points, end exclusive. Kinds are assign, access and hex as the patterns have them. Values (group 2 of
    an assignment, else the whole match) are hashed and counted over the whole corpus by distinct repositories and
    owners (``owner_col``, by default the repository): a value of ``wide`` owners or more is an example that was copied
    around, any other is live-looking, and its value gets one more span of kind live.

    Nothing but matches is shuffled; copies of a value are combined before the shuffle, and the join that brings the counts back is left to
    the skew handling of adaptive execution. Null or empty texts have no spans; a null repository is one of its own; repeated ids give
    a row each; extra columns are dropped; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    repo = F.coalesce(F.col(repo_col).cast("string"), F.lit(""))
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit("")) if owner_col else repo
    d = docs.select(F.col(id_col).alias("id"), repo.alias("repo"), owner.alias("owner"), text.alias("text"))
    found = F.concat(*[F.when(F.col("text").rlike(p), _matches(F.col("text"), k, o, p)).otherwise(F.array().cast("array<struct<kind:string,o:int,i:int,gap:int,match:string>>"))
                       for o, (k, p) in enumerate(PATTERNS.items())])
    scan = stored(d.select(F.monotonically_increasing_id().alias("row"), "id", "repo", "owner", found.alias("found")))
    m = scan.where("size(found) > 0").select("row", "repo", "owner", F.inline("found"))
    size = F.char_length("match")
    so_far = Window.partitionBy("row", "o").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("end", F.sum(F.col("gap") + size).over(so_far)).withColumn("value", F.when(F.col("o") == 0, F.regexp_extract("match", ASSIGN, 2)).otherwise(F.col("match")))
    m = m.where((F.col("o") > 0) | (F.char_length("value") >= LEAST_VALUE))
    m = m.select("row", "repo", "owner", "kind", "o", (F.col("end") - size).alias("start"), "end", (F.col("end") - F.char_length("value")).alias("from"), F.sha2("value", 256).alias("value"))
    m = stored(m)
    spread = m.select("value", "repo", "owner").distinct().groupBy("value").agg(F.countDistinct("repo").alias("repos"), F.countDistinct("owner").alias("owners"))
    m = m.join(spread, "value").withColumn("live", F.col("owners") < wide)
    span = lambda start, order, kind: F.struct(F.col(start).cast("long").alias("start"), F.lit(order).alias("o") if isinstance(order, int) else order.alias("o"),
                                               kind.alias("kind"), F.col("end").cast("long").alias("end"), F.col("owners").alias("owners"), F.col("live").alias("live"))
    both = F.when(F.col("live"), F.array(span("start", F.col("o"), F.col("kind")), span("from", 3, F.lit("live")))).otherwise(F.array(span("start", F.col("o"), F.col("kind"))))
    # one value may be found twice over (as hex and as an assignment); its live span stands once
    rows = m.select("row", F.explode(both).alias("s")).groupBy("row").agg(F.array_sort(F.collect_set("s")).alias("spans"))
    out = scan.select("row", "id").join(rows, "row", "left")
    empty = F.array().cast(rows.schema["spans"].dataType)
    spans = F.transform(F.coalesce("spans", empty), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.owners.alias("owners"), s.live.alias("live")))
    return out.select(F.col("id").alias(id_col), spans.alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
