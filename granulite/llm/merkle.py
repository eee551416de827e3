"""Merkle manifest of a dataset: trees by group whose nodes are labelled with the leaf ranks they cover, and proofs from those labels."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulite.llm.common import stored
from granulite.operators.ordered import group_totals, row_index

#: Nodes under one parent.
FANOUT = 16
#: What a leaf of ``documents`` is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*inputs) -> Column:
    """Lower-case hex SHA-256 of the inputs, concatenated."""
    return F.sha2(F.concat(*inputs), 256)


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value, so that no two rows of fields read alike."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return digest(*[field(c) for c in columns])


class Manifest(NamedTuple):
    """Stored tables: ``leaves`` and ``groups`` carry ``lo = hi = rank``; ``levels[i]`` has the nodes i + 1 steps above the leaves, each with the
    interval ``lo .. hi`` of leaf ranks it covers and its children; ``group_levels`` the same above the groups."""
    leaves: DataFrame
    levels: list[DataFrame]
    groups: DataFrame
    group_levels: list[DataFrame]
    id_col: str
    group_col: str
    fanout: int


def _ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """``lo = hi = `` rank of each row in its group ``g``, and the group's size ``n``. Rows are cut by ranges of (group, order), so a group of any
    size spreads over tasks; only counts go across the cuts. Equal rows are told apart by where they were read."""
    d = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("g", *order, "_tie")
    d = stored(d.withColumn("_part", F.spark_partition_id()))
    d = row_index(d, ["g"], [*order, "_tie"], "_part", "lo")
    d = group_totals(d.withColumn("hi", F.col("lo")), ["g"], F.count("*").alias("n"))
    return stored(d.drop("_tie", "_part"))


def _grow(leaves: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels above ``leaves`` (g, lo, hi, n, digest) and the tops ``(g, digest)``. A level holds the groups of more than one node below it."""
    biggest = leaves.agg(F.max("n")).first()[0] or 0
    levels, below, reach = [], leaves, 1
    tops = leaves.where(F.col("n") <= 1).select("g", "digest")
    while reach < biggest:
        kid = F.struct("lo", "hi", "digest")
        up = below.where(F.col("n") > reach).groupBy("g", F.expr(f"lo div {reach * fanout}").alias("bucket")) \
            .agg(F.first("n").alias("n"), F.sort_array(F.collect_list(kid)).alias("kids"))
        up = up.select("g", F.col("kids")[0]["lo"].alias("lo"), F.array_max("kids.hi").alias("hi"), "n",
                       F.sha2(F.array_join("kids.digest", ""), 256).alias("digest"), "kids")
        below = stored(up)
        levels.append(below)
        reach *= fanout
        tops = tops.unionByName(below.where(F.col("n") <= reach).select("g", "digest"))
    return levels, tops


def _siblings(kids: Column, lo: Column, hi: Column) -> Column:
    """The parent's interval less the node's own: children before it and after it, as joined digests."""
    side = lambda keep: F.array_join(F.transform(F.filter(kids, keep), lambda k: k.digest), "")
    return F.struct(side(lambda k: k.hi < lo).alias("left"), side(lambda k: k.lo > hi).alias("right"))


def _attach(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """Bring ``path`` and the further columns of ``tops`` (g, path, ...) down to the leaves, a level at a time.

    A node meets its ancestor in the bucket of the ancestor's level, where the ancestor's interval contains its own. At
    most ``fanout`` nodes share a bucket, so no join key is hot, and proofs are shared by the children of a node until the last join.
    """
    tops = tops.withColumnRenamed("g", "_tg")
    extra = [c for c in tops.columns if c not in ("_tg", "path")]
    down = None
    for i in range(len(levels), -1, -1):
        reach = fanout ** i
        nodes = levels[i - 1] if i else leaves
        here = nodes.where(F.col("n") <= reach).join(tops, F.col("g") == F.col("_tg")).drop("_tg")
        if down is not None:
            up = down.select(F.col("g").alias("_g"), F.expr(f"lo div {reach * fanout}").alias("_b"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                             F.col("kids").alias("_kids"), F.col("path").alias("_path"), *extra)
            inside = (F.col("g") == F.col("_g")) & (F.expr(f"lo div {reach * fanout}") == F.col("_b")) & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
            j = nodes.where(F.col("n") > reach).join(up.hint("merge"), inside)
            j = j.withColumn("path", F.concat(F.array(_siblings(F.col("_kids"), F.col("lo"), F.col("hi"))), F.col("_path")))
            here = here.unionByName(j.select(*here.columns))
        down = here
    return down


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS,
                    carry: dict[str, Column] | None = None, fanout: int = FANOUT) -> Manifest:
    """Build the trees: one over the rows of each group in order of ``id_col``, one over the groups' tops in byte order of the group's name.

    A leaf is the digest of the row's ``fields``; every ``fanout`` consecutive nodes (the last run may be shorter, even one)
    become a node until one is left, so a lone leaf is its group's top. A null group is a group of its own and the first; a
    null id is the first of its group; rows with equal ids go by their digests, and equal rows are leaves of their own. Texts are hashed
    where they are read and go no further. ``carry`` adds columns computed from the same rows to the leaves; columns of the
    input that are not named stay out, so their names cannot clash. An empty table has no nodes.
    """
    g = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaves = docs.select(F.col(id_col).alias("id"), g.alias("g"), leaf_digest(*[F.col(f) for f in fields]).alias("digest"),
                         *[c.alias(f"c_{k}") for k, c in (carry or {}).items()])
    leaves = _ranked(leaves, ["id", "digest"])
    levels, tops = _grow(leaves, fanout)
    groups = _ranked(tops.select(F.lit(0).alias("g"), F.col("g").alias("name"), "digest"), ["name"])
    group_levels, _ = _grow(groups, fanout)
    return Manifest(leaves, levels, groups, group_levels, id_col, group_col, fanout)


def manifest_nodes(m: Manifest) -> DataFrame:
    """All nodes: ``group_col`` (null above the groups, and for the null group), ``tree`` (group or root), ``level``, ``lo``, ``hi``, ``digest``."""
    out = None
    for tree, tables in (("group", [m.leaves, *m.levels]), ("root", [m.groups, *m.group_levels])):
        name = F.when(F.col("g") != "", F.expr("substr(g, 2)")) if tree == "group" else F.lit(None).cast("string")
        for level, t in enumerate(tables):
            part = t.select(name.alias(m.group_col), F.lit(tree).alias("tree"), F.lit(level).alias("level"), "lo", "hi", "digest")
            out = part if out is None else out.unionByName(part)
    return out


def merkle_proofs(m: Manifest) -> DataFrame:
    """One row per leaf: ``id_col``, ``leaf``, ``subroot``, ``root``, ``path`` and the carried columns.

    ``path`` has an entry for every node from the leaf up to the root: the digests of its siblings before and after it, joined.
    """
    none = F.array().cast("array<struct<left:string,right:string>>")
    last = m.group_levels[-1] if m.group_levels else m.groups
    root = last.select("g", F.col("digest").alias("root"), none.alias("path"))
    groups = _attach(m.groups, m.group_levels, root, m.fanout)
    tops = groups.select(F.col("name").alias("g"), F.col("digest").alias("subroot"), "root", "path")
    p = _attach(m.leaves, m.levels, tops, m.fanout)
    carried = [F.col(c).alias(c[2:]) for c in m.leaves.columns if c.startswith("c_")]
    return p.select(F.col("id").alias(m.id_col), F.col("digest").alias("leaf"), "subroot", "root", "path", *carried)


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, s: digest(s.left, node, s.right))
