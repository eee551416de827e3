"""Registered queries of the corpus operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulite.llm.common import read_table
from granulite.operators.lineage import shared_folder

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shingle_sql(table: str, key: str) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+')"
    runs = "case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end"
    return f"select distinct {key}, unnest({runs}) as sh from (select {key}, {words} as w from {table})"


@query("op2_embedding_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    from granulite.llm.embedding_dedup import embedding_dedup
    return embedding_dedup(read_table(spark, sf, "embeddings"))


_HEX20 = "cast(concat('0x', substr(h, {0}, 5)) as integer)"
_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({_HEX20.format(1 + 5 * i)} >> {s}) & 31), 1)" for i in range(8) for s in (15, 10, 5, 0))


@query("op1_warc", f"""
with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as first from p group by h)
select page_id, cast(strlen(body) as bigint) as payload_bytes, {_B32} as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to
from p join f using (h)""")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    from granulite.llm.warc import read_warc, write_warc
    path = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(read_table(spark, sf, "pages"), path)
    r = read_warc(spark, path)
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^<urn:page:(-?[0-9]*)>$', 1), '') as bigint)")
    revisit = F.col("type") == "revisit"
    return r.select(number("record_id").alias("page_id"), F.when(revisit, F.col("http_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
                    F.when(revisit, F.regexp_replace("declared_digest", "^sha1:", "")).otherwise(F.col("payload_sha1")).alias("payload_digest"),
                    F.col("type").alias("record_type"), F.when(revisit, number("refers_to")).alias("refers_to"))


@query("op5_token_counts")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers
    from granulite.llm.token_counts import token_counts
    return token_counts(read_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_bpe_automaton")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers
    from granulite.llm.bpe_automaton import bpe_encode
    return bpe_encode(read_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, ids=False)


@query("op4_minhash_dedup", f"""
with recursive s as ({_shingle_sql('documents', 'doc_id')}),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.y from r join e on r.b = e.x)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from (select a as doc_id, min(b) as component_id from r group by a) left join n using (doc_id)""")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    from granulite.llm.minhash_dedup import minhash_dedup
    return minhash_dedup(read_table(spark, sf, "documents"))


@query("op3_decontaminate", f"""
with d as ({_shingle_sql('documents', 'doc_id')}), b as ({_shingle_sql('benchmark', 'item_id')}),
n as (select item_id, count(*) as n_item from b group by item_id),
s as (select doc_id, item_id, count(*) as n_shared from d join b using (sh) group by doc_id, item_id)
select doc_id, item_id, n_item, n_shared, n_shared / n_item as containment from s join n using (item_id) where 100 * n_shared >= 80 * n_item""")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    from granulite.llm.decontaminate import contamination
    return contamination(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


@query("op10_toxicity")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    from granulite.llm.toxicity import score, train
    docs = read_table(spark, sf, "documents")
    return score(docs, train(docs, read_table(spark, sf, "labels")))


@query("op7_secrets")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    from granulite.llm.secrets import joined, secret_spans
    s = secret_spans(read_table(spark, sf, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x.kind != "live")
    return s.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op8_line_dedup")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    from granulite.llm.line_dedup import line_dedup
    d = line_dedup(read_table(spark, sf, "documents"))
    return d.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op6_substring_dedup")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    from granulite.llm.substring_dedup import substring_dedup
    return substring_dedup(read_table(spark, sf, "documents"), text=False)


@query("op11_collocations", f"""
with d as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from d),
t as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
g as ({" union all ".join(f"select lang, {k} as k, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) as phrase from w where len(w) >= {k}" for k in range(1, 5))}),
f as (select lang, k, phrase, string_split(phrase, ' ') as w, count(*) as f from g group by all having count(*) >= 30),
c as (select * from f where k > 1),
inside as (select distinct s.lang, s.phrase from c s join c o on s.lang = o.lang and o.k > s.k and contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' ') and 100 * o.f >= 80 * s.f),
cut as (select c.lang, c.phrase, c.f as a, unnest(range(1, c.k)) as i, w from c anti join inside using (lang, phrase)),
s as (select cut.*, x.f as l, y.f as r, cast((2000000::hugeint * a) // (x.f + y.f) as bigint) as score from cut
  join f x on x.lang = cut.lang and x.phrase = array_to_string(cut.w[1:i], ' ') join f y on y.lang = cut.lang and y.phrase = array_to_string(cut.w[i + 1:], ' ')),
b as (select lang, phrase, a, unnest(arg_min(struct_pack(l := l, r := r, score := score), score * 10 + i)) from s group by lang, phrase, a),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b)
select lang, rank, phrase, a, l, r, n, score from o join t using (lang) where rank <= 2000""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    from granulite.llm.collocations import collocations
    return collocations(read_table(spark, sf, "documents"))


@query("op12_fingerprints")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    from granulite.llm.fingerprints import document_fingerprints
    return document_fingerprints(read_table(spark, sf, "documents"))


def _merkle_sql(levels: int = 6, upper: int = 4) -> str:
    """Trees of up to 16 to the power of ``levels`` leaves, with one pair of steps written out per level."""
    ctes = ["""d as (select doc_id, source, lang, n_chars, text, list_reduce(flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: [ascii(ch), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda c, x: case when x >= 0 then xor(c, x) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, 4294967295) as crc from documents)"""]
    field = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    ctes.append(f"""l as (select *, row_number() over (partition by g order by doc_id nulls first, digest) - 1 as r, count(*) over (partition by g) as n from (
  select doc_id, coalesce('=' || source, '') as g, {leaf("text")} as digest, case when xor(crc, 4294967295) % 5 = 0 then {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} end as seen from d))""")

    def tree(name: str, leaves: str, height: int) -> None:
        """Tables name_i (g, r, n, digest) and runs name_r_i (g, b, run) of their digests."""
        ctes.append(f"{name}_0 as (select g, r, n, digest from {leaves})")
        for i in range(height):
            ctes.append(f"{name}_r_{i} as (select g, r // 16 as b, first(n) as n, list(digest order by r) as run from {name}_{i} where n > {16 ** i} group by all)")
            ctes.append(f"{name}_{i + 1} as (select g, b as r, n, sha256(array_to_string(run, '')) as digest from {name}_r_{i})")
        tops = " union all ".join(f"select g, digest from {name}_{i} where n <= {16 ** i} and n > {16 ** (i - 1) if i else 0}" for i in range(height + 1))
        ctes.append(f"{name}_top as ({tops})")

    def climb(start: str, name: str, tag: str, height: int) -> str:
        """Follow proof and folded digest of the rows of ``start`` (with r, g, cur, proof) up the levels of a tree."""
        last = start
        for i in range(height):
            left, right = f"array_to_string(run[1:(r // {16 ** i}) % 16], '')", f"array_to_string(run[(r // {16 ** i}) % 16 + 2:], '')"
            ctes.append(f"""{tag}_{i} as (select p.* replace (case when run is null then cur else sha256({left} || cur || {right}) end as cur, proof || coalesce({left} || {right}, '') as proof)
  from {last} p left join {name}_r_{i} t on p.g = t.g and r // {16 ** (i + 1)} = t.b)""")
            last = f"{tag}_{i}"
        return last

    tree("s", "l", levels)
    ctes.append("u as (select 0 as g, g as name, digest, row_number() over (order by g) - 1 as r, count(*) over () as n from s_top)")
    tree("u", "u", upper)
    ctes.append("w as (select doc_id, digest as leaf, g, r, coalesce(seen, digest) as cur, '' as proof from l)")
    inner = climb("w", "s", "c", levels)
    ctes.append(f"v as (select doc_id, leaf, u.digest as subroot, u.g, u.r, cur, proof from {inner} p join u on p.g = u.name)")
    outer = climb("v", "u", "e", upper)
    return "with " + ",\n".join(ctes) + f"""
select doc_id, leaf, subroot, t.digest as root, sha256(proof) as proof_sha256, cur as folded_root, cur = t.digest as verified from {outer}, u_top t"""


@query("op13_merkle_manifest", _merkle_sql())
def op13(spark: SparkSession, sf: str) -> DataFrame:
    from granulite.llm.merkle import FIELDS, fold, leaf_digest, merkle_manifest, merkle_proofs, proof_digest
    docs = read_table(spark, sf, "documents")
    later = leaf_digest(*[F.translate("text", _UPPER, _LOWER) if f == "text" else F.col(f) for f in FIELDS])
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    p = merkle_proofs(merkle_manifest(docs, carry={"seen": F.when(tampered, later)}))
    p = p.withColumn("folded_root", fold(F.coalesce("seen", "leaf"), F.col("path")))
    return p.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified"))


@query("pipeline")
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    from corpus_pipeline import run
    return run(spark, sf)
