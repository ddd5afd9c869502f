"""The numbered operators as queries over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.toxicity import fit_toxicity, held_out, score_toxicity

    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm import langid

    docs = documents(spark, sf_dir)
    sample = langid.training_sample(docs)
    found = langid.identify(docs.select("doc_id", "text"), langid.fit([r[0] for r in sample], [r[1] for r in sample]))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.mixing import mix_sources

    return mix_sources(documents(spark, sf_dir))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from orbitframe.llm.bpe import bpe_digest

    return bpe_digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.quality import fit_quality, score_quality

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score_quality(docs, fit_quality(docs)).select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).alias("kept"))


def op8_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.topk import top_inner_products

    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from orbitframe.llm.storage import Workspace
    from orbitframe.llm.tokenfile import token_digest

    return token_digest(documents(spark, sf_dir), f"{Workspace(spark, 'tokens').root}/shards", public_tokenizers.path("byte_bpe_50k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.rules import weak_quality

    return weak_quality(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.suffixdedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.neardup import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.fingerprint import compare_edits

    return compare_edits(documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.manifest import manifest

    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return manifest(documents(spark, sf_dir), altered=(tampered, {"text": F.translate("text", UPPER, UPPER.lower())}))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.llm.infilling import fill_in_middle, restored

    made = fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", digest(F.col("text")).alias("output_sha256"), digest(restored(F.col("text"), F.col("form"))).alias("restored_sha256"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


SQL = {
    # full sets of words, every pair of documents that share one, and the closure of the links
    "op2_near_duplicates": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as shingle from d),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b using (shingle) where a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as id, doc_id as c from d union select e.b, r.c from r join e on e.a = r.id where r.c < e.b),
m as (select id, min(c) as c from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id, m.c = d.doc_id as kept from d join m on m.id = d.doc_id left join n using (doc_id)
""",
    # every 50-byte string and the first document it starts in, runs of bytes that later ones cover, and what is left
    "op1_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, unnest(range(0, greatest(0, strlen(h) // 2 - 49))) as i, h from d),
g as (select doc_id, i, substr(h, (2 * i + 1)::bigint, 100) as g from w),
m as (select g, min(doc_id) as first from g group by 1),
c as (select doc_id, i from g join m using (g) where first < doc_id),
n as (select *, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as new from c),
k as (select *, sum(new) over (partition by doc_id order by i) as k from n),
r as (select doc_id, min(i) as a, max(i) + 50 as b from k group by doc_id, k),
x as (select doc_id, b as a, lead(a) over (partition by doc_id order by a, b) as b from (select doc_id, a, b from r union all select doc_id, 0, 0 from d)),
e as (select d.doc_id, string_agg(substr(h, (2 * a + 1)::bigint, (2 * (coalesce(b, strlen(h) // 2) - a))::bigint), '' order by a) as kept from x join d using (doc_id) group by 1)
select d.doc_id, strlen(h) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(kept)) as kept_sha256
from d join e using (doc_id) left join (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from r group by 1) s using (doc_id)
""",
    "op8_top_inner_products": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
""",
}


def _fingerprint_sql() -> str:
    """Fingerprints by md5 keys of words and whole sums of factors; the text that follows by doc_id."""
    from orbitframe.llm.fingerprint import FACTORS, LEAST, LIMIT, SIZE

    terms = " + ".join(f"coalesce(cast(k[i + {j}] as hugeint), 0) * {FACTORS[j + 1]}::hugeint" for j in range(SIZE))
    return rf"""
with d as (select doc_id, coalesce(text, '') as t, lead(coalesce(text, '')) over (order by doc_id) as following, first_value(coalesce(text, '')) over (order by doc_id) as begun from documents),
e as (select doc_id, t, coalesce(following, begun) as next, length(t) // 4 as k from d),
b as (select doc_id, t, next, length(t) as n_chars, left(t, (length(t) - k)::bigint) || left(next, k::bigint) as edited from e),
x as (select doc_id, 1 as role, t as v from b union all select doc_id, 2, edited from b union all select doc_id, 3, next from b),
w as (select doc_id, role, list_transform(regexp_extract_all(translate(v, '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+'), lambda s: ('0x' || substr(md5(s), 1, 12))::ubigint) as k from x),
h as (select distinct doc_id, role, unnest(list_transform(range(1, case when len(k) = 0 then 1 when len(k) < {SIZE} then 2 else len(k) - {SIZE - 2} end), lambda i: ({FACTORS[0]}::hugeint + {terms}) % 18446744073709551616::hugeint)) as h from w),
r as (select *, row_number() over (partition by doc_id, role order by h) as place from h),
f as (select * from r where h < {LIMIT}::hugeint or place <= {LEAST}),
g as (select doc_id, role, case when count(*) < {LEAST} then 18446744073709551615::hugeint else greatest({LIMIT - 1}::hugeint, max(h)) end as bound, string_agg(lpad(lower(hex(h::ubigint)), 16, '0'), '' order by h) as fp from f group by 1, 2),
p as (select a.doc_id, o.role, least(a.bound, o.bound) as bound from g a join g o on o.doc_id = a.doc_id and a.role = 1 and o.role > 1),
n as (select p.doc_id, p.role, count(*) as n, count(y.h) as common from p join f x on x.doc_id = p.doc_id and x.role = 1 and x.h <= p.bound left join f y on y.doc_id = p.doc_id and y.role = p.role and y.h = x.h group by 1, 2),
s as (select a.doc_id, q.role, case when a.fp is null then (case when o.fp is null then 1.0 else 0.0 end) else coalesce(n.common::double / n.n, 0.0) end as near
  from (select doc_id, fp from b left join (select * from g where role = 1) using (doc_id)) a cross join (select unnest([2, 3]) as role) q
  left join g o on o.doc_id = a.doc_id and o.role = q.role left join n on n.doc_id = a.doc_id and n.role = q.role)
select b.doc_id, b.n_chars, sha256(b.edited) as edited_sha256, coalesce(g1.fp, '') as fingerprint, coalesce(g2.fp, '') as edited_fingerprint, s2.near as near_edited, s3.near as near_next
from b left join g g1 on g1.doc_id = b.doc_id and g1.role = 1 left join g g2 on g2.doc_id = b.doc_id and g2.role = 2 join s s2 on s2.doc_id = b.doc_id and s2.role = 2 join s s3 on s3.doc_id = b.doc_id and s3.role = 3
"""


def _manifest_sql(levels: int = 7) -> str:
    """Trees level by level, up to ``levels`` of them: a tree with one node is through."""
    field = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id::varchar", "source", "lang", "n_chars::varchar", text))) + ")"
    bits = "list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), xor(a, b))"
    crc = f"xor(4294967295, list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda s: ascii(s)::bigint), lambda a, b: {bits}, 4294967295::bigint))"

    def tree(name: str, nodes: str) -> str:
        """Tables name0 ... of (tree, pos, v, n) and, of every level, name_s0 ... of (tree, pos, before, after)."""
        out = [f"{name}0 as (select tree, pos, v, count(*) over (partition by tree) as n from ({nodes}))"]
        for k in range(levels):
            out.append(f"{name}_s{k} as (select tree, pos, coalesce(string_agg(v, '') over (partition by tree, pos // 8 order by pos rows between unbounded preceding and 1 preceding), '') as before, coalesce(string_agg(v, '') over (partition by tree, pos // 8 order by pos rows between 1 following and unbounded following), '') as after, n > 1 as going from {name}{k})")
            out.append(f"{name}{k + 1} as (select tree, pos // 8 as pos, case when max(n) > 1 then sha256(string_agg(v, '' order by pos)) else any_value(v) end as v, any_value((n + 7) // 8) as n from {name}{k} group by 1, 2)")
        return ",\n".join(out)

    steps, joins, fold, proof = [], [], "l.changed", []
    for name, at, on in (("a", "l.pos", "l.tree"), ("r", "l.tree", "0")):
        for k in range(levels):
            s = f"{name}_s{k}"
            joins.append(f"join {s} on {s}.tree = {on} and {s}.pos = {at} // {8**k}")
            proof.append(f"{s}.before || {s}.after")
            steps.append(s)
    chain, last = [], "select doc_id, l.tree, l.pos, leaf, changed as v0, " + " || ".join(proof) + " as proof, " + ", ".join(f"{s}.before as b{i}, {s}.after as a{i}, {s}.going as g{i}" for i, s in enumerate(steps)) + " from l " + " ".join(joins)
    chain.append(f"m0 as ({last})")
    for i in range(len(steps)):
        chain.append(f"m{i + 1} as (select * exclude (v0), case when g{i} then sha256(b{i} || v0 || a{i}) else v0 end as v0 from m{i})")
    return f"""
with x as (select *, {leaf('text')} as leaf, case when {crc} % 3 = 0 then {leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} else {leaf('text')} end as changed from documents),
l as (select doc_id, leaf, changed, dense_rank() over (order by lang nulls first) - 1 as tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from x),
{tree('a', 'select tree, pos, leaf as v from l')},
{tree('r', f'select 0 as tree, tree as pos, v from a{levels}')},
{", ".join(chain)}
select m.doc_id, m.leaf, a{levels}.v as subroot, r{levels}.v as root, sha256(m.proof) as proof_sha256, m.v0 as folded_root, m.v0 = r{levels}.v as verified
from m{len(steps)} m join a{levels} on a{levels}.tree = m.tree cross join r{levels}
"""


_FIM_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as s from documents),
h as (select *, len(u) as n, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(s, k, 8))::bigint) as h from d),
c as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) as p, greatest(h[1] % (n + 1), h[2] % (n + 1)) as q, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form from h),
x as (select *, array_to_string(u[1:p], '') as prefix, array_to_string(u[p + 1:q], '') as middle, array_to_string(u[q + 1:], '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(t) as restored_sha256
from x
"""


def oracle_sql() -> dict[str, str]:
    return SQL | {"op11_fingerprint": _fingerprint_sql(), "op12_merkle_manifest": _manifest_sql(), "op13_fill_in_middle": _FIM_SQL}
