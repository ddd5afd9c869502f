"""A corpus pipeline of numbered operators: each stage is written as Parquet and read again by the next one.

Toxic documents go, one document of each near-duplicate group stays, repeated passages are cut from the texts that
remain, sources are brought to their target weights by whole copies, and the mix is encoded to token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm.bpe import encode_documents
from orbitframe.llm.mixing import mix_sources
from orbitframe.llm.neardup import near_duplicates
from orbitframe.llm.storage import Workspace
from orbitframe.llm.suffixdedup import remove_repeats
from orbitframe.llm.toxicity import fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the network learns from the labelled ones among them."""
    scored = score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.where("toxicity_score < 0.5").drop("toxicity_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id.

    Documents without words stay. Rows count by themselves: those that share an id, or have none, are numbered behind
    all ids (below 2 ** 62), so equal rows leave one and different texts of one id don't go for each other.
    """
    number = F.monotonically_increasing_id()
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("key"))
    shared = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").cast("long").alias("key"), F.lit(True).alias("shared"))
    if shared.take(1):
        met = rows.join(shared, rows.key.eqNullSafe(shared.key), "left").select("doc", F.when(F.col("shared"), number + 2**62).otherwise(rows.key).alias("key"))
        rows = Workspace(spark, "rows").save(met, "keyed")
    gone = near_duplicates(rows.select("key", "doc.text"), id_col="key").where("not kept").select(F.col("doc_id").alias("key"))
    return rows.join(gone, "key", "left_anti").select("doc.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings that one with a smaller id has; characters cut in two go whole."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = remove_repeats(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("rest")), keep=("rest",), characters=True)
    raw = F.col("kept").cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.make_valid_utf8(raw))  # bytes that were invalid before
    kept = cut.select("doc_id", text.alias("text"), *(F.col("rest")[c].alias(c) for c in rest))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows are numbered in a written table first, since ids may be null or repeated."""
    rows = Workspace(spark, "mix").save(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    copies = mix_sources(rows.select("row", "doc.doc_id", "doc.text", "doc.source"), keep=("row",)).where("copies > 0").select("row", "copies")
    return rows.join(copies, "row").select(F.explode(F.array_repeat("doc", F.col("copies").cast("int"))).alias("doc")).select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and digests of the ids and of what they decode to."""
    import public_tokenizers

    how = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = encode_documents(docs, *how, decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("suffix_dedup", cut_repeats), ("mixing", mix), ("byte_bpe", encode)]
#: Sketches, trained networks and vocabularies have no SQL; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = work.save(stage(spark, docs, sf_dir), name)
        if k:
            work.drop(STAGES[k - 1][0])  # the next table no longer needs it
    return STAGES[-1][1](spark, docs, sf_dir)
