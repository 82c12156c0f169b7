"""The registered queries of the corpus operators: whole tables in, the contract's columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import bpe, exact_dedup, language, language_model, licenses, merkle, packing, prefix_trie, secrets, simhash, token_counts, toxicity, vectors
from quernstone.llm.common import in_fold, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024, ranks_path=vocabulary("byte_bpe_50k.tiktoken"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.summary(licenses.scan(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.withColumnRenamed("id", "doc_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~in_fold("doc_id", 5, 0)), "doc_id", "text", "toxic")
    scored = docs.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), toxicity.toxicity(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary("word_bpe_49k.json"), digests=True)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", threshold=0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.expr("id <=> component_id").alias("kept"), "recall")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dedup(table(spark, sf_dir, "documents"), "doc_id", "text", size=4, distance=4)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where("doc_id is not null").where(~in_fold("doc_id", 4, 2)), "text", "lang")
    found = docs.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), language.identify(model, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.ambiguous")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.content_sort(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", keep_largest=True)
    return found.select("doc.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.summary(secrets.spans(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.withColumnRenamed("id", "doc_id").drop("row")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = table(spark, sf_dir, "documents"), F.col("text")
    found = merkle.manifest(docs, "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], "lang", in_fold("doc_id", 3, 0), {"text": merkle.ascii_lower(text)})
    return found.drop("copied")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.regrown(prefix_trie.turns(table(spark, sf_dir, "conversations")), family=5, shared=9))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_model.train(docs.where(~in_fold("doc_id", 7, 2)), "text", order=2)
    scored = language_model.score(model, docs, "doc_id", "text")
    return scored.select("doc_id", in_fold("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_token_counts, op3_license_scan, op4_toxicity, op5_bpe, op6_embedding_near_dedup, op7_simhash_near_dedup, op8_language_id, op9_exact_dedup, op10_secret_scan, op11_merkle_manifest, op12_prefix_trie, op13_lm_scoring)}

#: The others are held against brute-force versions in tests/llm: fitted models, library tokenizers, 64-bit XXH64, label sets of their own.
ORACLE_SQL = {
    "op9_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept,
               sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))
    """,
}
