"""Corpus cleaning pipeline: language, exact copies, near copies, secrets, packing.

Every stage but the last gives rows of its input with the columns of its input, whatever those are named. A null text
counts as empty. Documents with a null identifier take part like others. An empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import exact_dedup, language, packing, secrets, simhash
from quernstone.llm.common import cut, in_fold, table, without
from quernstone.llm.queries import vocabulary
from quernstone.operators.checkpoints import shared_folder


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus; those without a letter and those that hang between two languages go.

    Repeated rows are judged one by one, so they stay or go together.
    """
    model = language.train(docs.where("doc_id is not null").where(~in_fold("doc_id", 4, 2)), "text", "lang")
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), language.identify(model, F.col("text")).alias("found"))
    return found.where((F.col("found.lang") != language.UNDETERMINED) & ~F.col("found.ambiguous")).select("doc.*")


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of rows that repeat it, one."""
    return exact_dedup.exact_dedup(docs, "doc_id", "text", keep_largest=True)


def distinct_fingerprints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document with the smallest doc_id (null last); of rows that repeat its id and text, one."""
    found = simhash.near_dedup(docs, "doc_id", "text", size=4, distance=4)
    texts = cut(found.groupBy("root", "id", "hash").agg(F.count("*").alias("n")))
    rank = F.struct(F.isnull("id").alias("none"), "id", "hash")
    first = cut(texts.groupBy("root").agg(F.min(rank).alias("first")))
    judged = texts.join(first, "root").withColumn("stays", rank == F.col("first"))
    return without(docs, "doc_id", "text", judged.where("not stays"), judged.where("stays and n > 1"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which neither a pattern nor the entropy of a window points to a secret; repeated rows stay or go together."""
    return secrets.without_secrets(docs, "doc_id", "text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of the documents in sequences of 1024 tokens; repeated rows are packed each."""
    return packing.pack_documents(docs, "doc_id", "text", vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024, ranks_path=vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", identified),
    ("exact_dedup", distinct_texts),
    ("simhash_near_dedup", distinct_fingerprints),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: No stage but the second can be written in SQL; tests/llm holds run() against plain Python versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again.

    A stage's folder is removed when its successor is written; the last one's stays, as the result reads it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs
