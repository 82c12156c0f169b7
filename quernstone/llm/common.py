"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.checkpoints import cut


def body(text_col: str):
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def in_fold(id_col: str, folds: int, fold: int):
    """True where crc32 of the identifier's text, modulo ``folds``, is ``fold``; false for a null identifier."""
    digest = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    return F.coalesce(digest % folds == fold, F.lit(False))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is the smallest node reachable.

    Alternating large-star and small-star steps: each hangs a node's neighbours on the smallest of them, so the edge
    set turns into stars in a logarithmic number of rounds. Every step is a pre-aggregated minimum and an equi-join
    (AQE splits a hub's rows); each round is cut by a checkpoint. Self-loops and repeated edges are allowed.
    """
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    stars = cut(edges.where("a <> b").select(high, low).distinct())
    seen = None
    for _ in range(rounds):
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        stars = cut(hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct())
        now = stars.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if now == seen:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def without(docs: DataFrame, id_col: str, text_col: str, gone: DataFrame, once: DataFrame | None = None, most: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` whose (identifier, XXH64 of the text) is not in ``gone`` (id, hash), with their own columns.

    Of rows that are named in ``once`` (id, hash) one each stays. A saved list of up to ``most`` rows of fixed size (about
    50 MB) is broadcast, so no text moves; a longer one is joined by a shuffle. The columns of ``docs`` travel inside one
    struct, so none can clash with the list's.
    """
    listed = gone.select("id", "hash", F.lit(True).alias("gone"))
    if once is not None:
        listed = listed.union(once.select("id", "hash", F.lit(False)))
    listed = cut(listed.groupBy(F.col("id").alias("gone_id"), F.col("hash").alias("gone_hash")).agg(F.max("gone").alias("gone")))
    held = {r["gone"]: r["count"] for r in listed.groupBy("gone").count().collect()}
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").alias("own_id"), F.xxhash64(body(text_col)).alias("own_hash"))
    same = F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_hash") == F.col("gone_hash"))
    joined = own.join(F.broadcast(listed) if sum(held.values()) <= most else listed, same, "left")
    stay = joined.where("gone is null").select("doc.*")
    if held.get(False):
        stay = stay.union(joined.where("not gone").groupBy("own_id", "own_hash").agg(F.first("doc").alias("doc")).select("doc.*"))
    return stay


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
