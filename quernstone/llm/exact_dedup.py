"""Exact duplicates by content sort, on DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import body, cut


def _hot_texts(rows: DataFrame, share: int, least: int, keep_largest: bool) -> DataFrame:
    """(hash, parts, hot_keep, hot_salt, hot_size) of texts that hold over 1/``share`` of all rows or of all bytes.

    There are at most 2 * ``share`` of them. ``parts`` is the number of salts that a text is dealt over. Whole texts are
    compared; a hash that two frequent texts share is left out and sorted like any other.
    """
    sizes = rows.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    most_rows, most_bytes = max(least - 1, sizes["n"] // share), max(1, (sizes["bytes"] or 0) // share)
    counts = rows.groupBy("hash").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where(F.col("n") >= least)
    parts = F.greatest(F.ceil(F.col("n") / max(most_rows, 1)), F.ceil(F.col("bytes") / most_bytes)).cast("int")
    hot = cut(counts.select("hash", parts.alias("parts")).where("parts > 1"))
    salted = rows.join(F.broadcast(hot), "hash").withColumn("salt", F.pmod("mark", "parts"))
    best = F.max(F.struct("id", "salt")) if keep_largest else F.min(F.struct(F.isnull("id").alias("none"), "id", "salt"))
    texts = salted.groupBy("hash", "body").agg(best.alias("best"), F.count("*").alias("n"), F.first("parts").alias("parts"))
    texts = texts.groupBy("hash").agg(F.count("*").alias("texts"), *[F.first(c).alias(c) for c in ("best", "n", "parts")]).where("texts = 1")
    return cut(texts.select("hash", "parts", F.col("best.id").alias("hot_keep"), F.col("best.salt").alias("hot_salt"), F.col("n").alias("hot_size")))


def content_sort(docs: DataFrame, id_col: str, text_col: str, keep_largest: bool = False, hot_share: int = 100_000, hot_least: int = 64) -> DataFrame:
    """(doc, keep_id, group_size, kept, text_sha256) for every row; ``doc`` is a struct of all columns of ``docs``.

    Texts are range-partitioned by sampled splitters over their first characters and a hash of the whole (a routing
    key of bounded size), sorted within partitions, and compared in full with their neighbours. Of equal texts the row
    with the smallest identifier stays (``keep_largest``: the largest); null identifiers come last, and of rows with
    equal identifiers one stays. A null text is empty; an empty table gives no rows.

    Copies of a text that holds over 1/``hot_share`` of the rows or bytes would fill one sort partition. They carry a
    salt, taken from their own columns, into the routing key, so they are sorted and compared in several partitions;
    what a salt can't know, the winner and the size of the whole group, comes from a pre-aggregated comparison of at
    most 2 * ``hot_share`` rows of fixed size, which are broadcast. Rows are told apart by what they hold, never by
    position, so the input may come in another order each time it is read, as after a shuffle.
    """
    # a string travels once, as the sort's own body; what is not one is kept as it came beside its body
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    plain = kinds[text_col] == "string"
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if not (plain and c == text_col)])
    own = lambda c: F.when(~F.col("void"), F.col("body")) if plain and c == text_col else F.col("rest").getField(c)
    doc = F.struct(*[own(c).alias(c) for c in docs.columns]).alias("doc")
    # what can be hashed of a row; rows that agree in all of it may stand for one another
    mark = F.xxhash64(F.col(f"`{id_col}`"), *[F.col(f"`{c}`") for c, kind in kinds.items() if c != text_col and not any(x in kind for x in ("map<", "variant"))])
    text = body(text_col)
    rows = docs.select(rest.alias("rest"), F.isnull(f"`{text_col}`").alias("void"), F.col(f"`{id_col}`").alias("id"), mark.alias("mark"), text.alias("body"), F.xxhash64(text).alias("hash"), F.octet_length(text).cast("long").alias("bytes"))
    hot = _hot_texts(rows.select("id", "mark", "body", "hash", "bytes"), hot_share, hot_least, keep_largest)

    dealt = rows.drop("bytes").join(F.broadcast(hot), "hash", "left")
    dealt = dealt.withColumn("salt", F.coalesce(F.pmod("mark", "parts"), F.lit(0))).withColumn("front", F.substring("body", 1, 32)).drop("parts")
    dealt = dealt.repartitionByRange("front", "hash", "salt")
    equal = Window.partitionBy("front", "hash", "salt", "body")
    ordered = equal.orderBy(F.desc_nulls_last("id") if keep_largest else F.asc_nulls_last("id"), "mark")
    frequent = F.col("hot_size").isNotNull()
    found = dealt.select(
        "rest", "void", "body", "hot_keep", "hot_size", F.first("id").over(ordered).alias("own_keep"), F.count("*").over(equal).alias("own_size"),
        ((F.row_number().over(ordered) == 1) & (~frequent | (F.col("salt") == F.col("hot_salt")))).alias("kept"),
    )
    keep = F.when(frequent, F.col("hot_keep")).otherwise(F.col("own_keep"))
    return found.select(doc, keep.alias("keep_id"), F.coalesce("hot_size", "own_size").alias("group_size"), "kept", F.sha2("body", 256).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    return content_sort(docs, id_col, text_col, **how).where("kept").select("doc.*")
