"""Constants that cells name, joined to the rows that name them instead of standing in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.casts import HELD, fresh
from quernstone.functions.cells import CONST
from quernstone.operators.checkpoints import cut

#: What may be sent to every task: rows, and bytes of texts.
_FEW, _SMALL = 100_000, 1 << 25
_TOKEN = CONST.strip("^$")


def named(columns: list[Column]) -> Column:
    """The distinct ``Const:T:N`` in some texts, in order; an empty array where there are none."""
    none = F.array().cast("array<string>")
    found = [F.coalesce(F.when(F.contains(c, F.lit("Const:")), F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0))), none) for c in columns]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found)))) if found else none


def hold(df: DataFrame, columns: list[Column], texts: DataFrame, name: str) -> DataFrame:
    """``df`` with a column ``name``: token -> (text, kind) of the constants that the texts of a row name, null for none.

    ``texts`` (token, text, kind) has one row per constant. Each distinct set of tokens is joined to them once and then to
    its rows, by broadcast where both its count and its bytes are small. Beyond that rows without tokens are spread over
    keys that match nothing, so they don't meet in one task. Tokens that are no constants have no entry.
    """
    own, key = fresh([*df.columns, name], "__tokens", "__key")
    sets = df.select(named(columns).alias("tokens")).where("size(tokens) > 0").distinct()
    entry = F.struct("token", F.struct("text", "kind"))
    found = sets.select("tokens", F.explode("tokens").alias("token")).join(texts, "token").groupBy("tokens").agg(F.map_from_entries(F.collect_list(entry)).cast(HELD).alias(name))
    found = cut(found.select(F.array_join("tokens", "\n").alias(key), name))
    weight = F.aggregate(F.map_values(name), F.lit(0).cast("long"), lambda n, v: n + F.octet_length(v["text"]) + 64)
    n, size = found.agg(F.count("*"), F.coalesce(F.sum(weight + F.octet_length(key)), F.lit(0))).first()
    if not n:
        return df.withColumn(name, F.lit(None).cast(HELD))
    kept = [F.col(f"`{c}`") for c in df.columns]
    made = df.select(*kept, named(columns).alias(own))
    if n <= _FEW and size <= _SMALL:
        at, found = F.when(F.size(own) > 0, F.array_join(own, "\n")), F.broadcast(found)
    else:
        # no token begins with a point
        at = F.when(F.size(own) > 0, F.array_join(own, "\n")).otherwise(F.concat(F.lit("."), F.pmod(F.xxhash64(*columns), F.lit(1 << 14)).cast("string")))
    return made.withColumn(own, at).join(found, F.col(own) == F.col(key), "left").select(*kept, name)
