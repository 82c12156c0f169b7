"""Places where a user's functions join in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build(df: DataFrame, make: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Rows as the user makes them, or as they are."""
    return df if make is None else df.transform(make)


def built(df: DataFrame, seen: Callable) -> None:
    """Call ``seen`` with every row, for its side effects on the executors."""
    df.foreachPartition(lambda rows: [seen(r) for r in rows] and None)


def decoding(df: DataFrame, decode: Callable[[Column], Column]) -> DataFrame:
    """Apply a column function to every string column."""
    return df.select(*[decode(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])


def call_view(calls: DataFrame, header: str, params: list[tuple[str, str]]) -> DataFrame:
    """Bound calls of one header as typed columns (name, SQL type)."""
    fields = [F.get("bound", F.lit(k)).try_cast(kind).alias(name) for k, (name, kind) in enumerate(params)]
    # a plain filter would be pushed below the steps that parse the calls and repeat them all for each row
    own = F.when(F.col("Type") == header, F.array(F.struct(*fields)))
    return calls.select("*", F.explode_outer(own).alias("typed")).where("typed is not null")


def to_call(header: str, values: list[Column]) -> Column:
    """The text of a call."""
    return F.concat(F.lit(header + "("), F.concat_ws(", ", *[v.cast("string") for v in values]), F.lit(")"))
