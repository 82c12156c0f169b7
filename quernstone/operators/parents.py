"""Parents and children that share a sheet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.casts import fresh


def split_parent(df: DataFrame, bold: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the bold columns that hold any of them, and rows of the others."""
    rest = [c for c in df.columns if c not in bold]
    keys = [c for c in ("file", "sheet", "row") if c in df.columns and c not in bold]
    return df.where(F.coalesce(*bold).isNotNull()).select(*keys, *bold), df.select(*rest)


def row_slice(df: DataFrame, low: int, high: int | None = None) -> DataFrame:
    return df.where(F.col("row") == low) if high is None else df.where(F.col("row").between(low, high))


def strict_backward_fill(value: Column, by: list[str], order: list) -> Column:
    """The last value that is not null on an earlier row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def parent_of(df: DataFrame, key: Column, by: list[str], order: list, name: str = "parent") -> DataFrame:
    """Attach the nearest parent key strictly above each row; null where a row has none (an orphan)."""
    return df.withColumn(name, strict_backward_fill(key, by, order))


def orphans(df: DataFrame, bold: list[str], rest: list[str], parent: str = "parent") -> DataFrame:
    """Violations for rows with cells of a child but no parent above them, in sheets that have parent columns."""
    from quernstone.operators.constraints import violations

    child = F.coalesce(*[F.col(f"`{c}`").cast("string") for c in rest]).isNotNull()
    lone = df.where(child & F.col(parent).isNull()) if bold else df.where("false")
    return violations(lone, "orphan row", file=F.col("file"), sheet=F.col("sheet"), row=F.col("row"))


def parent_of_ranged(df: DataFrame, key: str, by: list[str], order: str, width: int, name: str = "parent") -> DataFrame:
    """The same for sheets too large for one sort: ranges of ``width`` order values are filled on their own, and the last
    key before each range comes from a second pass over one row per range. ``order`` is a whole number column."""
    part, own, carry, end, *names = fresh(df.columns, "__range", "__own", "__carried", "__end", *[f"__by{k}" for k in range(len(by) + 1)])
    ranged = df.withColumn(part, F.floor(F.col(order) / width))
    inner = Window.partitionBy(*by, part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy(*by, part).agg(F.max_by(key, F.when(F.col(key).isNotNull(), F.col(order))).alias(end))
    outer = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn(carry, F.last(end, ignorenulls=True).over(outer)).select(carry, *[F.col(f"`{c}`").alias(n) for c, n in zip([*by, part], names, strict=True)])
    same = reduce(Column.__and__, [F.col(f"`{c}`").eqNullSafe(F.col(n)) for c, n in zip([*by, part], names, strict=True)])
    filled = ranged.withColumn(own, F.last(key, ignorenulls=True).over(inner)).join(carried, same)
    return filled.withColumn(name, F.coalesce(own, carry)).drop(own, carry, part, *names)
