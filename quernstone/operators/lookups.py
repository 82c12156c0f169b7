"""Joins against references, constants, enums, call prototypes and containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.casts import cast_columns, fold_tokens, fresh, to_enum
from quernstone.functions.cells import const_parts
from quernstone.operators.chains import CYCLE, UNKNOWN, chain_ends
from quernstone.operators.checkpoints import cut


def resolve_const(values: DataFrame, column: str, consts: DataFrame) -> DataFrame:
    """Replace ``Const:Table:Name`` by the text that the constant ends in, however many others it goes through.

    ``consts`` (table, name, value) has one row per constant. Adds ``<column>_error``: unknown table, unknown constant, or
    a chain that never ends; then the text that could not be resolved stays. The chains are followed once per constant,
    so the values take part in a single join.
    """
    named = lambda text: F.when(const_parts(text).isNotNull(), const_parts(text))
    own = F.struct("table", "name")
    ends = chain_ends(consts.select(own.alias("node"), named(F.col("value")).alias("target")))
    texts = consts.select(own.alias("end"), "value")
    tables = consts.select("table").distinct()
    known = tables.withColumn("known", F.lit(True))
    made = ends.join(texts, "end", "left").withColumn("next", const_parts(F.col("value")))
    made = made.join(known.withColumnRenamed("table", "next_table"), F.col("next.table") == F.col("next_table"), "left")
    error = F.when(F.col("fault") == CYCLE, F.lit("endless const")).when(F.col("fault") == UNKNOWN, F.when(F.col("known"), F.lit("unknown const")).otherwise(F.lit("unknown const table")))
    resolved = made.select(F.struct("node", "value", error.alias("error")).alias("hit"))
    cells = values.select(F.struct(*[F.col(f"`{c}`") for c in values.columns]).alias("row"), const_parts(F.col(f"`{column}`")).alias("part"))
    found = cells.join(resolved, F.col("part") == F.col("hit.node"), "left").join(known.select(F.col("table").alias("in_table"), "known"), F.col("part.table") == F.col("in_table"), "left")
    missing = F.when(F.col("part").isNotNull() & F.col("hit").isNull(), F.when(F.col("known"), F.lit("unknown const")).otherwise(F.lit("unknown const table")))
    text = F.when(F.col("hit").isNotNull() & ~F.coalesce(F.col("hit.error") == "endless const", F.lit(False)), F.col("hit.value")).otherwise(F.col("row").getField(column))
    kept = [text.alias(c) if c == column else F.col("row").getField(c).alias(c) for c in values.columns]
    return found.select(*kept, F.coalesce("hit.error", missing).alias(f"{column}_error"))


def fk_check(values: DataFrame, column: str, reference: DataFrame, ref_column: str) -> DataFrame:
    """Rows whose value is not among the references; null is no reference. Repeats are settled before the join."""
    (ref,) = fresh(values.columns, "__ref")
    keys = distinct_refs(reference, ref_column).withColumnRenamed(ref_column, ref)
    return values.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col(ref), "left_anti")


def distinct_refs(table: DataFrame, column: str) -> DataFrame:
    return table.select(column).distinct()


def unknown_tokens(values: DataFrame, column: str, members: DataFrame) -> DataFrame:
    """Tokens of an array column that are no members."""
    return values.withColumn("token", F.explode(column)).join(members.select(F.col("member").alias("token")), "token", "left_anti")


def call_catalog(prototypes: DataFrame) -> DataFrame:
    """(header, params, defaults, needed) with params [(pos, name, type, has_default, default)] in order, from rows (header, pos, ...)."""
    param = F.struct("pos", "name", "type", "has_default", "default")
    made = prototypes.groupBy("header").agg(F.array_sort(F.collect_list(param)).alias("params"), F.count(F.when(~F.col("has_default"), 1)).alias("needed"))
    return made.select("header", "params", F.col("params.default").alias("defaults"), "needed")


def bind_calls(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Match ``Type`` and ``Parameters`` to prototypes: (.., bound [text per parameter, defaults filled], error)."""
    made = catalog.select(F.struct(F.col("header"), F.size("params").alias("total"), "defaults", "needed").alias("proto"))
    (proto,) = fresh(calls.columns, "__proto")
    joined = calls.join(made.withColumnRenamed("proto", proto), F.col("Type") == F.col(f"{proto}.header"), "left")
    given, total = F.size("Parameters"), F.col(f"{proto}.total")
    error = F.when(F.col(proto).isNull(), F.lit("unknown header")).when(given < F.col(f"{proto}.needed"), F.lit("too few arguments")).when(given > total, F.lit("too many arguments"))
    bound = F.concat("Parameters", F.slice(F.col(f"{proto}.defaults"), given + 1, F.greatest(total - given, F.lit(0))))
    return joined.withColumn("error", error).withColumn("bound", F.when(F.col("error").isNull(), bound)).drop(proto)


def lookup(df: DataFrame, column: str, table: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Attach the row of ``table`` with that key: null fields for a miss, or ``lookup_error`` if ``strict``."""
    (hit,) = fresh([*df.columns, *table.columns], "__hit")
    other = table.withColumn(hit, F.lit(True))
    found = df.join(other, df[column] == other[key], "left")
    return (found.withColumn("lookup_error", F.when(F.col(hit).isNull(), F.lit("no such key"))) if strict else found).drop(hit)


def contains(df: DataFrame, column: str, table: DataFrame, key: str) -> DataFrame:
    own, hit = fresh(df.columns, "__key", "__hit")
    keys = table.select(F.col(key).alias(own)).distinct().withColumn(hit, F.lit(True))
    return df.join(keys, df[column] == F.col(own), "left").withColumn("found", F.coalesce(hit, F.lit(False))).drop(own, hit)


def nth(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The row at position ``n`` (from 0) of each group; no row where the group is shorter."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") == n + 1).drop("__n")


def nth_element(array, n: int):
    return F.try_element_at(array, F.lit(n + 1))


def evaluate_enums(values: DataFrame, column: str, members: dict[str, int]) -> DataFrame:
    """Add ``mask`` and ``mask_error`` for expressions of members; distinct expressions are evaluated once."""
    (found,) = fresh(values.columns, "__enum")
    made = cast_columns(values, {found: (to_enum(members), F.col(f"`{column}`"))})
    return made.select(*[F.col(f"`{c}`") for c in values.columns], F.col(f"{found}.value.mask").cast("long").alias("mask"), F.col(f"{found}.error").alias("mask_error"))


def enum_values(members: DataFrame) -> DataFrame:
    """(enum, member, value, fault) of rows (enum, member, tokens) as read from sheets.

    Decimal and ``0x`` numbers stand for themselves, ``~`` inverts what follows, and names stand for the values of other
    members of the enum. Each round settles the members whose names are settled; those left over name each other in a
    circle or something unknown.
    """
    number = lambda t: F.when(t.rlike("^0x[0-9A-Fa-f]{1,16}$"), F.conv(F.substring(t, 3, 16), 16, -10)).when(t.rlike("^[0-9]{1,18}$"), t).try_cast("long")
    is_name = lambda t: t.rlike("^[A-Za-z_]")
    valued = lambda df: df.withColumn("r", fold_tokens(F.col("tokens"), number)).select("enum", "member", F.col("r.mask").alias("value"), F.when(F.col("r.fault") != 0, F.lit("not an expression")).alias("fault"))
    rest = cut(members.select("enum", "member", "tokens", F.array_distinct(F.filter("tokens", is_name)).alias("names")))
    settled = cut(valued(rest.where("size(names) = 0")))
    rest, left = rest.where("size(names) > 0"), -1
    while (now := rest.count()) not in (0, left):
        left = now
        used = rest.select("enum", "member", F.explode("names").alias("name")).join(settled.select("enum", F.col("member").alias("name"), "value").where("value is not null"), ["enum", "name"])
        held = used.groupBy("enum", "member").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("held"))
        both = cut(rest.join(held, ["enum", "member"], "left").withColumn("ready", F.coalesce(F.size("held") == F.size("names"), F.lit(False))))
        named = both.where("ready").withColumn("tokens", F.transform("tokens", lambda t: F.when(is_name(t), F.try_element_at("held", t).cast("string")).otherwise(t)))
        signed = lambda t: F.coalesce(t.try_cast("long"), number(t))
        more = named.withColumn("r", fold_tokens(F.col("tokens"), signed)).select("enum", "member", F.col("r.mask").alias("value"), F.when(F.col("r.fault") != 0, F.lit("not an expression")).alias("fault"))
        settled = cut(settled.union(more))
        rest = both.where("not ready").select("enum", "member", "tokens", "names")
    return settled.union(rest.select("enum", "member", F.lit(None).cast("long"), F.lit("unknown or circular name")))


def enum_names(df: DataFrame, column: str, members: DataFrame, to_value: bool) -> DataFrame:
    """Name to value or back, with ``enum_error`` on a miss."""
    own, other = ("member", "value") if to_value else ("value", "member")
    table = members.select(F.col(own).alias("__own"), F.col(other).alias(f"{column}_{other}"))
    found = df.join(table, df[column] == F.col("__own"), "left")
    return found.withColumn("enum_error", F.when(F.col("__own").isNull() & F.col(column).isNotNull(), F.lit("unknown member"))).drop("__own")
