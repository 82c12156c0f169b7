"""From sparse cells (file, sheet, row, col, kind, value, bold) to wide tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.cells import normalize_cell
from quernstone.operators.checkpoints import cut
from quernstone.operators.constraints import violations

SHEET = ["file", "sheet"]
_DIRECTIVE = "^\\s*(based|json)\\s*:\\s*(\\S+)\\s*$"


def table_name(sheet):
    """Sheets that agree before the first point belong to one table."""
    return F.split_part(sheet, F.lit("."), F.lit(1))


def drop_comments(cells: DataFrame) -> DataFrame:
    """Rows whose first cell starts with ``#``, other cells that do, and blank cells go."""
    full = cells.where((F.col("kind") != "blank") & F.col("value").isNotNull() & (F.trim("value") != ""))
    marked = full.where(F.startswith("value", F.lit("#")))
    commented = marked.where("col = 0").select(*SHEET, "row").distinct()
    return full.where(~F.startswith("value", F.lit("#"))).join(commented, [*SHEET, "row"], "left_anti")


def _rows(full: DataFrame) -> DataFrame:
    """Valid rows of a sheet and whether they hold nothing but a directive."""
    rows = full.groupBy(*SHEET, "row").agg(F.count("*").alias("n"), F.min_by("value", "col").alias("first"))
    return rows.withColumn("lone", (F.col("n") == 1) & F.col("first").rlike(_DIRECTIVE))


def _heads(rows: DataFrame) -> DataFrame:
    """(file, sheet, h1, h2, h3): the numbers of the three header rows, by minima, so no sheet is sorted."""
    heads = rows.where("not lone").groupBy(*SHEET).agg(F.min("row").alias("h1"))
    for k in (2, 3):
        later = rows.join(heads, SHEET).where(F.col("row") > F.col(f"h{k - 1}")).groupBy(*SHEET).agg(F.min("row").alias(f"h{k}"))
        heads = heads.join(later, SHEET, "left")
    return heads


@dataclass(frozen=True)
class Layout:
    """Cells without comments, their rows, and the header rows of sheets."""

    full: DataFrame
    rows: DataFrame
    heads: DataFrame


def layout(cells: DataFrame | Layout, save: bool = False) -> Layout:
    """What directives, headers and rows are read from; with ``save`` each part is saved, so that all three share it."""
    if isinstance(cells, Layout):
        return cells
    keep = cut if save else lambda df: df
    full = keep(drop_comments(cells))
    rows = keep(_rows(full))
    return Layout(full, rows, keep(_heads(rows)))


def read_directives(cells: DataFrame | Layout) -> DataFrame:
    """(file, sheet, table, based, json) from the lone cells in front; ``json`` defaults to the table."""
    rows = layout(cells).rows
    lead = rows.join(rows.where("not lone").groupBy(*SHEET).agg(F.min("row").alias("h1")), SHEET, "left").withColumn("front", F.coalesce(F.col("row") < F.col("h1"), F.lit(True)))
    word = lambda k: F.max(F.when(F.col("front") & (F.regexp_extract("first", _DIRECTIVE, 1) == k), F.regexp_extract("first", _DIRECTIVE, 2)))
    found = lead.groupBy(*SHEET).agg(word("based").alias("based"), word("json").alias("json"))
    table = table_name(F.col("sheet"))
    return found.select(*SHEET, table.alias("table"), "based", F.coalesce("json", table).alias("json"))


def read_headers(cells: DataFrame | Layout) -> DataFrame:
    """(file, sheet, col, name, type, scope, bold) from the first three valid rows."""
    made = layout(cells)
    nth = F.when(F.col("row") == F.col("h1"), 1).when(F.col("row") == F.col("h2"), 2).when(F.col("row") == F.col("h3"), 3)
    top = made.full.join(made.heads, SHEET).withColumn("nth", nth).where("nth is not null").groupBy(*SHEET, "col").pivot("nth", [1, 2, 3]).agg(F.first("value").alias("v"), F.first("bold").alias("b"))
    return top.where("`1_v` is not null").select(*SHEET, "col", F.col("1_v").alias("name"), F.col("2_v").alias("type"), F.lower("3_v").alias("scope"), F.coalesce("1_b", F.lit(False)).alias("bold"))


def read_rows(cells: DataFrame | Layout, headers: DataFrame) -> DataFrame:
    """(file, sheet, row, name, bold, value) of the cells under a header, normalised for its type."""
    made = layout(cells)
    below = made.full.join(made.heads.select(*SHEET, "h3"), SHEET).where("row > h3").select(*SHEET, "row", "col", "kind", "value")
    named = below.join(headers.select(*SHEET, "col", "name", "type", "bold"), [*SHEET, "col"])
    value = normalize_cell(F.col("kind"), F.col("value"), F.regexp_replace("type", "[*()$!~?]", ""))
    return named.select(*SHEET, "row", "name", "bold", value.alias("value")).where("value is not null")


def scope_faults(headers: DataFrame, scopes: list[str]) -> DataFrame:
    """Violations for header scopes that are none."""
    wrong = headers.where(~F.coalesce(F.col("scope").isin(scopes), F.lit(False)))
    return violations(wrong, "unknown scope", file=F.col("file"), sheet=F.col("sheet"), table=table_name(F.col("sheet")), column=F.col("name"), value=F.col("scope"))


def to_models(rows: DataFrame, names: list[str], by: list[str] = [*SHEET, "row"]) -> DataFrame:  # noqa: B006
    """Long to wide: a column per name, null where a row has no cell."""
    return rows.groupBy(*by).pivot("name", names).agg(F.first("value"))


def max_row(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*SHEET).agg(F.max("row").alias("max_row"))


def parent_rows(rows: DataFrame) -> DataFrame:
    return rows.where("bold").select(*SHEET, "row").distinct()


def sheet_order(df: DataFrame) -> DataFrame:
    """Rows in the order of sheets and rows; for sinks only."""
    return df.orderBy("sheet", "row")


def const_order(df: DataFrame) -> DataFrame:
    return df.orderBy("file")


def _columns(cells: DataFrame, names: list[str]) -> DataFrame:
    wide = drop_comments(cells).groupBy(*SHEET, "row").pivot("col", [*range(len(names))]).agg(F.first("value"))
    return wide.select(*SHEET, "row", *[F.col(str(k)).alias(n) for k, n in enumerate(names)])


def read_consts(cells: DataFrame) -> DataFrame:
    """(table, name, scope, type, value, file, sheet, row) of sheets with four columns and no header."""
    return _columns(cells, ["name", "scope", "type", "value"]).where("name is not null").select(table_name(F.col("sheet")).alias("table"), "name", F.lower("scope").alias("scope"), "type", "value", *SHEET, "row")


def read_enums(cells: DataFrame) -> DataFrame:
    """(enum, member, expression, tokens, file, sheet, row) of sheets with two columns and no header."""
    found = _columns(cells, ["member", "expression"]).where("member is not null")
    text = F.regexp_replace("expression", "\\s", "")
    return found.select(table_name(F.col("sheet")).alias("enum"), F.trim("member").alias("member"), text.alias("expression"), F.regexp_extract_all(text, F.lit("[A-Za-z_0-9]+|[&|~()]"), F.lit(0)).alias("tokens"), *SHEET, "row")


def duplicate_members(found: DataFrame, by: list[str]) -> DataFrame:
    """Names that a merged lookup table holds more than once, with every place."""
    place = F.concat_ws("!", "file", "sheet", F.col("row").cast("string"))
    return found.groupBy(*by).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(place)), ",").alias("places")).where("n > 1")
