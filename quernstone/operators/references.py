"""References and coverage as declared types ask for them, over cast tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.casts import cast_columns
from quernstone.operators.catalog import Catalog, declared, parts_of
from quernstone.operators.checkpoints import cut
from quernstone.operators.constraints import violations
from quernstone.operators.documents import written

Tables = dict[str, DataFrame]


def _walk(df: DataFrame, keep: list[str], catalog: Catalog, kind: str) -> Iterator[tuple[str, str, DataFrame]]:
    """(table, column, rows of ``keep`` and v) for every reference inside a declared type, one projection per path."""
    own = [F.col(f"`{c}`") for c in keep]
    d = declared(kind)
    shape, inner = parts_of(d.name)
    if d.reference:
        yield d.reference, d.reference_column or catalog.key(d.reference), df.where("v is not null").select(*own, written(catalog, kind).text(F.col("v")).alias("v"))
    elif shape == "list":
        yield from _walk(df.select(*own, F.explode("v").alias("v")), keep, catalog, inner[0])
    elif shape == "map":
        yield from _walk(df.select(*own, F.explode(F.map_keys("v")).alias("v")), keep, catalog, inner[0])
        yield from _walk(df.select(*own, F.explode(F.map_values("v")).alias("v")), keep, catalog, inner[1])
    elif d.name == "dsl":
        for header, params in catalog.calls.items():
            for k, (_, part, _, _) in enumerate(params):
                if "$" in part:
                    given = df.where(F.col("v.Type") == header).select(*own, F.get("v.Parameters", F.lit(k)).alias("argument"))
                    typed = cast_columns(given, {"cast": (catalog.without_consts().cast(part), F.col("argument"))})
                    yield from _walk(typed.select(*own, F.col("cast.value").alias("v")), keep, catalog, part)


def reference_leaves(tables: Tables, catalog: Catalog, place: list[str]) -> dict[tuple[str, str], DataFrame]:
    """(place.., table, column, v) by target (table, column): every reference in lists, maps and arguments of calls.

    The columns with references are saved once per table: each path reads them, none repeats their cast.
    """
    found: dict[tuple[str, str], list[DataFrame]] = {}
    for name, df in tables.items():
        wanted = {c: kind for c, (kind, _) in catalog.columns[name].items() if "$" in kind or "dsl" in kind}
        if wanted:
            df = cut(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*place, *wanted])]))
        for column, kind in wanted.items():
            cells = df.select(*[F.col(f"`{c}`") for c in place], F.lit(name).alias("table"), F.lit(column).alias("column"), F.col(f"`{column}`").alias("v"))
            for table, key, leaves in _walk(cells, [*place, "table", "column"], catalog, kind):
                found.setdefault((table, key), []).append(leaves)
    return {target: reduce(DataFrame.union, parts) for target, parts in found.items()}


def group_values(tables: Tables, catalog: Catalog, group: str, column: str) -> DataFrame:
    """Distinct texts of a column over all tables of a JSON group that have it."""
    text = lambda name: written(catalog, catalog.columns[name][column][0]).text(F.col(f"`{column}`"))
    own = [df.select(text(name).alias("held")) for name, df in tables.items() if catalog.groups.get(name, name) == group and column in catalog.columns[name] and column in df.columns]
    if not own:
        return next(iter(tables.values())).select(F.lit(None).cast("string").alias("held")).where("false")
    return reduce(DataFrame.union, own).where("held is not null").distinct()


def reference_faults(tables: Tables, catalog: Catalog, place: list[str], changed: DataFrame | None = None) -> DataFrame:
    """Violations for references to values that no table of the target's JSON group holds: one anti-join per target.

    ``changed`` (file) limits the check to rows of these files; a value that went from the other side then stays unseen.
    """
    found = [violations(next(iter(tables.values())).sparkSession.range(0), "unknown reference")]
    for (table, column), leaves in reference_leaves(tables, catalog, place).items():
        if changed is not None:
            leaves = leaves.join(changed.select("file").distinct(), "file", "left_semi")
        lost = leaves.join(group_values(tables, catalog, table, column), F.col("v") == F.col("held"), "left_anti")
        found.append(violations(lost, "unknown reference", table=F.col("table"), column=F.col("column"), value=F.col("v"), detail=f"{table}.{column}", **{c: F.col(f"`{c}`") for c in place if c in ("file", "sheet", "row")}))
    return reduce(DataFrame.union, found)


def coverage_faults(tables: Tables, catalog: Catalog) -> DataFrame:
    """Violations for strong columns: keys of the table, or members of the enum, that never occur in the column.

    A strong column must refer to a table's key or be of an enum.
    """
    some = next(iter(tables.values()))
    session = some.sparkSession
    say = lambda table, column, text: violations(session.range(1), "not covered", table=table, column=column, detail=text)
    found = [violations(session.range(0), "not covered")]
    for name, df in tables.items():
        for column, (kind, _) in catalog.columns[name].items():
            d = declared(kind)
            if not d.strong:
                continue
            missing = None
            if d.reference:
                key = catalog.key(d.reference) if d.reference in catalog.columns else None
                if key is None:
                    found.append(say(name, column, "unknown table or no key"))
                elif d.reference_column not in (None, key):
                    found.append(say(name, column, "must refer to the key"))
                else:
                    missing = group_values({d.reference: tables[d.reference]}, catalog, catalog.groups.get(d.reference, d.reference), key)
                    held: Column = written(catalog, kind).text(F.col(f"`{column}`"))
            elif d.name in catalog.enums:
                missing, held = session.createDataFrame([(m,) for m in catalog.enums[d.name]], "held string"), F.col(f"`{column}`.name")
            else:
                found.append(say(name, column, "neither a table nor an enum"))
            if missing is not None:
                found.append(violations(missing.subtract(df.select(held.alias("held"))), "not covered", table=name, column=column, value=F.col("held")))
    return reduce(DataFrame.union, found)
