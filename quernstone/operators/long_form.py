"""The rules over cells as they are, a row a cell: one cast a type and one plan for any number of tables."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.casts import cast_columns
from quernstone.operators import constraints as rules
from quernstone.operators import constants, parents
from quernstone.operators.catalog import Catalog, declared, parts_of
from quernstone.operators.checkpoints import cut, shared_folder
from quernstone.operators.documents import text_of_argument, written

_PLACE = ["file", "sheet", "row"]
_LEAVES = "array<struct<path: string, text: string>>"


def leaves(catalog: Catalog, kind: str, c: Column, path: str = "") -> Column:
    """(path, text) of every scalar in a cast value: items of lists, keys and values of maps, arguments of calls."""
    d = catalog.root(kind)
    shape, inner = parts_of(d.name)
    if shape == "list":
        return F.flatten(F.transform(c, lambda x: leaves(catalog, inner[0], x, f"{path}[]")))
    if shape == "map":
        key = F.transform(F.map_keys(c), lambda x: leaves(catalog, inner[0], x, f"{path}{{k}}"))
        return F.concat(F.flatten(key), F.flatten(F.transform(F.map_values(c), lambda x: leaves(catalog, inner[1], x, f"{path}{{v}}"))))
    if d.name == "dsl":
        none = F.expr(f"cast(array() as {_LEAVES})")
        own = [(h, k, part) for h, ps in catalog.calls.items() for k, (_, part, _, _) in enumerate(ps) if "$" in part]
        given = [F.when(c["Type"] == h, text_of_argument(catalog, part, F.get(c["Parameters"], F.lit(k)), lambda v, h=h, k=k, part=part: leaves(catalog, part, v, f"{path}{h}:{k}"))) for h, k, part in own]
        return F.concat(none, *[F.coalesce(g, none) for g in given])
    return F.array(F.struct(F.lit(path).alias("path"), written(catalog, kind).text(c).alias("text")))


def targets(catalog: Catalog, kind: str, path: str = "") -> dict[str, tuple[str, str]]:
    """path -> (table, column) of the references in a declared type."""
    d = declared(kind)
    shape, inner = parts_of(d.name)
    if d.reference:
        return {path: (d.reference, d.reference_column or catalog.key(d.reference))}
    if shape == "list":
        return targets(catalog, inner[0], f"{path}[]")
    if shape == "map":
        return targets(catalog, inner[0], f"{path}{{k}}") | targets(catalog, inner[1], f"{path}{{v}}")
    if d.name == "dsl":
        return {p: t for h, ps in catalog.calls.items() for k, (_, part, _, _) in enumerate(ps) for p, t in targets(catalog, part, f"{path}{h}:{k}").items()}
    return {}


def cast_cells(rows: DataFrame, catalog: Catalog) -> DataFrame:
    """(file, sheet, row, table, name, value, text, leaves, error) of rows (file, sheet, row, table, name, value).

    Cells are saved apart by what their declared type comes down to, and each kind of them is cast in one projection,
    whatever tables and columns they stand in. ``text`` is the value of a scalar as a key is written.
    """
    kinds, places = {}, []
    for table, columns in catalog.columns.items():
        for name, (kind, _) in columns.items():
            seal = json.dumps(catalog.described(kind))
            nr = kinds.setdefault(seal, (len(kinds), kind))[0]
            places.append((table, name, nr))
    session = rows.sparkSession
    known = session.createDataFrame(places, "table string, name string, type int")
    typed = rows.select(*_PLACE, "table", "name", "value").join(known, ["table", "name"])
    if catalog.consts:
        typed = constants.hold(typed, [F.col("value")], catalog.const_texts(session), "held")
    folder = f"{shared_folder(session)}/cells-{uuid.uuid4().hex}"
    typed.write.partitionBy("type").parquet(folder)
    saved = session.read.schema(typed.schema).parquet(folder)
    found = []
    for nr, kind in kinds.values():
        made = cast_columns(saved.where(F.col("type") == nr), {"cast": (catalog.cast(kind, F.col("held") if catalog.consts else None), F.col("value"))})
        found.append(made.select(*_PLACE, "table", "name", "value", written(catalog, kind).text(F.col("cast.value")).alias("text"), leaves(catalog, kind, F.col("cast.value")).cast(_LEAVES).alias("leaves"), F.col("cast.error").alias("error")))
    return cut(reduce(DataFrame.union, found))


def check(rows: DataFrame, catalog: Catalog, parent: str, width: int = 1 << 20) -> DataFrame:
    """Violations of casts, missing values, keys, references and orphans over rows (file, sheet, row, table, name, value).

    ``parent`` names the column that a child table has for the key of its parent, which isn't in the rows. The plan has a
    branch for each kind of type and one for each rule, none for a table.
    """
    session = rows.sparkSession
    cells = cast_cells(rows.where(F.col("name") != parent), catalog)
    place = {p: F.col(p) for p in _PLACE}
    told = lambda df, rule, **more: rules.violations(df, rule, table=F.col("table"), column=F.col("name"), **place, **more)
    marks = {(t, c): declared(kind) for t, columns in catalog.columns.items() for c, (kind, _) in columns.items()}
    table = lambda rows_, shape: session.createDataFrame(rows_, shape)

    found = [told(cells.where("error is not null"), "cast", value=F.col("value"), detail=F.col("error"))]
    # a row of a table without a cell where the type allows none
    needed = table([(t, [c for c in columns if c != parent and not catalog.root(columns[c][0]).nullable], [c for c in columns if c != parent and (marks[t, c].primary or marks[t, c].group)]) for t, columns in catalog.columns.items()], "table string, needed array<string>, keys array<string>")
    held = cells.groupBy(*_PLACE, "table").agg(F.collect_set("name").alias("held")).join(needed, "table")
    lists = lambda df, names: df.withColumn("name", F.explode(F.array_except(names, "held")))
    found.append(told(lists(held, "needed"), "cast", detail=F.lit("null")))
    found.append(told(lists(held, "keys"), "key without value"))

    # the key of the parent above each row of a child table
    children = [t for t in catalog.columns if (t, parent) in marks]
    of = table([(marks[t, parent].reference, marks[t, parent].reference_column, t) for t in children], "table string, name string, child string")
    above = cells.join(of.select("table", "name"), ["table", "name"]).select(*_PLACE, F.col("text").alias("key"))
    below = held.join(of.select(F.col("child").alias("table")), "table").select(*_PLACE, "table")
    line = above.withColumn("table", F.lit(None).cast("string")).unionByName(below.withColumn("key", F.lit(None).cast("string"))).groupBy(*_PLACE).agg(F.max("key").alias("key"), F.max("table").alias("table"))
    hung = parents.parent_of_ranged(line, "key", ["file", "sheet"], "row", width, "parent").where("table is not null").select(*_PLACE, "table", "parent")
    hung = cut(hung)
    found.append(rules.violations(hung.where("parent is null"), "orphan row", table=F.col("table"), **place))

    primary = table([(t, c) for (t, c), d in marks.items() if d.primary], "table string, name string")
    keyed = cells.join(primary, ["table", "name"]).join(hung, [*_PLACE, "table"], "left").withColumn("parent", F.coalesce("parent", F.lit("")))
    repeated = rules.repeated_keys(cut(keyed.select("table", "name", "parent", "text", *_PLACE)), ["table", "name", "parent", "text"], _PLACE)
    detail = F.concat(F.when(F.col("parent") != "", F.concat(F.lit("parent "), "parent", F.lit(": "))).otherwise(F.lit("")), F.col("n").cast("string"), F.lit(" rows: "), "places")
    found.append(told(repeated, "key repeated", value=F.col("text"), detail=detail))

    # references by path, against all columns that stand for the target in the tables of its group
    paths = [(t, c, p, *to) for t, columns in catalog.columns.items() for c, (kind, _) in columns.items() if c != parent for p, to in targets(catalog, kind).items()]
    wanted = {(to, column) for *_, to, column in paths}
    own = [(t, c, catalog.groups.get(t, t)) for t, columns in catalog.columns.items() for c in columns if (catalog.groups.get(t, t), c) in wanted]
    values = cells.join(table(own, "table string, name string, target string"), ["table", "name"]).where("text is not null").select("target", F.col("name").alias("column"), "text").distinct()
    each = cells.select(*_PLACE, "table", "name", F.explode("leaves").alias("leaf")).select(*_PLACE, "table", "name", "leaf.path", "leaf.text").where("text is not null")
    asked = each.join(table(paths, "table string, name string, path string, target string, column string"), ["table", "name", "path"])
    lost = asked.join(values, ["target", "column", "text"], "left_anti")
    found.append(told(lost, "unknown reference", value=F.col("text"), detail=F.concat("target", F.lit("."), "column")))
    return reduce(DataFrame.unionByName, found)
