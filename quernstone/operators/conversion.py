"""The whole way from cells to checked tables, and on to documents and snapshots."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.casts import HELD
from quernstone.functions.cells import CONST
from quernstone.operators import cells as sheets
from quernstone.operators import constraints as rules
from quernstone.operators import containers, documents, incremental, long_form, lookups, parents, reference_index, references
from quernstone.operators.catalog import SCOPES, SERVER, Catalog, cast_declared, declared, inheritance_levels
from quernstone.operators.checkpoints import cut, shared_folder
from quernstone.operators.saved import Saved

PARENT = "parent"
#: Names that a declared column can't have, as they say where a row stands.
PLACE = ["file", "sheet", "row"]
_TAKEN = (*PLACE, "table", "errors")
_FAULT = "table string, column string, value string, detail string"


def root_of(table: str) -> str:
    """The table of a sheet's bold columns."""
    return f"{table}_attribute"


@dataclass
class Conversion:
    """Cast tables with their places, the rows they came from, and all violations; ``faults`` is evaluated when it is read."""

    catalog: Catalog
    tables: dict[str, DataFrame]
    rows: DataFrame
    faults: DataFrame


def refreshed_cells(sources: DataFrame, path: str, work: DataFrame) -> DataFrame:
    """Cells of all files of ``sources`` (path, content): those on the work list (file) are read again, the others come
    from the snapshot under ``path``. A file that is gone drops out; a file without cells leaves no old ones behind.
    """
    from quernstone.sources.workbooks import workbook_cells

    name = F.regexp_extract("path", "([^/]+)$", 1).alias("file")
    again = sources.select("path", "content", name).join(work, "file", "left_semi")
    read = workbook_cells(again)
    blank = again.select("file", *[(F.lit("blank") if f.name == "kind" else F.lit(None).cast(f.dataType)).alias(f.name) for f in read.schema if f.name != "file"])
    read.unionByName(blank).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(path)
    kept = incremental.read_snapshot(sources.sparkSession, path, read.schema).join(sources.select(name), "file", "left_semi")
    return kept.where("kind <> 'blank'").select(read.columns)


def _primary(catalog: Catalog, table: str) -> str | None:
    return next((c for c, (kind, _) in catalog.columns[table].items() if kind.startswith("*")), None)


def _catalog(headers: DataFrame, directives: DataFrame, consts: DataFrame | None, values: DataFrame | None, params: DataFrame | None) -> tuple[Catalog, list[tuple]]:
    """The declarations, which are small and come to the driver, and (table, column, value, detail) of those that can't be used."""
    first = F.struct("file", "sheet")
    own = headers.groupBy("table", "bold", "name").agg(F.min("col").alias("col"), F.min_by("type", first).alias("type"), F.min_by("scope", first).alias("scope")).collect()
    made, bad = Catalog(), []
    for r in sorted(own, key=lambda r: (r.table, r.col, r.name)):
        if r.name.lower() in _TAKEN or (r.name == PARENT and not r.bold):
            bad.append((r.table, r.name, r.type, "reserved name"))
            continue
        columns = made.columns.setdefault(root_of(r.table) if r.bold else r.table, {})
        if r.name not in columns and r.name.lower() in {c.lower() for c in columns}:
            bad.append((r.table, r.name, r.type, "differs from another column by case alone"))
            continue
        columns[r.name] = (r.type or "", SCOPES.get(r.scope, 0))
    made.groups.update({r.table: r.json for r in directives.groupBy("table").agg(F.min("json").alias("json")).collect()})
    for r in values.collect() if values is not None else ():
        if r.value is not None:
            made.enums.setdefault(r.enum, {})[r.member] = r.value
    for r in sorted(params.collect(), key=lambda r: (r.header, r.pos)) if params is not None else ():
        made.calls.setdefault(r.header, []).append((r.name, r.type, r.has_default, r.default))
    for r in consts.collect() if consts is not None else ():
        made.consts[r.table, r.name] = (r.type or "", r.value)
    for table, columns in [*made.columns.items()]:
        root = root_of(table)
        if root in made.columns:
            key = _primary(made, root)
            if key is None:
                bad.append((root, None, None, "parent without a primary key"))
            else:
                made.columns[table] = {PARENT: (f"(${root}.{key})", made.columns[root][key][1]), **columns}
    for header, name, kind in [(h, n, k) for h, ps in made.calls.items() for n, k, _, _ in ps if re.search(r"\bdsl\b", k)]:
        made.calls.pop(header, None)
        bad.append((header, name, kind, "a call can't be an argument of a call"))
    # first what isn't a type, then what leads to something that isn't there, until all that is left can be cast
    held = F.lit(None).cast(HELD)
    for check in (declared, lambda kind: made.cast(kind, held)):
        while True:
            wrong, ends, seen = [], made.const_ends(), {}
            for key in [*made.consts]:
                kind = made.consts[key][0]
                if kind not in seen:
                    try:
                        seen[kind] = made.root(kind) and None
                    except ValueError as e:
                        seen[kind] = str(e)
                if seen[kind] or key not in ends:
                    wrong.append((*key, made.consts.pop(key)[1], seen[kind] or f"Const:{key[0]}:{key[1]}: constants form a cycle"))
            for table, column, kind in [(t, c, k) for t, columns in made.columns.items() for c, (k, _) in columns.items()]:
                try:
                    check(kind)
                except ValueError as e:
                    wrong.append((table, column, kind, str(e)))
                    if column in made.columns[table]:
                        del made.columns[table][column]
            if not wrong:
                break
            bad += wrong
    if made.consts:
        made.texts = cut(made.const_texts(headers.sparkSession))
    return made, bad


def _declarations(headers: DataFrame, directives: DataFrame, catalog: Catalog, consts: DataFrame | None, members: DataFrame | None, values: DataFrame | None, params: DataFrame | None) -> list[DataFrame]:
    """Violations of names, schemas, bases, keys, enums, prototypes and reference types."""
    session = headers.sparkSession
    place = {c: F.col(c) for c in ("file", "sheet", "table")}
    scope = F.create_map(*[F.lit(x) for kv in SCOPES.items() for x in kv])
    columns = headers.select("table", F.concat_ws("!", "file", "sheet").alias("sheet"), "name", "type", F.coalesce(F.try_element_at(scope, F.col("scope")), F.lit(0)).alias("scope"), "bold")
    bases = directives.groupBy("table").agg(F.min("based").alias("based"))
    whole = session.createDataFrame([(t, c, kind) for t, cs in catalog.columns.items() for c, (kind, _) in cs.items()], "table string, name string, type string")
    found = [
        sheets.scope_faults(headers, [*SCOPES]),
        rules.violations(rules.invalid_names(headers, "name"), "name", column=F.col("name"), value=F.col("name"), **place),
        rules.violations(headers.groupBy(*place, "name").count().where("count > 1"), "column repeated", column=F.col("name"), **place),
        rules.violations(rules.schema_differences(directives.select("table", F.concat_ws("!", "file", "sheet").alias("sheet"), "based"), columns), "schema", table=F.col("table"), detail=F.col("rule")),
        rules.violations(rules.inheritance_faults(bases, columns.select("table", "name", "type", "scope").distinct()), "inheritance", table=F.col("table"), column=F.col("name"), detail=F.col("fault")),
        rules.violations(inheritance_levels(bases).where("fault = 'cycle'"), "inheritance", table=F.col("table"), detail=F.col("fault")),
        rules.violations(rules.key_declarations(columns.select("table", "bold", "name", "type").distinct()), "key", table=F.col("table"), detail=F.col("fault")),
        rules.violations(rules.reference_types(whole), "reference type", table=F.col("table"), column=F.col("name"), value=F.col("leaf"), detail=F.col("fault")),
    ]
    for part in (SERVER, SCOPES["client"]):
        hidden = session.createDataFrame(containers.hidden_keys(catalog, part), "table string, column string")
        found.append(rules.violations(hidden, "hidden key", table=F.col("table"), column=F.col("column")))
    if members is not None:
        found.append(rules.violations(rules.invalid_names(members, "member"), "name", table=F.col("enum"), column=F.col("member"), value=F.col("member"), **{c: F.col(c) for c in PLACE}))
        found.append(rules.violations(rules.enum_grammar(members), "enum", table=F.col("enum"), column=F.col("member"), detail=F.col("fault")))
        found.append(rules.violations(values.where("fault is not null"), "enum", table=F.col("enum"), column=F.col("member"), detail=F.col("fault")))
        found.append(rules.violations(sheets.duplicate_members(members, ["enum", "member"]), "enum repeated", table=F.col("enum"), column=F.col("member"), detail=F.col("places")))
    if consts is not None:
        found.append(rules.violations(rules.invalid_names(consts, "name"), "name", table=F.col("table"), column=F.col("name"), value=F.col("name"), **{c: F.col(c) for c in PLACE}))
        found.append(rules.violations(sheets.duplicate_members(consts, ["table", "name"]), "const repeated", table=F.col("table"), column=F.col("name"), detail=F.col("places")))
    if params is not None:
        keys = session.createDataFrame([(t, catalog.key(t)) for t in catalog.columns], "table string, key string")
        found.append(rules.violations(rules.call_definitions(params, keys), "call", table=F.col("header"), detail=F.col("fault")))
    return found


def _raw_tables(rows: DataFrame, catalog: Catalog, width: int) -> dict[str, DataFrame]:
    """Wide tables of text, children with the text of their parent's key."""
    names = {t: [c for c in columns if c != PARENT] for t, columns in catalog.columns.items()}
    roots = {root_of(t): t for t in names if root_of(t) in names}
    made = {}
    for table, own in names.items():
        if table in roots:
            continue
        bold = names.get(root_of(table), [])
        marked = rows.where(F.col("table") == table).withColumn("name", F.concat(F.when(F.col("bold"), "+").otherwise("-"), "name"))
        wide = sheets.to_models(marked, [*["+" + c for c in bold], *["-" + c for c in own]])
        held = lambda sign, cs: F.coalesce(*[F.col(f"`{sign}{c}`") for c in cs], F.lit(None).cast("string")).isNotNull()
        part = lambda df, sign, cs, *more: df.where(held(sign, cs)).select(*PLACE, *more, *[F.col(f"`{sign}{c}`").alias(c) for c in cs])  # noqa: E731, B023
        if bold and PARENT in catalog.columns[table]:
            made[root_of(table)] = part(wide, "+", bold)
            wide = parents.parent_of_ranged(wide, "+" + _primary(catalog, root_of(table)), ["file", "sheet"], "row", width, PARENT)
            made[table] = part(wide, "-", own, PARENT)
        else:
            made[table] = part(wide, "-", own)
    # a sheet of nothing but bold columns
    for table in (t for t in roots if t not in made):
        wide = sheets.to_models(rows.where((F.col("table") == roots[table]) & F.col("bold")), names[table])
        made[table] = wide.select(*PLACE, *names[table])
    return made


def _keys(cast: DataFrame, catalog: Catalog, table: str) -> list[DataFrame]:
    """Violations of keys: null, repeated (under one parent, or in the table), or a combination of an enum's members; and orphans."""
    found, place = [], {p: F.col(p) for p in PLACE}
    columns = catalog.columns[table]
    marks = {c: declared(kind) for c, (kind, _) in columns.items()}
    by = [PARENT] if PARENT in marks else []
    # a cell that is there but is no value has an error that names its text
    told = lambda c, test: F.exists("errors", lambda e: (e["column"] == c) & F.coalesce(test(e["value"]), F.lit(False)))
    empty = lambda c: F.col(f"`{c}`").isNull() & ~told(c, lambda v: v.isNotNull())
    if by:
        found.append(rules.violations(cast.where(empty(PARENT)), "orphan row", table=table, **place))
    texts = {c: documents.written(catalog, columns[c][0]).text(F.col(f"`{c}`")) for c, d in marks.items() if d.primary or d.group}
    for c, text in texts.items():
        if c == PARENT:
            continue
        found.append(rules.violations(cast.where(empty(c)), "key without value", table=table, column=c, **place))
        if catalog.root(columns[c][0]).name in catalog.enums:
            combined = F.col(f"`{c}`.mask").isNotNull() & F.col(f"`{c}`.name").isNull() | told(c, lambda v: v.rlike("[&|]"))
            found.append(rules.violations(cast.where(combined), "combined enum key", table=table, column=c, value=text, **place))
        if marks[c].primary:
            # texts that differ may be one value, so values are compared
            keyed = cast.select(*[texts[k].alias(f"k{n}") for n, k in enumerate([*by, c])], *PLACE)
            repeated = rules.repeated_keys(keyed, [f"k{n}" for n in range(len(by) + 1)], PLACE)
            detail = F.concat(F.lit("parent ") if by else F.lit(""), F.concat("k0", F.lit(": ")) if by else F.lit(""), F.col("n").cast("string"), F.lit(" rows: "), "places")
            found.append(rules.violations(repeated, "key repeated", table=table, column=c, value=F.col(f"k{len(by)}"), detail=detail, **place))
    return found


def _used(rows: DataFrame) -> DataFrame:
    """(file, table, const, name) of the constants that cells name, once per file and table."""
    named = F.explode(F.regexp_extract_all("value", F.lit(CONST.strip("^$")), F.lit(0))).alias("token")
    found = rows.where(F.contains("value", F.lit("Const:"))).select("file", "table", named).distinct()
    return found.select("file", "table", F.split_part("token", F.lit(":"), F.lit(2)).alias("const"), F.split_part("token", F.lit(":"), F.lit(3)).alias("name"))


def _cast_tables(catalog: Catalog, rows: Callable[[DataFrame | None], DataFrame], used: DataFrame | None, saved: Saved | None, width: int) -> tuple[dict[str, DataFrame], str]:
    """All tables cast and saved once, and a seal of all that they and their references depend on, if they are kept.

    ``rows`` gives the uncast rows of some files, or of all for None.
    """
    named: dict[str, set[tuple[str, str]]] = {}
    for r in used.select("table", "const", "name").distinct().collect() if used is not None else ():
        named.setdefault(r.table, set()).add((r.const, r.name))
    own = lambda table: {*named.get(table, ()), *named.get(table.removesuffix(root_of("")), ())}
    cast = lambda df, name: cast_declared(df, replace(catalog, names_consts=bool(own(name))), name)
    raw = {}

    def tables(files: DataFrame | None) -> dict[str, DataFrame]:
        if files is None or "some" not in raw:
            raw["all" if files is None else "some"] = _raw_tables(rows(files), catalog, width)
        return raw["all" if files is None else "some"]

    whole = tables(None)
    if saved is None:
        return {name: cut(cast(df, name)) for name, df in whole.items()}, ""
    fresh = {r.table for r in rows(saved.work).select("table").distinct().collect()}
    made = lambda name: lambda files: cast(tables(files)[name], name)
    seals = {name: catalog.fingerprint(name, own(name)) for name in whole}
    found = {name: saved.cast(name, seals[name], cast(df.limit(0), name).schema, not fresh.isdisjoint({name, name.removesuffix(root_of(""))}), made(name)) for name, df in whole.items()}
    saved.forget(found)
    seal = json.dumps([sorted(seals.items()), sorted((t, [*columns.items()]) for t, columns in catalog.columns.items()), sorted(catalog.groups.items()), sorted(catalog.calls.items())])
    return found, hashlib.sha256(seal.encode()).hexdigest()[:24]


def convert(cells: DataFrame, const_cells: DataFrame | None = None, enum_cells: DataFrame | None = None, params: DataFrame | None = None, changed: DataFrame | None = None, width: int = 1 << 20, saved: Saved | None = None) -> Conversion:
    """Cast all tables of ``cells`` and check every rule.

    ``const_cells`` and ``enum_cells`` are cells of lookup sheets, ``params`` the rows of ``read_prototypes``; ``changed``
    (file) limits the check of references to rows of these files. Declarations (headers, constants, enums, prototypes) come
    to the driver; rows never do. Cells without comments and rows are saved once, rows apart by table, so a table reads only
    its own, and each cast table once. Parents are found in ranges of ``width`` rows. A declaration that can't be used is a
    violation, and its column isn't cast. Without any table there are no tables and no violations.

    With ``saved`` the cells are those of the files on its work list. What other files hold is taken from there: their rows,
    headers and directives as they are, and their cast rows too where all that a table's cast depends on (types, what
    references end in, enums, prototypes, the constants that its cells name) is the same; else the table is cast anew.
    The rules are checked over all rows, but for references: of those only the ones of changed files, the ones to values
    that went from changed files, and the ones lost before are looked up again.
    """
    session = cells.sparkSession
    shape = sheets.layout(cells, save=True)
    table = sheets.table_name(F.col("sheet"))
    headers, directives = sheets.read_headers(shape).withColumn("table", table), sheets.read_directives(shape)
    consts = cut(sheets.read_consts(const_cells)) if const_cells is not None else None
    members = cut(sheets.read_enums(enum_cells)) if enum_cells is not None else None
    values = cut(lookups.enum_values(members.dropDuplicates(["enum", "member"]))) if members is not None else None
    if saved is None:
        headers, directives = cut(headers), cut(directives)
        fresh = sheets.read_rows(shape, headers).withColumn("table", table)
        folder = f"{shared_folder(session)}/rows-{uuid.uuid4().hex}"
        fresh.write.partitionBy("table").parquet(folder)
        rows = session.read.schema(fresh.schema).parquet(folder)
        used = _used(rows) if consts is not None else None
    else:
        parts = {"headers": cut(headers), "directives": cut(directives)}
        parts["rows"] = sheets.read_rows(shape, parts["headers"]).withColumn("table", table).sortWithinPartitions("table")
        for name in ("headers", "directives", "rows"):
            saved.put(name, parts[name])
        headers, directives, rows = (saved.get(name, df.schema) for name, df in parts.items())
        own = _used(rows.join(saved.work, "file", "left_semi"))
        saved.put("used", own)
        used = saved.get("used", own.schema)
    catalog, bad = _catalog(headers, directives, consts, values, params)
    tables, seal = _cast_tables(catalog, lambda files: rows if files is None else rows.join(files, "file", "left_semi"), used, saved, width)
    found = [rules.violations(session.createDataFrame(bad, _FAULT), "declaration", **{c: F.col(c) for c in ("table", "column", "value", "detail")})]
    found += _declarations(headers, directives, catalog, consts, members, values, params)
    for name, df in tables.items():
        found.append(rules.cast_faults(df, name, PLACE))
        found += _keys(df, catalog, name)
    if tables:
        marked = [kind for columns in catalog.columns.values() for kind, _ in columns.values()]
        if any("$" in kind or "dsl" in kind for kind in marked):
            found.append(references.reference_faults(tables, catalog, PLACE, changed) if saved is None else reference_index.saved_faults(saved, tables, catalog, seal))
        found.append(references.coverage_faults(tables, catalog))
    return Conversion(catalog, tables, rows, reduce(DataFrame.unionByName, found))


def validate(cells: DataFrame, const_cells: DataFrame | None = None, enum_cells: DataFrame | None = None, params: DataFrame | None = None, width: int = 1 << 20) -> DataFrame:
    """The violations that ``convert`` tells of, without its tables: cells are cast by type, so the plan doesn't grow with
    the number of tables. Combined enum keys and coverage need whole columns and are left to ``convert``.
    """
    session = cells.sparkSession
    shape = sheets.layout(cells, save=True)
    table = sheets.table_name(F.col("sheet"))
    headers, directives = cut(sheets.read_headers(shape).withColumn("table", table)), cut(sheets.read_directives(shape))
    consts = cut(sheets.read_consts(const_cells)) if const_cells is not None else None
    members = cut(sheets.read_enums(enum_cells)) if enum_cells is not None else None
    values = cut(lookups.enum_values(members.dropDuplicates(["enum", "member"]))) if members is not None else None
    rows = cut(sheets.read_rows(shape, headers).withColumn("table", table))
    catalog, bad = _catalog(headers, directives, consts, values, params)
    found = [rules.violations(session.createDataFrame(bad, _FAULT), "declaration", **{c: F.col(c) for c in ("table", "column", "value", "detail")})]
    found += _declarations(headers, directives, catalog, consts, members, values, params)
    if catalog.columns:
        owned = rows.withColumn("table", F.when(F.col("bold"), F.concat("table", F.lit(root_of("")))).otherwise(F.col("table")))
        found.append(long_form.check(owned, catalog, PARENT, width))
    return reduce(DataFrame.unionByName, found)


def reconvert(sources: DataFrame, path: str, version: str, const_cells: DataFrame | None = None, enum_cells: DataFrame | None = None, params: DataFrame | None = None, width: int = 1 << 20) -> tuple[Conversion, Callable[[], None]]:
    """Convert ``sources`` (path, content) with what the last run left under ``path``, and a function to call at the end.

    Files are read again if they are new or changed, if ``version`` is another one, or if the last run found faults in
    them. The function remembers the files and those with faults for the next run; until it is called, the next run has
    the same work.
    """
    from quernstone.sources.workbooks import workbook_cells

    session = sources.sparkSession
    now = cut(incremental.manifest(sources, version))
    store = session._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(session._jsc.hadoopConfiguration())
    held = lambda name: store.exists(session._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS"))
    before = cut(session.read.schema(now.schema).parquet(f"{path}/manifest")) if held("manifest") else now.limit(0)
    failed = cut(session.read.schema("file string").json(f"{path}/error_files")) if held("error_files") else now.select("file").limit(0)
    work = cut(incremental.work_list(incremental.manifest_diff(before, now), failed))
    again = sources.withColumn("file", F.regexp_extract("path", "([^/]+)$", 1)).join(work, "file", "left_semi").drop("file")
    made = convert(workbook_cells(again), const_cells, enum_cells, params, width=width, saved=Saved(f"{path}/state", now.select("file"), work))

    def remember() -> None:
        incremental.write_error_files(made.faults, f"{path}/error_files")
        now.write.mode("overwrite").parquet(f"{path}/manifest")

    return made, remember


def publish(made: Conversion, path: str) -> int:
    """Write the documents of both scopes with their checksums and the raw dump under ``path``; returns the number of violations.

    With any violation no document is written, only the violations and their files, from which the next work list is made.
    """
    faults = cut(made.faults)
    count = faults.count()
    faults.write.mode("overwrite").parquet(f"{path}/faults")
    rules.error_files(faults).write.mode("overwrite").json(f"{path}/error_files")
    if count:
        return count
    session = faults.sparkSession
    for scope in ("server", "client"):
        held = containers.by_json(made.tables, made.catalog, SCOPES[scope])
        groups = {g: [g, *(t for t in made.tables if t != g and made.catalog.groups.get(t, t) == g)] for g in held}
        values = {g: documents.written_columns(made.catalog, tables) for g, tables in groups.items()}
        containers.write_containers(session, held, scope, f"{path}/json", values=values)
        containers.write_crc(session, f"{path}/json/{scope}", f"{path}/crc/{scope}")
    containers.write_raw_dump(made.rows.drop("table"), f"{path}/diff")
    return 0
