"""Sheets, parents, rules, containers, snapshots and hooks on small fixtures."""

import io
import json
import zipfile
import zlib
from pathlib import Path
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from quernstone.functions.cells import fingerprint
from quernstone.operators import cells, constraints, containers, hooks, incremental, lookups, parents, references
from quernstone.operators.catalog import Catalog, cast_declared, declared, inheritance_levels, parts_of, root_types
from quernstone.sources import prototypes, workbooks

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheets):
    """A workbook of inline strings, numbers and bold names (a name ending in ``*``)."""
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><fonts><font/><font><b/></font></fonts><cellXfs><xf fontId="0"/><xf fontId="1"/></cellXfs></styleSheet>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>shared</t></si></sst>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k, rows in enumerate(sheets.values()):
            xml = io.StringIO()
            for r, row in enumerate(rows, 1):
                xml.write(f'<row r="{r}">')
                for c, v in enumerate(row):
                    at, bold = f"{chr(65 + c)}{r}", isinstance(v, str) and v.endswith("*")
                    if v is None:
                        continue
                    if isinstance(v, str):
                        xml.write(f'<c r="{at}" t="s"><v>0</v></c>' if v == "shared" else f'<c r="{at}" t="inlineStr" s="{int(bold)}"><is><t>{escape(v.rstrip("*") if bold else v)}</t></is></c>')
                    else:
                        xml.write(f'<c r="{at}"><v>{v}</v></c>')
                xml.write("</row>")
            book.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{xml.getvalue()}</sheetData></worksheet>')


def test_workbook_to_tables(spark, tmp_path):
    sheet = [["based: Base"], ["json: G"], ["# a comment", "x"], ["group*", "id", "note"], ["string", "int", "string"], ["common", "server", "client"], ["P1"], [None, 1, "shared"], ["P2", 2.00000001], [None, 3, "#hidden"]]
    workbook(tmp_path / "data.xlsx", {"Drop.one": sheet, "#skipped": [["x"]]})
    workbook(tmp_path / "~$data.xlsx", {"A": [["x"]]})
    workbook(tmp_path / "const.xlsx", {"Raid": [["Fee", "server", "int", "3"]]})
    workbook(tmp_path / "enum.xlsx", {"FLAGS": [["A", "1"], ["B", "A | 0x2"]]})
    sources = workbooks.list_sources(spark, str(tmp_path))
    assert sorted(r.kind for r in sources.collect()) == ["const", "data", "enum"]
    found = workbooks.workbook_cells(sources.where("kind = 'data'")).cache()
    assert [tuple(r)[1:] for r in cells.read_directives(found).collect()] == [("Drop.one", "Drop", "Base", "G")]
    headers = cells.read_headers(found)
    assert {(r.name, r.type, r.scope, r.bold) for r in headers.collect()} == {("group", "string", "common", True), ("id", "int", "server", False), ("note", "string", "client", False)}
    rows = cells.read_rows(found, headers)
    wide = cells.to_models(rows, ["group", "id", "note"])
    assert [tuple(r)[2:] for r in wide.orderBy("row").collect()] == [(6, "P1", None, None), (7, None, "1", "shared"), (8, "P2", "2", None), (9, None, "3", None)]
    assert cells.max_row(rows).first().max_row == 9 and cells.parent_rows(rows).count() == 2
    owned = parents.parent_of(wide, F.col("group"), ["file", "sheet"], ["row"]).where("id is not null")
    assert [(r.id, r.parent) for r in owned.orderBy("row").collect()] == [("1", "P1"), ("2", "P1"), ("3", "P2")]
    consts = cells.read_consts(workbooks.workbook_cells(sources.where("kind = 'const'")))
    assert [(r.table, r.name, r.value) for r in consts.collect()] == [("Raid", "Fee", "3")]
    enums = cells.read_enums(workbooks.workbook_cells(sources.where("kind = 'enum'")))
    assert {r.member: r.tokens for r in enums.collect()} == {"A": ["1"], "B": ["A", "|", "0x2"]}
    assert cells.duplicate_members(enums.union(enums), ["enum", "member"]).count() == 2


def test_orphans_and_ranges(spark):
    df = spark.createDataFrame([("f", "s", r, k) for r, k in [(1, None), (2, "P"), (3, None), (9, None), (10, "Q"), (11, None), (35, None)]], "file string, sheet string, row int, key string")
    plain = parents.parent_of(df, F.col("key"), ["file", "sheet"], ["row"])
    for width in (1, 4, 100):
        ranged = parents.parent_of_ranged(df, "key", ["file", "sheet"], "row", width).select(*plain.columns)
        assert sorted(map(str, ranged.collect())) == sorted(map(str, plain.collect()))
    assert plain.where("row = 1").first().parent is None and plain.where("row = 10").first().parent == "P"


def test_declared_types():
    d = declared("*$item.id?")
    assert (d.primary, d.reference, d.reference_column, d.nullable) == (True, "item", "id", True)
    assert declared("(!$x)").group and declared("(!$x)").strong and declared("~int").sequence
    assert parts_of("{string:[int]}") == ("map", ["string", "[int]"]) and parts_of("{{a:b}:c}") == ("map", ["{a:b}", "c"]) and parts_of("point") == ("point", ["uint"])
    for bad in ("(int)?", "", "$", "$!x"):
        with pytest.raises(ValueError):
            declared(bad)


def test_catalog_casts(spark):
    catalog = Catalog({"category": {"id": ("*string", 3)}, "item": {"id": ("*int", 3), "category": ("$category", 3), "tags": ("[$category]", 1), "flag": ("FLAGS?", 1), "n": ("~x", 2), "at": ("point<uint8>?", 2)}}, {"FLAGS": {"A": 1, "B": 2}})
    df = spark.createDataFrame([("1", "c", "a & b", "A|B", "5", "1,2"), ("x", "c", "", "", "6", "300,1")], "id string, category string, tags string, flag string, n string, at string")
    good, bad = cast_declared(df, catalog, "item").orderBy(F.size("errors")).collect()
    assert (good.id, good.tags, good.flag.mask, good.n, tuple(good["at"]), good.errors) == (1, ["a", "b"], 3, 5, (1, 2), [])
    assert [(e.column, e.value) for e in bad.errors] == [("id", "x"), ("at", "300,1")] and bad.tags == [] and bad.flag is None
    faults = constraints.cast_faults(cast_declared(df.withColumn("row", F.lit(4)), catalog, "item"), "item", ["row"])
    assert faults.count() == 2 and constraints.report([faults]).columns[0] == "rule"
    with pytest.raises(ValueError, match="cast: 2"):
        constraints.report([faults], fail=True)
    with pytest.raises(ValueError, match="cycle"):
        Catalog({"a": {"id": ("*$a", 3)}}).root("$a")


def test_recursive_catalogs_end_or_say_why(spark):
    columns = spark.createDataFrame([("a", "id", "b", "id", None, False), ("b", "id", None, None, "int", True), ("c", "id", "d", "id", None, False), ("d", "id", "c", "id", None, False), ("e", "id", "c", "id", None, False), ("f", "id", "zz", "id", None, False), ("g", "id", "f", "id", None, False)], "table string, name string, target string, target_column string, type string, nullable boolean")
    got = {r.table: (r.root, r.nullable, r.hops, r.fault) for r in root_types(columns).collect()}
    assert got["a"] == ("int", True, 1, None) and got["b"] == ("int", True, 0, None)
    assert got["c"] == got["d"] == got["e"] == (None, False, None, "cycle")
    assert got["f"] == (None, False, 0, "unknown target") and got["g"] == (None, False, 1, "unknown target")
    based = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "table string, based string")
    assert {r.table: r.level for r in inheritance_levels(based).collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None}
    assert root_types(columns.where("false")).count() == inheritance_levels(based.where("false")).count() == 0


@pytest.mark.parametrize("n", [25, 1000])
def test_long_chains(spark, n):
    chain = spark.range(n + 1).select(F.col("id").cast("string").alias("table"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("based"))
    got = {int(r.table): (r.level, r.fault) for r in inheritance_levels(chain).collect()}
    assert got == {k: (k, None) for k in range(n + 1)}
    ring = chain.withColumn("based", F.coalesce("based", F.lit(str(n))))
    assert {(r.level, r.fault) for r in inheritance_levels(ring).collect()} == {(None, "cycle")}


def test_two_million_links(spark):
    wide = spark.range(2_000_000).select(F.col("id").alias("table"), F.when(F.col("id") > 0, F.floor(F.col("id") / 40)).alias("based"))
    r = inheritance_levels(wide).agg(F.count("*").alias("n"), F.max("level").alias("top"), F.count("fault").alias("bad")).first()
    assert (r.n, r.top, r.bad) == (2_000_000, 4, 0)


def test_consts_end(spark):
    chain = [("T", f"c{k}", f"Const:T:c{k + 1}") for k in range(30)] + [("T", "c30", "7")]
    consts = spark.createDataFrame([("T", "a", "Const:T:b"), ("T", "b", "5"), ("T", "loop", "Const:T:loop"), ("T", "lost", "Const:V:x"), *chain], "table string, name string, value string")
    df = spark.createDataFrame([("Const:T:a",), ("Const:T:zz",), ("Const:U:a",), ("plain",), (None,), ("Const:T:loop",), ("Const:T:c0",), ("Const:T:lost",)], "c string").withColumn("part", F.lit(1)).withColumn("__p", F.lit(2))
    out = lookups.resolve_const(df, "c", consts)
    assert out.columns == ["c", "part", "__p", "c_error"]
    assert {(r.c, r.c_error) for r in out.collect()} == {("5", None), ("7", None), ("Const:T:zz", "unknown const"), ("Const:U:a", "unknown const table"), ("plain", None), (None, None), ("Const:T:loop", "endless const"), ("Const:V:x", "unknown const table")}


#: The table of accepted and rejected cells: declared type, accepted, rejected.
CELLS = [
    ("int", ["12", "-3", "0x1F", "Const:Raid:Fee"], ["1.5", "2147483648", "", "Const:Raid:Missing", "Const:Nope:Fee", "Const:Raid:Name"]), ("int?", ["", "null"], ["x"]), ("uint8_t", ["0", "255"], ["256", "-1"]), ("uint64", ["18446744073709551615"], ["18446744073709551616"]),
    ("float", ["1.5"], ["1e39"]), ("bool", ["true", "FALSE"], ["1", "yes"]), ("string", ["any", "", "null", "Const:Raid:Name"], []), ("DateTime", ["2021-02-16", "2021-02-16 00:00:00"], ["soon"]),
    ("TimeSpan", ["01:02:03", "1 02:03:04", "1.02:03:04"], ["1h"]), ("DateRange", ["2021-02-16 ~ 2021-03-16", "1 00:00:00"], ["a ~ b"]), ("[int]", ["1 & 2 & 3", "1\n2", "", "1 & Const:Raid:Fee"], ["1 & x", "1 & Const:Raid:Missing"]),
    ("{string:int}", ["a:1 & b:2", ""], ["a", "a:1:2", "a:1 & a:2"]), ("point", ["3, 4"], ["3"]), ("size", ["3, 4"], ["3"]), ("range", ["1 ~ 9"], ["1-9"]), ("FLAGS", ["A", "A | B", "(A | B) & C", "(A|B)"], ["Z", "~A", "A |"]),
    ("dsl", ["item(1)", "item(1, 2)", "item(1, 2, 3.5)", "item(Const:Raid:Fee)", "sex(A|B)", "none()"], ["item()", "item(1,2,3,4)", "nope(1)", "item(x)", "item(1, -1)", "sex(Z)", "item", ""]), ("dsl?", ["", "item(1)"], ["item()"]),
]


def test_whole_cells(spark):
    calls = {"item": [("id", "$item", False, None), ("count", "uint", True, "1"), ("percent", "double", True, "100.0")], "sex": [("v", "FLAGS", False, None)], "none": []}
    consts = {("Raid", "Fee"): ("int", "Const:Raid:Base"), ("Raid", "Base"): ("int32", "7"), ("Raid", "Name"): ("string", "boss")}
    for kind, good, bad in CELLS:
        catalog = Catalog({"t": {"c": (kind, 3)}, "item": {"id": ("*int", 3)}}, {"FLAGS": {"A": 1, "B": 2, "C": 4}}, calls, consts)
        df = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad], "c string, fine boolean")
        wrong = [(kind, r.text, r.errors) for r in cast_declared(df.withColumn("text", F.col("c")), catalog, "t").collect() if (not r.errors) != r.fine]
        assert not wrong
    catalog = Catalog({"t": {"n": ("int", 3), "d": ("dsl", 3), "e": ("FLAGS", 3)}}, {"FLAGS": {"A": 1, "B": 2, "C": 4}}, calls | {"item": [("id", "int", False, None), *calls["item"][1:]]}, consts)
    r = cast_declared(spark.createDataFrame([("Const:Raid:Fee", "item(3)", "(A | B) & C")], "n string, d string, e string"), catalog, "t").first()
    assert (r.n, r.d.Parameters, r.e.mask) == (7, ["3", "1", "100.0"], 0)
    with pytest.raises(ValueError, match="cycle"):
        Catalog(consts={("a", "b"): ("int", "Const:a:b")}).const_text("a", "b")


def test_prototypes_and_calls(spark):
    text = json.dumps({"item": [{"name": "id", "type": "$item", "desc": "i"}, {"name": "count", "type": "uint", "default": 1}, {"name": "max", "type": "int?", "default": None}], "sex": [{"name": "v", "type": "SEX"}]})
    params = prototypes.read_prototypes(spark.createDataFrame([(text,)], "value string"))
    assert [(r.header, r.ordinal, r.name, r.has_default, r.default) for r in params.orderBy("ordinal", "pos").collect()] == [("item", 0, "id", False, None), ("item", 0, "count", True, "1"), ("item", 0, "max", True, None), ("sex", 1, "v", False, None)]
    calls = spark.createDataFrame([("item", ["7"]), ("item", []), ("item", list("1234")), ("nope", ["1"])], "Type string, Parameters array<string>")
    got = {(r.Type, len(r.Parameters)): (r.bound, r.error) for r in lookups.bind_calls(calls, lookups.call_catalog(params)).collect()}
    assert got == {("item", 1): (["7", "1", None], None), ("item", 0): (None, "too few arguments"), ("item", 4): (None, "too many arguments"), ("nope", 1): (None, "unknown header")}


def document(path):
    """The text of a document, from its files in order."""
    return "".join(f.read_text() for f in sorted(Path(path).glob("part-*.txt")))


def test_containers_round_trip(spark, tmp_path):
    rows = [(1, 'a"b', None), (2, "c\\d", "x"), (3, "c\\d", "\n"), (10, "é", "y")]
    df = spark.createDataFrame(rows, "id long, g string, note string").repartition(3)
    made = {"keyed": (df, None, "id"), "listed": (df, None, None), "grouped": (df, "g", None), "both": (df, "g", "id"), "byname": (df, None, "g"), "none": (df.where("false"), None, "id")}
    containers.write_containers(spark, made, "server", str(tmp_path), order=["id"])
    row = lambda r: dict(zip(("id", "g", "note"), r, strict=True))
    got = {n: json.loads(document(f"{tmp_path}/server/json={n}")) for n in made}
    assert got["keyed"] == {str(r[0]): row(r) for r in rows} and got["listed"] == [row(r) for r in rows] and got["none"] == {}
    assert [*got["keyed"]] == ["1", "2", "3", "10"]
    groups = {g: [row(r) for r in rows if r[1] == g] for g in dict.fromkeys(r[1] for r in rows)}
    assert got["grouped"] == groups and got["both"] == {g: {str(r["id"]): r for r in rs} for g, rs in groups.items()}
    assert got["byname"]["c\\d"]["id"] == 2
    schema = "id long, g string, note string"
    back = containers.read_container(spark, f"{tmp_path}/server/json=keyed", schema, keyed=True)
    assert sorted(tuple(r) for r in back.collect()) == sorted((str(r[0]), *r) for r in rows)
    assert sorted(tuple(r) for r in containers.read_container(spark, f"{tmp_path}/server/json=listed", schema).collect()) == rows
    assert containers.read_container(spark, f"{tmp_path}/server/json=none", schema, keyed=True).count() == 0
    containers.write_crc(spark, f"{tmp_path}/server", f"{tmp_path}/crc")
    crc = json.loads(document(f"{tmp_path}/crc"))
    assert crc == {f"{n}.json": zlib.crc32(document(f"{tmp_path}/server/json={n}").encode()) for n in made}
    containers.write_containers(spark, {n: (d.repartition(7) if n == "listed" else d.coalesce(1), *keys) for n, (d, *keys) in made.items() if n != "both"}, "server", str(tmp_path), order=["id"])
    assert {k: v for k, v in crc.items() if k != "both.json"} == {r.file: r.crc32 for r in containers.document_checksums(spark, f"{tmp_path}/server").collect()}
    assert not (tmp_path / "server" / "json=both").exists()
    with pytest.raises(Exception, match="nowhere"):
        containers.write_containers(spark, {"keyed": (df.limit(1), None, "id"), "bad": (df.select(F.raise_error(F.lit("nowhere")).cast("long").alias("id")), None, "id")}, "server", str(tmp_path))
    assert json.loads(document(f"{tmp_path}/server/json=keyed")) == got["keyed"] and sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == ["crc", "server"]
    containers.write_lines(df, f"{tmp_path}/lines", ["g"])
    assert spark.read.json(f"{tmp_path}/lines").count() == 4
    repeated = df.union(df)
    assert json.loads("[" + containers.entries(repeated, None, None, order=["id"]).where("at.id = 1").first().entry + "]") == [row(rows[0])] * 2


def test_scoped_groups(spark):
    own = {"id": ("*int", 1), "g": ("(string)", 3), "seen": ("string", 2)}
    catalog = Catalog({"a": own, "b": own, "c": {"id": ("*int", 3)}}, groups={"b": "a", "c": "lost"})
    df = spark.createDataFrame([(1, "x", "y")], "id int, g string, seen string")
    made = containers.by_json({"a": df, "b": df, "c": df.select("id")}, catalog, 2)
    assert [*made] == ["a"] and made["a"][0].columns == ["g", "seen"] and made["a"][1:] == ("g", None) and made["a"][0].count() == 2
    assert containers.hidden_keys(catalog, 2) == [("a", "id"), ("b", "id")]


def test_raw_dump(spark, tmp_path):
    rows = spark.createDataFrame([("f", "s", 4, "g", True, "P"), ("f", "s", 5, "b", False, "1"), ("f", "s", 5, "a", False, '"'), ("f", "s", 6, "b", False, "2")], "file string, sheet string, row int, name string, bold boolean, value string")
    assert sorted(tuple(r)[2:] for r in containers.raw_dump(rows).collect()) == [("bold", 4, '{"g":"P"}'), ("normal", 5, '{"a":"\\"","b":"1"}'), ("normal", 6, '{"a":null,"b":"2"}')]
    containers.write_raw_dump(rows, f"{tmp_path}/dump")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/dump/file=f/sheet=s/part=normal").collect()) == ['{"a":"\\"","b":"1"}', '{"a":null,"b":"2"}']


def test_references_by_declared_types(spark):
    catalog = Catalog(
        {"category": {"id": ("*string", 3)}, "more": {"id": ("*string", 3)}, "item": {"id": ("*int", 3), "category": ("$category?", 3), "tags": ("[$category]", 3), "weights": ("{$category:int}", 3), "give": ("dsl?", 3)}, "quota": {"category": ("!$category", 3), "flag": ("!FLAG", 3), "bad": ("!$item.tags", 3)}},
        {"FLAG": {"A": 1, "B": 2}}, {"pick": [("what", "$category", False, None), ("many", "[$item]", True, None)]}, groups={"more": "category"},
    )
    cast = lambda name, rows, schema: cast_declared(spark.createDataFrame(rows, schema), catalog, name)
    tables = {
        "category": cast("category", [("a",), ("b",)], "id string"), "more": cast("more", [("m",)], "id string"),
        "item": cast("item", [("f1", 4, "1", "a", "a & zz", "b:1", "pick(m)"), ("f2", 5, "2", "x", "", "y:2 & a:1", "pick(w, 1 & 9)"), ("f2", 6, "3", "", "m", "", "")], "file string, row int, id string, category string, tags string, weights string, give string"),
        "quota": cast("quota", [("a", "A", "q")], "category string, flag string, bad string"),
    }
    place = ["file", "row"]
    own = {n: (df if n == "item" else df.withColumn("file", F.lit(n)).withColumn("row", F.lit(0))) for n, df in tables.items() if n != "quota"}
    found = references.reference_faults(own, catalog, place)
    want = {("f1", 4, "tags", "zz"), ("f2", 5, "category", "x"), ("f2", 5, "weights", "y"), ("f2", 5, "give", "w"), ("f2", 5, "give", "9")}
    assert {(r.file, r.row, r.column, r.value) for r in found.collect()} == want
    some = references.reference_faults(own, catalog, place, changed=spark.createDataFrame([("f1",)], "file string"))
    assert {(r.file, r.column) for r in some.collect()} == {("f1", "tags")}
    gaps = {(r.column, r.value, r.detail) for r in references.coverage_faults(tables, catalog).collect()}
    assert gaps == {("category", "b", None), ("flag", "B", None), ("bad", None, "must refer to the key")}


def test_scopes_and_orphans(spark):
    headers = spark.createDataFrame([("f", "S.x", 0, "a", "int", "server", False), ("f", "S.x", 1, "b", "int", "sever", False), ("f", "S.x", 2, "c", "int", None, False)], "file string, sheet string, col int, name string, type string, scope string, bold boolean")
    assert {(r.table, r.column, r.value) for r in cells.scope_faults(headers, ["server", "client", "common"]).collect()} == {("S", "b", "sever"), ("S", "c", None)}
    wide = spark.createDataFrame([("f", "s", 3, None, "0"), ("f", "s", 4, "P1", None), ("f", "s", 5, None, "1"), ("f", "s", 6, "P2", "2")], "file string, sheet string, row int, grp string, id string")
    owned = parents.parent_of(wide, F.col("grp"), ["file", "sheet"], ["row"])
    assert [(r.rule, r.row) for r in parents.orphans(owned, ["grp"], ["id"]).collect()] == [("orphan row", 3)]
    assert parents.orphans(owned, [], ["id"]).count() == 0


def test_incremental(spark, tmp_path):
    seal = "file string, crc32 long, length long, engine_version string"
    old = spark.createDataFrame([("a", 1, 1, "v"), ("b", 2, 2, "v"), ("c", 3, 3, "v"), ("e", 1, 1, "u")], seal)
    new = spark.createDataFrame([("a", 1, 1, "v"), ("b", 9, 2, "v"), ("d", 4, 4, "v"), ("e", 1, 1, "v")], seal)
    diff = incremental.manifest_diff(old, new).cache()
    assert {r.file: r.state for r in diff.collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "added", "e": "changed"}
    work = incremental.work_list(diff, spark.createDataFrame([("a",), ("c",)], "file string"))
    assert sorted(r.file for r in work.collect()) == ["a", "b", "d", "e"]
    rows = lambda v, *fs: spark.createDataFrame([("t", f, v) for f in fs], "table string, file string, x int")
    merged = incremental.merge_snapshots(rows(1, "a", "b", "c"), rows(2, "b", "d"), diff.where("file <> 'e'"))
    assert sorted((r.file, r.x) for r in merged.collect()) == [("a", 1), ("b", 2), ("d", 2)]
    incremental.write_snapshot(rows(1, "a", "b", "c"), f"{tmp_path}/s")
    got = incremental.refresh(spark, f"{tmp_path}/s", rows(2, "a", "b", "d"), spark.createDataFrame([("b",), ("d",)], "file string"))
    assert sorted((r.file, r.x) for r in got.collect()) == [("a", 1), ("b", 2), ("c", 1), ("d", 2)]
    (tmp_path / "f.bin").write_bytes(b"hello")
    files = spark.read.format("binaryFile").load(f"{tmp_path}/f.bin")
    assert files.select(fingerprint(F.col("content"))).first()[0] == "907060870.5"
    assert tuple(incremental.manifest(files, "v").first()) == ("f.bin", 907060870, 5, "v")
    bad = constraints.violations(rows(1, "a", "a"), "r", file=F.col("file"))
    incremental.write_error_files(bad, f"{tmp_path}/bad")
    assert spark.read.json(f"{tmp_path}/bad").count() == constraints.error_files(bad).count() == 1


def test_rules_on_planted_faults(spark):
    columns = spark.createDataFrame([("a", "s1", "id", "*int", 3, False), ("a", "s2", "id", "*long", 3, False), ("b", "s3", "id", "*int?", 1, False), ("b", "s3", "k", "*int", 1, False), ("b", "s3", "r", "$zz", 1, False)], "table string, sheet string, name string, type string, scope int, bold boolean")
    sheets = spark.createDataFrame([("a", "s1", None), ("a", "s2", "x"), ("b", "s3", "gone")], "table string, sheet string, based string")
    assert {(r.table, r.rule) for r in constraints.schema_differences(sheets, columns).collect()} == {("a", "columns differ"), ("a", "based differs")}
    assert {r.fault for r in constraints.key_declarations(columns.where("table = 'b'")).collect()} == {"several primary keys", "nullable key"}
    assert [tuple(r) for r in constraints.inheritance_faults(sheets.where("table = 'b'"), columns).collect()] == [("b", "gone", "unknown base")]
    assert [(r.leaf, r.fault) for r in constraints.reference_types(columns).collect()] == [("$zz", "unknown table")]
    assert constraints.invalid_names(spark.createDataFrame([("ok_1",), ("1bad",), ("has space",)], "n string"), "n").count() == 2
    nested = spark.createDataFrame([(1, ["a", None], {"k": 2})], "id int, l array<string>, m map<string,int>")
    assert sorted((r.part, r.leaf) for r in constraints.leaves(nested, ["id"], {"l": "list", "m": "map"}).collect()) == [("item", "a"), ("key", "k"), ("value", "2")]


def test_hooks(spark):
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    assert hooks.build(df, None) is df and hooks.build(df, lambda d: d.withColumn("x", F.lit(1))).columns == ["id", "t", "x"]
    assert hooks.decoding(df, F.upper).first().t == "A"
    hooks.built(df, lambda row: None)
    assert spark.range(1).select(hooks.to_call("f", [F.lit(1), F.lit("x")])).first()[0] == "f(1, x)"
    assert lookups.nth(df, ["id"], ["t"], 1).count() == 0 and df.select(lookups.nth_element(F.array("t"), 5)).first()[0] is None
