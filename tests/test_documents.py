"""Values of documents by declared types, checksums of wholes, and declarations that used to break a conversion."""

import json
import random
import tracemalloc
import zlib

import pytest
from pyspark.sql import functions as F

from quernstone.functions import checksums
from quernstone.operators import containers, conversion, incremental, parents, references
from quernstone.operators.catalog import Catalog, cast_declared
from quernstone.operators.documents import written_columns
from quernstone.sources import workbooks
from tests.test_operators import workbook

CATALOG = Catalog(
    {
        "t": {
            "id": ("*FLAGS", 3), "one": ("FLAGS?", 3), "many": ("[FLAGS]", 3), "span": ("TimeSpan?", 3), "day": ("DateTime?", 3), "period": ("DateRange?", 3), "at": ("point?", 3), "area": ("size?", 3), "reach": ("range?", 3),
            "number": ("double?", 3), "yes": ("bool?", 3), "big": ("ulong?", 3), "text": ("string?", 3), "spans": ("{TimeSpanKey:[int]}", 3), "names": ("{FLAGS:string}", 3), "call": ("dsl?", 3), "next": ("~t?", 3),
        }
    },
    {"FLAGS": {"A": 1, "B": 2, "C": 4}}, {"f": [("n", "int", False, None), ("flags", "[FLAGS]", False, None), ("wait", "TimeSpan?", True, "01:00:00")], "g": []},
)
CATALOG.columns["t"]["spans"] = ("{int:[int]}", 3)


def rows_of(spark, *rows):
    names = [*CATALOG.columns["t"]]
    df = spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], ", ".join(f"{c} string" for c in names))
    made = cast_declared(df, CATALOG, "t")
    assert [r.errors for r in made.select("errors").collect()] == [[]] * len(rows)
    return made.drop("errors")


def test_values_by_types(spark):
    made = rows_of(
        spark,
        {"id": "A", "one": "A | B", "many": "A & C", "span": "-1.02:03:04.5", "day": "2020-01-02", "period": "2020-01-02 ~ 2020-01-03 04:05:06", "at": "1, 2", "area": "3,4", "reach": "5 ~ 6", "number": "1.5", "yes": "TRUE",
         "big": "18446744073709551615", "text": 'q"\\\n', "spans": "1:2 & 3:4", "names": "A:x & B:y", "call": "f(7, A & B)", "next": "5"},
        {"id": "B", "one": "C", "span": "00:00:01", "period": "01:00:00", "call": "g()", "many": "", "spans": "", "names": ""},
        {"id": "A | C", "call": "f(-1, C, )", "many": "B", "span": "10.00:00", "spans": "", "names": ""},
    )
    got = {r.key: json.loads(r.entry) for r in containers.entries(made, None, "id", values=written_columns(CATALOG, ["t"])).collect()}
    none = dict.fromkeys(CATALOG.columns["t"])
    assert got == {
        '"A"': {**none, "id": "A", "one": 3, "many": ["A", "C"], "span": "-1.02:03:04.5000000", "day": "2020-01-02 00:00:00", "period": {"Start": "2020-01-02 00:00:00", "End": "2020-01-03 04:05:06"}, "at": {"x": 1, "y": 2},
                "area": {"width": 3, "height": 4}, "reach": {"min": 5, "max": 6}, "number": 1.5, "yes": True, "big": 18446744073709551615, "text": 'q"\\\n', "spans": {"1": [2], "3": [4]}, "names": {"A": "x", "B": "y"},
                "call": {"Type": "f", "Parameters": [7, ["A", "B"], "01:00:00"]}, "next": 5},
        '"B"': {**none, "id": "B", "one": "C", "span": "00:00:01", "period": {"Start": "0001-01-01 00:00:00", "End": "0001-01-01 01:00:00"}, "call": {"Type": "g", "Parameters": []}, "many": [], "spans": {}, "names": {}},
        '"5"': {**none, "id": 5, "call": {"Type": "f", "Parameters": [-1, ["C"], None]}, "many": ["B"], "span": "10.00:00:00", "spans": {}, "names": {}},
    }


def test_enum_keys_are_compared_by_name(spark):
    catalog = Catalog({"a": {"id": ("*E", 3)}, "b": {"to": ("$a", 3)}}, {"E": {"G": 2, "H": 4}})
    cast = lambda name, c, *vs: cast_declared(spark.createDataFrame([(v, "f") for v in vs], f"{c} string, file string"), catalog, name)
    found = references.reference_faults({"a": cast("a", "id", "G"), "b": cast("b", "to", "G", "H")}, catalog, ["file"]).collect()
    assert [(r.column, r.value) for r in found] == [("to", "H")]


def test_checksums_of_wholes(spark):
    random.seed(5)
    parts = [(g, k, random.randbytes(random.choice([0, 1, 3, 1000, 70_000]))) for g in ("a", "b", None) for k in range(9)]
    df = spark.createDataFrame([(g, k, zlib.crc32(p), len(p)) for g, k, p in parts], "g string, k int, crc32 long, length long").repartition(5)
    want = {g: b"".join(p for h, _, p in parts if h == g) for g in ("a", "b", None)}
    assert {r.g: (r.crc32, r.length) for r in checksums.combined(df, ["g"], ["k"]).collect()} == {g: (zlib.crc32(p), len(p)) for g, p in want.items()}
    assert checksums.combined(df.where("false"), ["g"], ["k"]).count() == 0
    zeros = spark.range(1).select(checksums.shifted(F.lit(zlib.crc32(b"x")), F.lit(1 << 20)).alias("c")).first().c
    assert zeros ^ zlib.crc32(bytes(1 << 20)) == zlib.crc32(b"x" + bytes(1 << 20))


def test_large_sheets_in_bounded_memory(spark, tmp_path):
    rows = [[f"text {k}", k, None, "shared", "bold*"] for k in range(30_000)]
    workbook(tmp_path / "large.xlsx", {"one": rows, "two": [["x"]], "none": []})
    content = (tmp_path / "large.xlsx").read_bytes()
    tracemalloc.start()
    count = {name: sum(1 for _ in found) for name, found in workbooks._sheets(content)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == {"one": 120_000, "two": 1, "none": 0} and peak < 4_000_000
    cells = workbooks.workbook_cells(workbooks.list_sources(spark, str(tmp_path)), 7000)
    got = cells.groupBy("sheet", "col").agg(F.count("*").alias("n"), F.max("row").alias("last"), F.min("value").alias("least"), F.max("bold").alias("bold")).collect()
    assert sorted(tuple(r) for r in got) == [("one", 0, 30000, 29999, "text 0", False), ("one", 1, 30000, 29999, "0", False), ("one", 3, 30000, 29999, "shared", False), ("one", 4, 30000, 29999, "bold", True), ("two", 0, 1, 0, "x", False)]


def book(spark, sheet, header, *body):
    rows = [(r, c, v) for r, line in enumerate([*zip(*header, strict=True), *body]) for c, v in enumerate(line) if v is not None]
    return spark.createDataFrame([("f.xlsx", sheet, r, c, "string", str(v), False) for r, c, v in rows], "file string, sheet string, row int, col int, kind string, value string, bold boolean")


def test_the_plan_of_a_validation_does_not_grow_with_tables(spark):
    kinds = ["*int", "string?", "uint8", "double", "[int]", "{int:string}", "$t0"]
    cell = {"*int": "{r}", "string?": "x", "uint8": "7", "double": "1.5", "[int]": "1 & 2", "{int:string}": "1:a", "$t0": "1"}

    def cells(n):
        tables = [[(0, k, f"c{k}"), (1, k, kind), (2, k, "common"), *((3 + r, k, cell[kind].format(r=r)) for r in range(3))] for _ in range(n) for k, kind in enumerate(kinds)]
        rows = [("b.xlsx", f"t{j // len(kinds)}", r, c, "string", v, False) for j, some in enumerate(tables) for r, c, v in some]
        wrong = {("t1", 3, 2): "300", ("t1", 4, 6): "99", ("t2", 5, 0): "0", ("t2", 5, 3): None}
        rows = [(f, s, r, c, k, wrong.get((s, r, c), v), b) for f, s, r, c, k, v, b in rows]
        return spark.createDataFrame(rows, "file string, sheet string, row int, col int, kind string, value string, bold boolean")

    lines = []
    for n in (3, 40):
        found = conversion.validate(cells(n))
        lines.append(found._jdf.queryExecution().analyzed().toString().count("\n"))
        assert sorted((r.rule, r.table, r.column, r.row, r.value) for r in found.collect()) == [
            ("cast", "t1", "c2", 3, "300"), ("cast", "t2", "c3", 5, None), ("key repeated", "t2", "c0", 3, "0"), ("unknown reference", "t1", "c6", 4, "99"),
        ]
    assert lines[0] == lines[1]


def prototypes(spark, **calls):
    rows = [(h, 0, k, n, t, False, None) for h, ps in calls.items() for k, (n, t) in enumerate(ps)]
    return spark.createDataFrame(rows, "header string, ordinal int, pos int, name string, type string, has_default boolean, default string")


def test_calls_without_references_and_calls_in_calls(spark):
    sheet = book(spark, "a", [("id", "*int", "common"), ("c", "dsl", "common")], (1, "f(1)"), (2, "g(f(1))"))
    assert {r.rule for r in conversion.convert(sheet.where("row < 4")).faults.collect()} == set()
    assert conversion.convert(sheet.where("row < 4"), params=prototypes(spark, f=[("n", "int")])).faults.count() == 0
    made = conversion.convert(sheet, params=prototypes(spark, f=[("n", "int")], g=[("c", "[dsl]")]))
    assert {(r.rule, r.table, r.column, r.detail) for r in made.faults.collect()} == {("declaration", "g", "c", "a call can't be an argument of a call"), ("cast", "a", "c", "unknown header")}


def test_long_chains_of_declarations():
    n = 3000
    catalog = Catalog({f"t{k}": {"id": (f"*$t{k + 1}" if k < n else "*int", 3)} for k in range(n + 1)}, consts={("C", f"n{k}"): ("int", f"Const:C:n{k + 1}" if k < n else "7") for k in range(n + 1)})
    assert catalog.root("$t0").name == "int" and catalog.const_text("C", "n0") == "7"
    catalog.columns[f"t{n}"]["id"] = ("*$t5", 3)
    catalog.consts["C", f"n{n}"] = ("int", "Const:C:n9")
    with pytest.raises(ValueError, match="cycle"):
        catalog.root("$t0")
    with pytest.raises(ValueError, match="cycle"):
        catalog.const_text("C", "n0")


def test_names(spark):
    sheet = book(spark, "a", [("Id", "*int", "common"), ("id", "int", "common")], (1, 2))
    assert [(r.rule, r.column) for r in conversion.convert(sheet).faults.collect()] == [("declaration", "id")]
    consts = book(spark, "C", [("bad name", "server", "int", "1"), ("ok", "server", "int", "2")])
    enums = book(spark, "E", [("bad-name", "1"), ("ok", "2")])
    turned = lambda df: df.select("file", "sheet", F.col("col").alias("row"), F.col("row").alias("col"), "kind", "value", "bold")
    made = conversion.convert(sheet.where("col = 0"), turned(consts), turned(enums))
    assert {(r.rule, r.table, r.column, r.file) for r in made.faults.collect()} == {("name", "C", "bad name", "f.xlsx"), ("name", "E", "bad-name", "f.xlsx")}


def test_nulls_in_groups_keys_and_names_of_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([(None, 1, "p", None), (None, 2, None, "x"), ("s", 1, "q", None), ("s", 9, None, "y")], "sheet string, row int, key string, v string")
    assert sorted((r.v, r.parent) for r in parents.parent_of_ranged(rows, "key", ["sheet"], "row", 3).where("v is not null").collect()) == [("x", "p"), ("y", "q")]
    keyed = spark.createDataFrame([("g", None, 1), ("g", "k", 2)], "g string, k string, n int")
    assert [list(r.container) for r in containers.to_grouped_keyed(keyed, "g", "k", ["n"]).collect()] == [["k"]]
    assert [r.entry for r in containers.entries(keyed, "g", "k", ["n"]).collect()] == ['{"k":{"n":2}}']
    named = spark.createDataFrame([("001", "2020-01-01", 1)], "table string, file string, x int")
    got = incremental.refresh(spark, f"{tmp_path}/s", named, named.select("file")).collect()
    assert [tuple(r) for r in got] == [("001", "2020-01-01", 1)]
