"""Workbooks through all rules to documents, and again for changed files only."""

import json
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quernstone.operators import conversion
from quernstone.operators.catalog import SCOPES, cast_declared
from quernstone.sources import prototypes, workbooks
from tests.test_operators import document, workbook

ITEM = [["json: item"], ["id", "category", "tags", "give"], ["*int", "$category", "[FLAGS]", "dsl?"], ["common", "common", "server", "client"], [1, "a", "A & B"], [2, "b", None, "item(1)"], ["Const:Raid:Fee", "a", "A"]]
CATEGORY = [["id", "note"], ["*string", "string?"], ["common", "server"], ["a", 'x"y'], ["b"]]
DROP = [["day*", "id", "item"], ["*string", "*int", "$item"], ["common", "common", "common"], ["mon"], [None, 1, 1], [None, 2, 3], ["tue"], [None, 1, 2]]
DSL = json.dumps({"item": [{"name": "id", "type": "$item"}, {"name": "count", "type": "uint", "default": 1}]})


def converted(spark, folder, **books):
    for name, sheets in books.items():
        workbook(folder / f"{name}.xlsx", sheets)
    sources = workbooks.list_sources(spark, str(folder))
    cells = {k: workbooks.workbook_cells(sources.where(F.col("kind") == k)) for k in ("data", "const", "enum")}
    return conversion.convert(cells["data"], cells["const"], cells["enum"], prototypes.read_prototypes(spark.createDataFrame([(DSL,)], "value string")), width=3)


def lookups():
    return {"const": {"Raid": [["Fee", "server", "int", "3"]]}, "enum": {"FLAGS": [["A", "1"], ["B", "A | 0x2"]]}}


def test_clean_workbooks_become_documents(spark, tmp_path):
    made = converted(spark, tmp_path, data={"item.a": ITEM, "category": CATEGORY}, drop={"drop": DROP}, **lookups())
    assert made.faults.collect() == []
    assert sorted((r.parent, r.id, r.item) for r in made.tables["drop"].collect()) == [("mon", 1, 1), ("mon", 2, 3), ("tue", 1, 2)]
    assert sorted(r.day for r in made.tables["drop_attribute"].collect()) == ["mon", "tue"]
    assert conversion.publish(made, f"{tmp_path}/out") == 0
    read = lambda scope, name: json.loads(document(f"{tmp_path}/out/json/{scope}/json={name}"))
    assert read("server", "category") == {"a": {"id": "a", "note": 'x"y'}, "b": {"id": "b", "note": None}} and read("client", "category") == {"a": {"id": "a"}, "b": {"id": "b"}}
    row = lambda p, i, item: {"parent": p, "id": i, "item": item}
    assert read("client", "drop") == {"mon": {"1": row("mon", 1, 1), "2": row("mon", 2, 3)}, "tue": {"1": row("tue", 1, 2)}}
    assert read("server", "drop_attribute") == {"mon": {"day": "mon"}, "tue": {"day": "tue"}}
    assert {k: [*v] for k, v in read("server", "item").items()} == dict.fromkeys("123", ["id", "category", "tags"]) and read("client", "item")["2"]["give"]["Parameters"] == [1, 1]
    assert read("server", "item")["1"]["tags"] == ["A", "B"]
    crc = json.loads(document(f"{tmp_path}/out/crc/server"))
    assert crc == {f"{n}.json": zlib.crc32(document(f"{tmp_path}/out/json/server/json={n}").encode()) for n in ("category", "drop", "drop_attribute", "item")}
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out/diff/file=drop.xlsx/sheet=drop/part=bold").collect()) == ['{"day":"mon"}', '{"day":"tue"}']


def test_every_fault_is_told_and_nothing_written(spark, tmp_path):
    item = [["row", "id", "category", "n", "gone", "tags", "bad name"], ["int", "*int", "$category", "uint8", "$lost", "![FLAGS", "int?"], ["common", "common", "common", "common", "sever", "common", "common"], [1, 1, "a", 300], [1, 1, "zz", 3]]
    drop = [["day*", "id", "item"], ["*string", "*int", "$item"], ["common", "common", "common"], [None, 7, 1], ["mon"], ["mon"], [None, 1, 1], [None, 1, 1]]
    made = converted(spark, tmp_path, data={"item": item, "category": CATEGORY}, drop={"drop": drop}, const={"Raid": [["Fee", "server", "int", "Const:Raid:Fee"]]}, enum={"FLAGS": [["A", "B"], ["B", "A"], ["B", "1"]]})
    found = {(r.rule, r.table, r.column, r.value) for r in made.faults.collect()}
    assert {
        ("scope", "row"), ("unknown scope", "gone"), ("declaration", "row"), ("declaration", "gone"), ("declaration", "tags"), ("declaration", "Fee"), ("name", "bad name"), ("cast", "n"),
        ("unknown reference", "category"), ("key repeated", "id"), ("key repeated", "day"), ("orphan row", None), ("enum repeated", "B"), ("enum", "A"),
    } - {(r, c) for r, _, c, _ in found} == {("scope", "row")}
    assert ("unknown reference", "item", "category", "zz") in found and ("key repeated", "drop", "id", "1") in found
    told = ("rule", "file", "sheet", "table", "column", "row", "value", "detail")
    shown = lambda df: Counter(tuple(r[c] for c in told) for r in df.collect() if r.rule not in ("combined enum key", "not covered"))
    sources = workbooks.list_sources(spark, str(tmp_path))
    cells = {k: workbooks.workbook_cells(sources.where(F.col("kind") == k)) for k in ("data", "const", "enum")}
    calls = prototypes.read_prototypes(spark.createDataFrame([(DSL,)], "value string"))
    assert shown(conversion.validate(cells["data"], cells["const"], cells["enum"], calls, width=3)) == shown(made.faults)
    assert conversion.publish(made, f"{tmp_path}/out") == len(made.faults.collect()) > 0
    assert not (tmp_path / "out" / "json").exists()
    assert {r.file for r in spark.read.json(f"{tmp_path}/out/error_files").collect()} >= {"data.xlsx", "drop.xlsx"}


def test_only_changed_files_are_read_again(spark, tmp_path):
    books = tmp_path / "books"
    books.mkdir()
    files = lambda *names: spark.createDataFrame([(n,) for n in names], "file string")
    seen = lambda work: sorted((r.file, r.sheet, r.value) for r in conversion.refreshed_cells(workbooks.list_sources(spark, str(books)), f"{tmp_path}/cells", work).collect())
    for name in "abc":
        workbook(books / f"{name}.xlsx", {"one": [[name]], "two": [["x"]]})
    assert len(seen(files("a.xlsx", "b.xlsx", "c.xlsx"))) == 6
    workbook(books / "a.xlsx", {"one": [["new"]]})
    workbook(books / "b.xlsx", {"one": [["unseen"]]})
    (books / "c.xlsx").unlink()
    assert seen(files("a.xlsx")) == [("a.xlsx", "one", "new"), ("b.xlsx", "one", "b"), ("b.xlsx", "two", "x")]
    workbook(books / "a.xlsx", {"one": [[None]]})
    assert {f for f, _, _ in seen(files("a.xlsx"))} == {"b.xlsx"}


def test_no_tables(spark, tmp_path):
    made = conversion.convert(spark.createDataFrame([], workbooks.CELLS))
    assert made.tables == {} and made.faults.count() == 0 and conversion.publish(made, f"{tmp_path}/out") == 0
    assert SCOPES["common"] == 3


def test_unchanged_files_and_tables_are_not_cast_again(spark, tmp_path, monkeypatch):
    """After a change only the rows of changed files, or of tables whose declarations changed, are cast; the result is that of a full run."""
    books, state = tmp_path / "books", f"{tmp_path}/state"
    books.mkdir()
    cast_rows = {}

    def counted(df, catalog, table):
        own = df.groupBy("file").count().collect()
        cast_rows.update({(table, r.file): r["count"] for r in own})
        return cast_declared(df, catalog, table)

    def run(compared=False):
        cast_rows.clear()
        sources = workbooks.list_sources(spark, str(books))
        data = sources.where(F.col("kind") == "data").select("path", "content")
        other = {k: workbooks.workbook_cells(sources.where(F.col("kind") == k)) for k in ("const", "enum")}
        calls = prototypes.read_prototypes(spark.createDataFrame([(DSL,)], "value string"))
        with monkeypatch.context() as m:
            m.setattr(conversion, "cast_declared", counted)
            made, remember = conversion.reconvert(data, state, "1", other["const"], other["enum"], calls, width=3)
        done = {*cast_rows}
        if compared:
            whole = conversion.convert(workbooks.workbook_cells(data), other["const"], other["enum"], calls, width=3)
            shown = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
            assert made.tables.keys() == whole.tables.keys() and shown(made.faults) == shown(whole.faults)
            for name, df in whole.tables.items():
                assert shown(made.tables[name]) == shown(df), name
        remember()
        return done

    other = [["id", "category"], ["*int", "$category"], ["common", "common"], [7, "a"]]
    item = [*ITEM[:4], *ITEM[5:]]
    workbook(books / "data.xlsx", {"item.a": [[*r[:3]] for r in item], "category": CATEGORY})
    workbook(books / "more.xlsx", {"other": other})
    for name, sheets in lookups().items():
        workbook(books / f"{name}.xlsx", sheets)
    assert run() == {("item", "data.xlsx"), ("category", "data.xlsx"), ("other", "more.xlsx")}
    workbook(books / "more.xlsx", {"other": [*other, [8, "gone"]]})
    workbook(books / "const.xlsx", {"Raid": [["Fee", "server", "int", "4"]]})
    assert run(compared=True) == {("other", "more.xlsx"), ("item", "data.xlsx")}
    (books / "more.xlsx").unlink()
    workbook(books / "enum.xlsx", {"FLAGS": [["A", "1"], ["B", "A | 0x4"]]})
    assert run() == {("item", "data.xlsx")}


def test_references_to_values_that_went(spark, tmp_path, monkeypatch):
    """After any mix of edits the index gives the faults of a full check, and looks at no more than it must."""
    books, state, asked = tmp_path / "books", f"{tmp_path}/state", []
    books.mkdir()
    of = conversion.reference_index.suspects
    counted = lambda *given: asked.append(of(*given).count()) or of(*given)
    monkeypatch.setattr(conversion.reference_index, "suspects", counted)
    shown = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))

    def run(remembered=True):
        data = workbooks.list_sources(spark, str(books)).select("path", "content")
        made, remember = conversion.reconvert(data, state, "1", width=3)
        whole = conversion.convert(workbooks.workbook_cells(data), width=3)
        faults = shown(made.faults)
        assert faults == shown(whole.faults)
        if remembered:
            remember()
        return sum("unknown reference" in f for f in faults), asked.pop()

    def users(name, *values):
        workbook(books / f"{name}.xlsx", {f"{name}": [["id", "ones"], ["*int", "[$key]"], ["common", "common"], *[[k, v] for k, v in enumerate(values)]]})

    def keys(name, *values):
        workbook(books / f"{name}.xlsx", {f"key.{name}": [["id"], ["*string"], ["common"], *[[v] for v in values]]})

    keys("k", "a", "b")
    keys("l", "c")
    users("u", "a & b", "c & c")
    users("w", "a", "x")
    assert run() == (1, 6)
    # the value c goes with its file, from an unchanged file two references are lost; w is faulty and so read again
    (books / "l.xlsx").unlink()
    assert run() == (3, 4)
    # a run that isn't remembered leaves an index that the next one goes on from
    keys("k", "b", "c")
    users("w", "x", "b")
    assert run(remembered=False) == (2, 6)
    keys("k", "b")
    keys("m", "a", "x", "c")
    assert run() == (0, 6)
