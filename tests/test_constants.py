"""Constants joined to the rows that name them."""

import pytest
from pyspark.sql import functions as F

from quernstone.operators import constants
from quernstone.operators.catalog import Catalog, cast_declared
from quernstone.operators.documents import written_columns


def test_places_of_constants(spark):
    kinds = {"n": "int?", "list": "[int]", "flag": "FLAGS?", "flags": "[FLAGS]", "word": "string?", "call": "dsl?"}
    consts = {("C", "two"): ("int", "Const:C:end"), ("C", "end"): ("int", "2"), ("C", "both"): ("FLAGS", "A|B"), ("C", "word"): ("string", "x & y"), ("C", "empty"): ("string", None)}
    calls = {"f": [("n", "int", False, None), ("words", "[string]", True, "Const:C:word"), ("flags", "[FLAGS]", True, "A")]}
    catalog = Catalog({"t": {c: (kind, 3) for c, kind in kinds.items()}}, {"FLAGS": {"A": 1, "B": 2}}, calls, consts)
    rows = [
        ("Const:C:two", "1 & Const:C:two & 3", "Const:C:both", "A & Const:C:both", "Const:C:word", "f(Const:C:two, a & Const:C:word, Const:C:both & B)"),
        ("7", "", "A | B", "B", "Const:C:empty", "f(1)"),
        ("Const:C:two", "Const:C:none & 1", "Const:D:both", "Const:C:two & A", "Const:C:two", "f(Const:C:none)"),
        (None,) * 6,
    ]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], ", ".join(f"{c} string" for c in kinds) + ", __constants int")
    made = cast_declared(df, catalog, "t")
    assert made.columns == [*df.columns, "errors"]
    a, b, c, d = made.orderBy("__constants").collect()
    assert (a.n, a.list, a.flag.mask, [x.mask for x in a.flags], a.word, a.errors) == (2, [1, 2, 3], 3, [1, 3], "x & y", [])
    assert (b.n, b.list, b.word, b.call.Parameters, b.errors) == (7, [], None, ["1", "x & y", "A"], [])
    assert {(e.column, e.error) for e in c.errors} == {("list", "unknown const"), ("flag", "unknown const table"), ("flags", "const of another type"), ("word", "const of another type"), ("call", "n: unknown const")}
    assert d.n is None and not d.errors
    # documents read the arguments without the constants; an item may hold a separator
    call = written_columns(catalog, ["t"])["call"]
    assert made.where("__constants = 0").select(call.json(F.col("call"))).first()[0] == '{"Type":"f","Parameters":[2,["a","x & y"],[3,"B"]]}'


@pytest.mark.parametrize("few", [0, 100_000])
def test_hold_by_both_joins(spark, monkeypatch, few):
    monkeypatch.setattr(constants, "_FEW", few)
    texts = spark.createDataFrame([("Const:A:a", "1", "int"), ("Const:A:b", "2", "int")], "token string, text string, kind string")
    df = spark.createDataFrame([("Const:A:a & Const:A:b", 1), ("Const:A:b", 2), ("Const:A:b", 2), ("plain", 3), (None, 4), ("Const:A:c", 5)], "c string, k int")
    found = [(r.k, sorted((t, v.text) for t, v in (r.h or {}).items())) for r in constants.hold(df, [F.col("c")], texts, "h").collect()]
    assert sorted(found) == [(1, [("Const:A:a", "1"), ("Const:A:b", "2")]), (2, [("Const:A:b", "2")]), (2, [("Const:A:b", "2")]), (3, []), (4, []), (5, [])]
    none = constants.hold(df.where("k in (3, 4)"), [F.col("c")], texts, "h").collect()
    assert len(none) == 2 and all(r.h is None for r in none)
    assert constants.hold(df.limit(0), [F.col("c")], texts, "h").count() == 0


def test_very_many_constants(spark):
    n = 100_000
    consts = {("C", f"n{k}"): ("int", f"Const:C:n{k - 1}" if k % 50 else str(k)) for k in range(n)}
    ends = Catalog(consts=consts).const_ends()
    assert ends["C", "n49"] == "0" and ends["C", "n99999"] == "99950" and len(ends) == n
    catalog = Catalog({"t": {"one": ("int", 3), "some": ("[int]", 3)}}, consts=consts)
    df = spark.range(n).select("id", F.format_string("Const:C:n%d", "id").alias("one"), F.format_string("5 & Const:C:n%d", (F.col("id") * 7 % n)).alias("some"))
    made = cast_declared(df, catalog, "t")
    wrong = made.where("size(errors) > 0 or one <> id - id % 50 or some[0] <> 5 or some[1] <> id * 7 % 100000 - (id * 7 % 100000) % 50 or one is null")
    assert wrong.count() == 0 and made.count() == n
    assert "n99999" not in made._jdf.queryExecution().toString()


def test_circles_of_constants_have_no_end():
    consts = {("C", "a"): ("int", "Const:C:b"), ("C", "b"): ("int", "Const:C:a"), ("C", "in"): ("int", "Const:C:a"), ("C", "ok"): ("int", "Const:C:one"), ("C", "one"): ("int", "1"), ("C", "out"): ("int", "Const:D:x")}
    assert Catalog(consts=consts).const_ends() == {("C", "ok"): "1", ("C", "one"): "1", ("C", "out"): "Const:D:x"}
