"""Queries beside their SQL on tables that once gave other results, and plans that once took more than they need."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quernstone.operators import constraints

TABLES = {
    "lineitem": "l_orderkey long, l_linenumber int, l_suppkey long",
    "orders": "o_orderkey long, o_custkey long",
    "customer": "c_custkey long",
    "supplier": "s_suppkey long, s_nationkey int",
    "nation": "n_nationkey int",
}


@pytest.mark.parametrize("given", [
    {"lineitem": [(1, 1, 1)], "orders": [(1, 1)], "customer": [(1,)], "supplier": [(1, 0), (6, 7)], "nation": [(7,)]},
    {"lineitem": [(None, 1, 9), (None, 1, None), (2, 1, 2), (2, 1, 2)], "orders": [(1, None), (2, 10)], "customer": [(1,), (10,)], "supplier": [(2, None), (9, 7)], "nation": [(7,), (None,)]},
    {name: [] for name in TABLES},
])
def test_violation_report_tells_of_rules_that_hold(spark, tmp_path, given):
    for name, schema in TABLES.items():
        spark.createDataFrame(given[name], schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = entry.queries()["violation_report"](spark, str(tmp_path)).select("rule", "table", "n").collect()
    want = con.execute(entry.oracle_sql()["violation_report"]).fetchall()
    assert Counter(map(tuple, got)) == Counter(want)


def test_words_of_texts_at_hand_are_learned_once(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from quernstone.llm import packing

    monkeypatch.setattr(packing, "_KEPT_WORDS", 1)
    encode = packing._ByteLevelIds(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = ["one two three\nfour two", "  odd  spaces\tthere two", "", "\n", "five <|endoftext|> 六 two"]
    want = [b"".join(n.to_bytes(4, "little") for n in x.ids) for x in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
    learn, learned = encode._learn, []
    monkeypatch.setattr(encode, "_learn", lambda words: (learned.extend(words), learn(words)))
    assert encode(texts) == want
    first, learned[:] = len(learned), []
    assert first and encode(texts[:1]) == want[:1] and encode(texts[:1]) == want[:1] and not learned


def test_places_of_a_popular_key_are_limited_before_the_shuffle(spark):
    rows = [(k if n % 7 else None, f"f{n % 3}", n) for k in (1, 2, 3) for n in range(k * k * 20)] + [(9, "f", 1)]
    df = spark.createDataFrame(rows, "k int, file string, row long").repartition(4)
    made = constraints.duplicate_places(df, ["k"], ["file", "row"], most=4)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "], row_number(), 4, Partial" in plan and "ObjectHashAggregate" not in plan
    want = {k: sorted((f, n) for key, f, n in rows if key == k) for k in (1, 2, 3)}
    assert {r.k: (r.n, [tuple(p) for p in r.places]) for r in made.collect()} == {k: (len(v), v[:4]) for k, v in want.items()}


def test_reference_types_sort_no_columns(spark, monkeypatch):
    columns = spark.createDataFrame([("A", "id", "*int"), ("B", "x", "int"), (None, "y", "*int"), ("A", "r1", "[$A]"), ("A", "r2", "{$B:$A.id}"), ("A", "r3", "$A.zz"), ("B", "r4", "$C.id"), ("B", "r5", "$B.x"), ("B", "r5", "$B"), (None, "r6", "$C")], "table string, name string, type string")
    want = [("A", "r2", "$B", "table without key"), ("A", "r3", "$A.zz", "unknown column"), ("B", "r4", "$C.id", "unknown table"), ("B", "r5", "$B", "table without key"), (None, "r6", "$C", "unknown table")]
    made = constraints.reference_types(columns)
    assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()
    shuffled = constraints.reference_types(columns, most=0)
    for found in (made, shuffled):
        assert Counter(map(tuple, found.select("table", "name", "leaf", "fault").collect())) == Counter(want)


def test_view_of_calls_parses_each_text_once(spark):
    from quernstone.functions import casts
    from quernstone.operators import hooks, lookups

    texts = spark.createDataFrame([(1, "item(7)"), (2, "item(8, 2)"), (3, "other(9)"), (4, "item("), (5, None), (6, "item(1, 2, 3)")], "n int, text string").repartition(2)
    catalog = spark.createDataFrame([("item", 0, "id", "int", False, None), ("item", 1, "count", "int", True, "1")], "header string, pos int, name string, type string, has_default boolean, default string")
    calls = casts.cast_columns(texts, {"c": (casts.to_call, F.col("text"))}).select("n", "c.value.Type", "c.value.Parameters")
    made = hooks.call_view(lookups.bind_calls(calls, lookups.call_catalog(catalog)), "item", [("id", "long"), ("count", "long")])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2 and not any("Filter" in line and "regexp_extract" in line for line in plan.splitlines())
    assert sorted(map(tuple, made.select("n", "typed.id", "typed.count").collect())) == [(1, 7, 1), (2, 8, 2), (6, None, None)]
