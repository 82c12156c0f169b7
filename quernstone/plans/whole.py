"""Cells of the tables through the whole conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import checksums
from quernstone.operators import constraints, containers
from quernstone.operators.catalog import CLIENT, COMMON, Catalog, cast_declared
from quernstone.operators.checkpoints import cut
from quernstone.operators.conversion import convert, validate
from quernstone.operators.documents import written_columns
from quernstone.plans.registry import query


def _sheet(sheet: str, header: list[tuple[str, str, str]], bold: int, body: DataFrame) -> DataFrame:
    """Cells of a sheet from its columns (name, type, scope), the first ``bold`` of them bold, and (row, col, value) below."""
    head = [(r, c, text, c < bold) for c, column in enumerate(header) for r, text in enumerate(column)]
    top = body.sparkSession.createDataFrame(head, "row long, col int, value string, bold boolean")
    cells = top.union(body.select("row", "col", "value", F.lit(False))).where("value is not null")
    return cells.select(F.lit("book.xlsx").alias("file"), F.lit(sheet).alias("sheet"), "row", "col", F.lit("string").alias("kind"), "value", "bold")


def _cells(t, nation: Column, balance: Column) -> DataFrame:
    """Nations as parents of their customers in one sheet, and regions, to which nations refer, in another."""
    line = lambda base, k: F.col(base).cast("long") * 80_000_000 + k + 10
    cell = lambda row, values, first=0: F.explode(F.array(*[F.struct(row.alias("row"), F.lit(first + n).alias("col"), v.cast("string").alias("value")) for n, v in enumerate(values)])).alias("c")
    nations = t("nation").select(cell(line("n_nationkey", F.lit(0)), [F.col("n_nationkey"), F.col("n_regionkey")])).select("c.*")
    customers = t("customer").select(cell(line("c_nationkey", 1 + F.col("c_custkey")), [F.col("c_custkey"), F.col("c_mktsegment"), nation, balance], 2)).select("c.*")
    header = [("nation", "*int", "common"), ("region", "$Region", "common"), ("id", "*int", "common"), ("segment", "string", "client"), ("home", "$Place_attribute", "common"), ("balance", "double", "server")]
    regions = t("region").select(cell(F.col("r_regionkey").cast("long") + 10, [F.col("r_regionkey"), F.col("r_name")])).select("c.*")
    return _sheet("Place.all", header, 2, nations.union(customers)).union(_sheet("Region", [("id", "*int", "common"), ("name", "string", "common")], 0, regions))


@query("""select '"' || c_nationkey || '"' as key, '{' || string_agg('"' || c_custkey || '":{"parent":' || c_nationkey || ',"id":' || c_custkey || ',"segment":"' || c_mktsegment || '","home":' || c_nationkey || '}', ',' order by c_custkey) || '}' as entry from customer group by c_nationkey""")
def converted_document(t):
    """The entries of the document that the client gets of the customers, by nation."""
    made = convert(_cells(t, F.col("c_nationkey"), F.col("c_acctbal")))
    rows, gk, pk = containers.by_json(made.tables, made.catalog, CLIENT)["Place"]
    return containers.entries(rows, gk, pk).select("key", "entry")


_FAULTS = """select 'unknown reference' as rule, 'Place' as "table", 'home' as "column", c_nationkey::bigint * 80000000 + c_custkey + 11 as row, (1000 + c_nationkey)::varchar as value from customer where c_custkey % 5 = 0
    union all select 'cast', 'Place', 'balance', c_nationkey::bigint * 80000000 + c_custkey + 11, 'b' || c_custkey from customer where c_custkey % 7 = 0"""


def _faulty(t) -> DataFrame:
    """Cells where some customers name a nation that isn't there and the balance of some is no number."""
    own = F.col("c_custkey")
    nation = F.when(own % 5 == 0, 1000 + F.col("c_nationkey")).otherwise(F.col("c_nationkey"))
    balance = F.when(own % 7 == 0, F.concat(F.lit("b"), own.cast("string"))).otherwise(F.col("c_acctbal").cast("string"))
    return _cells(t, nation, balance)


@query(_FAULTS)
def conversion_faults(t):
    """All violations that a conversion tells of."""
    return convert(_faulty(t)).faults.select("rule", "table", "column", "row", "value")


@query(_FAULTS)
def validation_faults(t):
    """The same from cells in long form."""
    return validate(_faulty(t)).select("rule", "table", "column", "row", "value")


_VALUES = Catalog(
    {"order": {k: (kind, COMMON) for k, kind in {
        "id": "*int", "flag": "FLAGS", "flags": "[FLAGS]", "wait": "TimeSpan", "period": "DateRange", "price": "{string:long}", "at": "point", "give": "dsl", "note": "string?",
    }.items()}},
    {"FLAGS": {"A": 1, "B": 2}}, {"item": [("id", "int", False, None), ("wait", "TimeSpan", True, "01:00:00")]},
)


@query("""select '"' || o_orderkey || '"' as key, '{"id":' || o_orderkey || ',"flag":' || case o_orderkey % 3 when 0 then '"A"' when 1 then '"B"' else '3' end || ',"flags":' || case o_orderkey % 2 when 0 then '["A","B"]' else '["B"]' end
    || ',"wait":"' || case when o_custkey % 3 = 0 then '' else (o_custkey % 3) || '.' end || printf('%02d:%02d:%02d', o_orderkey % 24, o_custkey % 60, o_orderkey % 60) || '"'
    || ',"period":{"Start":"' || strftime(o_orderdate::date, '%Y-%m-%d') || ' 00:00:00","End":"' || strftime(o_orderdate::date + 1, '%Y-%m-%d') || ' 00:00:00"},"price":{"all":' || round(o_totalprice)::bigint || ',"none":0}'
    || ',"at":{"x":' || (o_orderkey % 100) || ',"y":' || (o_custkey % 100) || '},"give":{"Type":"item","Parameters":[' || (o_custkey % 9) || ',"' || case o_orderkey % 2 when 0 then '01:00:00' else '00:00:0' || (o_custkey % 10) end || '"]}'
    || ',"note":' || case o_orderkey % 5 when 0 then 'null' else '"' || o_orderstatus || '\\"' || o_orderpriority || '"' end || '}' as entry from orders""")
def document_values(t):
    """Orders as members of a document, with an enum, lists, a map, a span, a range, a pair, a call and a text that may be null."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.col("o_orderdate").cast("date")
    text = {
        "id": key, "flag": F.when(key % 3 == 0, "A").when(key % 3 == 1, "B").otherwise("A | B"), "flags": F.when(key % 2 == 0, "A & B").otherwise("B"),
        "wait": F.concat((customer % 3).cast("string"), F.lit("."), two(key % 24), F.lit(":"), two(customer % 60), F.lit(":"), two(key % 60)), "period": F.concat(day.cast("string"), F.lit(" ~ "), F.date_add(day, 1).cast("string")),
        "price": F.concat(F.lit("all:"), F.round("o_totalprice").cast("long").cast("string"), F.lit(" & none:0")), "at": F.concat((key % 100).cast("string"), F.lit(","), (customer % 100).cast("string")),
        "give": F.when(key % 2 == 0, F.concat(F.lit("item("), (customer % 9).cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("item("), (customer % 9).cast("string"), F.lit(", 00:00:0"), (customer % 10).cast("string"), F.lit(")"))),
        "note": F.when(key % 5 != 0, F.concat("o_orderstatus", F.lit('"'), "o_orderpriority")),
    }
    made = cut(cast_declared(t("orders").select(*[c.cast("string").alias(n) for n, c in text.items()]), _VALUES, "order"))
    return containers.entries(made.drop("errors"), None, "id", values=written_columns(_VALUES, ["order"])).select("key", "entry")


@query("""select c_nationkey, sum(octet_length(encode(c_name || c_mktsegment)))::bigint as length, true as same from customer group by c_nationkey""")
def checksum_of_parts(t):
    """Checksums of the customers' texts, put together by nation, beside that of the whole text."""
    text = F.concat("c_name", "c_mktsegment")
    rows = t("customer").select("c_nationkey", "c_custkey", text.alias("text"), F.crc32(text.cast("binary")).alias("crc32"), F.octet_length(text).cast("long").alias("length"))
    whole = rows.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "text"))).alias("rows")).select("c_nationkey", F.crc32(F.array_join(F.transform("rows", lambda r: r["text"]), "").cast("binary")).alias("whole"))
    made = checksums.combined(rows.drop("text"), ["c_nationkey"], ["c_custkey"])
    return made.join(whole, "c_nationkey").select("c_nationkey", "length", (F.col("crc32") == F.col("whole")).alias("same"))


@query("""with r as (select l_partkey, l_returnflag, l_orderkey * 8 + l_linenumber as row from lineitem), n as (select l_partkey, count(*) as n from r group by 1 having count(*) > 1),
    k as (select *, row_number() over (partition by l_partkey order by l_returnflag, row) as k from r)
    select l_partkey, n, string_agg(l_returnflag || '!' || row, ',' order by k) as places from k join n using (l_partkey) where k <= 5 group by l_partkey, n""")
def duplicate_places(t):
    """Parts in several line items: how many rows, and the five least places."""
    rows = t("lineitem").select("l_partkey", "l_returnflag", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"))
    made = constraints.duplicate_places(rows, ["l_partkey"], ["l_returnflag", "row"], most=5)
    return made.select("l_partkey", "n", F.array_join(F.transform("places", lambda p: F.concat_ws("!", p["l_returnflag"], p["row"].cast("string"))), ",").alias("places"))
