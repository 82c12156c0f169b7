"""Cells, containers, scopes and incremental work over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators import catalog, cells, containers, hooks, incremental
from quernstone.operators.catalog import CLIENT, COMMON, SERVER, Catalog
from quernstone.operators.checkpoints import cut
from quernstone.operators.constraints import leaves
from quernstone.plans.registry import query
from quernstone.sources import prototypes


@query("""select user_id, cast(max(event_id) filter (event_type = 'click') as varchar) as click, cast(max(event_id) filter (event_type = 'purchase') as varchar) as purchase,
    cast(max(event_id) filter (event_type = 'signup') as varchar) as signup, cast(max(event_id) filter (event_type = 'view') as varchar) as view from events group by user_id""")
def long_to_wide(t):
    long = t("events").groupBy("user_id", F.col("event_type").alias("name")).agg(F.max("event_id").cast("string").alias("value"))
    return cells.to_models(long, ["click", "purchase", "signup", "view"], by=["user_id"])


@query("select s_suppkey, s_name from supplier")
def scope_project(t):
    columns = {"s_suppkey": ("*long", COMMON), "s_name": ("string", CLIENT), "s_nationkey": ("$nation", SERVER), "s_acctbal": ("double", SERVER)}
    return catalog.scope_project(t("supplier"), Catalog({"supplier": columns}), "supplier", CLIENT)


def _as_cells(df: DataFrame, key: str, columns: list[tuple[str, str, str]], sheet: str) -> DataFrame:
    """A table as a sheet: a directive, three header rows, values, and a comment row after every seventh value."""
    head = df.agg(F.count("*").alias("n")).select(F.explode(F.array(
        F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit("json: party").alias("value"), F.lit(False).alias("bold")),
        *[F.struct(F.lit(2 + r).alias("row"), F.lit(c).alias("col"), F.lit(x).alias("value"), F.lit(False).alias("bold")) for c, col in enumerate(columns) for r, x in enumerate(col)],
    )).alias("c")).select("c.*", F.lit("string").alias("kind"))
    row = (F.col(key) * 2 + 10).cast("int")
    kinds = ["numeric" if kind in ("int", "long", "double") else "string" for _, kind, _ in columns]
    body = df.select(F.explode(F.array(
        *[F.struct(row.alias("row"), F.lit(c).alias("col"), F.col(name).cast("string").alias("value"), F.lit(False).alias("bold"), F.lit(kinds[c]).alias("kind")) for c, (name, _, _) in enumerate(columns)],
        F.struct((row + 1).alias("row"), F.lit(0).alias("col"), F.when(F.col(key) % 7 == 0, "#note").otherwise("").alias("value"), F.lit(False).alias("bold"), F.lit("string").alias("kind")),
        F.struct((row + 1).alias("row"), F.lit(1).alias("col"), F.when(F.col(key) % 7 == 0, "lost").otherwise("").alias("value"), F.lit(False).alias("bold"), F.lit("string").alias("kind")),
        F.struct(row.alias("row"), F.lit(len(columns)).alias("col"), F.lit("#aside").alias("value"), F.lit(False).alias("bold"), F.lit("string").alias("kind")),
    )).alias("c")).select("c.*")
    return head.unionByName(body).select(F.lit("book.xlsx").alias("file"), F.lit(sheet).alias("sheet"), "row", "col", "kind", "value", "bold")


def _party_cells(t) -> DataFrame:
    first = _as_cells(t("supplier"), "s_suppkey", [("s_suppkey", "int", "common"), ("s_name", "string", "common"), ("s_nationkey", "int", "server")], "Party.supplier")
    return first.union(_as_cells(t("customer"), "c_custkey", [("c_custkey", "int", "common"), ("c_name", "string", "common"), ("c_nationkey", "int", "server")], "Party.customer"))


@query("select cast(s_suppkey as varchar) as s_suppkey, s_name, cast(s_nationkey as varchar) as s_nationkey from supplier")
def cells_roundtrip(t):
    found = _party_cells(t).where("sheet = 'Party.supplier'")
    found = cells.layout(found, save=True)
    rows = cells.read_rows(found, cells.read_headers(found))
    return cells.sheet_order(cells.to_models(rows, ["s_suppkey", "s_name", "s_nationkey"])).select("s_suppkey", "s_name", "s_nationkey")


@query("""select 'Party.' || side as sheet, 'Party' as "table", 'party' as json, 3::bigint as columns, n as rows from (select 'supplier' as side, count(*) as n from supplier union all select 'customer', count(*) from customer)""")
def sheet_directives(t):
    found = cells.layout(_party_cells(t), save=True)
    headers = cut(cells.read_headers(found))
    rows = cells.read_rows(found, headers).groupBy("file", "sheet").agg(F.count_distinct("row").alias("rows"))
    columns = headers.groupBy("file", "sheet").agg(F.count("*").alias("columns"))
    return cells.read_directives(found).join(columns, ["file", "sheet"]).join(rows, ["file", "sheet"]).select("sheet", "table", "json", "columns", "rows")


@query("""select 'Seg' as "table", c_mktsegment || '_' || c_nationkey as name, cast(count(*) as varchar) as value, 1::bigint as n from customer where c_custkey % 2 = 0 group by 1, 2
    union all select 'SegMore', c_mktsegment || '_' || c_nationkey, cast(count(*) as varchar), 1::bigint from customer where c_custkey % 2 = 1 group by 1, 2""")
def merge_lookup_tables(t):
    name = F.concat_ws("_", "c_mktsegment", F.col("c_nationkey").cast("string"))
    sheet = F.when(F.col("c_custkey") % 2 == 0, "Seg.a").otherwise("SegMore.b")
    each = t("customer").groupBy(sheet.alias("sheet"), name.alias("name")).agg(F.count("*").cast("string").alias("value"), F.min("c_custkey").cast("int").alias("row"))
    made = each.select("sheet", "row", F.posexplode(F.array("name", F.lit("Server"), F.lit("int"), "value")).alias("col", "value")).select(F.lit("c.xlsx").alias("file"), "sheet", "row", "col", F.lit("string").alias("kind"), "value", F.lit(False).alias("bold"))
    consts = cells.read_consts(made)
    return cells.const_order(consts).groupBy("table", "name").agg(F.first("value").alias("value"), F.count("*").alias("n"))


@query("""select o_custkey, '[' || string_agg('{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}', ',' order by o_orderkey) || ']' as container, count(*)::integer as size from orders group by o_custkey""")
def container_grouped(t):
    rows = t("orders").select("o_custkey", F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    made = containers.to_grouped(rows, "o_custkey", ["key", "status"])
    return made.select("o_custkey", containers.text(F.col("container")).alias("container"), containers.size(F.col("container")).alias("size"))


@query("""select c_nationkey, '{' || string_agg('"' || c_custkey || '":{"key":' || c_custkey || ',"segment":"' || c_mktsegment || '"}', ',' order by c_custkey) || '}' as container from customer group by c_nationkey""")
def container_grouped_keyed(t):
    rows = t("customer").select("c_nationkey", F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    made = containers.to_grouped_keyed(rows, "c_nationkey", "key", ["key", "segment"])
    return made.select("c_nationkey", containers.text(F.col("container")).alias("container"))


@query("""select 'list' as shape, null::varchar as key, '{"id":' || s_suppkey || ',"nation":' || s_nationkey || '}' as entry from supplier
    union all select 'keyed', '"' || s_suppkey || '"', '{"id":' || s_suppkey || ',"nation":' || s_nationkey || '}' from supplier""")
def container_list_keyed(t):
    rows = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    shapes = {"list": containers.entries(rows, None, None, order=["id"]), "keyed": containers.entries(rows, None, "id")}
    made = [df.select(F.lit(n).alias("shape"), "key", "entry") for n, df in shapes.items()]
    return made[0].union(made[1])


@query("""select o_orderstatus as sheet, o_custkey as part, '[' || string_agg('{"key":' || o_orderkey || '}', ',' order by o_orderkey) || ']' as container from orders group by all""")
def container_by_sheet(t):
    rows = t("orders").select(F.col("o_orderstatus").alias("sheet"), F.col("o_custkey").alias("part"), F.col("o_orderkey").alias("key"))
    return containers.by_sheet(rows, ["key"], ["sheet", "part"]).select("sheet", "part", containers.text(F.col("container")).alias("container"))


_PARTY = "(select s_nationkey as nation, s_suppkey as id from supplier union all select c_nationkey, 1000000 + c_custkey from customer)"


@query(f"""select 'party' as json, nation, string_agg(id::varchar, ',' order by id) as ids, 2::integer as columns from {_PARTY} group by all""")
def container_by_json(t):
    """Two tables of one JSON group; the balance is of the other scope."""
    own = {"id": ("*long", COMMON), "nation": ("(int)", COMMON), "balance": ("double", SERVER)}
    tables = {
        "party": t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")),
        "client": t("customer").select((F.col("c_custkey") + 1000000).alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")),
    }
    merged, gk, _ = containers.by_json(tables, Catalog({"party": own, "client": own}, groups={"client": "party"}), CLIENT)["party"]
    made = containers.to_grouped(merged, gk)
    return made.select(F.lit("party").alias("json"), "nation", F.array_join(F.transform("container", lambda r: r["id"].cast("string")), ",").alias("ids"), F.lit(len(merged.columns)).alias("columns"))


@query(f"""select '"' || nation || '"' as key, '{{' || string_agg('"' || id || '":{{"id":' || id || ',"nation":' || nation || '}}', ',' order by id) || '}}' as entry from {_PARTY} group by nation""")
def document_entries(t):
    """The entries of a document with both keys."""
    rows = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")).union(t("customer").select(F.col("c_custkey") + 1000000, "c_nationkey"))
    return containers.entries(rows, "nation", "id").select("key", "entry")


@query("""select 'Party.supplier' as sheet, 'normal' as part, (s_suppkey * 2 + 10)::integer as row, '{"s_name":"' || s_name || '","s_nationkey":"' || s_nationkey || '","s_suppkey":"' || s_suppkey || '"}' as json from supplier
    union all select 'Party.customer', 'normal', (c_custkey * 2 + 10)::integer, '{"c_custkey":"' || c_custkey || '","c_name":"' || c_name || '","c_nationkey":"' || c_nationkey || '"}' from customer""")
def raw_dump_rows(t):
    found = cells.layout(_party_cells(t), save=True)
    return containers.raw_dump(cut(cells.read_rows(found, cells.read_headers(found)))).select("sheet", "part", "row", "json")


@query("select n_nationkey, upper(n_name) as n_name, n_nationkey % 2 = 0 as even from nation")
def hook_build(t):
    """A user's row builder, then a user's decoder of strings."""
    made = hooks.build(t("nation").select("n_nationkey", "n_name"), lambda df: df.withColumn("even", F.col("n_nationkey") % 2 == 0))
    return hooks.decoding(made, F.upper)


@query("""select 'h' || p_size as header, 0 as pos, 'id' as name, '$part' as type, false as has_default, null::varchar as "default" from part union select 'h' || p_size, 1, 'count', 'uint', true, p_size::varchar from part union select 'h' || p_size, 2, 'max', 'int?', true, null from part""")
def call_prototypes(t):
    """A document of prototypes for every size of part; a default of null still makes a parameter optional."""
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit('{"h'), size, F.lit('": [{"name": "id", "type": "$part"}, {"name": "count", "type": "uint", "default": '), size, F.lit('}, {"name": "max", "type": "int?", "default": null}]}'))
    return prototypes.read_prototypes(t("part").select(text.alias("value")).distinct()).drop("ordinal")


@query("""select vec_id, part, count(*) as n, sum(case when x > 0 then 1 else 0 end)::bigint as positive from (select vec_id, 'item' as part, unnest(embedding) as x from embeddings) group by all
    union all select vec_id, 'self', 1, case when label > 0 then 1 else 0 end from embeddings""")
def nested_leaves(t):
    found = leaves(t("embeddings"), ["vec_id"], {"embedding": "list", "label": "scalar"})
    return found.groupBy("vec_id", "part").agg(F.count("*").alias("n"), F.count(F.when(F.col("leaf").cast("double") > 0, 1)).alias("positive"))


def _manifests(t) -> tuple[DataFrame, DataFrame]:
    """Documents as files of ten; the new state lacks some, has others, and a part of the rest changed."""
    file = F.concat(F.lit("f"), F.floor(F.col("doc_id") / 10).cast("string"))
    seal = lambda df: df.groupBy("file").agg(F.sum(F.crc32(F.encode("text", "utf-8"))).alias("crc32"), F.sum("n_chars").alias("length")).withColumn("engine_version", F.lit("1"))
    docs = t("documents").withColumn("file", file)
    number = F.floor(F.col("doc_id") / 10)
    changed = F.when((number % 3 == 1) & (F.col("doc_id") % 10 == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return seal(docs.where(number % 5 != 0)), seal(docs.where(number % 7 != 0).withColumn("text", changed))


_STATE = """select 'f' || n as file, case when n % 5 = 0 and n % 7 <> 0 then 'added' when n % 7 = 0 and n % 5 <> 0 then 'deleted' when n % 3 = 1 and has0 then 'changed' else 'unchanged' end as state
    from (select doc_id // 10 as n, bool_or(doc_id % 10 = 0) as has0 from documents group by 1) where n % 5 <> 0 or n % 7 <> 0"""


@query(_STATE)
def manifest_diff(t):
    return incremental.manifest_diff(*_manifests(t))


@query(f"select file from ({_STATE}) where state in ('added', 'changed') or (state = 'unchanged' and cast(substr(file, 2) as bigint) % 11 = 0)")
def work_list(t):
    diff = incremental.manifest_diff(*_manifests(t))
    failed = diff.where(F.substring("file", 2, 20).cast("long") % 11 == 0).select("file")
    return incremental.work_list(diff, failed)


def _snapshots(t) -> tuple[DataFrame, DataFrame]:
    rows = t("orders").select(F.concat(F.lit("f"), F.floor(F.col("o_custkey") / 10).cast("string")).alias("file"), "o_orderkey", "o_custkey")
    number = F.floor(F.col("o_custkey") / 10)
    return rows.where(number % 4 != 0).withColumn("version", F.lit(1)), rows.where((number % 4 == 0) | (number % 3 == 0)).withColumn("version", F.lit(2))


@query("select 'f' || (o_custkey // 10) as file, o_orderkey, o_custkey, case when (o_custkey // 10) % 4 = 0 or (o_custkey // 10) % 3 = 0 then 2 else 1 end as version from orders")
def refresh_union(t):
    cached, loaded = _snapshots(t)
    diff = cached.select("file").distinct().withColumn("state", F.lit("unchanged"))
    return incremental.merge_snapshots(cached, loaded, diff)


@query("select 'f' || (o_custkey // 10) as file, count(*) as n from orders where (o_custkey // 10) % 6 <> 5 group by 1")
def refresh_equals_full(t):
    """Files gone since drop out, the others come from either side; the same rows as loading all present files at once."""
    cached, loaded = _snapshots(t)
    number = F.substring("file", 2, 20).cast("long")
    gone = number % 6 == 5
    diff = cached.select("file").distinct().withColumn("state", F.when(gone, "deleted").otherwise("unchanged"))
    return incremental.merge_snapshots(cached, loaded.where(~gone), diff).groupBy("file").agg(F.count("*").alias("n"))


@query("select c_custkey as missing from customer where c_custkey % 3 <> 0 except select o_custkey from orders where o_orderstatus = 'P'")
def set_difference(t):
    return incremental.missing(t("customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("missing")), t("orders").where("o_orderstatus = 'P'").select("o_custkey"))
