"""Rules over catalogs that are derived from the tables: a customer or supplier stands for a declared table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import constraints as rules
from quernstone.operators.catalog import inheritance_levels, root_types
from quernstone.plans.registry import query


@query("""with recursive up as (select o_orderkey as k, case when o_orderkey % 64 >= 40 then -1 when o_orderkey > 0 then o_orderkey // 2 end as t from orders),
    c(k, t, hops) as (select k, t, 0 from up union all select c.k, up.t, c.hops + 1 from c join up on up.k = c.t)
    select 'T' || k as "table", max(case when t is null then 'int' end) as root, max(hops)::bigint as hops, case when bool_or(t = -1) then 'unknown target' end as fault from c group by k""")
def root_type(t):
    """Order n refers to order n // 2; some refer to one that isn't there, so their chains and those through them end in nothing."""
    k = F.col("o_orderkey")
    up = F.when(k % 64 >= 40, F.lit(-1)).when(k > 0, F.floor(k / 2))
    rows = t("orders").select(F.concat(F.lit("T"), k.cast("string")).alias("table"), F.lit("id").alias("name"), F.concat(F.lit("T"), up.cast("string")).alias("target"), F.lit("id").alias("target_column"), F.when(k == 0, "int").alias("type"), (k % 2 == 1).alias("nullable"))
    return root_types(rows).select("table", "root", "hops", "fault")


@query("""with recursive c(k, b, level) as (select c_custkey, c_custkey // 3, 0 from customer union all select c.k, u.c_custkey // 3, c.level + 1 from c join customer u on u.c_custkey = c.b and c.k <> 0 where c.b > 0 or c.level < 0)
    select 'T' || k as "table", (max(level) + case when k > 0 then 1 else 0 end)::bigint as level from c group by k""")
def inheritance_level(t):
    k = F.col("c_custkey")
    rows = t("customer").select(F.concat(F.lit("T"), k.cast("string")).alias("table"), F.when(k > 0, F.concat(F.lit("T"), F.floor(k / 3).cast("string"))).alias("based"))
    return inheritance_levels(rows).select("table", "level")


def _sheet_columns(t):
    n, key = F.col("l_linenumber"), F.col("l_suppkey").cast("string")
    return t("lineitem").select(
        F.concat(F.lit("S"), key).alias("table"), F.concat(F.lit("S"), key, F.lit("."), "l_returnflag").alias("sheet"), F.concat(F.lit("c"), n.cast("string")).alias("name"),
        F.when(F.col("l_suppkey") % 3 == 0, "int").otherwise(F.concat(F.lit("int"), "l_returnflag")).alias("type"), F.when((n % 2 == 0) & (F.col("l_suppkey") % 2 == 0), 1).otherwise(3).alias("scope"), F.lit(False).alias("bold"),
    ).distinct()


@query("""with c as (select distinct 'S' || l_suppkey as "table", 'S' || l_suppkey || '.' || l_returnflag as sheet, 'c' || l_linenumber || case when l_suppkey % 3 = 0 then 'int' else 'int' || l_returnflag end || case when l_linenumber % 2 = 0 and l_suppkey % 2 = 0 then 1 else 3 end as x from lineitem),
    own as (select "table", sheet, string_agg(x, ';' order by x) as s from c group by all)
    select "table", 'columns differ' as rule, count(distinct s) as n from own group by 1 having count(distinct s) > 1
    union all select 'S' || l_suppkey, 'based differs', count(distinct case when l_suppkey % 5 = 0 then l_returnflag else '' end) from lineitem group by l_suppkey having count(distinct case when l_suppkey % 5 = 0 then l_returnflag else '' end) > 1""")
def schema_reconcile(t):
    key = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    sheets = t("lineitem").select(key.alias("table"), F.concat(key, F.lit("."), "l_returnflag").alias("sheet"), F.when(F.col("l_suppkey") % 5 == 0, F.col("l_returnflag")).alias("based")).distinct()
    return rules.schema_differences(sheets, _sheet_columns(t))


def _inheritance(t):
    """A customer's table has a column per priority of their orders and is based on that of their nation."""
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    made = lambda prefix, key: orders.groupBy(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("table"), F.col("o_orderpriority").alias("name")).agg(F.min("o_orderstatus").alias("type"), (1 + F.count("*") % 3).cast("int").alias("scope"))
    base = F.when(F.col("c_custkey") % 20 == 0, "N99").otherwise(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    tables = t("customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("table"), base.alias("based"))
    return tables, made("C", "c_custkey").union(made("N", "c_nationkey"))


_OWN = """with o as (select * from orders join customer on o_custkey = c_custkey), own as (select c_custkey as k, c_nationkey as n, o_orderpriority as name, min(o_orderstatus) as type, 1 + count(*) % 3 as scope from o group by all),
    base as (select c_nationkey as n, o_orderpriority as name, min(o_orderstatus) as type, 1 + count(*) % 3 as scope from o group by all)"""


@query(f"""{_OWN} select * from (select 'C' || c_custkey as "table", base.name as name, case when own.name is null then 'missing' when own.type <> base.type then 'retyped' when own.scope::integer & base.scope::integer <> base.scope then 'narrower scope' end as fault
    from customer join base on base.n = c_nationkey left join own on own.k = c_custkey and own.name = base.name where c_custkey % 20 <> 0) where fault is not null
    union all select 'C' || c_custkey, 'N99', 'unknown base' from customer where c_custkey % 20 = 0""")
def inherit_check(t):
    return rules.inheritance_faults(*_inheritance(t))


@query(f"""{_OWN} select 'C' || k as "table", own.name, k % 20 <> 0 and b.name is not null as inherited from own left join (select distinct n, name from base) b on b.n = own.n and b.name = own.name
    union all select 'N' || n, name, false from base""")
def inherit_columns(t):
    return rules.inherited(*_inheritance(t)).select("table", "name", "inherited")


@query("""select "table", bold, unnest(list_filter([case when p > 1 then 'several primary keys' end, case when g > 1 then 'several group keys' end, case when o then 'nullable key' end], lambda x: x is not null)) as fault from (
    select 'T' || l_suppkey as "table", l_returnflag = 'A' as bold, count(*) filter (l_linenumber % 7 = 0 and l_partkey % 100 = 0) as p, count(*) filter (l_linenumber % 7 = 1 and l_partkey % 100 = 0) as g, coalesce(bool_or(l_linenumber % 7 < 2 and l_partkey % 100 = 0 and l_quantity < 10), false) as o from lineitem group by all)""")
def key_declaration_rule(t):
    n, mark = F.col("l_linenumber") % 7, F.col("l_partkey") % 100 == 0
    optional = F.when(F.col("l_quantity") < 10, "?").otherwise("")
    kind = F.when(mark & (n == 0), F.concat(F.lit("*int"), optional)).when(mark & (n == 1), F.concat(F.lit("(int"), optional, F.lit(")"))).otherwise("int")
    columns = t("lineitem").select(F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("table"), (F.col("l_returnflag") == "A").alias("bold"), kind.alias("type"))
    return rules.key_declarations(columns)


@query("select l_orderkey, l_linenumber from lineitem where l_linestatus = 'O' and l_returnflag <> 'N'")
def enum_key_rule(t):
    key = F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") != "N"), F.concat("l_returnflag", F.lit(" | O"))).otherwise(F.col("l_returnflag"))
    return rules.combined_enum_keys(t("lineitem").withColumn("key", key), "key").select("l_orderkey", "l_linenumber")


@query("""select 'E' || p_size as enum, 'm' || p_partkey as member, case p_partkey % 6 when 1 then 'doesn''t end in a value' when 2 then 'begins with an operator' when 3 then 'two of a kind side by side' when 4 then 'unknown name nothing' end as fault from part where p_partkey % 6 between 1 and 4""")
def enum_grammar(t):
    k, own = F.col("p_partkey") % 6, F.concat(F.lit("m"), F.col("p_partkey").cast("string"))
    value = F.col("p_size").cast("string")
    tokens = F.when(k == 1, F.array(value, F.lit("|"))).when(k == 2, F.array(F.lit("&"), value)).when(k == 3, F.array(value, value)).when(k == 4, F.array(value, F.lit("|"), F.lit("nothing"))).when(k == 5, F.array(F.lit("("), own, F.lit("|"), value, F.lit(")"), F.lit("&"), F.lit("~"), F.lit("0xFF"))).otherwise(F.array(value))
    members = t("part").select(F.concat(F.lit("E"), value).alias("enum"), own.alias("member"), tokens.alias("tokens"))
    return rules.enum_grammar(members)


@query("""with p as (select 'h' || l_orderkey as header, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_shipdate, l_suppkey, l_extendedprice, l_quantity) - 1 as pos, l_returnflag = 'A' as d, l_suppkey as s from lineitem)
    select header, pos::integer as pos, 'required after default' as fault from (select *, bool_or(d) over (partition by header order by pos rows between unbounded preceding and 1 preceding) as had from p) where had and not d
    union all select header, pos::integer, case when s % 10 = 0 then 'unknown table' else 'table without key' end from p where s % 10 = 0 or s % 10 = 3""")
def dsl_definition_rule(t):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_shipdate", "l_suppkey", "l_extendedprice", "l_quantity")
    supplier = lambda c: F.concat(F.lit("S"), F.col(c).cast("string"))
    params = t("lineitem").select(F.concat(F.lit("h"), F.col("l_orderkey").cast("string")).alias("header"), (F.row_number().over(order) - 1).alias("pos"), F.concat(F.lit("$"), supplier("l_suppkey")).alias("type"), (F.col("l_returnflag") == "A").alias("has_default"))
    keys = t("supplier").where("s_suppkey % 10 <> 0").select(supplier("s_suppkey").alias("table"), F.when(F.col("s_suppkey") % 10 != 3, "id").alias("key"))
    return rules.call_definitions(params, keys)


@query("""select 'L' || l_orderkey as "table", 'r' || l_linenumber as name, '$S' || l_suppkey || case when l_linenumber % 2 = 0 then '.name' else '' end as leaf,
    case when l_suppkey % 10 = 0 then 'unknown table' when l_linenumber % 2 = 0 and l_suppkey % 4 = 0 then 'unknown column' when l_linenumber % 2 = 1 and l_suppkey % 10 = 3 then 'table without key' end as fault
    from lineitem where l_suppkey % 10 = 0 or (l_linenumber % 2 = 0 and l_suppkey % 4 = 0) or (l_linenumber % 2 = 1 and l_suppkey % 10 = 3)""")
def ref_type_rule(t):
    supplier = lambda c: F.concat(F.lit("S"), F.col(c).cast("string"))
    kept = t("supplier").where("s_suppkey % 10 <> 0")
    ids = kept.select(supplier("s_suppkey").alias("table"), F.lit("id").alias("name"), F.when(F.col("s_suppkey") % 10 == 3, "int").otherwise("*int").alias("type"))
    names = kept.where("s_suppkey % 4 <> 0").select(supplier("s_suppkey").alias("table"), F.lit("name").alias("name"), F.lit("string").alias("type"))
    kind = F.concat(F.lit("[$"), supplier("l_suppkey"), F.when(F.col("l_linenumber") % 2 == 0, ".name").otherwise(""), F.lit("]"))
    refs = t("lineitem").select(F.concat(F.lit("L"), F.col("l_orderkey").cast("string")).alias("table"), F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("name"), kind.alias("type"))
    return rules.reference_types(refs.union(ids).union(names))
