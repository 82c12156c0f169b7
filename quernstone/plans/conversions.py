"""Conversions of text that is derived from the tables, good and bad cells alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import casts, cells, times
from quernstone.operators import lookups
from quernstone.operators.catalog import Catalog, cast_declared
from quernstone.operators.constraints import cast_faults
from quernstone.plans.registry import query


def _cast(df: DataFrame, cast: casts.Cast, text: Column) -> DataFrame:
    return casts.cast_columns(df, {"r": (cast, text)})


def _text(c: str) -> Column:
    return F.col(c).cast("string")


_INTS = "case o_orderkey % 6 when 0 then '-' || o_orderkey when 1 then '0x' || to_hex(o_orderkey) when 2 then o_orderkey || '.5' when 3 then o_orderkey || '00000000' when 4 then ' ' || o_orderkey || ' ' else '' end"


def _ints() -> Column:
    k, text = F.col("o_orderkey") % 6, _text("o_orderkey")
    return F.when(k == 0, F.concat(F.lit("-"), text)).when(k == 1, F.concat(F.lit("0x"), F.hex("o_orderkey"))).when(k == 2, F.concat(text, F.lit(".5"))).when(k == 3, F.concat(text, F.lit("00000000"))).when(k == 4, F.concat(F.lit(" "), text, F.lit(" "))).otherwise("")


@query("""select o_orderkey, case when o_orderkey % 6 = 0 then -o_orderkey when o_orderkey % 6 in (1, 4) then o_orderkey when o_orderkey % 6 = 3 and o_orderkey * 100000000 <= 2147483647 then o_orderkey * 100000000 end::integer as value,
    case when o_orderkey % 6 = 5 then 'null' when o_orderkey % 6 = 2 then 'not a int32' when o_orderkey % 6 = 3 and o_orderkey * 100000000 > 2147483647 then 'above int32' end as error from orders""")
def cast_ints(t):
    return _cast(t("orders"), casts.to_signed(32), _ints()).select("o_orderkey", "r.value", "r.error")


@query("""select o_orderkey, case when o_orderkey % 6 in (1, 4) or o_orderkey = 0 then o_orderkey when o_orderkey % 6 = 3 and o_orderkey * 100000000 <= 4294967295 then o_orderkey * 100000000 end as value,
    case when o_orderkey % 6 = 5 then 'null' when o_orderkey % 6 = 2 then 'not a uint32' when o_orderkey % 6 = 0 and o_orderkey > 0 then 'below uint32' when o_orderkey % 6 = 3 and o_orderkey * 100000000 > 4294967295 then 'above uint32' end as error from orders""")
def cast_unsigned(t):
    return _cast(t("orders"), casts.to_unsigned(32), _ints()).select("o_orderkey", "r.value", "r.error")


@query("""select o_orderkey, (cast(o_orderkey as hugeint) * 1700000000000000 )::varchar as text, case when cast(o_orderkey as hugeint) * 1700000000000000 <= 18446744073709551615 then (cast(o_orderkey as hugeint) * 1700000000000000)::varchar end as value,
    case when cast(o_orderkey as hugeint) * 1700000000000000 > 18446744073709551615 then 'above uint64' end as error from orders""")
def cast_unsigned_64(t):
    text = (F.col("o_orderkey").cast("decimal(20,0)") * F.lit(1700000000000000).cast("decimal(17,0)")).cast("string")
    return _cast(t("orders").select("o_orderkey", text.alias("text")), casts.to_unsigned(64), F.col("text")).select("o_orderkey", "text", F.col("r.value").cast("string").alias("value"), "r.error")


@query("""select l_orderkey, l_linenumber, case when l_returnflag = 'A' then true when l_returnflag = 'N' and l_linestatus = 'F' then false end as value,
    case when l_returnflag = 'R' then 'null' when l_returnflag = 'N' and l_linestatus = 'O' then 'not a bool' end as error from lineitem""")
def cast_bool(t):
    text = F.when(F.col("l_returnflag") == "A", "True").when(F.col("l_returnflag") == "R", " null ").when(F.col("l_linestatus") == "F", "FALSE").otherwise("yes")
    return _cast(t("lineitem"), casts.to_bool, text).select("l_orderkey", "l_linenumber", "r.value", "r.error")


@query("""select p_partkey, case p_partkey % 4 when 0 then p_size * 1.0::double when 1 then p_size * 1000.0::double when 2 then null else 0.5::double end as value,
    case p_partkey % 4 when 2 then 'not a double' end as error from part""")
def cast_double(t):
    k, size = F.col("p_partkey") % 4, _text("p_size")
    text = F.when(k == 0, size).when(k == 1, F.concat(size, F.lit("e3"))).when(k == 2, F.concat(size, F.lit("d"))).otherwise(".5")
    return _cast(t("part"), casts.to_double, text).select("p_partkey", "r.value", "r.error")


@query("""select p_partkey, case when p_partkey % 2 = 0 then p_size * 0.25::double end as value, case when p_partkey % 2 = 1 then case when p_size % 2 = 0 then 'above float' else 'below float' end end as error from part""")
def cast_float(t):
    odd = F.when(F.col("p_size") % 2 == 0, "1e39").otherwise("-1e39")
    text = F.when(F.col("p_partkey") % 2 == 0, (F.col("p_size") * 0.25).cast("string")).otherwise(odd)
    return _cast(t("part"), casts.to_float_checked, text).select("p_partkey", "r.value", "r.error")


@query("""select l_orderkey, l_linenumber, case when l_linenumber % 3 = 0 then date_trunc('day', l_shipdate) when l_linenumber % 3 = 1 then l_shipdate end as value,
    case when l_linenumber % 3 = 2 then 'not a DateTime' end as error from lineitem""")
def cast_datetime(t):
    n = F.col("l_linenumber") % 3
    text = F.when(n == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).when(n == 1, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("l_shipdate", "yyyy"))
    return _cast(t("lineitem"), casts.to_datetime, text).select("l_orderkey", "l_linenumber", "r.value", "r.error")


def _span_text() -> Column:
    k, n = F.col("o_orderkey"), F.col("o_custkey")
    clock = F.format_string("%02d:%02d:%02d", k % 24, n % 60, k % 60)
    return F.when(k % 4 == 0, clock).when(k % 4 == 1, F.concat(F.lit("-"), (n % 9).cast("string"), F.lit("."), clock)).when(k % 4 == 2, F.concat((n % 9).cast("string"), F.lit(" "), clock, F.lit(".25"))).otherwise(F.concat((k % 24).cast("string"), F.lit("h")))


_SPAN = "((o_orderkey % 24) * 3600 + (o_custkey % 60) * 60 + o_orderkey % 60) * 1000"


@query(f"""select o_orderkey, case o_orderkey % 4 when 0 then {_SPAN} when 1 then -({_SPAN} + (o_custkey % 9) * 86400000) when 2 then {_SPAN} + (o_custkey % 9) * 86400000 + 250 end as millis,
    case when o_orderkey % 4 = 3 then 'not a TimeSpan' end as error from orders""")
def cast_timespan(t):
    found = _cast(t("orders"), casts.to_timespan, _span_text())
    return found.select("o_orderkey", times.total_millis(F.col("r.value")).alias("millis"), "r.error")


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then o_orderdate when o_orderkey % 3 = 1 then timestamp '0001-01-01' end as starts,
    case when o_orderkey % 3 = 0 then o_orderdate + interval 30 day when o_orderkey % 3 = 1 then timestamp '0001-01-02 03:04:05' end as ends,
    case when o_orderkey % 3 = 0 then o_orderdate + interval (o_orderkey % 40) day < o_orderdate + interval 30 day end as inside,
    case when o_orderkey % 3 = 2 then 'not a DateRange' end as error from orders""")
def cast_date_range(t):
    k, day = F.col("o_orderkey"), lambda c: F.date_format(c, "yyyy-MM-dd")
    later = lambda n: F.col("o_orderdate") + times.span_of(days=n)
    text = F.when(k % 3 == 0, F.concat(day("o_orderdate"), F.lit(" ~ "), day(later(30)))).when(k % 3 == 1, "1 03:04:05").otherwise("soon ~ later")
    found = _cast(t("orders"), casts.to_date_range, text)
    inside = F.when(k % 3 == 0, times.in_range(later(k % 40), F.col("r.value")))
    return found.select("o_orderkey", F.col("r.value.Start").alias("starts"), F.col("r.value.End").alias("ends"), inside.alias("inside"), "r.error")


@query("select doc_id, len(list_filter(string_split(replace(replace(replace(replace(text, '(', ' '), ')', ' '), '&', ' '), '|', ' '), chr(10)), lambda x: trim(x) <> '')) as items from documents")
def split_list(t):
    text = F.translate("text", "()&|", "    ")
    return t("documents").select("doc_id", F.size(cells.split_items(text)).cast("long").alias("items"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then 'a=' || o_custkey || ';b=' || o_orderkey end as entries,
    case o_orderkey % 4 when 1 then 'not key:value' when 2 then 'duplicate key' when 3 then 'not a int32' end as error from orders""")
def to_map_cell(t):
    k, c, o = F.col("o_orderkey") % 4, _text("o_custkey"), _text("o_orderkey")
    text = F.when(k == 0, F.concat(F.lit("a:"), c, F.lit(" & b: "), o)).when(k == 1, F.concat(F.lit("a:"), c, F.lit(":1"))).when(k == 2, F.concat(F.lit("a:"), c, F.lit("|a:"), o)).otherwise("a:x")
    found = _cast(t("orders"), casts.to_map(casts.to_string, casts.to_signed(32)), text)
    entries = F.array_join(F.transform(F.map_entries("r.value"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return found.select("o_orderkey", entries.alias("entries"), "r.error")


@query("""select p_partkey, case when p_partkey % 3 < 2 then p_size::bigint end as a, case when p_partkey % 3 < 2 then p_partkey end as b, p_partkey % 3 < 2 and p_size = p_partkey as same,
    case when p_partkey % 3 = 2 then 'not a range' end as error from part""")
def pair_cells(t):
    k, a, b = F.col("p_partkey") % 3, _text("p_size"), _text("p_partkey")
    point = casts.to_point()(F.concat(a, F.lit(" , "), b))["value"]
    span = casts.to_range()(F.when(k < 2, F.concat(a, F.lit("~"), b)).otherwise(F.concat(a, F.lit("-"), b)))
    found = t("part").select("p_partkey", point.alias("p"), span.alias("r"))
    first = F.when(F.col("r.error").isNull(), F.col("p.x"))
    return found.select("p_partkey", first.alias("a"), F.col("r.value.max").alias("b"), F.coalesce(F.col("r.value.min") == F.col("r.value.max"), F.lit(False)).alias("same"), "r.error")


@query("select p_partkey, p_size = p_partkey % 50 as equal, p_size <> p_partkey % 50 as differs from part")
def pair_equality(t):
    pair = lambda c: casts.to_size()(F.concat(c.cast("string"), F.lit(",7")))["value"]
    a, b = pair(F.col("p_size")), pair(F.col("p_partkey") % 50)
    return t("part").select("p_partkey", times.same_pair(a, b).alias("equal"), (~times.same_pair(a, b)).alias("differs"))


@query("""select l_orderkey, l_linenumber, case when l_linenumber % 4 = 0 then l_returnflag when l_linenumber % 4 in (1, 2) then null end as name,
    case l_linenumber % 4 when 0 then a when 1 then a | b when 2 then (a | b) & a end::integer as mask, case when l_linenumber % 4 = 3 then 'unknown member' end as error
    from (select *, case l_returnflag when 'A' then 1 when 'N' then 2 else 4 end as a, case l_linestatus when 'O' then 8 else 3 end as b from lineitem)""")
def enum_mask(t):
    members = {"A": 1, "N": 2, "R": 4, "O": 8, "F": 3}
    n, a, b = F.col("l_linenumber") % 4, F.col("l_returnflag"), F.col("l_linestatus")
    text = F.when(n == 0, a).when(n == 1, F.concat_ws(" | ", a, b)).when(n == 2, F.concat(a, F.lit("|"), b, F.lit("&"), a)).otherwise(F.concat(a, F.lit("|Z")))
    found = _cast(t("lineitem"), casts.to_enum(members), text)
    return found.select("l_orderkey", "l_linenumber", "r.value.name", "r.value.mask", "r.error")


@query("""select l_orderkey, l_linenumber, (a | (b & a))::bigint as mask from (select *, case l_returnflag when 'A' then 1 when 'N' then 2 else 4 end as a, case l_linestatus when 'O' then 8 else 3 end as b from lineitem)""")
def enum_nested(t):
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    text = F.concat(F.lit("("), a, F.lit(") | ("), b, F.lit(" & "), a, F.lit(")"))
    found = lookups.evaluate_enums(t("lineitem").select("l_orderkey", "l_linenumber", text.alias("text")), "text", {"A": 1, "N": 2, "R": 4, "O": 8, "F": 3})
    return found.select("l_orderkey", "l_linenumber", "mask")


@query("""select p_partkey, p_partkey % 5 in (0, 1, 2) as is_null, p_partkey % 5 = 3 as is_const, p_partkey % 5 = 4 as is_call,
    case p_partkey % 5 when 3 then 'Const:Part:x' || p_partkey when 4 then 'f(' || p_size || ', ' || p_name || ')' end as value from part""")
def null_literals(t):
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, F.lit(None)).when(k == 1, "").when(k == 2, " null ").when(k == 3, F.concat(F.lit("Const:Part:x"), _text("p_partkey"))).otherwise(F.concat(F.lit("f("), _text("p_size"), F.lit(", "), F.col("p_name"), F.lit(")")))
    found = t("part").select("p_partkey", text.alias("c"))
    c = F.col("c")
    return found.select("p_partkey", cells.is_null_literal(c).alias("is_null"), F.coalesce(cells.is_const(c), F.lit(False)).alias("is_const"), F.coalesce(cells.is_call(c), F.lit(False)).alias("is_call"), casts.to_string(c)["value"].alias("value"))


@query("select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then l_linenumber end as value, case when l_linenumber % 2 = 1 then 'not a int32' end as error from lineitem")
def sequence_cast(t):
    text = F.concat(_text("l_linenumber"), F.when(F.col("l_linenumber") % 2 == 0, "").otherwise("#"))
    return _cast(t("lineitem"), casts.to_sequence, text).select("l_orderkey", "l_linenumber", "r.value", "r.error")


@query("""select o_orderkey, c as "column", v as value, e as detail from (
    select o_orderkey, 'tags' as c, o_custkey || ' & x' as v, 'not a int32' as e from orders where o_orderkey % 3 = 0
    union all select o_orderkey, 'weights', 'k', 'not key:value' from orders where o_orderkey % 3 = 1
    union all select o_orderkey, 'reward', 'item', 'not a call' from orders where o_orderkey % 3 = 2
    union all select o_orderkey, 'id', '', 'null' from orders where o_orderkey % 5 = 0)""")
def format_errors(t):
    k, c = F.col("o_orderkey"), _text("o_custkey")
    columns = {"id": ("int", 3), "tags": ("[int]", 3), "weights": ("{string:int}", 3), "reward": ("dsl?", 3)}
    df = t("orders").select(
        "o_orderkey", k.alias("row"), F.when(k % 5 == 0, "").otherwise(c).alias("id"), F.concat(c, F.when(k % 3 == 0, " & x").otherwise(" & 2")).alias("tags"),
        F.when(k % 3 == 1, "k").otherwise("k:1").alias("weights"), F.when(k % 3 == 2, "item").when(k % 2 == 0, "item(1)").alias("reward"),
    )
    found = cast_faults(cast_declared(df, Catalog({"orders": columns}), "orders"), "orders", ["row"])
    return found.select(F.col("row").alias("o_orderkey"), "column", "value", "detail")


@query("""select o_orderkey, year(o_orderdate)::integer as year, month(o_orderdate)::integer as month, day(o_orderdate)::integer as day, hour(o_orderdate)::integer as hour,
    (s // 86400000)::bigint as days, ((s // 3600000) % 24)::bigint as hours, ((s // 60000) % 60)::bigint as minutes, (s % 1000)::bigint as millis
    from (select *, o_orderkey * 7919123 + o_custkey as s from orders)""")
def time_parts(t):
    found = t("orders").select("o_orderkey", times.moment_parts(F.col("o_orderdate")).alias("m"), times.span_parts(F.col("o_orderkey") * 7919123 + F.col("o_custkey")).alias("s"))
    return found.select("o_orderkey", "m.year", "m.month", "m.day", "m.hour", "s.days", "s.hours", "s.minutes", F.col("s.milliseconds").alias("millis"))


@query("select o_orderkey, o_orderdate + interval (o_custkey % 50) day + interval (o_orderkey % 30) hour as later, o_orderdate - interval (o_orderkey % 100) minute - interval (o_custkey % 70) second as earlier from orders")
def time_add(t):
    later = times.add(F.col("o_orderdate"), days=F.col("o_custkey") % 50, hours=F.col("o_orderkey") % 30)
    earlier = times.add(F.col("o_orderdate"), minutes=-(F.col("o_orderkey") % 100), seconds=-(F.col("o_custkey") % 70))
    return t("orders").select("o_orderkey", later.alias("later"), earlier.alias("earlier"))


@query("select event_id, cast(datediff('millisecond', timestamp '2024-01-01', date_trunc('second', ts)) as bigint) as millis, ts > timestamp '2024-01-02' as after from events")
def time_diff_ms(t):
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    whole = F.date_trunc("second", "ts").cast("timestamp_ntz")
    return t("events").select("event_id", times.millis_between(whole, start).alias("millis"), (F.col("ts") > F.expr("timestamp_ntz'2024-01-02 00:00:00'")).alias("after"))


@query("""select o_orderkey, (o_orderkey % 5) * 86400000 + (o_custkey % 30) * 3600000 - 1500 as sum, (o_orderkey % 5) * 86400000 + (o_custkey % 30) * 3600000 + 1500 as difference,
    (o_orderkey % 5) * 24 > o_custkey % 30 as longer, o_orderkey % 5 = 0 as empty from orders""")
def span_ops(t):
    a, b = times.span_of(days=F.col("o_orderkey") % 5, hours=F.col("o_custkey") % 30), times.parse_span(F.lit("00:00:01.5"))
    days, hours = times.span_of(days=F.col("o_orderkey") % 5), times.span_of(hours=F.col("o_custkey") % 30)
    return t("orders").select("o_orderkey", times.total_millis(a - b).alias("sum"), times.total_millis(a + b).alias("difference"), (days > hours).alias("longer"), times.is_empty(days).alias("empty"))


@query("""select o_orderkey, case when o_orderkey % 2 = 1 and s > 0 then '-' else '' end || case when s // 86400000 > 0 then (s // 86400000) || '.' else '' end || lpad(((s // 3600000) % 24)::varchar, 2, '0') || ':' || lpad(((s // 60000) % 60)::varchar, 2, '0') || ':' || lpad(((s // 1000) % 60)::varchar, 2, '0')
    || case when s % 1000 > 0 then '.' || (s % 1000) else '' end as text, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as moment from (select *, o_orderkey * 86413 as s from orders)""")
def span_text(t):
    millis = F.when(F.col("o_orderkey") % 2 == 1, -F.col("o_orderkey") * 86413).otherwise(F.col("o_orderkey") * 86413)
    return t("orders").select("o_orderkey", times.span_text(millis).alias("text"), times.moment_text(F.col("o_orderdate")).alias("moment"))
