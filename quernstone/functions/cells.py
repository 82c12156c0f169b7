"""Predicates and captures on the text of a cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: References to constants, calls, names.
CONST = "^Const:([A-Za-z_][A-Za-z_0-9]*):([A-Za-z_][A-Za-z_0-9]*)$"
CALL = "(?s)^\\s*([A-Za-z_][A-Za-z_0-9]*)\\s*\\((.*)\\)\\s*$"
NAME = "^[a-zA-Z_$][a-zA-Z_$0-9]*$"
#: Fixed value: separators of a list cell, outside parentheses.
SEPARATOR = "[&|\\n](?![^()]*\\))"
#: Ends each item of a list put together from texts that may hold separators.
ITEM_END = "\x1e"


def is_null_literal(c: Column) -> Column:
    """Null, empty, or ``null`` with blanks around it."""
    return c.isNull() | (c == "") | (F.trim(c) == "null")


def is_const(c: Column) -> Column:
    return c.rlike(CONST)


def const_parts(c: Column) -> Column:
    """struct(table, name) of a reference to a constant, else null."""
    return F.when(is_const(c), F.struct(F.regexp_extract(c, CONST, 1).alias("table"), F.regexp_extract(c, CONST, 2).alias("name")))


def is_call(c: Column) -> Column:
    return c.rlike(CALL)


def call_parts(c: Column) -> Column:
    """struct(header, args) of ``header(a, b)``, else null; no argument between empty parentheses."""
    inner = F.regexp_extract(c, CALL, 2)
    args = F.when(F.trim(inner) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(inner), "\\s*,\\s*"))
    return F.when(is_call(c), F.struct(F.regexp_extract(c, CALL, 1).alias("header"), args.alias("args")))


def valid_name(c: Column) -> Column:
    return c.rlike(NAME)


def split_items(c: Column) -> Column:
    """Items of a list cell, trimmed, without empty ones; an empty array for a null literal. A text with ``ITEM_END`` has no other separators."""
    parts = F.when(F.contains(c, F.lit(ITEM_END)), F.split(c, ITEM_END)).otherwise(F.split(c, SEPARATOR))
    items = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(is_null_literal(c), F.array().cast("array<string>")).otherwise(items)


def fingerprint(content: Column) -> Column:
    """``crc32.length`` of binary content."""
    return F.concat_ws(".", F.crc32(content).cast("string"), F.octet_length(content).cast("string"))


def normalize_number(c: Column) -> Column:
    """Text of a numeric cell under an integer type: a whole number if within 1e-4 of one, else four decimals."""
    whole = F.rint(c)
    return F.when(F.abs(whole - c) < 0.0001, whole.cast("long").cast("string")).otherwise(F.bround(c.cast("decimal(30,10)"), 4).cast("string"))


def serial_datetime(days: Column) -> Column:
    """A day count from 1899-12-30, as workbooks store dates, to the millisecond."""
    return F.expr("timestamp_ntz'1899-12-30 00:00:00'") + F.make_dt_interval(secs=(F.round(days * 86400000) / 1000).cast("decimal(18,6)"))


def normalize_cell(kind: Column, value: Column, declared: Column) -> Column:
    """Text of a raw cell as its declared type wants it; blank becomes null."""
    number = F.expr("try_cast(value as double)") if isinstance(value, str) else value.try_cast("double")
    numeric = kind == "numeric"
    moment = serial_datetime(number)
    text = F.trim(value)
    return (
        F.when(numeric & declared.isin("int", "long"), normalize_number(number))
        .when(numeric & (declared == "DateTime"), F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))
        .when(numeric & (declared == "TimeSpan"), F.date_format(moment, "HH:mm:ss"))
        .when((kind == "blank") | (text == ""), F.lit(None))
        .otherwise(text)
    )
