"""Spans, moments and pairs, as the reading side uses them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.casts import span_millis


def span_of(days=0, hours=0, minutes=0, seconds=0, millis=0) -> Column:
    n = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.make_dt_interval(n(days).cast("int"), n(hours).cast("int"), n(minutes).cast("int"), n(seconds).cast("decimal(18,6)") + n(millis).cast("decimal(18,6)") / F.lit(1000))


def parse_span(text: Column) -> Column:
    return F.make_dt_interval(secs=(span_millis(F.trim(text)) / 1000).cast("decimal(18,6)"))


def total_millis(span: Column) -> Column:
    """Whole milliseconds of an interval, with its sign."""
    day, hour, minute, second = (F.extract(F.lit(x), span) for x in ("DAY", "HOUR", "MINUTE", "SECOND"))
    return ((day.cast("long") * 24 + hour) * 60 + minute) * 60000 + (second * 1000).cast("long")


def is_empty(span: Column) -> Column:
    return total_millis(span) == 0


def span_parts(millis: Column) -> Column:
    """struct(days, hours, minutes, seconds, milliseconds); every part has the sign of the span."""
    whole = lambda by, of: F.expr("1").cast("long") * ((millis - millis % by) / by).cast("long") % of if of else ((millis - millis % by) / by).cast("long")
    return F.struct(whole(86400000, 0).alias("days"), whole(3600000, 24).alias("hours"), whole(60000, 60).alias("minutes"), whole(1000, 60).alias("seconds"), (millis % 1000).alias("milliseconds"))


def span_text(millis: Column) -> Column:
    """``[-][d.]hh:mm:ss[.ms]``, days and milliseconds only where they are not zero, the latter not padded."""
    p = span_parts(F.abs(millis))
    days = F.when(p["days"] != 0, F.concat(p["days"].cast("string"), F.lit("."))).otherwise(F.lit(""))
    rest = F.when(p["milliseconds"] != 0, F.concat(F.lit("."), p["milliseconds"].cast("string"))).otherwise(F.lit(""))
    clock = F.format_string("%02d:%02d:%02d", p["hours"], p["minutes"], p["seconds"])
    return F.concat(F.when(millis < 0, F.lit("-")).otherwise(F.lit("")), days, clock, rest)


def moment_parts(ts: Column) -> Column:
    second = F.extract(F.lit("SECOND"), ts)
    return F.struct(F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"), F.hour(ts).alias("hour"), F.minute(ts).alias("minute"), F.floor(second).cast("int").alias("second"), (second * 1000 % 1000).cast("int").alias("millisecond"))


def add(ts: Column, **parts) -> Column:
    """A moment later by days, hours, minutes, seconds or millis; negative ones go back."""
    return ts + span_of(**parts)


def millis_between(later: Column, earlier: Column) -> Column:
    return total_millis(later - earlier)


def moment_text(ts: Column | None = None) -> Column:
    """``yyyy-MM-dd HH:mm:ss``; the present moment by default."""
    return F.date_format(F.localtimestamp() if ts is None else ts, "yyyy-MM-dd HH:mm:ss")


def in_range(ts: Column, span: Column) -> Column:
    """Start inclusive, end exclusive."""
    return (ts >= span["Start"]) & (ts < span["End"])


def same_pair(a: Column, b: Column) -> Column:
    return a == b
