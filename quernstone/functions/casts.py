"""Typed parsing of cell text. A conversion gives struct(value, error): one bad cell never fails a job.

A conversion is taken in steps. Over a table ``cast_columns`` makes each step a projection of its own, so what a step
finds is computed once and read by the next; used as a function of a column, all steps stand in one expression.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.cells import CONST, ITEM_END, call_parts, is_null_literal, split_items
from quernstone.operators.checkpoints import cut

DECIMAL = "^[+-]?[0-9]+$"
HEXADECIMAL = "^0x[0-9A-Fa-f]{1,16}$"
NUMBER = "^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
DATETIME = "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?)?$"
TIMESPAN = "^(-?)(?:([0-9]+)[. ])?([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.]([0-9]{1,7}))?)?$"
#: Fixed value: the largest finite 32-bit float.
FLOAT_MAX = 3.4028234663852886e38




@dataclass(frozen=True)
class Cast:
    """steps: from text to what was found; judge: (text, found) -> error or null; finish: found -> value, null for null.

    ``few``: the texts of a column are few and costly, so a table casts its distinct ones and joins them back.
    """

    steps: tuple[Callable[[Column], Column], ...]
    judge: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column] = lambda v: v
    few: bool = False

    def __call__(self, c: Column) -> Column:
        found = reduce(lambda x, step: step(x), self.steps, c)
        error = self.judge(c, found)
        return F.struct(F.when(error.isNull(), self.finish(found)).alias("value"), error.alias("error"))


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores in front as long as one is taken."""
    low, made = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in low:
            name = "_" + name
        low.add(name.lower())
        made.append(name)
    return made


def _staged(df: DataFrame, wanted: dict[str, tuple[Cast, Column]]) -> DataFrame:
    """``df`` with a column struct(value, error) for each name, one projection a step for all of them together."""
    own = [F.col(f"`{c}`") for c in df.columns]
    texts, found, errors = ([*fresh(df.columns, *[f"__{kind}{k}" for k in range(len(wanted))])] for kind in ("text", "found", "error"))
    casts = [cast for cast, _ in wanted.values()]
    made = df.select(*own, *[c.cast("string").alias(t) for t, (_, c) in zip(texts, wanted.values(), strict=True)])
    for nr in range(max((len(cast.steps) for cast in casts), default=0)):
        step = [(cast.steps[nr](F.col(f if nr else t)) if nr < len(cast.steps) else F.col(f)).alias(f) for cast, t, f in zip(casts, texts, found, strict=True)]
        made = made.select(*own, *texts, *step)
    made = made.select(*own, *found, *[cast.judge(F.col(t), F.col(f)).alias(e) for cast, t, f, e in zip(casts, texts, found, errors, strict=True)])
    results = [F.struct(F.when(F.col(e).isNull(), cast.finish(F.col(f))).alias("value"), F.col(e).alias("error")).alias(n) for n, cast, f, e in zip(wanted, casts, found, errors, strict=True)]
    return made.select(*own, *results)


def cast_columns(df: DataFrame, wanted: dict[str, tuple[Cast, Column]], most: int = 100_000, hold: Callable[[DataFrame, list[Column]], DataFrame] = lambda df, _: df) -> DataFrame:
    """``df`` with a column struct(value, error) for each name, cast from text. The names must be new.

    Conversions marked ``few`` are made for distinct texts and joined back, by broadcast where a count shows at most
    ``most`` of them and by AQE's choice beyond. ``hold`` adds what the casts read beside some texts, to be dropped after.
    """
    plain = {n: w for n, w in wanted.items() if not w[0].few}
    made = _staged(hold(df, [c.cast("string") for _, c in plain.values()]), plain)
    made = made.select(*[F.col(f"`{c}`") for c in df.columns], *plain)
    for name, (cast, c) in wanted.items():
        if cast.few:
            (own,) = fresh(made.columns, "__text")
            made = made.withColumn(own, c.cast("string"))
            texts = cut(made.select(F.col(own).alias("text")).distinct())
            table = _staged(hold(texts, [F.col("text")]), {"found": (replace(cast, few=False), F.col("text"))}).select(F.col("text").alias(f"{own}_"), F.col("found").alias(name))
            table = F.broadcast(table) if texts.count() <= most else table
            made = made.join(table, F.col(own).eqNullSafe(F.col(f"{own}_")), "left").drop(own, f"{own}_")
    return made


def _scalar(step: Callable[[Column], Column], kind: str, *problems: tuple[Callable[[Column], Column], str], finish: Callable[[Column], Column] = lambda v: v) -> Cast:
    """Null literals, then text that is no such value, then ``problems`` with the value."""

    def judge(c: Column, v: Column) -> Column:
        error = F.when(is_null_literal(c), F.lit("null")).when(v.isNull(), F.lit(f"not a {kind}"))
        for found, name in problems:
            error = error.when(found(v), F.lit(name))
        return error

    return Cast((step,), judge, finish)


def nullable(cast: Cast) -> Cast:
    """The same conversion where a null literal is a null value and no error."""
    return replace(cast, judge=lambda c, found: F.when(~is_null_literal(c), cast.judge(c, found)))


#: Constants by token ``Const:T:N``: what a constant ends in, and its declared type.
HELD = "map<string,struct<text:string,kind:string>>"


def placed(held: Column) -> Callable[[Column], Column]:
    """The text of a constant for its token, any other text as it is."""
    return lambda c: F.when(F.startswith(c, F.lit("Const:")), F.coalesce(F.try_element_at(held, c)["text"], c)).otherwise(c)


def substituted(cast: Cast, held: Column, others: list[str], tables: list[str]) -> Cast:
    """The same conversion where ``Const:T:N`` stands for a text of ``held``; ``others`` are declared types that differ.

    ``tables`` are all that have constants, whether any of theirs is in ``held`` or not.
    """
    put = placed(held)

    def judge(c: Column, found: Column) -> Column:
        hit = F.try_element_at(held, c)
        missing = F.when(F.regexp_extract(c, "^(Const:[^:]*:)", 1).isin([f"Const:{t}:" for t in tables]), F.lit("unknown const")).otherwise(F.lit("unknown const table"))
        wrong = F.when(c.rlike(CONST), F.when(hit.isNull(), missing).when(hit["kind"].isin(others), F.lit("const of another type")))
        return F.coalesce(wrong, cast.judge(put(c), found))

    return replace(cast, steps=(put, *cast.steps), judge=judge)


def _bool(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))


to_bool = _scalar(_bool, "bool")


def _whole(signed: bool) -> Callable[[Column], Column]:
    """Numbers up to 64 bits as long; what is beyond becomes the nearest end of that range."""

    def step(c: Column) -> Column:
        text, low, high = F.trim(c), F.lit(-(2**63)).cast("long"), F.lit(2**63 - 1)
        short = F.when(text.rlike("^[+-]?0*[0-9]{1,18}$"), text).try_cast("long")
        long = F.when(text.rlike(DECIMAL), F.when(F.startswith(text, F.lit("-")), low).otherwise(high))
        # conv() raises beyond 16 digits; the pattern keeps it below
        wide = F.conv(F.when(text.rlike(HEXADECIMAL), F.substring(text, 3, 16)), 16, -10 if signed else 10)
        return F.coalesce(short, long, F.when(wide.isNotNull(), F.coalesce(wide.try_cast("long"), high)))

    return step


def _widest(signed: bool) -> Callable[[Column], Column]:
    def step(c: Column) -> Column:
        text = F.trim(c)
        digits = F.regexp_replace(F.regexp_replace(text, "^[+]", ""), "^(-?)0+(?=[0-9])", "$1")
        # more digits than any type holds stay out of range without overflowing the decimal
        wide = F.when(F.length(digits) > 30, F.when(F.startswith(digits, F.lit("-")), F.lit("-" + "9" * 30)).otherwise(F.lit("9" * 30))).otherwise(digits)
        from_hex = F.conv(F.when(text.rlike(HEXADECIMAL), F.substring(text, 3, 16)), 16, -10 if signed else 10)
        return F.coalesce(F.when(text.rlike(DECIMAL), wide), from_hex).try_cast("decimal(31,0)")

    return step


def _integer(low: int, high: int, kind: str, held: str, signed: bool) -> Cast:
    wide = held in ("long", "decimal(20,0)") and high > 2**32
    lit = lambda n: F.lit(str(n)).cast("decimal(31,0)") if wide else F.lit(n).cast("long")
    problems = ((lambda v: v < lit(low), f"below {kind}"), (lambda v: v > lit(high), f"above {kind}"))
    return _scalar(_widest(signed) if wide else _whole(signed), kind, *problems, finish=lambda v: v.cast(held))


def to_signed(bits: int) -> Cast:
    """Decimal or ``0x`` text within the range of a signed integer; hexadecimal 64-bit text is in two's complement."""
    return _integer(-(2 ** (bits - 1)), 2 ** (bits - 1) - 1, f"int{bits}", {8: "byte", 16: "short", 32: "int", 64: "long"}[bits], True)


def to_unsigned(bits: int) -> Cast:
    return _integer(0, 2**bits - 1, f"uint{bits}", {8: "short", 16: "int", 32: "long", 64: "decimal(20,0)"}[bits], False)


def _double(c: Column) -> Column:
    return F.when(F.trim(c).rlike(NUMBER), F.trim(c)).try_cast("double")


to_double = _scalar(_double, "double")
to_float_checked = _scalar(_double, "double", (lambda v: v < -FLOAT_MAX, "below float"), (lambda v: v > FLOAT_MAX, "above float"))
to_string = Cast((lambda c: F.when(~is_null_literal(c), c),), lambda c, v: F.lit(None).cast("string"))


def _moment(text: Column) -> Column:
    return F.when(text.rlike(DATETIME), text).try_cast("timestamp_ntz")


to_datetime = _scalar(lambda c: _moment(F.trim(c)), "DateTime")


def _captured(text: Column) -> Column:
    """Sign, days, hours, minutes, seconds and fraction of a span; missing numbers are zeros."""
    numbers = [F.regexp_replace(F.regexp_extract(text, TIMESPAN, k), "^$", "0") for k in range(2, 7)]
    return F.when(text.rlike(TIMESPAN), F.array(F.regexp_extract(text, TIMESPAN, 1), *numbers))


def _fits(p: Column) -> Column:
    part = lambda k: F.get(p, F.lit(k)).cast("int")
    return p.isNotNull() & (F.length(F.get(p, F.lit(1))) <= 8) & (part(2) < 24) & (part(3) < 60) & (part(4) < 60)


def _millis(p: Column) -> Column:
    part = lambda k: F.get(p, F.lit(k))
    days = F.when(_fits(p), part(1)).cast("long")
    total = ((days * 24 + part(2).cast("int")) * 60 + part(3).cast("int")) * 60000 + part(4).cast("int") * 1000 + F.rpad(part(5), 7, "0").substr(1, 3).cast("int")
    return F.when(part(0) == "-", -total).otherwise(total)


def span_millis(text: Column) -> Column:
    """Milliseconds of ``[-][d.]hh:mm[:ss[.f]]``, a space as good as the first point; null for other text."""
    return _millis(_captured(text))


def _interval(millis: Column) -> Column:
    return F.make_dt_interval(secs=(millis / 1000).cast("decimal(18,6)"))


to_timespan = _scalar(lambda c: _captured(F.trim(c)), "TimeSpan", (lambda p: ~_fits(p), "not a TimeSpan"), finish=lambda p: _interval(_millis(p)))


def _two_moments(c: Column) -> Column:
    side = lambda k: F.when(c.rlike("^[^~]*~[^~]*$"), _moment(F.trim(F.split_part(c, F.lit("~"), F.lit(k)))))
    return F.struct(side(1).alias("Start"), side(2).alias("End"), F.when(~F.contains(c, F.lit("~")), _captured(F.trim(c))).alias("span"))


def _range_fits(r: Column) -> Column:
    return (r["Start"].isNotNull() & r["End"].isNotNull()) | F.coalesce(_fits(r["span"]), F.lit(False))


def _date_range(r: Column) -> Column:
    origin = F.expr("timestamp_ntz'0001-01-01 00:00:00'")
    both = F.struct(r["Start"].alias("Start"), r["End"].alias("End"))
    return F.when(r["Start"].isNotNull() & r["End"].isNotNull(), both).when(_fits(r["span"]), F.struct(origin.alias("Start"), (origin + _interval(_millis(r["span"]))).alias("End")))


#: ``a ~ b``, or a span from the year 1 on.
to_date_range = _scalar(_two_moments, "DateRange", (lambda r: ~_range_fits(r), "not a DateRange"), finish=_date_range)


def _each(cast: Cast, texts: Column) -> Column:
    """struct(c, v) of every text of an array and what the steps of ``cast`` find in it."""
    found = reduce(lambda xs, step: F.transform(xs, step), cast.steps, texts)
    return F.zip_with(texts, found, lambda c, v: F.struct(c.alias("c"), v.alias("v")))


def _first(errors: Column) -> Column:
    return F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0))


def to_list(element: Cast) -> Cast:
    """Items between ``&``, ``|`` or line feeds; the error is that of the first bad item."""
    judge = lambda c, xs: _first(F.transform(xs, lambda x: element.judge(x["c"], x["v"])))
    return Cast((split_items, lambda items: _each(element, items)), judge, lambda xs: F.transform(xs, lambda x: element.finish(x["v"])))


def to_map(key: Cast, value: Cast) -> Cast:
    """Items ``k:v`` of exactly two parts with distinct keys."""

    def parts(items: Column) -> Column:
        return F.transform(items, lambda x: F.transform(F.split(x, ":"), lambda p: F.trim(p)))

    def typed(pairs: Column) -> Column:
        side = lambda cast, k: _each(cast, F.transform(pairs, lambda p: F.get(p, F.lit(k))))
        return F.when(F.forall(pairs, lambda p: F.size(p) == 2), F.arrays_zip(side(key, 0).alias("k"), side(value, 1).alias("v")))

    keys = lambda ps: F.transform(ps, lambda p: key.finish(p["k"]["v"]))

    def judge(c: Column, ps: Column) -> Column:
        bad = _first(F.transform(ps, lambda p: F.coalesce(key.judge(p["k"]["c"], p["k"]["v"]), value.judge(p["v"]["c"], p["v"]["v"]))))
        twice = F.when(F.size(F.array_distinct(keys(ps))) < F.size(ps), F.lit("duplicate key"))
        return F.when(ps.isNull(), F.lit("not key:value")).otherwise(F.coalesce(bad, twice))

    finish = lambda ps: F.map_from_arrays(keys(ps), F.transform(ps, lambda p: value.finish(p["v"]["v"])))
    return Cast((split_items, parts, typed), judge, finish)


def _pair(pattern: str, kind: str, first: str, second: str, element: Cast) -> Cast:
    def step(c: Column) -> Column:
        text = F.trim(c)
        one = lambda k: F.regexp_extract(text, pattern, k)
        return F.when(text.rlike(pattern), F.struct(one(1).alias("a"), one(2).alias("b")))

    def typed(p: Column) -> Column:
        found = lambda c: reduce(lambda x, f: f(x), element.steps, c)
        return F.when(p.isNotNull(), F.struct(p["a"].alias("a"), p["b"].alias("b"), found(p["a"]).alias("x"), found(p["b"]).alias("y")))

    def judge(c: Column, p: Column) -> Column:
        error = F.when(is_null_literal(c), F.lit("null")).when(p.isNull(), F.lit(f"not a {kind}"))
        return error.when(F.coalesce(element.judge(p["a"], p["x"]), element.judge(p["b"], p["y"])).isNotNull(), F.lit(f"{kind} element out of range"))

    return Cast((step, typed), judge, lambda p: F.when(p.isNotNull(), F.struct(element.finish(p["x"]).alias(first), element.finish(p["y"]).alias(second))))


def to_point(element: Cast | None = None) -> Cast:
    return _pair("^([0-9]+)\\s*,\\s*([0-9]+)$", "point", "x", "y", element or to_unsigned(32))


def to_size(element: Cast | None = None) -> Cast:
    return _pair("^([0-9]+)\\s*,\\s*([0-9]+)$", "size", "width", "height", element or to_unsigned(32))


def to_range(element: Cast | None = None) -> Cast:
    return _pair("^([0-9]+)\\s*~\\s*([0-9]+)$", "range", "min", "max", element or to_unsigned(32))


to_sequence = to_signed(32)


def _parts(c: Column) -> Column:
    p = call_parts(c)
    return F.when(p.isNotNull(), F.struct(p["header"].alias("Type"), p["args"].alias("Parameters")))


#: ``header(a, b)`` as struct(Type, Parameters) of text, unchecked; ``to_dsl`` checks it and lookups.bind_calls() joins it.
to_call = replace(_scalar(_parts, "call"), steps=(call_parts, lambda p: F.when(p.isNotNull(), F.struct(p["header"].alias("Type"), p["args"].alias("Parameters")))))


def _apart(step: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The step as a lambda over one element, null for null, so that its code isn't part of the method of the whole stage.

    The JVM doesn't compile methods of more than 8,000 bytes, and the checks of a few arguments exceed that.
    """
    return lambda c: F.get(F.transform(F.when(c.isNotNull(), F.array(c)), step), F.lit(0))


def to_dsl(calls: dict[str, list[tuple[str, str, bool, str | None]]], cast_of: Callable[[str], Cast], put: Callable[[Column], Column] | None = None) -> Cast:
    """A call that is known, with as many arguments as its prototype takes, each of the declared type: struct(Type, Parameters).

    ``calls``: header -> [(name, type, has default, default)]. Parameters come as text with defaults filled in; with ``put``
    constants in them are replaced by their texts, so what reads the value needs no constants.
    """
    lists = [f"{h}:{k}" for h, ps in calls.items() for k, p in enumerate(ps) if p[1].lstrip("*!~").startswith("[")]
    used = {(k, kind): f"a{nr}" for nr, (k, kind) in enumerate(dict.fromkeys((k, p[1]) for ps in calls.values() for k, p in enumerate(ps)))}
    casts = {kind: cast_of(kind) for _, kind in used}

    text = lambda p, k: F.get(p["Parameters"], F.lit(k))
    own = lambda p: [p["Type"].alias("Type"), p["Parameters"].alias("Parameters")]

    def typed(p: Column) -> Column:
        args = []
        for (k, kind), name in used.items():
            mine = [h for h, ps in calls.items() if k < len(ps) and ps[k][1] == kind]
            args.append(reduce(lambda x, step: step(x), casts[kind].steps, F.when(p["Type"].isin(mine), text(p, k))).alias(name))
        return F.struct(*own(p), *args)

    def told(p: Column) -> Column:
        given = F.size(p["Parameters"])
        error = F.when(~p["Type"].isin([*calls]), F.lit("unknown header"))
        for h, ps in calls.items():
            count = F.when(given < sum(not x[2] for x in ps), F.lit("too few arguments")).when(given > len(ps), F.lit("too many arguments"))
            bad = [F.when(text(p, k).isNotNull(), F.concat(F.lit(f"{name}: "), casts[kind].judge(text(p, k), p[used[k, kind]]))) for k, (name, kind, _, _) in enumerate(ps)]
            error = error.when(p["Type"] == h, F.coalesce(count, *bad))
        return F.struct(*own(p), error.alias("error"))

    def judge(c: Column, p: Column) -> Column:
        return F.when(is_null_literal(c), F.lit("null")).when(p.isNull(), F.lit("not a call")).otherwise(p["error"])

    def resolved(header: Column, x: Column, k: Column) -> Column:
        each = F.array_join(F.transform(split_items(x), lambda item: F.concat(put(item), F.lit(ITEM_END))), "")
        inside = F.contains(x, F.lit("Const:")) & ~x.rlike(CONST) & F.concat_ws(":", header, k.cast("string")).isin(lists)
        return F.when(inside, each).otherwise(put(x))

    def finish(p: Column) -> Column:
        full = given = p["Parameters"] if put is None else F.transform(p["Parameters"], lambda x, k: resolved(p["Type"], x, k))
        for h, ps in calls.items():
            rest = F.slice(F.array(*[F.lit(x[3]).cast("string") for x in ps]), F.size(p["Parameters"]) + 1, F.greatest(F.lit(len(ps)) - F.size(p["Parameters"]), F.lit(0)))
            full = F.when(p["Type"] == h, F.concat(given, rest)).otherwise(full) if ps else full
        return F.when(p.isNotNull(), F.struct(p["Type"].alias("Type"), full.alias("Parameters")))

    return Cast((_parts, _apart(typed), _apart(told)), judge, finish)


TOKENS = "0x[0-9A-Fa-f]+|[A-Za-z_0-9]+|[&|~()]"


def fold_tokens(tokens: Column, value_of: Callable[[Column], Column]) -> Column:
    """struct(mask, fault) of an expression over values, ``&``, ``|``, ``~`` and parentheses, from left to right.

    fault: 0, 1 where the tokens are no such expression, 2 where ``value_of`` knows no value for an operand. Parentheses
    are kept on a stack of (value, operator) that wait for what is inside.
    """
    kind = "struct<waiting:array<struct<value:bigint,op:string,flip:boolean>>,value:bigint,op:string,flip:boolean,fault:int>"
    start = F.from_json(F.lit('{"waiting":[],"flip":false,"fault":0}'), kind)
    join = lambda left, op, right: F.when(op == "&", left.bitwiseAND(right)).when(op == "|", left.bitwiseOR(right)).otherwise(right)
    none, no = F.lit(None).cast("long"), F.lit(None).cast("string")

    def take(at: Column, t: Column) -> Column:
        operand = at["value"].isNull() | at["op"].isNotNull()
        top = F.try_element_at(at["waiting"], F.lit(-1))
        state = lambda waiting, value, op, flip: F.struct(waiting.alias("waiting"), value.alias("value"), op.alias("op"), flip.alias("flip"), at["fault"].alias("fault"))
        bad = lambda n: F.struct(at["waiting"].alias("waiting"), at["value"].alias("value"), at["op"].alias("op"), at["flip"].alias("flip"), F.lit(n).alias("fault"))
        turned = lambda v, flip: F.when(flip, F.bitwise_not(v)).otherwise(v)
        opened = F.concat(at["waiting"], F.array(F.struct(at["value"].alias("value"), at["op"].alias("op"), at["flip"].alias("flip"))))
        closed = F.slice(at["waiting"], F.lit(1), F.size(at["waiting"]) - 1)
        own = value_of(t)
        return (
            F.when(at["fault"] != 0, at)
            .when(t == "(", F.when(operand, state(opened, none, no, F.lit(False))).otherwise(bad(1)))
            .when(t == ")", F.when(~operand & ~at["flip"] & top.isNotNull(), state(closed, join(top["value"], top["op"], turned(at["value"], top["flip"])), no, F.lit(False))).otherwise(bad(1)))
            .when(t.isin("&", "|"), F.when(operand, bad(1)).otherwise(state(at["waiting"], at["value"], t, F.lit(False))))
            .when(t == "~", F.when(operand & ~at["flip"], state(at["waiting"], at["value"], at["op"], F.lit(True))).otherwise(bad(1)))
            .when(~operand, bad(1))
            .when(own.isNull(), bad(2))
            .otherwise(state(at["waiting"], join(at["value"], at["op"], turned(own, at["flip"])), no, F.lit(False)))
        )

    def end(at: Column) -> Column:
        whole = (F.size(at["waiting"]) == 0) & at["value"].isNotNull() & at["op"].isNull() & ~at["flip"]
        fault = F.when(at["fault"] != 0, at["fault"]).when(whole, F.lit(0)).otherwise(F.lit(1))
        return F.struct(F.when(fault == 0, at["value"]).alias("mask"), fault.alias("fault"))

    return F.aggregate(tokens, start, take, end)


def to_enum(members: dict[str, int]) -> Cast:
    """A member name, or names joined by ``&``, ``|`` and parentheses, applied from left to right: struct(name, mask)."""

    def tokens(c: Column) -> Column:
        text = F.regexp_replace(c, "\\s", "")
        return F.when(text.rlike("^(?:[A-Za-z_][A-Za-z_0-9]*|[&|()])+$") & ~is_null_literal(c), F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)))

    known = lambda: F.from_json(F.lit(json.dumps(members)), "map<string,bigint>")

    def folded(ts: Column) -> Column:
        name = F.when(F.size(F.filter(ts, lambda t: ~t.isin("(", ")"))) == 1, F.get(F.filter(ts, lambda t: ~t.isin("(", ")")), F.lit(0)))
        return F.when(ts.isNotNull(), F.struct(name.alias("name"), fold_tokens(ts, lambda t: F.try_element_at(known(), t)).alias("r")))

    def judge(c: Column, f: Column) -> Column:
        error = F.when(is_null_literal(c), F.lit("null")).when(f.isNull() | (f["r"]["fault"] == 1), F.lit("not a enum expression"))
        return error.when(f["r"]["fault"] == 2, F.lit("unknown member"))

    return Cast((tokens, folded), judge, lambda f: F.when(f.isNotNull(), F.struct(f["name"].alias("name"), f["r"]["mask"].cast("int").alias("mask"))), few=True)
