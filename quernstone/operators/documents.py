"""Values of cast columns as they stand in JSON documents, by their declared types."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.casts import Cast
from quernstone.functions.times import total_millis
from quernstone.operators.catalog import _ALIASES, Catalog, parts_of

_NULL = "null"
#: Members of the pairs, in the order in which a cast holds them.
_PAIRS = {"point": ("x", "y"), "size": ("width", "height"), "range": ("min", "max")}


def quoted(c: Column) -> Column:
    """A value as a JSON string, escaped."""
    made = F.to_json(F.struct(c.cast("string").alias("k")))
    return F.substr(made, F.lit(6), F.length(made) - 6)


@dataclass(frozen=True)
class Written:
    """``text``: a scalar as the name of a member, null for null; ``json``: any value, ``null`` for null."""

    json: Callable[[Column], Column]
    text: Callable[[Column], Column]


def _bound(c: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of ``c``, in which ``c`` stands once however often ``made`` names it."""
    return F.get(F.transform(F.array(c), made), F.lit(0))


def _value(cast: Cast, text: Column) -> Column:
    """The value of a text that the cast is known to take, each step bound once."""

    def through(own: Column) -> Column:
        made: Callable[[Column], Column] = lambda v: F.when(cast.judge(own, v).isNull(), cast.finish(v))
        for step in reversed(cast.steps):
            made = (lambda step, after: lambda x: _bound(step(x), after))(step, made)
        return made(own)

    return _bound(text, through)


def text_of_argument(catalog: Catalog, kind: str, text: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of an argument of a call, which is kept as text without constants, cast to the type of its parameter."""
    return _bound(_value(catalog.without_consts().cast(kind), text), made)


def _or_null(made: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: F.coalesce(made(c), F.lit(_NULL))


def _named(text: Callable[[Column], Column]) -> Written:
    return Written(_or_null(lambda c: F.when(c.isNotNull(), quoted(text(c)))), text)


def _moment(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _span(c: Column) -> Column:
    """``[-][d.]hh:mm:ss[.fffffff]``: days and fraction only where they aren't zero."""

    def made(millis: Column) -> Column:
        rest = F.abs(millis)
        part = lambda by, of: F.floor(rest / by).cast("long") % of
        days = F.floor(rest / 86_400_000).cast("long")
        clock = F.format_string("%02d:%02d:%02d", part(3_600_000, 24), part(60_000, 60), part(1000, 60))
        ahead = F.concat(F.when(millis < 0, F.lit("-")).otherwise(F.lit("")), F.when(days > 0, F.concat(days.cast("string"), F.lit("."))).otherwise(F.lit("")))
        return F.concat(ahead, clock, F.when(rest % 1000 > 0, F.format_string(".%03d0000", rest % 1000)).otherwise(F.lit("")))

    return F.when(c.isNotNull(), _bound(total_millis(c), made))


def _number(c: Column) -> Column:
    made = F.to_json(F.struct(c.alias("k")))
    return F.when(c.isNotNull(), F.substr(made, F.lit(6), F.length(made) - 6))


def _object(members: dict[str, Callable[[Column], Column]]) -> Callable[[Column], Column]:
    def made(c: Column) -> Column:
        parts = [x for n, (name, value) in enumerate(members.items()) for x in (F.lit(("{" if not n else ",") + json.dumps(name) + ":"), value(c))]
        return F.when(c.isNotNull(), F.concat(*parts, F.lit("}")))

    return _or_null(made)


def _calls(catalog: Catalog) -> Callable[[Column], Column]:
    """Arguments are kept as text; each is written as its parameter's type says, as text where there are no prototypes."""

    def arguments(c: Column) -> Column:
        given = c["Parameters"]
        listed = F.array_join(F.transform(given, quoted), ",")
        for header, params in catalog.calls.items():
            own = [text_of_argument(catalog, kind, F.get(given, F.lit(k)), written(catalog, kind).json) for k, (_, kind, _, _) in enumerate(params)]
            listed = F.when(c["Type"] == header, F.concat_ws(",", *own) if own else F.lit("")).otherwise(listed)
        return F.concat(F.lit("["), listed, F.lit("]"))

    return _object({"Type": lambda c: quoted(c["Type"]), "Parameters": arguments})


def written(catalog: Catalog, kind: str) -> Written:
    """How values of a declared type are written: the one member of an enum by name and a combination by number, spans and
    moments as text, ranges and pairs as objects, arguments of calls by the types of the parameters, lists and maps by
    those of what they hold. Keys of maps are texts.
    """
    d = catalog.root(kind)
    shape, inner = parts_of(d.name)
    none = lambda c: F.lit(None).cast("string")
    if shape == "list":
        item = written(catalog, inner[0])
        return Written(_or_null(lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, item.json), ","), F.lit("]"))), none)
    if shape == "map":
        key, value = written(catalog, inner[0]), written(catalog, inner[1])
        pair = lambda e: F.concat(quoted(key.text(e["key"])), F.lit(":"), value.json(e["value"]))
        return Written(_or_null(lambda c: F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), pair), ","), F.lit("}"))), none)
    if shape in _PAIRS:
        return Written(_object({m: (lambda c, m=m: F.coalesce(c[m].cast("string"), F.lit(_NULL))) for m in _PAIRS[shape]}), none)
    if d.name in catalog.enums:
        text = lambda c: F.coalesce(c["name"], c["mask"].cast("string"))
        return Written(_or_null(lambda c: F.coalesce(F.when(c["name"].isNotNull(), quoted(c["name"])), c["mask"].cast("string"))), text)
    plain = _ALIASES.get(d.name)
    if plain == "dsl":
        return Written(_calls(catalog), none)
    if plain == "DateRange":
        return Written(_object({m: (lambda c, m=m: quoted(_moment(c[m]))) for m in ("Start", "End")}), none)
    if plain in ("string", "DateTime", "TimeSpan"):
        return _named({"string": lambda c: c.cast("string"), "DateTime": _moment, "TimeSpan": _span}[plain])
    if plain in ("float", "double"):
        return Written(_or_null(_number), lambda c: c.cast("string"))
    return Written(_or_null(lambda c: c.cast("string")), lambda c: c.cast("string"))


def written_columns(catalog: Catalog, tables: list[str]) -> dict[str, Written]:
    """How the columns of tables are written; of tables with a column of the same name the first one's type counts."""
    kinds = {c: kind for t in reversed(tables) for c, (kind, _) in catalog.columns.get(t, {}).items()}
    return {c: written(catalog, kind) for c, kind in kinds.items()}
