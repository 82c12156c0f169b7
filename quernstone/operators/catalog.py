"""Declared types and the catalog of columns."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Collection
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import casts
from quernstone.functions.cells import CONST
from quernstone.operators import constants
from quernstone.operators.chains import chain_ends

SERVER, CLIENT, COMMON = 1, 2, 3
SCOPES = {"server": SERVER, "client": CLIENT, "common": COMMON}
_ALIASES = {
    "bool": "bool", "sbyte": "int8", "int8": "int8", "int8_t": "int8", "byte": "uint8", "uint8": "uint8", "uint8_t": "uint8",
    "short": "int16", "int16": "int16", "int16_t": "int16", "ushort": "uint16", "uint16": "uint16", "uint16_t": "uint16",
    "int": "int32", "int32": "int32", "int32_t": "int32", "uint": "uint32", "uint32": "uint32", "uint32_t": "uint32",
    "long": "int64", "int64": "int64", "int64_t": "int64", "ulong": "uint64", "uint64": "uint64", "uint64_t": "uint64",
    "float": "float", "double": "double", "string": "string", "DateTime": "DateTime", "TimeSpan": "TimeSpan", "DateRange": "DateRange", "dsl": "dsl",
}


@dataclass(frozen=True)
class Declared:
    """A declared type without its markers: ``*T`` primary, ``(T)`` group, ``!T`` strong, ``~T`` sequence, ``$T`` reference, ``T?`` nullable."""

    name: str
    primary: bool = False
    group: bool = False
    strong: bool = False
    sequence: bool = False
    reference: str | None = None
    reference_column: str | None = None
    nullable: bool = False


def declared(text: str) -> Declared:
    """Markers are taken off from the outside in; anything left over on the way is an error."""
    rest, primary, group = text.strip(), False, False
    if rest.startswith("*"):
        primary, rest = True, rest[1:]
    elif m := re.fullmatch(r"\((.+)\)", rest):
        group, rest = True, m[1]
    elif rest.startswith("("):
        raise ValueError(f"{text}: nothing may follow the parenthesis of a group key")
    found = Declared(rest, primary, group)
    if found.name.startswith("!"):
        found = replace(found, strong=True, name=found.name[1:])
    if found.name.startswith("~"):
        found = replace(found, sequence=True, name=found.name[1:])
    if found.name.endswith("?"):
        found = replace(found, nullable=True, name=found.name[:-1])
    if m := re.fullmatch(r"\$(\w+)(?:\.(\w+))?", found.name):
        found = replace(found, reference=m[1], reference_column=m[2])
    elif found.name.startswith("$") or not found.name:
        raise ValueError(f"{text}: not a declared type")
    return found


def parts_of(name: str) -> tuple[str, list[str]]:
    """('list', [T]), ('map', [K, V]), ('point' | 'size' | 'range', [T]) or ('scalar', [name])."""
    if m := re.fullmatch(r"\[(.+)\]", name):
        return "list", [m[1]]
    if m := re.fullmatch(r"\{(.+)\}", name):
        depth = 0
        for k, c in enumerate(m[1]):
            depth += (c in "[{<") - (c in "]}>")
            if c == ":" and not depth:
                return "map", [m[1][:k], m[1][k + 1 :]]
        raise ValueError(f"{name}: a map needs a key and a value type")
    if m := re.fullmatch(r"(point|size|range)(?:<(.+)>)?", name):
        return m[1], [m[2] or "uint"]
    return "scalar", [name]


@dataclass
class Catalog:
    """Small declarations, held by the driver: columns by table (name, type text, scope), enums, call parameters.

    ``calls``: header -> [(name, type, has default, default)]. ``consts``: (table, name) -> (type, text), where a text may
    name another constant; ``texts`` is ``const_rows`` as a saved table, if there is one, and ``names_consts`` tells whether
    cells to be cast name any. ``groups``: table -> JSON group, the table's own name where it isn't listed.
    """

    columns: dict[str, dict[str, tuple[str, int]]] = field(default_factory=dict)
    enums: dict[str, dict[str, int]] = field(default_factory=dict)
    calls: dict[str, list[tuple[str, str, bool, str | None]]] = field(default_factory=dict)
    consts: dict[tuple[str, str], tuple[str, str | None]] = field(default_factory=dict)
    groups: dict[str, str] = field(default_factory=dict)
    texts: DataFrame | None = None
    names_consts: bool = True

    def key(self, table: str) -> str | None:
        """The group key if there is one, else the primary key."""
        marks = {c: declared(t) for c, (t, _) in self.columns[table].items()}
        return next((c for c, d in marks.items() if d.group), next((c for c, d in marks.items() if d.primary), None))

    def root(self, text: str) -> Declared:
        """The type that references end in; a null anywhere on the way makes it nullable."""
        d, seen, optional = declared(text), {text}, False
        while d.reference is not None:
            optional |= d.nullable
            if d.reference not in self.columns:
                raise ValueError(f"{text}: unknown table")
            column = d.reference_column or self.key(d.reference)
            if column not in self.columns[d.reference]:
                raise ValueError(f"{text}: unknown column or no key")
            kind = self.columns[d.reference][column][0]
            if kind in seen:
                raise ValueError(f"{text}: references form a cycle")
            seen.add(kind)
            d = declared(kind)
        end = replace(d, name="int") if d.sequence else d
        return replace(end, nullable=end.nullable or optional)

    def const_ends(self) -> dict[tuple[str, str], str | None]:
        """The text that each constant ends in; those in a circle of constants, or on the way into one, are left out."""
        ends: dict[tuple[str, str], str | None] = {}
        seen: set[tuple[str, str]] = set()
        for at in self.consts:
            way: list[tuple[str, str]] = []
            while at not in seen:
                seen.add(at)
                way.append(at)
                text = self.consts[at][1]
                link = re.fullmatch(CONST, text or "")
                if not link or link.groups() not in self.consts:
                    ends[at] = text
                    break
                at = link.groups()
            if at in ends:
                ends.update(dict.fromkeys(way, ends[at]))
        return ends

    def const_text(self, table: str, name: str) -> str | None:
        """The text a constant ends in; a circle of constants is an error."""
        at, seen = (table, name), set()
        while at not in seen:
            seen.add(at)
            text = self.consts[at][1]
            link = re.fullmatch(CONST, text or "")
            if not link or link.groups() not in self.consts:
                return text
            at = link.groups()
        raise ValueError(f"Const:{table}:{name}: constants form a cycle")

    def same_type(self, a: str, b: str) -> bool:
        """Whether two declared types end in the same one, nullability aside."""
        one, other = self.root(a).name, self.root(b).name
        return _ALIASES.get(one, one) == _ALIASES.get(other, other)

    def const_rows(self) -> list[tuple[str, str, str]]:
        """(token, text, kind) of the constants."""
        return [(f"Const:{t}:{n}", text or "", self.consts[t, n][0]) for (t, n), text in self.const_ends().items()]

    def const_texts(self, session: SparkSession) -> DataFrame:
        """``const_rows`` as a table; ``convert`` saves it once in ``texts``."""
        return self.texts if self.texts is not None else session.createDataFrame(self.const_rows(), "token string, text string, kind string")

    def without_consts(self) -> Catalog:
        """For texts in which constants are replaced already."""
        return replace(self, consts={}, texts=None)

    def cast(self, text: str, held: Column | None = None) -> casts.Cast:
        """The conversion of a declared type, of which a constant may stand for any value or element.

        ``held`` is the column that ``constants.hold`` gives the rows. Without it all constants stand in the expression,
        which is for few of them.
        """
        if self.consts and held is None:
            held = F.from_json(F.lit(json.dumps({token: {"text": own, "kind": kind} for token, own, kind in self.const_rows()})), casts.HELD)
        found = self._plain_cast(text, held)
        if not self.consts:
            return found
        others = [kind for kind in dict.fromkeys(kind for kind, _ in self.consts.values()) if not self.same_type(kind, text)]
        return casts.substituted(found, held, others, sorted({t for t, _ in self.consts}))

    def described(self, text: str) -> object:
        """All that the cast of a declared type depends on, but for constants: roots of references, enums, prototypes."""
        d = self.root(text)
        shape, inner = parts_of(d.name)
        own: object = d.name
        if shape in ("list", "map"):
            own = [shape, *(self.described(k) for k in inner)]
        elif d.name in self.enums:
            own = [d.name, sorted(self.enums[d.name].items())]
        elif d.name == "dsl":
            own = ["dsl", [[h, [[n, self.described(k), has, default] for n, k, has, default in ps]] for h, ps in sorted(self.calls.items())]]
        return [own, d.nullable]

    def fingerprint(self, table: str, used: Collection[tuple[str, str]]) -> str:
        """Of all declarations that the cast of a table depends on; ``used`` are the constants that its cells name."""
        consts = [[*c, self.described(self.consts[c][0]), self.const_text(*c)] if c in self.consts else [*c] for c in sorted(used)]
        whole = [[[c, self.described(kind)] for c, (kind, _) in self.columns[table].items()], consts, sorted({t for t, _ in self.consts}) if used else []]
        return hashlib.sha256(json.dumps(whole).encode()).hexdigest()[:24]

    def _to_dsl(self, held: Column | None) -> casts.Cast:
        own = lambda text: self.const_text(*m.groups()) if (m := re.fullmatch(CONST, text or "")) and m.groups() in self.consts else text
        calls = {h: [(n, kind, has, own(default)) for n, kind, has, default in ps] for h, ps in self.calls.items()}
        return casts.to_dsl(calls, lambda kind: self.cast(kind, held), casts.placed(held) if self.consts else None)

    def _plain_cast(self, text: str, held: Column | None) -> casts.Cast:
        d = self.root(text)
        shape, inner = parts_of(d.name)
        if shape == "list":
            return casts.to_list(self.cast(inner[0], held))
        if shape == "map":
            return casts.to_map(self.cast(inner[0], held), self.cast(inner[1], held))
        if shape in ("point", "size", "range"):
            element = _ALIASES.get(inner[0], "")
            if not element.startswith("uint"):
                raise ValueError(f"{text}: elements must be unsigned")
            found = {"point": casts.to_point, "size": casts.to_size, "range": casts.to_range}[shape](casts.to_unsigned(int(element[4:])))
        elif d.name in self.enums:
            found = casts.to_enum(self.enums[d.name])
        else:
            plain = _ALIASES.get(d.name)
            if plain is None:
                raise ValueError(f"{text}: unknown type")
            named = {"bool": casts.to_bool, "float": casts.to_float_checked, "double": casts.to_double, "string": casts.to_string, "DateTime": casts.to_datetime, "TimeSpan": casts.to_timespan, "DateRange": casts.to_date_range, "dsl": self._to_dsl(held) if plain == "dsl" and self.calls else casts.to_call}
            found = named.get(plain) or (casts.to_unsigned if plain[0] == "u" else casts.to_signed)(int(re.sub(r"\D", "", plain)))
        return casts.nullable(found) if d.nullable else found


def cast_texts(df: DataFrame, catalog: Catalog, wanted: dict[str, tuple[str, Column]], held: str = "__constants") -> DataFrame:
    """``df`` with a column struct(value, error) for each (declared type, text); constants are joined to the rows as ``held``."""
    if not catalog.consts:
        return casts.cast_columns(df, {name: (catalog.cast(kind), c) for name, (kind, c) in wanted.items()})
    texts = catalog.const_texts(df.sparkSession)
    given = lambda rows, columns: constants.hold(rows, columns, texts, held) if catalog.names_consts else rows.withColumn(held, F.lit(None).cast(casts.HELD))
    return casts.cast_columns(df, {name: (catalog.cast(kind, F.col(held)), c) for name, (kind, c) in wanted.items()}, hold=given)


def cast_declared(df: DataFrame, catalog: Catalog, table: str) -> DataFrame:
    """Every declared column of text cast, other columns kept; ``errors`` lists (column, value, error).

    The steps of all columns are projections over the same rows. Cells may name constants of the catalog; enums are cast
    once per distinct text; calls are checked against their prototypes.
    """
    wanted = catalog.columns[table]
    held, *names = casts.fresh([*df.columns, "errors", "text"], "__constants", *[f"__{c}" for c in wanted])
    found = dict(zip(wanted, names, strict=True))
    made = cast_texts(df, catalog, {found[c]: (t, F.col(f"`{c}`")) for c, (t, _) in wanted.items()}, held)
    error = lambda c: F.col(f"`{found[c]}`.error")
    faults = F.array(*[F.when(error(c).isNotNull(), F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"), error(c).alias("error"))) for c in wanted])
    keep = [F.col(f"`{found[c]}`.value").alias(c) if c in found else F.col(f"`{c}`") for c in df.columns]
    return made.select(*keep, F.array_compact(faults).alias("errors"))


def scope_project(df: DataFrame, catalog: Catalog, table: str, scope: int) -> DataFrame:
    """The columns that a scope may see."""
    return df.select(*[c for c, (_, s) in catalog.columns[table].items() if s & scope and c in df.columns])


def root_types(columns: DataFrame) -> DataFrame:
    """(table, name, root, nullable, hops, fault) of catalog rows (table, name, target, target_column, type, nullable).

    ``target`` is null for a column that is no reference. Chains may be of any length. A chain that ends in a column that
    does not exist has no root and the fault ``unknown target``; one that runs in circles the fault ``cycle``.
    """
    key = lambda table, name: F.when(F.col(table).isNotNull(), F.struct(F.col(table).alias("table"), F.col(name).alias("name")))
    ends = chain_ends(columns.select(key("table", "name").alias("node"), key("target", "target_column").alias("target"), "nullable"), ["nullable"])
    types = columns.select(key("table", "name").alias("end"), "type")
    found = ends.join(types, "end", "left")
    return found.select("node.table", "node.name", F.when(F.col("fault").isNull(), F.col("type")).alias("root"), "nullable", "hops", "fault")


def inheritance_levels(tables: DataFrame) -> DataFrame:
    """(table, level, fault) of rows (table, based): how many tables stand above one; null where bases form a ``cycle``.

    A base that is no table (``unknown target``) doesn't count.
    """
    ends = chain_ends(tables.select(F.col("table").alias("node"), F.col("based").alias("target")))
    return ends.select(F.col("node").alias("table"), F.col("hops").alias("level"), "fault")
