"""References by file, so that only those are looked up again whose file changed or whose value went from the other side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quernstone.operators.catalog import Catalog
from quernstone.operators.checkpoints import cut
from quernstone.operators.constraints import violations
from quernstone.operators.documents import written
from quernstone.operators.references import Tables, reference_leaves
from quernstone.operators.saved import Saved

_PLACE = ["file", "sheet", "row"]
_KEY = ["target", "key", "v"]
LEAVES = reduce(lambda made, name: made.add(name, "long" if name == "row" else "string"), [*_PLACE, "table", "column", *_KEY], StructType())
HELD = reduce(lambda made, name: made.add(name, "string"), ["file", *_KEY], StructType())


def _typed(parts: list[DataFrame], schema: StructType, tables: Tables) -> DataFrame:
    shaped = [df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]) for df in parts]
    return reduce(DataFrame.union, shaped) if shaped else next(iter(tables.values())).sparkSession.createDataFrame([], schema)


def index(tables: Tables, catalog: Catalog) -> tuple[DataFrame, DataFrame]:
    """All references of some tables, a row each with its place, and by file the distinct values that may be referred to."""
    found = reference_leaves(tables, catalog, _PLACE)
    leaves = [df.withColumns({"target": F.lit(to), "key": F.lit(key)}) for (to, key), df in found.items()]
    held = []
    for to, key in found:
        for name, df in tables.items():
            if catalog.groups.get(name, name) == to and key in catalog.columns[name] and key in df.columns:
                text = written(catalog, catalog.columns[name][key][0]).text(F.col(f"`{key}`"))
                held.append(df.select("file", F.lit(to).alias("target"), F.lit(key).alias("key"), text.alias("v")).where("v is not null"))
    return _typed(leaves, LEAVES, tables), _typed(held, HELD, tables).distinct()


def unheld(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of ``asked`` whose (target, key, v) isn't in ``held``, null values aside. Few rows ask: the values are brought
    down to theirs first, which needs no shuffle of the values where the rows are small."""
    asked = asked.where("v is not null")
    return asked.join(held.join(asked.select(_KEY).distinct(), _KEY, "left_semi").select(_KEY).distinct(), _KEY, "left_anti").select(asked.columns)


def suspects(leaves: DataFrame, held: DataFrame, lost: DataFrame, before: DataFrame, touched: DataFrame) -> DataFrame:
    """The references that must be looked up again: those of ``touched`` files, those to values that such files held
    ``before`` and no file holds now, and those that were ``lost``. No reference is in two of these."""
    gone = unheld(before.select(_KEY).distinct(), held)
    others = leaves.join(touched, "file", "left_anti")
    again = [leaves.join(touched, "file", "left_semi"), others.join(gone, _KEY, "left_semi"), lost.join(touched, "file", "left_anti")]
    return reduce(DataFrame.unionByName, again)


def saved_faults(saved: Saved, tables: Tables, catalog: Catalog, seal: str) -> DataFrame:
    """The violations that ``references.reference_faults`` finds, from what the last run left under the same ``seal``.

    ``seal`` stands for all declarations that references and their values depend on; under a new one everything is looked
    up. Files that came, went or are on the work list are touched. The index is marked as whole when all of it stands, so
    a run that breaks off leaves none.
    """
    part, session = f"references/{seal}", saved.session
    now = saved.files.select("file").distinct()
    none = session.createDataFrame([], LEAVES)
    if saved.take(part):
        seen = session.read.schema("file string").parquet(f"{saved.path}/{part}/seen")
        touched = cut(saved.work.select("file").union(seen.exceptAll(now)).union(now.exceptAll(seen)).distinct())
        before = cut(saved.get(f"{part}/held", HELD, every=True).join(touched, "file", "left_semi"))
        lost = cut(session.read.schema(LEAVES).parquet(f"{saved.path}/{part}/lost").join(now, "file", "left_semi"))
        some = {name: df.join(touched, "file", "left_semi") for name, df in tables.items()}
    else:
        touched, before, lost, some = now, none.select(HELD.names), none, tables
    for name, rows in zip(("leaves", "held"), index(some, catalog), strict=True):
        saved.put(f"{part}/{name}", rows, touched)
    leaves, held = saved.get(f"{part}/leaves", LEAVES), saved.get(f"{part}/held", HELD)
    lost = cut(unheld(suspects(leaves, held, lost, before, touched), held))
    lost.write.mode("overwrite").parquet(f"{saved.path}/{part}/lost")
    now.write.mode("overwrite").parquet(f"{saved.path}/{part}/seen")
    saved.give(part)
    place = {c: F.col(c) for c in (*_PLACE, "table", "column")}
    return violations(lost, "unknown reference", value=F.col("v"), detail=F.concat("target", F.lit("."), "key"), **place)
