"""Keyed and grouped containers, and JSON documents of them."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.checksums import combined
from quernstone.operators.catalog import Catalog, declared, scope_project
from quernstone.operators.documents import Written, quoted

JSON = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}


def _row(df: DataFrame, columns: list[str] | None) -> Column:
    return F.struct(*[F.col(c) for c in columns or df.columns])


def _ordered(df: DataFrame, by: list[str], texts: Column, order: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("order"), texts.alias("text")))), lambda x: x["text"]).alias("texts"))


def to_grouped(df: DataFrame, gk: str, columns: list[str] | None = None) -> DataFrame:
    """A row (gk, [rows]) per group."""
    return df.groupBy(gk).agg(F.array_sort(F.collect_list(_row(df, columns))).alias("container"))


def to_grouped_keyed(df: DataFrame, gk: str, pk: str, columns: list[str] | None = None) -> DataFrame:
    """A row (gk, {pk: row}) per group, keys in order.

    Of rows that repeat a key the least stays; rows without one are no members, as a map has no such key. The key rules
    report both.
    """
    unique = df.where(F.col(pk).isNotNull()).groupBy(gk, pk).agg(F.min(_row(df, columns)).alias("row"))
    return unique.groupBy(gk).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(pk), F.col("row"))))).alias("container"))


def _body(df: DataFrame, columns: list[str] | None, values: dict[str, Written]) -> Column:
    """A row as a JSON object; columns without a way to be written are left to Spark."""
    if not values:
        return F.to_json(_row(df, columns), JSON)
    parts = []
    for n, c in enumerate(columns or df.columns):
        held = F.col(f"`{c}`")
        plain = F.to_json(F.struct(held.alias("k")), JSON)
        parts += [F.lit(("," if n else "{")), quoted(F.lit(c)), F.lit(":"), values[c].json(held) if c in values else F.substr(plain, F.lit(6), F.length(plain) - 6)]
    return F.concat(*parts, F.lit("}"))


def entries(df: DataFrame, gk: str | None, pk: str | None, columns: list[str] | None = None, order: list[str] = (), values: dict[str, Written] | None = None) -> DataFrame:
    """(at, key, entry): the container that the keys of a table ask for, an entry a row, so no row holds the table.

    Without keys an entry is a row of the list; with a primary key its row; with a group key the list of the group, or
    with both keys the map of the group, which the format puts into one entry. ``at`` orders the entries, lists by
    ``order``; ``key`` is JSON text, null in lists. Of rows that repeat a primary key the one with the least text stays;
    rows without a key, which the key rules report, are no members. ``values`` says how columns are written.
    """
    values = values or {}
    body = _body(df, columns, values)
    name = lambda c: quoted(values[c].text(F.col(f"`{c}`")) if c in values else F.col(f"`{c}`"))
    for k in (gk, pk):
        df = df.where(F.col(f"`{k}`").isNotNull()) if k else df
    if gk and pk:
        unique = df.groupBy(gk, pk).agg(F.min(body).alias("body"))
        made = _ordered(unique, [gk], F.concat(name(pk), F.lit(":"), F.col("body")), F.col(pk))
        text = F.concat(F.lit("{"), F.array_join("texts", ","), F.lit("}"))
    elif gk:
        made = _ordered(df, [gk], body, F.struct(*order, body))
        text = F.concat(F.lit("["), F.array_join("texts", ","), F.lit("]"))
    elif pk:
        made, text = df.groupBy(pk).agg(F.min(body).alias("body")), F.col("body")
    else:
        same = df.select(F.struct(*order, body.alias("body")).alias("at"), body.alias("body")).groupBy("at").agg(F.min("body").alias("body"), F.count("*").alias("n"))
        return same.select("at", F.lit(None).cast("string").alias("key"), F.array_join(F.array_repeat("body", F.col("n").cast("int")), ",").alias("entry"))
    key = gk or pk
    return made.select(F.col(key).alias("at"), name(key).alias("key"), text.alias("entry"))


def merge_sheets(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def by_json(tables: dict[str, DataFrame], catalog: Catalog, scope: int) -> dict[str, tuple[DataFrame, str | None, str | None]]:
    """JSON group -> (its tables together, group key, primary key), with the columns that the scope may see.

    The keys are those of the table that bears the group's name; a group without such a table owns no document. A key
    that the scope can't see is no key of the container (``hidden_keys`` reports it).
    """
    found: dict[str, list[DataFrame]] = {}
    for name, df in tables.items():
        found.setdefault(catalog.groups.get(name, name), []).append(scope_project(df, catalog, name, scope))
    made = {}
    for group, parts in found.items():
        if group in tables:
            merged, marks = merge_sheets(parts), {c: declared(t) for c, (t, _) in catalog.columns[group].items()}
            seen = lambda mark: next((c for c, d in marks.items() if getattr(d, mark) and c in merged.columns), None)  # noqa: B023, E731
            made[group] = merged, seen("group"), seen("primary")
    return made


def hidden_keys(catalog: Catalog, scope: int) -> list[tuple[str, str]]:
    """(table, key) of keys out of a scope that sees other columns of the table."""
    seen = {t for t, columns in catalog.columns.items() if any(s & scope for _, s in columns.values())}
    return [(t, c) for t in sorted(seen) for c, (kind, s) in catalog.columns[t].items() if not s & scope and (declared(kind).primary or declared(kind).group)]


def by_sheet(df: DataFrame, columns: list[str], sheet: list[str]) -> DataFrame:
    """A list container per sheet, or per part of a sheet where ``sheet`` names more columns."""
    return df.groupBy(*sheet).agg(F.array_sort(F.collect_list(_row(df, columns))).alias("container"))


def values_of_json(tables: dict[str, DataFrame], groups: dict[str, str], group: str, column: str) -> DataFrame:
    """Values of a column over all tables of a JSON group that have it."""
    own = [df.select(column) for name, df in tables.items() if groups.get(name, name) == group and column in df.columns]
    return reduce(DataFrame.union, own)


def size(c: Column) -> Column:
    return F.size(c)


def text(c: Column) -> Column:
    return F.to_json(c, JSON)


def write_lines(df: DataFrame, path: str, parts: list[str] = ()) -> None:
    """JSON lines, nulls kept; the target is replaced."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false").option("timestampNTZFormat", JSON["timestampNTZFormat"])
    (writer.partitionBy(*parts) if parts else writer).json(path)


def write_document(made: DataFrame, path: str, keyed: bool) -> None:
    """One JSON document of ``entries`` as a folder of text files, whose contents in order of names are the document.

    An entry is a line. The files are ranges of one sort, so a document of any size is written by many tasks.
    """
    begin, end = "{}" if keyed else "[]"
    if made.isEmpty():
        made.sparkSession.range(0, 1, 1, 1).select(F.lit(begin + end)).write.mode("overwrite").text(path)
        return
    first = F.broadcast(made.agg(F.min("at").alias("first")))  # one row
    marked = made.join(first, F.col("at").eqNullSafe(F.col("first")), "left").withColumn("lead", F.when(F.col("first").isNotNull(), F.lit(begin)).otherwise(F.lit(",")))
    lines = marked.select(F.lit(0).alias("rank"), "at", F.concat("lead", F.concat("key", F.lit(":")) if keyed else F.lit(""), F.col("entry")).alias("value"))
    last = made.agg(F.max("at").alias("at")).select(F.lit(1).alias("rank"), "at", F.lit(end).alias("value"))
    lines.union(last).orderBy("rank", "at").select("value").write.mode("overwrite").text(path)


def _moved(spark: SparkSession, made: str, path: str) -> None:
    """Put the folder ``made`` in the place of ``path``, whose old contents go only when the new ones stand there."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    target, new, old = of(path), of(made), of(f"{path}-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    held = files.exists(target)
    if held and not files.rename(target, old):
        raise OSError(f"{path} can't be moved away")
    if not files.rename(new, target):
        if held:
            files.rename(old, target)
        raise OSError(f"{made} can't be moved to {path}")
    if held:
        files.delete(old, True)


def _removed(spark: SparkSession, path: str) -> None:
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def write_containers(spark: SparkSession, made: dict[str, tuple[DataFrame, str | None, str | None]], scope: str, path: str, order: list[str] = (), values: dict[str, dict[str, Written]] | None = None) -> None:
    """A JSON document per group (rows, group key, primary key) under ``path``/scope/json=name.

    All documents of the scope are written beside the old ones and take their place together, so a failure leaves the old
    ones whole and a group that is gone leaves none.
    """
    staged = f"{path}/_{scope}-{uuid.uuid4().hex}"
    try:
        spark.range(0).select(F.lit("").alias("value")).write.text(staged)
        for name, (df, gk, pk) in made.items():
            own = entries(df, gk, pk, order=[c for c in order if c in df.columns], values=(values or {}).get(name))
            write_document(own, f"{staged}/json={name}", bool(gk or pk))
        _moved(spark, staged, f"{path}/{scope}")
    finally:
        _removed(spark, staged)


def read_container(spark: SparkSession, path: str, schema: str, keyed: bool = False) -> DataFrame:
    """Read an emitted document back, a line at a time: an object gives its key as ``container_key``, an array gives rows."""
    lines = spark.read.text(path).where(~F.col("value").isin("{}", "[]", "}", "]")).select(F.substr("value", F.lit(2)).alias("value"))
    how = {"timestampNTZFormat": JSON["timestampNTZFormat"]}
    if keyed:
        parsed = F.from_json(F.concat(F.lit("{"), F.col("value"), F.lit("}")), f"map<string,struct<{schema}>>", how)
        return lines.select(F.explode(parsed).alias("container_key", "row")).select("container_key", "row.*")
    return lines.select(F.explode(F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), f"array<struct<{schema}>>", how)).alias("row")).select("row.*")


def document_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, crc32, length) of the documents under ``path``, which is one scope; ``file`` is the group's name and ``.json``.

    Blocks of the documents' files are read by different tasks, line by line; their checksums are put together, so a
    document of any number of files has the checksum of its whole text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, crc, length = None, 0, 0
        for batch in batches:
            done = []
            for path, start, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (path, start) != last:
                    if last:
                        done.append((*last, crc, length))
                    last, crc, length = (path, start), 0, 0
                line = value.encode() + b"\n"
                crc, length = zlib.crc32(line, crc), length + len(line)
            yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema=shape)
        if last:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*last, crc, length), strict=True))], schema=shape)

    names = ("path", "start", "crc32", "length")
    shape = pa.schema([("path", pa.string()), ("start", pa.int64()), ("crc32", pa.int64()), ("length", pa.int64())])
    lines = spark.read.schema("value string").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*.txt").text(path)
    blocks = lines.select("_metadata.file_path", "_metadata.file_block_start", "value").mapInArrow(run, "path string, start long, crc32 long, length long")
    name = F.concat(F.regexp_extract("path", "/json=([^/]+)/[^/]+$", 1), F.lit(".json"))
    return combined(blocks.withColumn("file", name).where("file <> '.json'"), ["file"], ["path", "start"])


def write_crc(spark: SparkSession, path: str, target: str) -> None:
    """The document {file: crc32} of the documents under ``path``, which is one scope."""
    found = document_checksums(spark, path)
    write_document(found.select(F.col("file").alias("at"), quoted(F.col("file")).alias("key"), F.col("crc32").cast("string").alias("entry")), target, True)


def raw_dump(rows: DataFrame) -> DataFrame:
    """(file, sheet, part, row, json) of uncast rows (file, sheet, row, name, bold, value): a JSON object per row and part.

    Bold columns are the part ``bold``, the others ``normal``. An object has all columns of its part, null where a row has
    no cell, so two dumps differ only where cells do.
    """
    own = ["file", "sheet", "part"]
    marked = rows.withColumn("part", F.when(F.col("bold"), "bold").otherwise("normal"))
    names = marked.groupBy(*own).agg(F.array_sort(F.collect_set("name")).alias("names"))
    held = marked.groupBy(*own, "row").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("held"))
    whole = F.map_from_arrays("names", F.transform("names", lambda n: F.try_element_at("held", n)))
    return held.join(names, own).select(*own, "row", F.to_json(whole, JSON).alias("json"))


def write_raw_dump(rows: DataFrame, path: str) -> None:
    """The raw dump as text under file, sheet and part, rows in order; ranges of rows are written by different tasks."""
    own = ["file", "sheet", "part", "row"]
    raw_dump(rows).repartitionByRange(*own).sortWithinPartitions(*own).drop("row").withColumnRenamed("json", "value").write.mode("overwrite").partitionBy("file", "sheet", "part").text(path)
