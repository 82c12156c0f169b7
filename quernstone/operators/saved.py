"""What a conversion keeps for the next one: uncast rows by file, cast rows by table, declarations and file."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass
from functools import cached_property
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quernstone.operators.incremental import read_snapshot

_BLANK = "__blank"
#: Names of files that may come to the driver or go to every task.
_FEW = 100_000


@dataclass
class Saved:
    """Parts under ``path``. ``files`` (file) are all that there are now, ``work`` (file) those that are read again.

    A part is partitioned by file and the files on the work list are replaced, a file that has no rows any more by a
    blank one. A run that breaks off leaves some of them new and some old; all are still on the next work list, as the
    manifest is written last.
    """

    path: str
    files: DataFrame
    work: DataFrame

    @cached_property
    def _names(self) -> set[str] | None:
        """The work list, if it may come to the driver."""
        return {r.file for r in self.work.select("file").distinct().collect()} if self.work.count() <= _FEW else None

    @cached_property
    def _all(self) -> DataFrame:
        """The names of all files; few enough of them are sent to every task."""
        names = self.files.select("file").distinct()
        return F.broadcast(names) if self.files.count() <= _FEW else names

    @property
    def session(self) -> SparkSession:
        return self.files.sparkSession

    def _folder(self, path: str):
        found = self.session._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.session._jsc.hadoopConfiguration())

    def put(self, part: str, rows: DataFrame, files: DataFrame | None = None) -> None:
        """Replace what ``part`` holds of ``files``, the work list if they aren't given, by ``rows``."""
        files = (self.work if files is None else files).select("file").distinct()
        blank = files.select(*[F.col("file") if f.name == "file" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema], F.lit(True).alias(_BLANK))
        kept = rows.join(files, "file", "left_semi").select(*[F.col(f"`{c}`") for c in rows.columns], F.lit(False).alias(_BLANK))
        kept.unionByName(blank).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(f"{self.path}/{part}")

    def get(self, part: str, schema: StructType, every: bool = False) -> DataFrame:
        """The rows of all files that there are; with ``every`` also of those that are gone."""
        found = read_snapshot(self.session, f"{self.path}/{part}", StructType([*schema.fields]).add(_BLANK, "boolean"))
        own = found.where(f"not {_BLANK}").drop(_BLANK)
        return (own if every else own.join(self._all, "file", "left_semi")).select([f"`{c}`" for c in schema.names])

    def take(self, part: str) -> bool:
        """Whether a part stands whole; from now on it doesn't, until it is given back."""
        mark, store = self._folder(f"{self.path}/{part}/_DONE")
        return store.delete(mark, False)

    def give(self, part: str) -> None:
        """The part stands whole again; others beside it are removed."""
        mark, store = self._folder(f"{self.path}/{part}/_DONE")
        store.create(mark, True).close()
        for found in store.listStatus(mark.getParent().getParent()):
            if found.getPath().getName() != mark.getParent().getName():
                store.delete(found.getPath(), True)

    def _touched(self, part: str) -> bool:
        """Whether a part that stands holds any file of the work list."""
        above, store = self._folder(f"{self.path}/{part}")
        held = {unquote(f.getPath().getName().removeprefix("file=")) for f in store.listStatus(above)}
        return self._names is None or not held.isdisjoint(self._names)

    def cast(self, table: str, fingerprint: str, schema: StructType, fresh: bool, made: Callable[[DataFrame | None], DataFrame]) -> DataFrame:
        """The cast rows of a table: those of unchanged files as they are, if all they depend on is what it was.

        ``made`` casts the rows of some files, or of all for None; ``fresh``: files on the work list have rows of it. Rows cast under other declarations are removed when the
        new ones stand, so that they can't come back stale.
        """
        part = f"cast/{table}/{fingerprint}"
        done, store = self._folder(f"{self.path}/{part}/_DONE")
        if store.exists(done):
            if fresh or self._touched(part):
                self.put(part, made(self.work))
        else:
            self.put(part, made(None), self.files)
            store.create(done, True).close()
        above, _ = self._folder(f"{self.path}/cast/{table}")
        for found in store.listStatus(above):
            if found.getPath().getName() != fingerprint:
                store.delete(found.getPath(), True)
        return self.get(part, schema)

    def forget(self, tables: Collection[str]) -> None:
        """Remove what is kept of tables other than these, so that one that comes back is cast anew."""
        above, store = self._folder(f"{self.path}/cast")
        for found in store.listStatus(above) if store.exists(above) else ():
            if found.getPath().getName() not in tables:
                store.delete(found.getPath(), True)
