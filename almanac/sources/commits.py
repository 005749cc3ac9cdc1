"""Several tables that change together: written aside, then made visible by one manifest.

A table set is a folder. Every commit writes its rows to folders of its own under ``data`` and then
renames one small file into ``commits``: the manifest, which lists the folders that make up each
table. Readers follow the newest manifest, so they see all tables of a commit or none, and a
commit that dies half-way leaves folders that nobody reads. Two commits can't get one number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T

APPEND, REPLACE = "append", "replace"


class TableSet:
    """``commit`` takes ``{table: (rows, APPEND or REPLACE)}``; tables that it does not name stay as they are."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def version(self) -> int:
        """Number of the newest commit, 0 before the first."""
        if not self._fs.exists(self._path("commits")):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("commits"))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        number = self.version() if version is None else version
        if number == 0:
            return {}
        stream = self._fs.open(self._path(f"commits/{number:012}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def read(self, table: str, schema: T.StructType, version: int | None = None) -> DataFrame:
        """A table as of a commit, the newest by default; one that no commit has named is empty."""
        folders = self.manifest(version).get(table, [])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def stage(self, table: str, rows: DataFrame) -> str:
        """Write rows to a folder that no manifest lists yet; returns its name."""
        folder = f"data/{table}/{uuid.uuid4().hex}"
        rows.write.mode("error").parquet(f"{self.root}/{folder}")
        return folder

    def publish(self, staged: dict[str, tuple[str, str]], based_on: int) -> int:
        """Make staged folders visible together as the commit after ``based_on``.

        Fails if another commit came in between: what was staged may rest on rows that it changed.
        """
        tables = self.manifest(based_on)
        for table, (folder, mode) in staged.items():
            tables[table] = (tables.get(table, []) if mode == APPEND else []) + [folder]
        number = based_on + 1
        draft, final = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"commits/{number:012}.json")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
        stream.close()
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"commit {number} exists: read the tables again and repeat the change")
        return number

    def commit(self, changes: dict[str, tuple[DataFrame, str]]) -> int:
        before = self.version()
        return self.publish({table: (self.stage(table, rows), mode) for table, (rows, mode) in changes.items()}, before)
