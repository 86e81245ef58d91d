"""Snapshots: a folder whose content is replaced as a whole, by a compare-and-swap of numbered manifests.

Data is always written to new folders.  A manifest names the folders that make
up a version; version n + 1 exists once a file of that number has been moved
into place, which only one writer can do.  A reader picks the highest number and
so sees one version whole, whatever is written meanwhile.
"""

from __future__ import annotations

import json
import re
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from evidara.operators.checks import ContractError


class StaleVersionError(ContractError):
    """Another writer has committed on the same base version."""


class Snapshots:
    """Versions of named relations in ``folder``, which driver and executors share.

    The swap needs a file system whose rename without overwriting is atomic, as
    in HDFS; local folders serve tests.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The highest committed number; 0 where nothing has been committed."""
        at = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(at):
            return 0
        found = (re.fullmatch(r"(\d+)\.json", f.getPath().getName()) for f in self._fs.listStatus(at))
        return max((int(m[1]) for m in found if m), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """What was committed under a version (the latest); empty for version 0."""
        number = self.version() if version is None else version
        if not number:
            return {}
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{number}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, rows: DataFrame, *partition_by: str) -> str:
        """Write rows to a new folder that no version names yet; returns its path relative to the store."""
        path = f"data/{name}-{uuid4().hex}"
        writer = rows.write.partitionBy(*partition_by) if partition_by else rows.write
        writer.parquet(f"{self.folder}/{path}")
        return path

    def read(self, path: str, schema: StructType | None = None) -> DataFrame:
        """What was written; rows dealt to folders need their ``schema`` where there may be none of them."""
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.folder}/{path}")

    def drop(self, path: str) -> None:
        """Delete data that no version names."""
        self._fs.delete(self._path(f"{self.folder}/{path}"), True)

    def commit(self, base: int, content: dict) -> int:
        """Make ``content`` the version after ``base``; refused if that exists already."""
        if self.version() != base:
            raise StaleVersionError(f"version {base} is not the latest of {self.folder}")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        final = self._path(f"{self.folder}/manifests/{base + 1}.json")
        waiting = self._path(f"{self.folder}/manifests/.{uuid4().hex}")
        stream = self._fs.create(waiting, False)
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf).rename(waiting, final, options)
        except Exception as e:
            self._fs.delete(waiting, False)
            if self._fs.exists(final):
                raise StaleVersionError(f"version {base + 1} of {self.folder} was committed meanwhile") from e
            raise
        return base + 1

    def clean(self, keep: int = 1) -> list[str]:
        """Delete data that none of the last ``keep`` versions names; for times without readers of older ones or writers."""
        latest = self.version()
        named = "".join(json.dumps(self.manifest(v)) for v in range(max(1, latest - keep + 1), latest + 1))
        gone = []
        for f in self._fs.listStatus(self._path(f"{self.folder}/data")):
            if f.getPath().getName() not in named:
                self._fs.delete(f.getPath(), True)
                gone.append(f.getPath().getName())
        return sorted(gone)


class ChunkStore:
    """Stored chunks (doc_id, representation, ordinal, ...), replaced a set of documents and representations at a time.

    Each representation is a folder of its own in the manifest, so a replacement
    rewrites only the representations it names and is seen whole or not at all.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.store = Snapshots(spark, folder)

    def chunks(self, version: int | None = None) -> DataFrame | None:
        """All chunks of a version; None where there are none yet."""
        out = None
        for path in self.store.manifest(version).get("representations", {}).values():
            own = self.store.read(path)
            out = own if out is None else out.unionByName(own)
        return out

    def replace(self, incoming: DataFrame, documents: DataFrame, representations: list[str], base: int | None = None) -> int:
        """Drop the chunks of (documents x representations), insert the incoming ones, commit; returns the new version."""
        base = self.store.version() if base is None else base
        held = dict(self.store.manifest(base).get("representations", {}))
        ids = documents.select("doc_id").distinct()
        for name in representations:
            own = incoming.filter(incoming["representation"] == name)
            if name in held:
                own = self.store.read(held[name]).join(ids, "doc_id", "left_anti").unionByName(own)
            held[name] = self.store.write("chunks", own)
        return self.store.commit(base, {"representations": held})
