"""A table as a log of parts: what a batch writes is one part, split by a column; a manifest names the parts that count.

A manifest is written beside the old one and then renamed, so readers see all of a batch or nothing, and a batch that runs again
replaces its own part. Readers open the folders that the manifest names, never the whole history. Folders that the last two manifests
don't name are removed. Needs no more than a Hadoop file system that the driver and the executors share.
"""

from __future__ import annotations

import json
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _name(part: str) -> str:
    """A part's name without what tells its attempts apart."""
    return part.split(".")[0]


class Log:
    """Rows under ``path``, split by the column ``by``."""

    def __init__(self, spark: SparkSession, path: str, by: str):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = lambda *parts: hadoop.Path("/".join([self.path, *parts]))
        self._fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, *folder: str) -> list[str]:
        at = self._at(*folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _manifests(self) -> list[str]:
        return [n for n in self._names("manifest") if n.endswith(".json")]

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._at("manifest", name))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def parts(self) -> list[tuple[str, str]]:
        """(part, folder) pairs that count, oldest first."""
        names = self._manifests()
        return [tuple(x) for x in self._load(names[-1])["parts"]] if names else []

    def folder(self, value: object) -> str:
        return f"{self.by}={value}"

    def read(self, folders: set[str] | None = None, besides: str | None = None) -> DataFrame | None:
        """The rows of the folders (None: all), without those of the part ``besides``; None if there are none."""
        names = self._manifests()
        now = self._load(names[-1]) if names else {"parts": []}
        paths: dict[str, list[str]] = {}
        for part, folder in now["parts"]:
            if _name(part) != besides and (folders is None or folder in folders):
                paths.setdefault(part, []).append(f"{self.path}/data/{part}/{folder}")
        schema = StructType.fromJson(now["schema"]) if paths else None
        read = [self.spark.read.schema(schema).option("basePath", f"{self.path}/data/{part}").parquet(*own) for part, own in paths.items()]
        return reduce(DataFrame.unionByName, read) if read else None

    def put(self, rows: DataFrame, part: str, replaces: list[tuple[str, str]] | None = None) -> None:
        """Writes ``rows`` as ``part`` instead of an earlier part of that name and of the pairs ``replaces``."""
        own_part = f"{part}.{uuid4().hex[:12]}"  # an earlier part of the name stays readable until the manifest is there
        # a value with many rows is written by as many tasks as it needs
        rows.hint("rebalance", self.by).write.partitionBy(self.by).parquet(f"{self.path}/data/{own_part}")
        gone = set(replaces or ())
        kept = [x for x in self.parts() if _name(x[0]) != part and x not in gone]
        own = [(own_part, n) for n in self._names("data", own_part) if n.startswith(f"{self.by}=")]
        names = self._manifests()
        number = int(names[-1].split(".")[0]) + 1 if names else 0
        self._publish(f"{number:012d}.json", {"schema": rows.schema.jsonValue(), "parts": kept + own})
        self._tidy([*names, f"{number:012d}.json"])

    def _publish(self, name: str, manifest: dict) -> None:
        unfinished = self._at("manifest", f"_{name}")
        out = self._fs.create(unfinished, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(unfinished, self._at("manifest", name)):
            raise FileExistsError(f"{self.path} was changed by another writer")

    def _tidy(self, names: list[str]) -> None:
        named = {tuple(x) for n in names[-2:] for x in self._load(n)["parts"]}
        for name in names[:-2]:
            for part, folder in map(tuple, self._load(name)["parts"]):
                if (part, folder) not in named:
                    self._fs.delete(self._at("data", part, folder), True)
            self._fs.delete(self._at("manifest", name), False)
