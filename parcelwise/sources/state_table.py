"""Additive state in a folder: immutable parts and one manifest for each version.

A batch's contribution is written as a part of its own and becomes visible with the next manifest, which is created only if no
other writer has made that version (compare and set). The manifest remembers the last batch of every source, so a batch that is
replayed, after a failure at any point, adds nothing. Parts that no manifest names are left-overs of failed commits and never read.
Needs a file system whose `create` without overwrite fails on an existing file.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Parts after which a commit rewrites the merged state as one.
MAX_PARTS = 16


class StateTable:
    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], max_parts: int = MAX_PARTS):
        """`merge` adds up the rows of several parts; merging twice must change nothing."""
        self.spark, self.path, self.merge, self.max_parts = spark, path.rstrip("/"), merge, max_parts
        self._jvm = spark.sparkContext._jvm

    def _fs(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _versions(self) -> list[int]:
        fs, where = self._fs(f"{self.path}/versions")
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _manifest(self, version: int) -> dict | None:
        fs, where = self._fs(f"{self.path}/versions/{version:012d}.json")
        stream = fs.open(where)
        try:
            text = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:  # its writer has not closed it yet
            return None

    def head(self) -> dict:
        """The newest complete manifest."""
        for version in reversed(self._versions()):
            found = self._manifest(version)
            if found is not None:
                return found
        return {"version": 0, "parts": [], "applied": {}}

    def _set(self, manifest: dict) -> bool:
        """Create the manifest of its version; False if another writer was first."""
        fs, where = self._fs(f"{self.path}/versions/{manifest['version']:012d}.json")
        try:
            stream = fs.create(where, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or fs.exists(where):
                return False
            raise
        try:
            stream.write(json.dumps(manifest).encode())
        finally:
            stream.close()
        return True

    def _write(self, df: DataFrame) -> str:
        part = f"parts/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{part}")
        return part

    def read(self, version: dict | None = None) -> DataFrame | None:
        """The merged state of the newest (or a given) manifest; None before the first commit."""
        parts = (version or self.head())["parts"]
        if not parts:
            return None
        return self.merge(self.spark.read.parquet(*[f"{self.path}/{p}" for p in parts]))

    def commit(self, delta: DataFrame, source: str, batch: int) -> int:
        """Add a source's batch once; returns the version that holds it. Batches of a source come in rising order."""
        part = None
        while True:
            head = self.head()
            if batch <= head["applied"].get(source, -1):
                return head["version"]
            part = part or self._write(delta)
            parts = [*head["parts"], part]
            if len(parts) > self.max_parts:
                whole = {**head, "parts": parts}
                parts = [self._write(self.read(whole))]
            if self._set({"version": head["version"] + 1, "parts": parts, "applied": {**head["applied"], source: batch}}):
                return head["version"] + 1

    def sink(self, source: str, delta: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """A micro-batch sink that commits what a batch adds."""
        return lambda df, batch_id: self.commit(delta(df), source, batch_id) and None
