"""Append-only tables in a shared folder, one sub-folder a batch, each batch counted only once its commit marker is there.

One writer at a time. A folder opened again goes on after its last whole batch; what an unfinished batch left is written anew, and nothing
committed is ever overwritten.
"""

from __future__ import annotations

import json

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


class BatchFolder:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.batches = self.completed()

    def _marker(self, batch: int) -> tuple[JavaObject, JavaObject]:
        """The file system and the path of a batch's commit marker."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/batch={batch}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def completed(self) -> int:
        k = 0
        while (mark := self._marker(k))[0].exists(mark[1]):
            k += 1
        return k

    def commit(self, note: dict | None = None) -> None:
        """Make the batch count, with a note that a later opening reads back. The marker appears whole or not at all."""
        files, at = self._marker(self.batches)
        draft = at.suffix(".draft")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(note or {}).encode()))
        out.close()
        if not files.rename(draft, at):
            raise RuntimeError(f"batch {self.batches} is already committed")
        self.batches += 1

    def note(self) -> dict:
        """The note of the last commit, empty before the first."""
        if not self.batches:
            return {}
        files, at = self._marker(self.batches - 1)
        stream = files.open(at)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text) if text else {}

    def remove(self) -> None:
        """Drop the whole folder, for callers that made it only for one run."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def read(self, table: str) -> DataFrame:
        """All committed batches of a table; there must be one."""
        return self.spark.read.parquet(*[f"{self.path}/{table}/batch={k}" for k in range(self.batches)])

    def write(self, df: DataFrame, table: str, *partition: str) -> DataFrame:
        """A table of the batch that is being made, written and read back."""
        out = df.write.mode("overwrite")
        (out.partitionBy(*partition) if partition else out).parquet(f"{self.path}/{table}/batch={self.batches}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{table}/batch={self.batches}")
