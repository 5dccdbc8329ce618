"""Versioned Parquet tables: a new version is written beside the old one, and a pointer file is replaced last.

A reader sees the old version or the new one, never a mixture, and a table can be rewritten from itself.  All goes through
Hadoop's file system, so the folder may be on any storage that Spark reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tamarisk import schema

TABLES = {"jobs": schema.JOBS, "job_sends": schema.JOB_SENDS, "source_runs": schema.SOURCE_RUNS, "metadata": schema.METADATA}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self) -> dict[str, str]:
        path = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(path):
            return {}
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        """The current version, or the empty table."""
        version, kind = self._pointer().get(name), TABLES[name]
        return self.spark.read.schema(kind).parquet(f"{self.root}/{version}") if version else self.spark.createDataFrame([], kind)

    def commit(self, **tables: DataFrame) -> None:
        """Write new versions of several tables and make all of them current in one step; on an error nothing changes."""
        pointer, new = self._pointer(), {}
        for name, rows in tables.items():
            new[name] = f"{name}/{uuid.uuid4().hex}"
            _as(rows, TABLES[name]).write.parquet(f"{self.root}/{new[name]}")
        old = [pointer[name] for name in new if name in pointer]
        temporary = self._path(f"{self.root}/.CURRENT-{uuid.uuid4().hex}")
        stream = self._fs.create(temporary)
        stream.write(bytearray(json.dumps(pointer | new).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        rename[0] = getattr(self._jvm.org.apache.hadoop.fs.Options.Rename, "OVERWRITE")
        context.rename(temporary, self._path(f"{self.root}/CURRENT"), rename)
        for version in old:
            self._fs.delete(self._path(f"{self.root}/{version}"), True)


def _as(rows: DataFrame, kind: StructType) -> DataFrame:
    return rows.select(*(rows[f.name].cast(f.dataType).alias(f.name) for f in kind.fields))
