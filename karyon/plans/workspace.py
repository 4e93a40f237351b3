"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table and reading it
back. The table lives in the folder that the cluster names in
``spark.checkpoint.dir``, so a lost executor loses nothing. Only a session in
one local process does without that setting; elsewhere a folder of one machine
would lose what other machines write, so its absence is an error.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; one of this machine is made only in a session of one local process that sets none."""
    named = spark.conf.get(_CONF, None)
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else None
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_CONF} to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="karyon-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set(_CONF, named)
    return named.rstrip("/")


class Workspace:
    """Names, writes and drops intermediate tables of one operator run.

    Tables that were superseded are dropped at once; those that a lazy result
    still reads stay until the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str = "run"):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.close)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}-{name}"

    def folder(self, name: str) -> str:
        """A new folder for files of other formats, dropped with the workspace."""
        jvm, path = self.spark._jvm, self.path(name)
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(p)
        return path

    def save(self, df: DataFrame, name: str, drop: DataFrame | None = None, **facts: Column) -> DataFrame:
        """Write ``df`` and read it back; then drop the table ``drop`` came from.

        ``facts`` are aggregates taken in passing; they are in ``out.facts``.
        """
        path, seen = self.path(name), Observation() if facts else None
        if seen:
            df = df.observe(seen, *[c.alias(k) for k, c in facts.items()])
        df.write.option("compression", "snappy").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._karyon_path = path
        out.facts = seen.get if seen else {}
        if drop is not None:
            self.drop(drop)
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_karyon_path", None)
        if path:
            self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass
