"""Runs of a pipeline as folders that become visible at once.

Tables are staged in a hidden folder and checked there; ``commit`` adds a manifest with counts and digests and
renames the folder in one step.  What reads runs sees whole ones only: after a crash between tables the run before is still the latest.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources import table_digest

MANIFEST = "manifest.json"


class Files:
    """The few file operations that runs need, on whatever store Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.io = jvm.org.apache.commons.io.IOUtils

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def rename(self, a: str, b: str) -> bool:
        return self.fs.rename(self.path(a), self.path(b))

    def names(self, p: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(p))] if self.exists(p) else []

    def write(self, p: str, text: str) -> None:
        out = self.fs.create(self.path(p), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(self.io.toByteArray(stream)).decode()
        finally:
            stream.close()


class Run:
    """One run below ``root``/runs; run ids sort by age, as times and counters do."""

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        if not re.fullmatch(r"[A-Za-z0-9][\w.:-]*", run_id):
            raise ValueError(f"{run_id!r} cannot name a run")
        self.spark, self.run_id = spark, run_id
        self.files = Files(spark, root)
        self.staged, self.final = f"{root}/runs/.staged-{run_id}", f"{root}/runs/{run_id}"
        self.tables: dict[str, dict] = {}
        if self.files.exists(self.final):
            raise FileExistsError(f"run {run_id} is there already")
        self.files.delete(self.staged)  # what a crashed attempt left

    def stage(self, name: str, df: DataFrame, *, key: str | None = None, allowed: dict[str, list] | None = None) -> DataFrame:
        """Write a table and check it as written: keys present and unique, columns within allowed values.  Returns what was written."""
        if name in self.tables or not re.fullmatch(r"\w[\w.-]*", name):
            raise ValueError(f"{name!r} cannot name another table")
        df.write.parquet(f"{self.staged}/{name}")
        there = self.spark.read.schema(df.schema).parquet(f"{self.staged}/{name}")
        if key is not None:
            lost = there.where(F.col(key).isNull() | (F.col(key).cast("string") == "")).count()
            if lost:
                raise ValueError(f"{name}: {lost} rows without {key}")
            twice = there.groupBy(key).count().where("count > 1").select(key).first()
            if twice:
                raise ValueError(f"{name}: {key} {twice[0]} is there more than once")
        for column, values in (allowed or {}).items():
            odd = there.where(F.col(column).isNull() | ~F.col(column).isin(values)).select(column).first()
            if odd:
                raise ValueError(f"{name}: {column} {odd[0]} is not allowed")
        self.tables[name] = {"rows": there.count(), "digest": table_digest(there), "columns": there.columns}
        return there

    def commit(self, **about) -> dict:
        """Write the manifest and make the run visible; another run of the same id that was faster is an error."""
        manifest = {"run_id": self.run_id, "tables": self.tables} | about
        self.files.write(f"{self.staged}/{MANIFEST}", json.dumps(manifest, ensure_ascii=False, sort_keys=True, indent=2))
        if self.files.exists(self.final) or not self.files.rename(self.staged, self.final):
            raise FileExistsError(f"run {self.run_id} is there already")
        return manifest


def committed(spark: SparkSession, root: str) -> list[str]:
    """The ids of all whole runs, the oldest first."""
    files = Files(spark, root)
    return sorted(n for n in files.names(f"{root}/runs") if not n.startswith(".") and files.exists(f"{root}/runs/{n}/{MANIFEST}"))


def read_run(spark: SparkSession, root: str, name: str, run_id: str | None = None, *, verify: bool = False) -> DataFrame:
    """A table of a run (by default the latest); with ``verify`` its rows must be those of the manifest."""
    runs = committed(spark, root)
    if run_id is None and not runs:
        raise FileNotFoundError(f"no run below {root}")
    chosen = run_id or runs[-1]
    if chosen not in runs:
        raise FileNotFoundError(f"no run {chosen} below {root}")
    table = spark.read.parquet(f"{root}/runs/{chosen}/{name}")
    if verify:
        manifest = json.loads(Files(spark, root).read(f"{root}/runs/{chosen}/{MANIFEST}"))
        if table_digest(table) != manifest["tables"][name]["digest"]:
            raise ValueError(f"{name} of run {chosen} is not what was committed")
    return table
