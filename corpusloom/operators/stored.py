"""Tables that a query keeps for a while, and the exchanges that go with their writing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

#: Deletes the exchanges of a run with its end: the written table takes their place.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Write as a compressed table into spark.checkpoint.dir (a temporary folder where a local session has none) and read it back."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path, before = f"{folder or tempfile.mkdtemp()}/stored-{uuid.uuid4().hex}", spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        for f in t.inputFiles()[:1]:
            folder = sc._jvm.org.apache.hadoop.fs.Path(f).getParent()
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
