"""Readers and writers: all-string CSV, JSON arrays and lines, manifests and idempotent tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every value as a string; nothing is read as missing but empty fields."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A JSON array (or one object) per file; anything malformed fails."""
    r = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (r.schema(schema) if schema else r).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One object per line, blank lines skipped; a missing file is an empty table if a schema is given."""
    r = spark.read.option("mode", "FAILFAST")
    if schema is None:
        return r.json(path)
    try:
        return r.schema(schema).json(path)
    except Exception as e:  # only a path that does not exist
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    for ending, reader in ((".csv", read_csv), (".jsonl", read_jsonl), (".json", read_json), (".parquet", lambda s, p: s.read.parquet(p))):
        if path.endswith(ending):
            return reader(spark, path)
    raise ValueError(f"no reader for {path}")


def write_jsonl(df: DataFrame, path: str) -> None:
    """Columns by name, array columns sorted."""
    cols = [F.array_sort(f.name).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in sorted(df.schema, key=lambda f: f.name)]
    df.select(*cols).write.option("ignoreNullFields", False).json(path)


def table_digest(df: DataFrame) -> str:
    """An order-insensitive digest of all rows."""
    row = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}:{r['s']}"


def write_same_or_fail(df: DataFrame, path: str) -> str:
    """'written', or 'unchanged' where the table is there with the same rows; other rows are an error."""
    try:
        there = df.sparkSession.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.write.parquet(path)
        return "written"
    if table_digest(there) != table_digest(df):
        raise ValueError(f"{path} holds other rows")
    return "unchanged"


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def validate(df: DataFrame, required: list[str], rows: int | None = None) -> list[str]:
    """What is wrong with a table: missing columns, and a row count that differs."""
    out = [f"missing column {c}" for c in required if c not in df.columns]
    if rows is not None and (n := df.count()) != rows:
        out.append(f"{n} rows instead of {rows}")
    return out
