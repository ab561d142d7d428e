"""A versioned store of decisions: what was judged once is not judged again while text and judge stay the same.

Decisions are appended as JSON lines, one folder for all versions.  A decision belongs to a record, to the digest of the text
that was judged and to the version of the judge; of several for one such key the newest counts.  A line that was torn by
a crash is not JSON: it is passed over and counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

KEY = ["id", "content_hash", "judge_version"]


class DecisionStore:
    """Decisions under ``path``; ``fields`` is the DDL of what a decision says beside its key and ``decided_at``."""

    def __init__(self, spark: SparkSession, path: str, fields: str = "verdict string, confidence string, reason string"):
        self.spark, self.path = spark, path
        self.schema = StructType([*StructType.fromDDL("id string, content_hash string, judge_version string, decided_at timestamp"), *StructType.fromDDL(fields)])

    def _exists(self) -> bool:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)

    def lines(self) -> DataFrame:
        """All lines with ``torn``: what of a line that does not read as a decision with a whole key."""
        if not self._exists():
            return self.spark.createDataFrame([], StructType([*self.schema, StructField("torn", StringType())]))
        raw = self.spark.read.text(self.path).where(F.trim("value") != "")
        read = raw.select("value", F.from_json("value", StructType([*self.schema, StructField("_corrupt", StringType())]), {"columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
        whole = F.col("d").isNotNull() & F.col("d._corrupt").isNull() & ~F.exists(F.array(*[F.coalesce(F.col(f"d.{k}"), F.lit("")) for k in KEY]), lambda x: x == "")
        return read.select(*[F.col(f"d.{f.name}").alias(f.name) for f in self.schema], F.when(~whole, F.col("value")).alias("torn"))

    def torn(self) -> int:
        return self.lines().where("torn is not null").count()

    def load(self, version: str) -> DataFrame:
        """The newest decision of each key of a version; of equally new ones the first by its text."""
        rows = self.lines().where(F.col("torn").isNull() & (F.col("judge_version") == version)).drop("torn")
        w = Window.partitionBy(*KEY).orderBy(F.col("decided_at").desc_nulls_last(), F.to_json(F.struct(*rows.columns)))
        return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")

    def pending(self, records: DataFrame, version: str) -> DataFrame:
        """The records (id, content_hash, ...) that this version has not decided on with the text they have now.

        Records without an id or digest are always pending: no decision can be theirs.
        """
        done = self.load(version).select("id", "content_hash")
        here = records.withColumns({"_id": F.col("id").cast("string")})
        return here.join(done.withColumnsRenamed({"id": "_id"}), ["_id", "content_hash"], "left_anti").select(*records.columns)

    def append(self, decisions: DataFrame, version: str) -> int:
        """Write decisions (id, content_hash and fields); returns how many.  ``decided_at`` is the time of writing unless it is given."""
        at = F.col("decided_at") if "decided_at" in decisions.columns else F.current_timestamp()
        own = {"judge_version": F.lit(version), "decided_at": at}
        rows = decisions.select(*[own.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in self.schema])
        before = self.lines().count()
        rows.write.mode("append").json(self.path)
        return self.lines().count() - before

    def decide(self, records: DataFrame, judge, version: str) -> int:
        """Decide on what is pending with ``judge`` (a function of a table that returns decisions); returns how many are new."""
        return self.append(judge(self.pending(records, version)), version)
