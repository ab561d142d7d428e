"""An append-only audit log as the sink of a stream: a replayed batch adds no row, and a failed write does not stop the service."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

log = logging.getLogger(__name__)


class AuditSink:
    """Writes batches below ``path``, one folder a batch and stream.

    A batch that is replayed after a crash overwrites its own folder, so its rows are there once.  ``stream`` names the
    stream: its batch ids count from zero again if its checkpoint is lost, so a new checkpoint needs a new name.  Errors of
    writing are logged and counted in ``errors``, never raised: the log must not break what it watches.
    """

    def __init__(self, path: str, stream: str = "audit"):
        if not stream or any(c in stream for c in "/=\\"):
            raise ValueError(f"{stream!r} cannot name a folder")
        self.path, self.stream = path, stream
        self.errors = self.written = 0

    def write(self, batch: DataFrame, batch_id: int) -> None:
        try:
            batch.write.mode("overwrite").json(f"{self.path}/stream={self.stream}/batch={batch_id}")
            self.written += 1
        except Exception:  # the contract: whatever fails, the stream goes on
            self.errors += 1
            log.exception("batch %s of %s was not written", batch_id, self.stream)

    def start(self, entries: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return entries.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows with stream and batch; lines that a crash tore are dropped."""
    rows = spark.read.schema(f"{schema}, _torn string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn").json(path)
    return rows.where(F.col("_torn").isNull()).drop("_torn")
