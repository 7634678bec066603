"""Where results go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

Handler = Callable[[DataFrame, int], None]


def results_sink(stream: DataFrame, handler: Handler, checkpoint: str) -> DataStreamWriter:
    """Hand every micro-batch to ``handler(batch, batch_id)``."""
    return stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)


def append_log(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append to a log, laid out by camera and sorted for look-ups by zone and time."""
    rows.sortWithinPartitions("zone_id", "timestamp").write.mode("append").partitionBy("stream_id").format(fmt).save(path)


def log_sink(path: str, fmt: str = "parquet") -> Handler:
    """A handler that writes each micro-batch once: a batch that is tried again overwrites its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{path}/batch={batch_id}")
    return write


def numbered_log_sink(path: str, record: Callable[[DataFrame, DataFrame | None], DataFrame]) -> Handler:
    """A handler that adds micro-batches to a log as rows with ids, in the log's own layout.

    ``record`` is ``record_violations`` or ``record_density_alerts``. A batch goes
    on numbering after the batches before it and lies in a folder of its own,
    divided by camera; tried again, it gets the same ids and overwrites itself.
    ``read_log`` reads all of it.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_log(spark, path)
        if before is not None:
            before = before.filter(f"batch < {int(batch_id)}")
        rows = record(batch, before)
        rows.sortWithinPartitions("zone_id", "timestamp").write.mode("overwrite").partitionBy("stream_id").parquet(
            f"{path}/batch={int(batch_id)}")
    return write


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The log that ``numbered_log_sink`` writes; None before its first rows."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return None
    return found if "id" in found.columns else None


def evidence_manifest_sink(manifest: DataFrame, path: str, batch_id: int = 0, fmt: str = "parquet") -> None:
    """Write a batch's manifest once, in a folder of its own: a batch that is tried again overwrites what it wrote."""
    manifest.write.mode("overwrite").format(fmt).save(f"{path}/batch={batch_id}")


def alert_handler(handler: Handler, failed_path: str) -> Handler:
    """``handler`` with its errors kept apart: a batch it fails on is written aside with a note and the stream goes on."""
    from pyspark.sql import functions as F

    from paceline.functions.text import join_notes

    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            handler(batch, batch_id)
        except Exception as error:  # noqa: BLE001
            note = F.lit(f"on_violation callback raised: {type(error).__name__}")
            marked = batch.withColumn("notes", join_notes("notes", note)) if "notes" in batch.columns else batch.withColumn("notes", note)
            marked.write.mode("overwrite").parquet(f"{failed_path}/batch={batch_id}")

    return run
