"""Writing out: whole or not at all, raw trees with their metadata, declared layers and an outbox that hands each row on once.

Edge cases: an empty table writes an empty folder with its schema; null sources lie in their own folder; repeated artefacts of one digest,
account and source are written once with all their names.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_whole(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Replace what lies at `path` only once the new content is complete: written beside it, then renamed. A failed write leaves the old content."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, draft, old = (hadoop(p) for p in (path, f"{path}.draft-{uuid4().hex}", f"{path}.old-{uuid4().hex}"))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.format(form).save(draft.toString())
    except Exception:
        files.delete(draft, True)
        raise
    if files.exists(target):
        files.rename(target, old)
    if not files.rename(draft, target):
        files.rename(old, target)
        raise RuntimeError(f"{path} could not be replaced")
    files.delete(old, True)


def export_raw(artefacts: DataFrame, path: str) -> None:
    """Payloads as landed, one folder a source, each with its digest and, as JSON beside it, all names and the facts of its landing."""
    names = F.array_sort(F.collect_set("origin"))
    held = artefacts.withColumn("digest", F.sha2("payload", 256)).groupBy("digest", "account_ref", "source").agg(F.min_by(F.struct("payload", "media_type", "fetched_at", "request_meta", "connection_id"), F.struct("fetched_at", "arrival_seq")).alias("f"), names.alias("origins"))
    sidecar = F.to_json(F.struct("account_ref", F.col("f.media_type").alias("media_type"), F.col("f.fetched_at").alias("fetched_at"), F.col("f.request_meta").alias("request_meta"), F.col("f.connection_id").alias("connection_id"), "origins"))
    held.select("source", "digest", F.col("f.payload").alias("payload"), sidecar.alias("metadata")).write.partitionBy("source").mode("errorifexists").parquet(path)


def export_declared(rows: DataFrame, path: str) -> None:
    """A declared layer as JSON lines, replaced whole."""
    write_whole(rows, path, "json")


def hand_on(waiting: DataFrame, folder: str, send: Callable[[DataFrame], None]) -> None:
    """A stream of outbox rows to `send`, once a batch even when a batch is tried again: its marker says that it went."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        marker = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/sent/batch={number}")
        files = marker.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(marker):
            send(df)
            files.create(marker, False).close()

    waiting.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
