"""The audit log as streams: requests are classified and appended as they arrive, events counted by type and hour."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.sources.files import children, exists, remove, shared_path


#: How late an event may come; states of hours before that are dropped.
LATENESS = "2 hours"


def audit_counts(events: DataFrame) -> DataFrame:
    """Events by type and hour, late by up to two hours."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", LATENESS)
    return timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("hour"), "event_type", "events")


def file_stream(spark: SparkSession, folder: str, files: str, schema=None, files_a_batch: int | None = None) -> DataFrame:
    """The Parquet files of a name in a folder as one stream, oldest first; a number of files for each batch if it is given."""
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{files}").schema if schema is None else schema).option("pathGlobFilter", files)
    return (reader if files_a_batch is None else reader.option("maxFilesPerTrigger", files_a_batch)).parquet(folder)


def append_to(rows: DataFrame, path: str) -> None:
    """Append what has arrived to Parquet files, each row once: files and progress both stand in the shared folder."""
    query = rows.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def count_to(events: DataFrame, path: str) -> list[dict]:
    """Count what has arrived since the last call into the counts below a path; the progress of each batch is returned.

    Progress, states and counts stand below the path, so a run that ends anywhere is taken up by the next one where it
    was.  Only hours that a batch changed are written, each batch to the folder of its number, which a repeated batch
    replaces.  States are kept while an hour can still change: those before the watermark are dropped.
    """

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")

    query = audit_counts(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return [json.loads(p.json) for p in query.recentProgress]


COUNTS = "hour timestamp, event_type string, events long, batch long"


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """hour, event_type, events: of every hour what the last batch that changed it wrote."""
    parts = [spark.read.schema(COUNTS).option("basePath", f"{path}/{kind}").parquet(f"{path}/{kind}") for kind in ("changes", "merged") if exists(spark, f"{path}/{kind}")]
    if not parts:
        return spark.createDataFrame([], "hour timestamp, event_type string, events long")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy("hour", "event_type").agg(F.max_by("events", "batch").alias("events"))


def merge_counts(spark: SparkSession, path: str) -> None:
    """Put the counts of all batches into one table in order of hours, and remove the batches' own.

    The table is complete before anything is removed, and rows that stand twice agree: a merge that fails half way
    leaves the counts as they were and can be repeated.  Not beside a running count.
    """
    if not exists(spark, f"{path}/changes"):
        return
    done = spark.read.schema(COUNTS).option("basePath", f"{path}/changes").parquet(f"{path}/changes").agg(F.max("batch")).first()[0]
    if done is None:
        return
    read_counts(spark, path).repartitionByRange("hour").sortWithinPartitions("hour", "event_type").write.mode("overwrite").parquet(f"{path}/merged/batch={done}")
    for kind in ("changes", "merged"):
        for name in children(spark, f"{path}/{kind}"):
            number = name.removeprefix("batch=")
            if number.isdigit() and (int(number) < done or kind == "changes" and int(number) == done):
                remove(spark, f"{path}/{kind}/{name}")


def run_once(spark: SparkSession, folder: str, files: str = "events.parquet", name: str = "audit_counts") -> DataFrame:
    """Count the files that are there as one stream, to the end, merge the counts and read them."""
    path = shared_path(spark, name)
    count_to(file_stream(spark, folder, files), path)
    merge_counts(spark, path)
    return read_counts(spark, path)
