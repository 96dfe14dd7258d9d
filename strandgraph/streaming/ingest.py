"""The ingestion gate: landed documents are kept if they name a known entity, once each; others go to a reject table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import insert_if_absent


def gate(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): whether a document's entities, lower-cased, have a label."""
    named = docs.select("doc_id", F.explode("entities").alias("e")).select("doc_id", F.lower("e").alias("label"))
    known = named.join(labels.select("label"), "label", "left_semi").select("doc_id").distinct()
    return docs.join(known, "doc_id", "left_semi"), docs.join(known, "doc_id", "left_anti")


def read_landed(spark: SparkSession, path: str, schema: str, delay: str = "1 hour", event_time: str = "observed_at", key: str = "checksum") -> DataFrame:
    """A stream of landed JSON files, late data bounded by a watermark and repeats within it dropped."""
    return spark.readStream.schema(schema).json(path).withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def start(stream: DataFrame, labels: DataFrame, kept_path: str, rejected_path: str, checkpoint: str):
    """Run the gate on each micro-batch. A batch's files carry its number and replace what a repeated run of it left."""

    def write(batch: DataFrame, number: int) -> None:
        kept, rejected = gate(batch, labels)
        for df, path in ((kept, kept_path), (rejected, rejected_path)):
            df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feed_counts(events: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts of updates by kind in event-time windows."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))


def absorb(present: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """present with the rows of a micro-batch whose keys are new."""
    return insert_if_absent(present, batch, keys)


def watched_updates(events: DataFrame, watched: DataFrame, delay: str = "2 hours", *, entity: str = "user_id", time: str = "ts", key: str = "event_id") -> DataFrame:
    """Updates of watched entities, each once: late ones up to the delay are let in, later ones and repeats are dropped. The watch list is
    a table of its own that the stream is joined with."""
    timed = events.withWatermark(time, delay)
    once = timed.dropDuplicatesWithinWatermark([key]) if events.isStreaming else timed.dropDuplicates([key])
    return once.join(watched.select(entity).distinct(), entity, "left_semi")


def watch_sessions(events: DataFrame, watched: DataFrame, gap: str = "30 minutes", delay: str = "2 hours", *, entity: str = "user_id", time: str = "ts", key: str = "event_id") -> DataFrame:
    """Sessions of updates by watched entity: runs whose steps are less than the gap apart, with their first and last time, number and kinds.
    As a stream, a session's state is kept by entity, grown and merged by late rows, and given out once the watermark has passed it."""
    rows = watched_updates(events, watched, delay, entity=entity, time=time, key=key)
    kinds = F.array_sort(F.collect_set("event_type"))
    found = rows.groupBy(F.session_window(time, gap).alias("session"), entity).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("updates"), kinds.alias("kinds"))
    return found.select(entity, "first", "last", "updates", F.array_join("kinds", ",").alias("kinds"))


def start_sessions(stream: DataFrame, watched: DataFrame, path: str, checkpoint: str, **how):
    """Write the sessions of a stream of updates as they close."""
    return watch_sessions(stream, watched, **how).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
