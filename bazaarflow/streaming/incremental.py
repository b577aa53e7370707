"""Structured Streaming jobs: incremental normalise-and-match runs, and dedup of arriving products."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from bazaarflow.operators.upsert import append_log, latest_per_key
from bazaarflow.session import materialise
from bazaarflow.sources.partitioned import layout, part_of, read_table, upsert_table


def landing_stream(spark: SparkSession, path: str, schema, *, files_per_batch: int | None = None, **options) -> DataFrame:
    reader = spark.readStream.schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def incremental_run(arriving: DataFrame, transform: Callable[[DataFrame], DataFrame], key: Sequence[str], order: str,
                    table: str, checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Runs ``transform`` on every batch of new rows and upserts the result into the log at ``table``.

    The checkpoint replaces the "not done yet" anti-join of a batch run. A batch repeated after a failure
    rewrites its own part of the log. Without ``every`` the query ends when all present data is done.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        append_log(transform(latest_per_key(batch, key, order)), table, batch_id)

    writer = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def match_run(arriving: DataFrame, snapshot: str, table: str, checkpoint: str, *, normalise: Callable[[DataFrame], DataFrame],
              match: Callable[[DataFrame, DataFrame], DataFrame], key: Sequence[str], order: str, every: str | None = None) -> StreamingQuery:
    """The incremental run: every batch of new rows is normalised, matched against a catalogue, and upserted.

    ``snapshot`` is a folder with the catalogue; it is read when a batch begins, so a run sees one state of it and the next run a newer
    one. ``table`` is a keyed table (sources.partitioned) with the columns of the result and ``order``; only the partitions in which a
    batch has rows are rewritten. A row counts only if its ``order`` is not below that of the stored row, so a late row
    never replaces a newer one, and a batch that is repeated after a failure changes nothing.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = materialise(latest_per_key(batch, key, order), f"batch-{batch_id}")
        if rows.isEmpty():
            return
        matched = match(normalise(rows), spark.read.parquet(snapshot)).join(rows.select(*key, order), list(key))
        parts = [r["p"] for r in rows.select(part_of(key, layout(spark, table)[0]).alias("p")).distinct().collect()]  # at most those of the table
        stored = read_table(spark, table, parts).select(*key, F.col(order).alias("_stored"))
        fresh = matched.join(stored, list(key), "left").where(F.col("_stored").isNull() | (F.col(order) >= F.col("_stored"))).drop("_stored")
        upsert_table(table, fresh, key, order=order)

    writer = arriving.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def dedup_stream(arriving: DataFrame, keys: Sequence[str], event_time: str, *, watermark: str = "1 day") -> DataFrame:
    """The first row per key within the watermark.

    The bound on the state is the watermark: a key seen longer ago can come back, and the keyed upsert of
    the sink stays the final guard.
    """
    timed = arriving.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(list(keys))


def append_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())
