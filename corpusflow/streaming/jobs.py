"""Structured Streaming twins of the batch operators. Every job runs over what is there and ends (available now)."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.skew import running, salted_join
from corpusflow.operators import ingest
from corpusflow.session import work_dir


def read_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(folder)


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def sync_documents(stream: DataFrame, to_chunks: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, document: str, buckets: int = 256) -> None:
    """Keep a chunk table in step with arriving documents.

    A batch replaces all rows of the documents in it (``document``: their path or id), so other documents stay, whatever
    batch they came in, and a batch that is run again leaves the same table.
    """
    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ingest.write_replacing(to_chunks(batch), target, document, buckets)

    _run(stream, each, checkpoint)


def latest_state(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The last update per key of a folder written by :func:`append_updates`."""
    df = spark.read.parquet(target)
    rest = [c for c in df.columns if c not in (*keys, "_batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")


def append_updates(stream: DataFrame, target: str, checkpoint: str, mode: str = "update") -> None:
    """Write changed rows with their batch number; a repeated batch overwrites its own folder."""
    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/_batch={n}")

    _run(stream, each, checkpoint, mode)


def span_rollup(spans: DataFrame, window: str = "1 day") -> DataFrame:
    """Steps, failures and latency per run and event-time window."""
    s = spans.withColumn("ts", F.col("ts").cast("timestamp"))
    return s.groupBy(F.window("ts", window).alias("w"), "run_id").agg(
        F.count("*").alias("steps"), F.sum((F.col("status") == "failed").cast("long")).alias("failed"), F.sum("latency_ms").alias("latency_ms"),
    ).select("run_id", F.col("w.start").alias("window_start"), "steps", "failed", "latency_ms")


def rollup_stream(spans: DataFrame, target: str, checkpoint: str, window: str = "1 day") -> DataFrame:
    """The roll-up of a stream: each batch leaves its partial sums, and reading adds them up.

    Sums don't depend on the order of arrival, so late rows count like any other and no state has to be kept.
    """
    def each(batch: DataFrame, n: int) -> None:
        span_rollup(batch, window).write.mode("overwrite").parquet(f"{target}/_batch={n}")

    _run(spans, each, checkpoint)
    parts = spans.sparkSession.read.parquet(target)
    return parts.groupBy("run_id", "window_start").agg(*(F.sum(c).alias(c) for c in ("steps", "failed", "latency_ms")))


def store_events(events: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Arriving events of runs (run_id, seq, type, data) as rows of a table; a repeated batch overwrites its own folder.

    No state is kept, so events may arrive in any order and batch. Answers and counts are derived when the table is
    read: :func:`answer_counts`, :func:`answer_parts`, or ``traces.assemble_stream`` for answers in one string.
    """
    def each(batch: DataFrame, n: int) -> None:
        batch.select("run_id", "seq", "type", "data").write.mode("overwrite").parquet(f"{target}/_batch={n}")

    _run(events, each, checkpoint)
    return events.sparkSession.read.parquet(target).drop("_batch")


def _until_complete(events: DataFrame) -> DataFrame:
    """Events up to the first ``complete`` one of their run. Rows of large runs aren't brought together."""
    e = events.withColumn("_run", F.to_json(F.struct("run_id")))  # not null
    ends = e.groupBy("_run").agg(F.min(F.when(F.col("type") == "complete", F.col("seq"))).alias("_end"), F.count("*").alias("_n"))
    return salted_join(e, ends, "_run", "_n", F.xxhash64("seq")).where("_end is null or seq <= _end").drop("_run", "_n")


def answer_counts(events: DataFrame) -> DataFrame:
    """Events and tool events per run up to its first ``complete`` event, and whether there is one."""
    return _until_complete(events).groupBy("run_id").agg(
        F.count("*").alias("event_count"), F.count_if(F.col("type") == "tool_call").alias("tool_event_count"), F.max(F.col("_end").isNotNull()).alias("complete"))


def answer_parts(events: DataFrame) -> DataFrame:
    """The pieces of every run's answer up to its first ``complete`` event, with their ordinal from 1; an answer may be of any length."""
    parts = _until_complete(events).where("type = 'content'").select("run_id", "seq", F.coalesce("data", F.lit("")).alias("part"), F.lit(1).alias("_one"))
    return running(parts, ["run_id"], F.floor(F.col("seq") / 4096), ["seq"], {"ordinal": F.col("_one")}).select("run_id", "ordinal", "part")


def spaced(events: DataFrame, keys: list[str], ttl: str, time: str = "ts") -> DataFrame:
    """Of every key the rows (``keys``, ``time``) that follow the last one kept by more than ``ttl``, in the order of time.

    A key's rows pass through one task in that order, and the task remembers only the last one kept. Rows without a time are
    one row of their key if it has no other.
    """
    rows = events.select(*keys, F.col(time).cast("timestamp").alias(time)).distinct()
    id_, at, until = "_id", "_at", "_until"  # the key as text, and microseconds
    rows = rows.select("*", F.to_json(F.struct(*keys)).alias(id_), F.unix_micros(time).alias(at), F.unix_micros(F.expr(f"`{time}` + interval {ttl}")).alias(until))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in (*keys, time))

    def run(batches):
        last, end = None, None
        for batch in batches:
            keep = []
            for i, (key, t, u) in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (id_, at, until)))):
                if key != last or (t is not None and end is not None and t > end):
                    keep.append(i)
                    last, end = key, u
            yield batch.take(pa.array(keep, pa.int64())).select([*keys, time])

    return rows.repartition(id_).sortWithinPartitions(id_, F.col(at).asc_nulls_last()).mapInArrow(run, schema)


def first_seen(events: DataFrame, keys: list[str], ttl: str, target: str, checkpoint: str, time: str = "ts") -> DataFrame:
    """The first row of every key, and each later one that follows the last of these by more than ``ttl`` of event time.

    An event that comes late may be the first, and then others aren't: a batch stores its keys and times (a repeated batch
    its own folder again), and :func:`spaced` chooses when they are read. So batches may be of any size and in any order.
    """
    def each(batch: DataFrame, n: int) -> None:
        batch.select(*keys, F.col(time).cast("timestamp").alias(time)).distinct().write.mode("overwrite").parquet(f"{target}/_batch={n}")

    _run(events, each, checkpoint)
    return spaced(events.sparkSession.read.parquet(target), keys, ttl, time)


def run_to_table(stream: DataFrame, label: str, keys: list[str] | None = None, mode: str = "update") -> DataFrame:
    """Run a stream to its end and read its result back."""
    spark = stream.sparkSession
    target, checkpoint = work_dir(spark, label), work_dir(spark, f"{label}-checkpoint")
    append_updates(stream, target, checkpoint, mode)
    return latest_state(spark, target, keys) if keys else spark.read.parquet(target).drop("_batch")
