"""Streaming forms of the ledger and of classification."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from pagewise.functions import text as T
from pagewise.functions import values as V
from pagewise.functions.values import Rule
from pagewise.operators.classify import classify_pages
from pagewise.operators.grouping import group_pages
from pagewise.operators.ledger import job_states
from pagewise.operators.payments import fulfil_payments, parse_payments
from pagewise.session import shared_folder


def read_table_stream(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    """File stream over one table of a folder; the schema is declared, never inferred."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def stream_ip_usage(usage: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Free and tool uses per usable address and day, kept up to date as events arrive.

    ``usage`` streams (event_id, ts, user_id, email, ip_address, kind). State holds one row per address and
    open day; the watermark closes days.
    """
    last = F.struct("event_ts", "event_id")
    return (
        usage.withColumn("ip", T.usable_ip(F.col("ip_address")))
        .filter(F.col("ip").isNotNull())
        .withColumn("event_ts", F.col("ts").cast("timestamp"))
        .withWatermark("event_ts", lateness)
        .groupBy(F.window("event_ts", "1 day"), "ip")
        .agg(
            F.count_if(F.col("kind") == "free").alias("free_process_count"),
            F.count_if(F.col("kind") == "tool").alias("tool_use_count"),
            F.max_by("user_id", last).alias("last_user_id"),
            F.max_by("email", last).alias("last_email"),
            F.max("event_ts").alias("updated_at"),
        )
        .select(
            "ip",
            F.to_date("window.start").alias("usage_date"),
            "free_process_count",
            "tool_use_count",
            "last_user_id",
            "last_email",
            F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
        )
    )


def stream_job_state(job_events: DataFrame) -> DataFrame:
    """Latest state per job as its events arrive: the batch fold with its buffers kept as stream state."""
    return job_states(job_events)


def stream_fulfil(notices: DataFrame) -> DataFrame:
    """Every payment once over a stream of notices.

    State is one row per payment id: its first final notice and its latest one. A repeated notice updates
    that row and can never credit again, because the credit is read from the first final notice. Spark
    checkpoints the state, so a restart neither loses nor repeats a payment.
    """
    return fulfil_payments(parse_payments(notices))


def stream_classify(pages: DataFrame, rules: tuple[Rule, ...] = V.SHIPPED_RULES) -> DataFrame:
    """Classification is stateless per page, so the batch function serves the stream as it is."""
    return classify_pages(pages, rules)


def group_landed_documents(classified: DataFrame, write: Callable[[DataFrame, int], None], **options: str) -> StreamingQuery:
    """Group each micro-batch of complete documents and hand the groups to ``write``."""
    writer = classified.writeStream.foreachBatch(lambda batch, epoch: write(group_pages(batch), epoch))
    return writer.options(**options).trigger(availableNow=True).start()


def upserted(stream: DataFrame, keys: Sequence[str], folder: str) -> DataFrame:
    """Run a keyed stream over everything that is there; the newest row of each key, from this run and earlier ones.

    Each batch adds only the rows it changed, under its own number, so a batch that is repeated after a failure
    replaces itself. A later call with the same ``folder`` goes on where this one ended.
    """
    spark = stream.sparkSession
    result, progress = f"{folder}/result", f"{folder}/progress"
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True)
    writer.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{result}/batch={epoch}")).start().awaitTermination()
    changes = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(result)
    others = [name for name in stream.columns if name not in keys]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("row"))
    return newest.select(*keys, "row.*").select(stream.columns)


def appended(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stateless stream over everything that is there; its rows from this run and earlier ones."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{folder}/result").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/result")


def drain(stream: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The result of a stream over everything that is there, kept in the shared folder; keyed where ``keys`` are named."""
    folder = f"{shared_folder(stream.sparkSession)}/{uuid.uuid4().hex}"
    return upserted(stream, keys, folder) if keys else appended(stream, folder)
