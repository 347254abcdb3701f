"""Structured Streaming ingest of landed API pages (S6, streaming form).

Page files (``{"result": [...]}`` per file) arriving in a folder are read with
a declared schema, flattened and normalised with the same column expressions
as the batch path (no dedupe inside the stream: that needs all history), then
appended to a Parquet ticket log with a checkpoint for exactly-once file
tracking.  ``current_tickets`` reads the log and keeps the latest row per
ticket number (the batch dedupe operator).

``ingest_ord`` of a streamed row is (modification time, file, position), as in
the batch read, so the latest version of a ticket is the same in both however
the pages fall into micro-batches.  A corrupt page fails the query.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tixflow.operators.normalize import dedupe_keep_last, normalize
from tixflow.sources.files import flatten, page_order


def page_schema(record: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("result", T.ArrayType(record), True)])


def page_records(stream: DataFrame) -> DataFrame:
    """Explode the envelopes of a (streaming) page frame into flat records."""
    d = stream.select(F.col("_metadata"), F.posexplode("result").alias("_pos", "r"))
    return flatten(d.select("r.*", page_order(F.col("_pos")).alias("ingest_ord")), keep=("ingest_ord",))


def start_page_stream(spark: SparkSession, source_dir: str, record_schema: T.StructType, log_path: str,
                      checkpoint_path: str, as_of: datetime | str | None = None,
                      available_now: bool = False) -> StreamingQuery:
    """Start the ingest query; ``available_now=True`` processes what is there and stops."""
    pages = (spark.readStream.schema(page_schema(record_schema)).option("multiLine", True).option("mode", "FAILFAST")
                  .json(source_dir))
    tickets = normalize(page_records(pages), as_of, dedupe=False)
    writer = (tickets.writeStream.format("parquet").option("path", log_path)
                     .option("checkpointLocation", checkpoint_path).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def current_tickets(spark: SparkSession, log_path: str) -> DataFrame:
    """Latest row per ticket number from the streamed log."""
    return dedupe_keep_last(spark.read.parquet(log_path))
