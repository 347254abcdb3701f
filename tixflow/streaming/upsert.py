"""Keep-latest upsert of streamed tickets (S6) with the keyword rules in the stream.

The current tickets are a table in number-hash buckets::

    table/buckets=<n>/batch=<id>/bucket=<b>/part-*.parquet

A micro-batch reads and rewrites only the buckets that its numbers fall into,
as new versions below its own batch folder; Spark's ``_SUCCESS`` file there
commits all of them at once.  A bucket's current version is the one of its
latest committed batch.  A batch that is already committed is skipped and one
that was cut off is written again, so replays after a restart change nothing.
Readers of older versions are not disturbed until ``vacuum``.

The latest row of a number is decided by ``ingest_ord`` (or first by an update
time), as in the batch dedupe, not by arrival, so repeated and late pages give
the batch result.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tixflow.functions.text import strip_ws
from tixflow.operators.classify import needs_classification, rule_category
from tixflow.operators.normalize import dedupe_keep_last, normalize
from tixflow.streaming.pages import page_records, page_schema

BUCKETS = 64


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, in the store that the path names."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(path)
    return [str(f.getPath()) for f in found or []]


def _value(path: str) -> int:
    return int(path.rstrip("/").rsplit("=", 1)[1])


def committed_batches(spark: SparkSession, table: str) -> list[int]:
    return sorted(_value(p.rsplit("/", 1)[0]) for p in _folders(spark, f"{table}/buckets=*/batch=*/_SUCCESS"))


def current_versions(spark: SparkSession, table: str) -> dict[int, str]:
    """Folder of each bucket's current version; at most as many as there are buckets."""
    done = set(committed_batches(spark, table))
    latest: dict[int, tuple[int, str]] = {}
    for p in _folders(spark, f"{table}/buckets=*/batch=*/bucket=*"):
        batch, bucket = _value(p.rsplit("/", 1)[0]), _value(p)
        if batch in done and latest.get(bucket, (-1, ""))[0] < batch:
            latest[bucket] = (batch, p)
    return {b: p for b, (_, p) in latest.items()}


def read_current(spark: SparkSession, table: str) -> DataFrame:
    """The latest row per ticket number."""
    paths = current_versions(spark, table)
    if not paths:
        raise FileNotFoundError(f"no committed batch below {table}")
    return spark.read.option("mergeSchema", True).parquet(*paths.values())


def upsert(batch: DataFrame, batch_id: int, table: str, buckets: int = BUCKETS, key: str = "number", updated: str | None = None) -> list[int]:
    """Merge a batch of rows (any number a key) into ``table``; the buckets that were rewritten."""
    spark = batch.sparkSession
    held = {_value(p) for p in _folders(spark, f"{table}/buckets=*")}
    if held - {buckets}:
        raise ValueError(f"{table} has {held} buckets, not {buckets}")
    if batch_id in committed_batches(spark, table):
        return []
    new = dedupe_keep_last(batch, key, updated).withColumn("bucket", bucket_of(key, buckets)).persist()
    try:
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most ``buckets`` rows
        if not touched:
            return []
        paths = [p for b, p in current_versions(spark, table).items() if b in set(touched)]
        merged = new.drop("bucket")
        if paths:
            old = spark.read.option("mergeSchema", True).parquet(*paths)
            merged = dedupe_keep_last(old.unionByName(merged, allowMissingColumns=True), key, updated)
        merged = merged.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket")
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/buckets={buckets}/batch={batch_id}")
        return touched
    finally:
        new.unpersist()


def vacuum(spark: SparkSession, table: str) -> int:
    """Delete the versions of buckets that later committed batches replaced; their number."""
    keep = set(current_versions(spark, table).values())
    done = set(committed_batches(spark, table))
    sc, gone = spark.sparkContext, 0
    for p in _folders(spark, f"{table}/buckets=*/batch=*/bucket=*"):
        if p not in keep and _value(p.rsplit("/", 1)[0]) in done:
            path = sc._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
            gone += 1
    return gone


def with_rule_category(tickets: DataFrame, taxonomy: dict[str, list[str]] | None = None) -> DataFrame:
    """C2 and C3 row by row: category, category_source (original, rule, or pending for the fitted tier) and category_raw."""
    needs, rule = needs_classification(F.col("category"), taxonomy), rule_category(F.col("full_text"), taxonomy)
    t = tickets.withColumns({"category_raw": F.col("category"), "_needs": needs, "_rule": F.when(needs, rule)})
    source = F.when(~F.col("_needs"), F.lit("original")).when(F.col("_rule").isNotNull(), F.lit("rule")).otherwise(F.lit("pending"))
    named = F.when(~F.col("_needs"), strip_ws(F.col("category"))).otherwise(F.coalesce("_rule", "category"))
    return t.withColumns({"category": named, "category_source": source}).drop("_needs", "_rule")


def start_upsert_stream(spark: SparkSession, source_dir: str, record_schema: T.StructType, table: str, checkpoint_path: str, as_of: datetime | str | None = None,
                        buckets: int = BUCKETS, available_now: bool = False, files_per_batch: int | None = None, updated: str | None = None,
                        merge: Callable[..., list[int]] = upsert) -> StreamingQuery:
    """Start the query that merges landed pages into ``table``, normalised and with their rule category."""
    reader = spark.readStream.schema(page_schema(record_schema)).option("multiLine", True).option("mode", "FAILFAST")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    tickets = with_rule_category(normalize(page_records(reader.json(source_dir)), as_of, dedupe=False))
    writer = tickets.writeStream.foreachBatch(lambda df, batch_id: merge(df, batch_id, table, buckets, updated=updated) and None).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
