"""Ticket-shaped inputs derived from the driver's tables.

``tk_raw`` turns every order into one raw ticket export row (the TK view of
FIXTURES.md): the text comes from a 12-row template table picked by
``o_orderkey % 12``, the nation name and the customer segment.  Its work grows
with ``orders``; the template table is a fixed 12-row literal, broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tixflow.sources.tables import read_table

# Fixture text (own wording): template id, short text, category as exported,
# fix note, cause note.
TEMPLATES = [
    (0, "branch office lost wireless connectivity", "Network",
     "replaced faulty access switch", "switch power supply failed"),
    (1, "nightly sql batch hits deadlock", "Database",
     "reordered updates in the batch", "two jobs lock rows in opposite order"),
    (2, "checkout page throws exception on submit", "",
     "rolled back the last release", "null field after release"),
    (3, "volume almost full on file host", "Other",
     "purged old logs and widened the quota", "log rotation disabled"),
    (4, "tls certificate about to lapse", "Security",
     "renewed the certificate", "renewal reminder missing"),
    (5, "staff cannot login after password reset", "Access & Identity",
     "resynced the directory account", "directory sync paused"),
    (6, "monthly report runs very slow", "network",
     "added an index", "missing index on ledger"),
    (7, "shared mailbox stopped receiving mail", "Software",
     "cleared the stuck mailbox rule", "mailbox rule loop"),
    (8, "restore of weekly snapshot incomplete", "Storage & Backup",
     "reran the restore", "snapshot window too short"),
    (9, "pager flood from one noisy threshold", "N/A",
     "raised the alert threshold", "threshold copied from test"),
    (10, "coffee machine leaking on floor two", "",
     "called the vendor", "worn seal"),
    (11, "worker host needs reboot after hang", "",
     "restarted the host", "memory leak in agent"),
]

AS_OF = "2001-09-01 00:00:00"


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "tid int, short string, cat string, fix string, cause string")


def tk_raw(spark: SparkSession, data_dir: str) -> DataFrame:
    """One raw ticket per order; ``ingest_ord`` = order key."""
    o = read_table(spark, data_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = read_table(spark, data_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read_table(spark, data_dir, "nation").select("n_nationkey", "n_name")
    t = F.broadcast(templates(spark))
    k = F.col("o_orderkey")
    resolved = F.col("o_orderstatus") == "F"
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(n, c.c_nationkey == n.n_nationkey)
          .join(t, (k % 12).cast("int") == t.tid))
    return j.select(
        F.concat(F.lit("INC"), F.lpad(k.cast("string"), 8, "0")).alias("number"),
        F.concat(F.when(k % 5 == 0, F.lit("URGENT: ")).otherwise(F.lit("")),
                 F.col("short"),
                 F.when(k % 3 == 0, F.lit(" - raised by service desk"))
                  .when(k % 3 == 1, F.lit(" (seen in monitoring)"))
                  .otherwise(F.lit(""))).alias("short_description"),
        F.concat(F.lit("Customer in "), F.col("n_name"), F.lit(" reports "), F.col("short")).alias("description"),
        F.col("cat").alias("category"),
        F.col("o_orderpriority").alias("priority_raw"),
        F.substring("o_orderpriority", 1, 1).alias("priority"),
        F.when(resolved, F.lit("resolved"))
         .when(F.col("o_orderstatus") == "O", F.lit(" New "))
         .otherwise(F.lit("wip")).alias("state"),
        F.col("o_orderdate").alias("opened_at"),
        F.when(resolved, F.timestamp_add("HOUR", (k * 37 % 101), F.col("o_orderdate"))).alias("resolved_at"),
        F.col("n_name").alias("assignment_group"),
        F.col("c_mktsegment").alias("business_service"),
        F.concat(F.lit("ci-"), (F.col("o_custkey") % 10).cast("string")).alias("cmdb_ci"),
        F.when(resolved & (k % 10 < 7), F.col("fix")).otherwise(F.lit("")).alias("close_notes"),
        F.when(resolved & (k % 7 < 4), F.col("cause")).otherwise(F.lit("")).alias("root_cause"),
        k.alias("ingest_ord"),
    )


def tk_dup_raw(spark: SparkSession, data_dir: str) -> DataFrame:
    """Dedupe fixture: TK plus a later, closed copy of every resolved ticket."""
    base = tk_raw(spark, data_dir)
    copies = (base.filter(F.col("state") == "resolved")
                  .withColumn("state", F.lit("closed"))
                  .withColumn("ingest_ord", F.col("ingest_ord") + F.lit(1 << 40)))
    return base.unionByName(copies)


def tk_prefix_raw(spark: SparkSession, data_dir: str) -> DataFrame:
    """Record-type fixture: number prefixes INC/CHG/PRB/REQ, blank record type."""
    base = tk_raw(spark, data_dir)
    k = F.col("ingest_ord")
    prefix = (F.when(k % 4 == 1, F.lit("CHG")).when(k % 4 == 2, F.lit("PRB"))
               .when(k % 4 == 3, F.lit("REQ")).otherwise(F.lit("INC")))
    return (base.withColumn("number", F.concat(prefix, F.substring("number", 4, 100)))
                .withColumn("record_type", F.lit("")))
