"""Records of quoted CSV files that may be split inside a record.

Spark's text source cuts files into byte ranges at line breaks; a quoted field
may hold line breaks, so a range may begin inside a record.  Whether it does
follows from quote parity: the number of quotes in every range, summed over
the ranges before it, is odd exactly where a range begins inside a quoted
field.  Each range then joins its own lines into records; what is open at its
end is joined with the beginnings of the next ranges.

The lines are checkpointed first, so both passes see the same ranges even if
executors are lost, and every file is read once.  The table of ranges has a
row per range; those that begin inside a field are broadcast up to
``MAX_BROADCAST`` rows and joined by a shuffle beyond it.

Quotes stand where RFC 4180 has them: around a field, doubled inside it.  A
file with a single quote inside an unquoted field has to be read unsplit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tixflow.session import cut_lineage, ensure_checkpoint_dir

MAX_BROADCAST = 500_000
PIECE = "file long, block long, pos long, head boolean, closed boolean, value binary"


def file_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """file (hash of its path), block, pos, value: every line (without its line feed) and the byte range that holds it."""
    ensure_checkpoint_dir(spark)
    # the metadata path is percent-encoded, but for "+"; a hash keeps the checkpoint small
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.option("lineSep", "\n").text(files).select(
        F.xxhash64(path).alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), "value")
    return lines.checkpoint()


def byte_ranges(lines: DataFrame) -> DataFrame:
    """file, block, inside (does the range begin in a quoted field?), first (pos and value of its first line), utf8."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    per = lines.groupBy("file", "block").agg(
        (F.sum(quotes) % 2).alias("odd"), F.min(F.struct("pos", F.col("value").cast("binary").alias("value"))).alias("first"), F.min(F.is_valid_utf8("value")).alias("utf8"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"), "first", "utf8")


def _pieces(lines: DataFrame) -> DataFrame:
    """Records and parts of records of every range (PIECE); lines of a range arrive together, in order."""
    names = [f.split()[0] for f in PIECE.split(", ")]

    def run(batches):
        at, held, odd = None, [], 0          # range, lines of the open record, is a quoted field open?
        key = (None, None, None, True)       # file, block, pos and head of the open record

        def batch(rows):
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for b in batches:
            file, block, pos, inside = (b.column(i).to_pylist() for i in (0, 1, 2, 4))
            value = b.column(3)
            toggles = (pc.count_substring(value, '"').to_numpy(zero_copy_only=False) & 1).astype(np.int8).tolist()
            out = []
            for i, v in enumerate(value.to_pylist()):
                if at != (file[i], block[i]):
                    if held:
                        out.append((*key, False, b"\n".join(held)))
                    at, held, odd = (file[i], block[i]), [], int(inside[i])
                    key = (file[i], block[i], pos[i], not odd)
                elif not held:
                    key = (file[i], block[i], pos[i], True)
                held.append(v)
                odd ^= toggles[i]
                if not odd:
                    out.append((*key, True, b"\n".join(held)))
                    held = []
            yield batch(out)
        if held:
            yield batch([(*key, False, b"\n".join(held))])
    return lines.select("file", "block", "pos", F.col("value").cast("binary").alias("value"), "inside").mapInArrow(run, PIECE)


def records(lines: DataFrame, ranges: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """file, block, pos, value (bytes): one row per record, the headers' included, where it begins.

    A record that is not closed at the end of its file ends there.
    """
    begins = ranges.where("inside").select("file", "block", "inside")
    few = begins.count() <= max_broadcast
    marked = lines.join(F.broadcast(begins) if few else begins.hint("shuffle_merge"), ["file", "block"], "left")
    marked = marked.withColumn("inside", F.coalesce("inside", F.lit(False)))
    if not few:  # the join by a shuffle has lost the order
        marked = marked.repartition("file", "block").sortWithinPartitions("file", "block", "pos")
    pieces = cut_lineage(_pieces(marked))
    whole = pieces.where("head and closed").select("file", "block", "pos", "value")
    # at most two parts of records a range
    parts = pieces.where("not (head and closed)")
    order = Window.partitionBy("file").orderBy("block", "pos")
    begin = F.last(F.when(F.col("head"), F.struct("block", "pos")), ignorenulls=True).over(order)
    parts = parts.select("file", begin.alias("begin"), F.struct("block", "pos", "value").alias("part"))
    joined = (parts.groupBy("file", "begin").agg(F.array_sort(F.collect_list("part")).alias("parts"))
              .select("file", "begin.block", "begin.pos",
                      F.expr("aggregate(parts, cast(null as binary), (a, p) -> if(a is null, p.value, a || X'0A' || p.value))").alias("value")))
    return whole.unionByName(joined)


def parse(records: DataFrame, n_columns: int, encoding: str, crlf: bool) -> DataFrame:
    """_c0, _c1, ... and ingest_ord of the records (with their files' path); empty lines are none."""
    text = F.col("value").cast("string") if encoding.lower().replace("-", "") == "utf8" else F.decode("value", encoding)
    if crlf:
        text = F.replace(F.regexp_replace(text, "\r$", ""), F.lit("\r\n"), F.lit("\n"))
    schema = ", ".join(f"_c{i} string" for i in range(n_columns))
    rows = records.select(F.struct(F.col("path").alias("file"), "block", "pos").alias("ingest_ord"), text.alias("text")).where("text <> ''")
    return rows.select(F.from_csv("text", schema, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}).alias("r"), "ingest_ord").select("r.*", "ingest_ord")
