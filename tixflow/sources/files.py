"""File sources and sinks.

* CSV: a file, a folder (``*.csv``, not recursive) or a glob.  One distributed
  pass finds every file's header line and whether its bytes are valid UTF-8.
  Files are grouped by header and encoding, and each group is one all-string
  ``spark.read.csv`` with columns by position, so repeated or case-variant
  headers keep the first column.  Files that are not valid UTF-8 are read as
  ISO-8859-1.  The groups are unioned by name; ``na_tokens`` become NULL.
* JSON: an array of records or an envelope ``{"result": [...]}``; nested
  objects are flattened to dotted column names.  A folder of landed API
  pages (one envelope per file, empty pages allowed) is the same read.  A
  corrupt file raises unless another ``mode`` is asked for.
* ``ingest_ord`` is a struct that orders rows: (file, block, position) for CSV,
  as in a concatenation of the sorted files, and (modification time, file,
  position) for landed pages, the same in batch and in the stream.

Only the list of files with their header lines is held on the driver.
"""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tixflow.config import NA_TOKENS
from tixflow.operators.normalize import rename_aliases
from tixflow.session import cut_lineage
from tixflow.sources import quoted


def _jvm_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(conf), p


def list_files(spark: SparkSession, path: str, suffix: str = ".csv") -> list[str]:
    """Folder -> its ``*suffix`` files; glob -> matches; else the path."""
    jvm, fs, p = _jvm_fs(spark, path)
    if "*" in path or "?" in path:
        stats = fs.globStatus(p) or []
        files = [s.getPath().toString() for s in stats if s.isFile()]
    elif fs.exists(p) and fs.getFileStatus(p).isDirectory():
        files = [s.getPath().toString() for s in fs.listStatus(p)
                 if s.isFile() and s.getPath().getName().endswith(suffix)]
    elif fs.exists(p):
        files = [fs.getFileStatus(p).getPath().toString()]
    else:
        files = []
    if not files:
        raise FileNotFoundError(f"No {suffix.lstrip('.').upper()} files found at: {path}")
    return sorted(files)


def file_facts(spark: SparkSession, files: list[str]) -> dict[str, tuple[bytes, bool]]:
    """S3: per non-empty file its first line and whether all its bytes are valid UTF-8.

    Read line by line on the executors; one row per file comes back.
    """
    lines = spark.read.text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), "value")
    rows = lines.groupBy("file").agg(
        F.min(F.struct("block", "pos", "value")).alias("first"),
        F.min(F.is_valid_utf8("value")).alias("ok")).select(
        "file", F.col("first.value").cast("binary").alias("header"), "ok").collect()
    # The metadata path is percent-encoded, the listed one is not ("+" is itself in both).
    return {unquote(r["file"]): (bytes(r["header"]), r["ok"]) for r in rows}


def file_order() -> Column:
    """Order of rows as in the concatenation of the sorted files."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("pos"))


def page_order(pos: Column) -> Column:
    """Order of records of landed pages: later files win, then later records."""
    return F.struct(F.col("_metadata.file_modification_time").alias("modified"),
                    F.col("_metadata.file_path").alias("file"), pos.cast("long").alias("pos"))


def _na_to_null(df: DataFrame, tokens: list[str] | None) -> DataFrame:
    if not tokens:
        return df
    return df.select(*[F.when(F.col(f"`{c}`").isin(tokens), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c)
                       if c != "ingest_ord" else F.col(c) for c in df.columns])


def _header(line: bytes, ok: bool, encoding: str) -> tuple[tuple[str, ...], str]:
    """Column names of a header line and the encoding to read its file with."""
    utf8 = encoding.lower().replace("-", "") == "utf8"
    enc = "ISO-8859-1" if utf8 and not ok else encoding
    names = next(csv.reader([line.decode(enc, "replace").removeprefix("\ufeff").removesuffix("\r")]), [])
    return tuple(names), enc


def _unsplit_frames(spark: SparkSession, files: list[str], encoding: str, multi_line: bool, aliases):
    facts = file_facts(spark, files)
    groups: dict[tuple, list[str]] = {}
    for f in files:
        names, enc = _header(*facts.get(f, (b"", True)), encoding)
        if names:  # an empty file has no rows
            groups.setdefault((names, enc), []).append(f)
    for (names, enc), fs in groups.items():
        by_position = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
        raw = spark.read.schema(by_position).csv(fs, header=True, enforceSchema=True, multiLine=multi_line,
                                                 quote='"', escape='"', encoding=enc, mode="PERMISSIVE")
        raw = raw.select(*by_position.names, file_order().alias("ingest_ord"))
        yield rename_aliases(raw, aliases, [*names, "ingest_ord"])


def _split_frames(spark: SparkSession, files: list[str], encoding: str, aliases):
    lines = quoted.file_lines(spark, files)
    ranges = cut_lineage(quoted.byte_ranges(lines))
    first = F.min(F.struct("block", "first"))["first"]
    heads = ranges.groupBy("file").agg(first.alias("first"), F.min("utf8").alias("ok")).collect()  # one row per file
    path = {r["file"]: r["path"] for r in spark.createDataFrame([(f,) for f in files], "path string").withColumn("file", F.xxhash64("path")).collect()}
    groups: dict[tuple, int] = {}
    of_file = []
    listed = {f: i for i, f in enumerate(files)}
    for r in sorted(heads, key=lambda r: listed[path[r["file"]]]):  # columns come in the order of the files, as in the one-task read
        line = bytes(r["first"]["value"])
        names, enc = _header(line, r["ok"], encoding)
        if names:
            g = groups.setdefault((names, enc, line.endswith(b"\r")), len(groups))
            of_file.append((r["file"], path[r["file"]], g, r["first"]["pos"]))
    if not of_file:
        return
    of_file = F.broadcast(spark.createDataFrame(of_file, "file long, path string, header_group int, header_pos long"))  # the driver's list of files
    rows = quoted.records(lines, ranges).join(of_file, "file").where("pos <> header_pos")
    for (names, enc, crlf), g in groups.items():
        yield rename_aliases(quoted.parse(rows.where(F.col("header_group") == g), len(names), enc, crlf), aliases, [*names, "ingest_ord"])


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8",
             na_tokens: list[str] | None = NA_TOKENS, aliases: dict[str, str] | None = None,
             multi_line: bool = True, splittable: bool = False) -> DataFrame:
    """Raw tickets from CSV exports with canonical column names and ``ingest_ord``.

    Quoted line breaks are kept.  ``splittable=True`` reads large files in byte
    ranges all the same (``sources.quoted``; ASCII-compatible encodings, quotes
    as RFC 4180 has them); without it a file is one task.
    ``multi_line=False`` lets Spark split large files; quoted line breaks are
    then not supported.
    """
    files = list_files(spark, path, ".csv")
    frames = list(_split_frames(spark, files, encoding, aliases) if splittable else _unsplit_frames(spark, files, encoding, multi_line, aliases))
    if not frames:
        return spark.createDataFrame([], "number string")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return _na_to_null(out, na_tokens)


def flatten(df: DataFrame, sep: str = ".", keep: tuple[str, ...] = ()) -> DataFrame:
    """Nested structs -> dotted top-level columns (arrays, and ``keep``, as they are)."""
    def walk(dtype: T.StructType, prefix: list[str]) -> list[Column]:
        cols = []
        for f in dtype.fields:
            path = prefix + [f.name]
            if isinstance(f.dataType, T.StructType) and path[0] not in keep:
                cols += walk(f.dataType, path)
            else:
                ref = F.col(".".join(f"`{p}`" for p in path))
                cols.append(ref.alias(sep.join(path)))
        return cols
    return df.select(*walk(df.schema, []))


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None,
              mode: str = "FAILFAST") -> DataFrame:
    """S4 + S5 + S6: records from a JSON array, an envelope, or a folder of pages.

    Pages without any record give an empty frame.
    """
    reader = spark.read.option("multiLine", True).option("mode", mode)
    if schema is not None:
        reader = reader.schema(schema)
    raw = reader.json(path)
    if "result" in raw.columns and isinstance(raw.schema["result"].dataType, T.ArrayType):
        if not isinstance(raw.schema["result"].dataType.elementType, T.StructType):
            return spark.createDataFrame([], "number string")
        d = raw.select(F.col("_metadata"), F.posexplode("result").alias("_pos", "r"))
        d = d.select("r.*", page_order(F.col("_pos")).alias("ingest_ord"))
    else:
        d = raw.select("*", page_order(F.monotonically_increasing_id()).alias("ingest_ord"))
    cols = [c for c in d.columns if c != "_corrupt_record"]
    return flatten(d.select(*cols), keep=("ingest_ord",))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tickets as CSV with a header (timestamps as text, white space kept)."""
    out = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if not isinstance(t, (T.ArrayType, T.MapType, T.StructType))
                      else F.to_json(F.col(f"`{c}`")).alias(c) for c, t in ((f.name, f.dataType) for f in df.schema.fields)])
    out.write.mode(mode).option("header", True).option("escape", '"').options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_report_json(report_row: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The nested report row as JSON (timestamps as strings, NULL for missing)."""
    report_row.coalesce(1).write.mode(mode).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss") \
              .option("ignoreNullFields", False).json(path)
