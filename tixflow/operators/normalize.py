"""Bring any raw ticket frame to the canonical ticket schema.

Every step is a column expression in one projection except the dedupe,
which is one shuffle on ``number``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tixflow.config import (COLUMN_ALIASES, PRIORITY_MAP, REQUIRED_COLUMNS,
                            STATE_MAP, TEXT_COLUMNS, TIMESTAMP_COLUMNS)
from tixflow.functions.lookup import lookup
from tixflow.functions.text import strip_ws, title_case
from tixflow.functions.time import as_of_literal, hours_between, parse_timestamp

REQUIRED_NAMES = [c for c, _ in REQUIRED_COLUMNS]
DERIVED_NAMES = ["full_text", "mttr_hours", "age_hours"]
ORD = "ingest_ord"


def canonical_schema(extra: list[T.StructField] | None = None) -> T.StructType:
    fields = []
    for name, _ in REQUIRED_COLUMNS:
        dtype = T.TimestampNTZType() if name in TIMESTAMP_COLUMNS else T.StringType()
        fields.append(T.StructField(name, dtype, True))
    fields += [T.StructField("full_text", T.StringType(), True),
               T.StructField("mttr_hours", T.DoubleType(), True),
               T.StructField("age_hours", T.DoubleType(), True),
               T.StructField(ORD, T.LongType(), True)]
    return T.StructType(fields + list(extra or []))


def empty_tickets(spark: SparkSession) -> DataFrame:
    """Empty input gives an empty frame with the full canonical schema."""
    return spark.createDataFrame([], canonical_schema())


def rename_aliases(raw: DataFrame, aliases: dict[str, str] | None = None,
                   names: list[str] | None = None) -> DataFrame:
    """N1 + N2: alias headers case-insensitively; on a name clash keep the first.

    Columns are taken by position, so repeated or case-variant headers are
    no ambiguity.  ``names``: the headers, where the frame's own differ.
    """
    table = COLUMN_ALIASES if aliases is None else aliases
    canonical = {n.lower(): n for n in [*REQUIRED_NAMES, ORD]}
    seen: set[str] = set()
    cols: list[Column] = []
    by_position = raw.toDF(*[f"_p{i}" for i in range(len(raw.columns))])
    for i, name in enumerate(raw.columns if names is None else names):
        target = table.get(name.lower().strip(), name)
        target = canonical.get(target.lower(), target)
        if target.lower() in seen:
            continue
        seen.add(target.lower())
        cols.append(F.col(f"_p{i}").alias(target))
    return by_position.select(*cols)


def priority_expr(c: Column, mapping: dict[str, str] | None = None) -> Column:
    """NULL -> '', strip, lower, lookup; otherwise 'Unknown'."""
    key = F.lower(strip_ws(F.coalesce(c.cast("string"), F.lit(""))))
    return F.coalesce(lookup(key, PRIORITY_MAP if mapping is None else mapping), F.lit("Unknown"))


def state_expr(c: Column, mapping: dict[str, str] | None = None) -> Column:
    """Lookup; unlisted text -> Python-style title case; blank -> 'Unknown'."""
    key = F.lower(strip_ws(F.coalesce(c.cast("string"), F.lit(""))))
    return F.coalesce(
        lookup(key, STATE_MAP if mapping is None else mapping),
        F.when(key == "", F.lit("Unknown")).otherwise(title_case(key)),
    )


def record_type_expr(rt: Column, number: Column) -> Column:
    """Keep a non-blank record type, else infer from the number prefix."""
    v = strip_ws(F.coalesce(rt.cast("string"), F.lit("")))
    return (F.when(v != "", v)
            .when(number.startswith("INC"), F.lit("Incident"))
            .when(number.startswith("CHG"), F.lit("Change"))
            .when(number.startswith("PRB"), F.lit("Problem"))
            .otherwise(F.lit("Incident")))


def normalize(raw: DataFrame, as_of: datetime | str | None = None, *,
              aliases: dict[str, str] | None = None,
              priority_map: dict[str, str] | None = None,
              state_map: dict[str, str] | None = None,
              timestamp_formats: list[str] | None = None,
              dedupe: bool = True,
              compat_record_type: bool = False) -> DataFrame:
    """Canonical tickets: 21 columns, ``full_text``, ``mttr_hours``,
    ``age_hours``, then extras and ``ingest_ord``.

    ``as_of`` is the reference time for ``age_hours`` (default: now).
    ``compat_record_type=True`` keeps the reference rule where an absent
    record-type column makes every row an Incident (Q5).
    """
    if not raw.columns:
        return empty_tickets(raw.sparkSession)
    df = rename_aliases(raw, aliases)
    if "number" not in df.columns:
        raise ValueError("ticket input has no number column (or alias of it)")
    if ORD not in df.columns:
        df = df.withColumn(ORD, F.monotonically_increasing_id())
    had_record_type = "record_type" in df.columns

    dtypes = dict((f.name, f.dataType) for f in df.schema.fields)
    out: dict[str, Column] = {}
    for name, default in REQUIRED_COLUMNS:
        present = name in dtypes
        src = F.col(f"`{name}`")
        if name in TIMESTAMP_COLUMNS:
            out[name] = (parse_timestamp(src, dtypes[name], timestamp_formats) if present
                         else F.lit(None).cast("timestamp_ntz"))
        elif name in TEXT_COLUMNS:
            out[name] = strip_ws(F.coalesce(src.cast("string"), F.lit(""))) if present else F.lit(default)
        elif name == "priority":
            out[name] = priority_expr(src if present else F.lit(None), priority_map)
        elif name == "state":
            out[name] = state_expr(src if present else F.lit(None), state_map)
        elif name == "number":
            out[name] = src.cast("string")
        elif name == "record_type":
            if present or not compat_record_type:
                out[name] = record_type_expr(src if present else F.lit(None), F.col("number").cast("string"))
            else:
                out[name] = F.lit(default)
        else:
            # Existing NULLs are kept (only absent columns get the default).
            out[name] = src.cast("string") if present else F.lit(default)

    full_text = strip_ws(F.concat_ws(" ", out["short_description"], out["description"]))
    resolution = F.coalesce(out["resolved_at"], out["closed_at"])
    mttr = hours_between(out["opened_at"], resolution)
    age = hours_between(out["opened_at"], as_of_literal(as_of))
    extras = [c for c in df.columns if c not in out and c != ORD]

    df = df.select(
        *[out[n].alias(n) for n in REQUIRED_NAMES],
        full_text.alias("full_text"),
        F.when(mttr > 0, mttr).alias("mttr_hours"),
        age.alias("age_hours"),
        *[F.col(f"`{c}`") for c in extras],
        F.col(ORD),
    )
    if not had_record_type and compat_record_type:
        df = df.withColumn("record_type", F.lit("Incident"))
    return dedupe_keep_last(df) if dedupe else df


def dedupe_keep_last(df: DataFrame, key: str = "number", updated: str | None = None) -> DataFrame:
    """One row per ``key``, the one with the largest ``ingest_ord``.

    With ``updated`` (a timestamp column) the latest update wins and
    ``ingest_ord`` decides between equal ones; rows without one are the oldest.

    ``row_number() = 1`` prunes unused columns and runs as a group limit before
    and after the shuffle, so of a key that holds a large share of the rows
    (e.g. NULL numbers) every task sends one row.
    """
    order = [F.col(ORD).desc()] if updated is None else [F.col(updated).desc_nulls_last(), F.col(ORD).desc()]
    latest = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn")
