"""Normalisation queries over an untidy ticket export.

Every order becomes a raw ticket whose values need work: text timestamps in each
declared format plus junk, padded, odd-cased, blank and NULL states and
priorities, padded and NULL texts.  The SQL side never parses a timestamp: it
derives the expected value from the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tixflow.operators.normalize import normalize
from tixflow.plans import fixtures as FX
from tixflow.plans import oracle as O
from tixflow.plans.catalog import register
from tixflow.sources.filters import trailing_window

STATES = [" Awaiting Vendor ", "AWAITING-INFO", "wip", None, "", "  ", "ready for review", "Canceled", "6\t"]
PRIORITIES = [" 1 - Critical", "SEV2", "p3", None, "", "urgent", "Medium ", "5"]
N_FORMATS = 11  # ten declared timestamp formats and junk


def _pick(values: list[str | None], k: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), (k % len(values)).cast("int"))


def messy_raw(spark: SparkSession, data_dir: str) -> DataFrame:
    t = FX.tk_raw(spark, data_dir)
    k = F.col("ingest_ord")
    ts = F.timestamp_add("SECOND", (k % 24) * 3600 + (k % 60) * 60 + k % 50, F.col("opened_at").cast("timestamp_ntz"))
    two_hours_on = F.timestamp_add("HOUR", F.lit(2), ts)
    text = [F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
            F.concat(F.date_format(two_hours_on, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02")),
            F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250Z")),
            F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(".125")), F.date_format(ts, "yyyy-MM-dd HH:mm"),
            F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "dd/MM/yyyy HH:mm:ss"), F.date_format(ts, "dd/MM/yyyy HH:mm"),
            F.concat(F.lit("  "), F.date_format(ts, "dd/MM/yyyy"), F.lit(" ")), F.concat(F.lit("n/a "), k.cast("string"))]
    form = (k % N_FORMATS).cast("int")
    return t.select(
        F.col("number").alias("Number"),
        F.when(k % 13 != 0, F.concat(F.lit(" \t"), "short_description", F.lit("\n "))).alias("Title"),
        F.concat(F.lit("\n"), "description", F.lit("  ")).alias("description"), "category",
        F.coalesce(*(F.when(form == i, x) for i, x in enumerate(text))).alias("Created"),
        _pick(STATES, k).alias("STATE"), _pick(PRIORITIES, k).alias("Priority"),
        "priority_raw", "assignment_group", "business_service", "cmdb_ci", "close_notes", "root_cause", "ingest_ord")


def _values(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else O.q(v) for v in values) + "]"


def messy_sql(s: O.Sql) -> str:
    """Registers the untidy rows with their expected timestamps; returns the normalised CTE."""
    k = "ingest_ord"
    ts = f"(CAST(opened_at AS TIMESTAMP) + to_seconds(({k} % 24) * 3600 + ({k} % 60) * 60 + {k} % 50))"
    s.add("tk_raw", O.tk_raw_sql())
    s.add("messy", f"""SELECT * REPLACE (
    CASE WHEN {k} % 13 <> 0 THEN ' ' || chr(9) || short_description || chr(10) || ' ' END AS short_description,
    chr(10) || description || '  ' AS description,
    {_values(STATES)}[1 + {k} % {len(STATES)}] AS state,
    {_values(PRIORITIES)}[1 + {k} % {len(PRIORITIES)}] AS priority,
    CAST(NULL AS TIMESTAMP) AS resolved_at,
    CASE {k} % {N_FORMATS} WHEN 3 THEN {ts} + INTERVAL 250 MILLISECOND WHEN 4 THEN {ts} + INTERVAL 125 MILLISECOND
         WHEN 5 THEN date_trunc('minute', {ts}) WHEN 8 THEN date_trunc('minute', {ts})
         WHEN 6 THEN date_trunc('day', {ts}) WHEN 9 THEN date_trunc('day', {ts})
         WHEN 10 THEN NULL ELSE {ts} END AS opened_at) FROM tk_raw""")
    s.add("messy_norm", O.normalized_sql("messy"))
    return "messy_norm"


def _sql(cols: str, where: str = ""):
    def build() -> str:
        s = O.Sql()
        return s.select(f"SELECT {cols} FROM {messy_sql(s)} {where}")
    return build


def _tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(messy_raw(spark, sf_dir), FX.AS_OF)


@register("messy_text", _sql("number, short_description, description, full_text"))
def q_messy_text(spark, sf_dir):
    return _tickets(spark, sf_dir).select("number", "short_description", "description", "full_text")


@register("messy_priority_state", _sql("number, priority, state"))
def q_messy_priority_state(spark, sf_dir):
    return _tickets(spark, sf_dir).select("number", "priority", "state")


@register("messy_timestamps", _sql("number, opened_at, round(age_hours * 3600, 3) AS age_seconds"))
def q_messy_timestamps(spark, sf_dir):
    return _tickets(spark, sf_dir).select("number", "opened_at", F.round(F.col("age_hours") * 3600, 3).alias("age_seconds"))


@register("messy_trailing_window", _sql("number, opened_at", f"WHERE opened_at >= TIMESTAMP '{FX.AS_OF}' - INTERVAL 400 DAY AND cmdb_ci <> 'ci-3'"))
def q_messy_trailing_window(spark, sf_dir):
    raw = trailing_window(messy_raw(spark, sf_dir), 400, FX.AS_OF, [F.col("cmdb_ci") != "ci-3"])
    return normalize(raw, FX.AS_OF).select("number", "opened_at")
