"""Fixture rows brought into the shapes the operators expect (Spark side and oracle side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoscope.functions.quality import (
    FIGURE_SIGNS,
    HEDGE_WORDS,
    LEAK_PATTERNS,
    LISTING_WORDS,
    NO_DATA_PATTERNS,
    NUMBERISH,
    PIPE_TABLE,
    REFUSAL_WORDS,
)
from dialoscope.functions.text import split_list
from dialoscope.operators.rollups import enrich
from dialoscope.plans.fixtures import fixture


def records(spark: SparkSession, sf_dir: str, costly: bool = False) -> DataFrame:
    """Result records of three accounts and two versions."""
    rows = fixture(spark, sf_dir, "eval_records", costly)
    tools = split_list("tools_csv")
    call = lambda t: F.struct(t.alias("tool"), F.parse_json(F.lit("{}")).alias("input"))
    return rows.select(
        F.concat(F.lit("acct"), (F.col("query_index") % 3).cast("string")).alias("account"), "run_version",
        F.col("query_index"), "query", F.lit("").alias("copilot_response"),
        F.when(F.col("query_index") % 6 == 0, "checked").otherwise("").alias("remarks"), "category",
        "expected_tool", F.concat(F.lit("t"), F.col("query_index").cast("string")).alias("thread_id"),
        F.transform(tools, call).alias("tool_calls"), "response", tools.alias("status_sequence"),
        F.array().cast("array<string>").alias("suggestions"),
        F.col("response_time_seconds").cast("decimal(12,2)").alias("response_time_seconds"), "step_count", "error",
        F.lit("2024-01-01T00:00:00").alias("timestamp"))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(records(spark, sf_dir, costly=True))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "registry")


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def rx(subject: str, pattern: str) -> str:
    return f"regexp_matches({subject}, {q(pattern)})"


BLANK = "regexp_replace(coalesce({0}, ''), '^\\s+|\\s+$', '', 'g') = ''"

_ANY_NO_DATA = "|".join(f"(?:{p})" for p in NO_DATA_PATTERNS)
_LOW = "lower(coalesce(response, ''))"

QUALITY_SQL = f"""CASE WHEN coalesce(error, '') <> '' OR {BLANK.format('response')} THEN 'fail'
 WHEN {rx(_LOW, _ANY_NO_DATA)} THEN 'no_data'
 WHEN {rx('response', FIGURE_SIGNS)} OR {rx(_LOW, LISTING_WORDS)} THEN 'success'
 WHEN {rx('response', PIPE_TABLE)} AND {rx('response', NUMBERISH)} THEN 'success'
 WHEN {rx(_LOW, REFUSAL_WORDS)} OR {rx(_LOW, HEDGE_WORDS)} THEN 'marginal'
 WHEN length(response) > 120 THEN 'success' ELSE 'marginal' END"""

LEAKS_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN {rx(_LOW, p)} THEN {q(name)} END" for name, p in LEAK_PATTERNS.items()
) + "], lambda x: x IS NOT NULL)"

# Records and enriched records on the oracle side.
RECORDS_CTE = """SELECT 'acct' || CAST(query_index % 3 AS VARCHAR) AS account, run_version, query_index, query,
 CASE WHEN query_index % 6 = 0 THEN 'checked' ELSE '' END AS remarks, category, expected_tool, error, response,
 CASE WHEN tools_csv = '' THEN [] ELSE string_split(tools_csv, ',') END AS tools,
 response_time_seconds, CAST(round(response_time_seconds * 100) AS BIGINT) AS cents, step_count
 FROM eval_records"""

ENRICHED_CTE = f"""SELECT * REPLACE (CASE WHEN step_count = 0 AND len(tools) > 0 THEN len(tools)
 ELSE step_count END AS step_count), {QUALITY_SQL} AS quality, {LEAKS_SQL} AS leaks FROM records"""


def half_up(num: str, den: str, places: int = 0) -> str:
    """Whole-number half-up rounding of num / den for DuckDB."""
    scaled = f"(CAST({num} AS HUGEINT) * {2 * 10**places} + ({den}))"
    return f"CAST({scaled} // nullif(2 * ({den}), 0) AS DOUBLE) / {float(10**places)}"
