"""Query suites: normalisation, profile, resume, and joining with captured results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoscope.functions.ordered import DEFAULT_BLOCK, block_of, running
from dialoscope.functions.text import truthy_text, utrim

DEFAULT_CATEGORY = "General"
SHEET_A = "Chat Queries"
SHEET_B = "Sheet1"

_SUITE = ("query_index", "query", "copilot_response", "remarks", "category", "expected_tool")


def _cell(name: str):
    """Trimmed cell, empty text for a missing one."""
    return F.when(truthy_text(name), utrim(name)).otherwise("")


def _normalize(rows: DataFrame, layout_a: Column, keys: Sequence[str], block: int) -> DataFrame:
    """Sheet rows of either layout to suite rows: one projection, then headings and numbers in one running step."""
    header = layout_a & F.coalesce(F.col("is_bold"), F.lit(False)) & truthy_text("c1") if "is_bold" in rows.columns else F.lit(False)
    query = F.when(layout_a, F.when(~header & truthy_text("c1"), utrim("c1"))).when(truthy_text("c3"), utrim("c3"))
    tool = utrim("c4")
    cut = rows.where(F.col("row_idx") >= 2).select(
        *keys, "row_idx", F.when(header, utrim("c1")).alias("title"), query.alias("query"),
        F.when(layout_a, _cell("c2")).otherwise("").alias("copilot_response"),
        F.when(layout_a, _cell("c3")).otherwise("").alias("remarks"),
        F.when(~layout_a & truthy_text("c2"), utrim("c2")).alias("own"),
        F.when(F.length(tool) > 0, tool).alias("expected_tool"))
    numbered = running(cut, keys, "row_idx", {"heading": F.col("title")}, {"query_index": F.col("query").isNotNull()}, block)
    named = numbered.withColumn("category", F.coalesce("own", "heading", F.lit(DEFAULT_CATEGORY)))
    return named.where(F.col("query").isNotNull()).select(*keys, *_SUITE)


def normalize_suite_a(rows: DataFrame, keys: Sequence[str] = (), block: int = DEFAULT_BLOCK) -> DataFrame:
    """Sheet rows (row_idx, c1..c4, is_bold): a bold first cell names the category of the rows below it.

    ``keys`` identify the sheet when several are held in one frame.
    """
    return _normalize(rows, F.lit(True), keys, block)


def normalize_suite_b(rows: DataFrame, keys: Sequence[str] = (), block: int = DEFAULT_BLOCK) -> DataFrame:
    """Sheet rows with the category in c2, the query in c3 and the expected tools in c4."""
    return _normalize(rows, F.lit(False), keys, block)


def pick_sheets(rows: DataFrame, file_key: str = "file", sheet: str = "sheet", block: int = DEFAULT_BLOCK) -> DataFrame:
    """The rows of the sheet that each workbook is read from, with ``__layout_a``.

    The choice is one row per workbook; it is joined by blocks of rows, so that a
    workbook of any size is spread over tasks.
    """
    facts = rows.groupBy(F.col(file_key).alias("__file")).agg(
        F.bool_or(F.col(sheet) == SHEET_A).alias("has_a"), F.bool_or(F.col(sheet) == SHEET_B).alias("has_b"),
        F.min_by(sheet, "sheet_no").alias("first"))
    chosen = facts.select("__file",
                          F.when(F.col("has_a"), SHEET_A).when(F.col("has_b"), SHEET_B)
                          .otherwise(F.col("first")).alias("__sheet"),
                          (F.col("has_a") | ~F.col("has_b")).alias("__layout_a"))
    parts = rows.select(F.col(file_key).alias("__f"), F.col(sheet).alias("__s"), block_of("row_idx", block).alias("__part")).distinct()
    parts = parts.join(chosen, (F.col("__f") == F.col("__file")) & (F.col("__s") == F.col("__sheet"))).drop("__file", "__sheet")
    return (rows.join(parts, (rows[file_key] == F.col("__f")) & (rows[sheet] == F.col("__s")) & (block_of(rows["row_idx"], block) == F.col("__part")))
            .drop("__f", "__s", "__part"))


def normalize_suite(rows: DataFrame, file_key: str = "file", sheet: str = "sheet",
                    block: int = DEFAULT_BLOCK) -> DataFrame:
    """Pick the layout per workbook from its sheet names.

    A sheet called "Chat Queries" means layout A, else "Sheet1" layout B, else
    the first sheet (lowest ``sheet_no``) read as layout A.
    """
    return _normalize(pick_sheets(rows, file_key, sheet, block), F.col("__layout_a"), [file_key], block)


def suite_profile(suite: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Queries and queries with an expected tool, per category, by name."""
    return (suite.groupBy(*keys, "category")
            .agg(F.count("*").alias("n"), F.count("expected_tool").alias("with_expected_tool"))
            .orderBy(*keys, "category"))


def remaining(suite: DataFrame, partial: DataFrame, on: Sequence[str] = ("query_index",),
              retry_errors: bool = False) -> DataFrame:
    """Suite rows not yet in a partial run; optionally those that ended in an error as well."""
    done = partial.where(~truthy_text("error")) if retry_errors else partial
    return suite.join(done.select(*on), list(on), "left_anti")


def build_records(suite: DataFrame, captured: DataFrame, run_version: int,
                  on: Sequence[str] = ("query_index",), missing_error: str = "no captured result") -> DataFrame:
    """Suite rows with their captured result; a missing result gives a failed record."""
    results = captured.select(*on, "thread_id", "tool_calls", "response", "status_sequence", "suggestions",
                              "response_time_seconds", "step_count", "error", F.lit(True).alias("__found"))
    joined = suite.join(results, list(on), "left")
    calls_type = captured.schema["tool_calls"].dataType.simpleString()
    no_text = F.array().cast("array<string>")
    return joined.select(
        *on, *[c for c in _SUITE if c not in on], "thread_id",
        F.coalesce("tool_calls", F.array().cast(calls_type)).alias("tool_calls"),
        F.coalesce("response", F.lit("")).alias("response"),
        F.coalesce("status_sequence", no_text).alias("status_sequence"),
        F.coalesce("suggestions", no_text).alias("suggestions"),
        F.coalesce(F.col("response_time_seconds").cast("decimal(12,2)"),
                   F.lit(0).cast("decimal(12,2)")).alias("response_time_seconds"),
        F.coalesce("step_count", F.lit(0)).alias("step_count"),
        F.when(F.col("__found"), F.col("error")).otherwise(missing_error).alias("error"),
        F.lit(run_version).alias("run_version"))


