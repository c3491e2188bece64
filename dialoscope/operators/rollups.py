"""Run analytics over result records.

``enrich`` classifies every record once.  The rollups read its columns and are
grouped by ``keys``, so one job covers any number of accounts and versions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoscope.functions.quality import QUALITIES, backfill_steps, classify_quality, leak_labels, lowered
from dialoscope.functions.text import cents, ratio_round, truthy_text
from dialoscope.operators.tools import tool_match

RUN = ("account", "run_version")


def enrich(records: DataFrame, normalize_quotes: bool = False, rubric: str = "v2") -> DataFrame:
    """Add response_quality, info_leak, leak_indicators; fill in missing step counts."""
    lower = records.withColumn("__low", lowered("response", normalize_quotes))
    return lower.withColumns({
        "step_count": F.coalesce(backfill_steps("step_count", "status_sequence"), F.lit(0)),
        "response_quality": classify_quality("response", "error", rubric, normalize_quotes=normalize_quotes, low="__low"),
        "leak_indicators": leak_labels("response", normalize_quotes=normalize_quotes, low="__low"),
    }).withColumn("info_leak", F.size("leak_indicators") > 0).drop("__low")


def _quality_counts() -> list[Column]:
    return [F.count_if(F.col("response_quality") == q).alias(q) for q in QUALITIES]


def _time() -> Column:
    return cents("response_time_seconds")


def _seconds(total: Column) -> Column:
    return total.cast("double") / 100.0


def run_stats(enriched: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Record count, the four quality counts and the number of leaking records."""
    return enriched.groupBy(*keys).agg(F.count("*").alias("total"), *_quality_counts(),
                                       F.count_if("info_leak").alias("leak"))


def leak_types(enriched: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Records per leak label, most frequent first."""
    return (enriched.select(*keys, F.explode("leak_indicators").alias("leak_type"))
            .groupBy(*keys, "leak_type").agg(F.count("*").alias("n"))
            .orderBy(*keys, F.desc("n"), "leak_type"))


def quality_shares(enriched: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Quality counts as whole percentages of the total."""
    stats = run_stats(enriched, keys)
    return stats.select(*keys, "total", *[ratio_round(100 * F.col(q), F.col("total")).alias(f"{q}_pct")
                                          for q in QUALITIES])


def tool_coverage(records: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Records without tool calls, distinct tools used, and whether any tool is visible at all."""
    flat = records.select(*keys, F.explode_outer("tool_calls").alias("call"))
    return flat.groupBy(*keys).agg(
        F.count_if(F.col("call").isNull()).alias("no_tool"),
        F.count_distinct(F.when(F.col("call").isNotNull(), F.coalesce("call.tool", F.lit("?")))).alias("tools_used"),
        (F.count("call") > 0).alias("tools_visible"))


def run_time(records: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Average seconds over all records, and total minutes with one second of pause per query."""
    summed = records.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(_time()).alias("c"))
    return summed.select(*keys, "n", _seconds(F.col("c")).alias("total_seconds"),
                         ratio_round(F.col("c"), F.col("n") * 100, 2).alias("avg_seconds"),
                         ratio_round(F.col("c") + F.col("n") * 100, F.lit(6000), 1).alias("total_minutes"))


def category_quality(enriched: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Quality counts, average seconds and record count per category."""
    summed = enriched.groupBy(*keys, "category").agg(*_quality_counts(), F.count("*").alias("n"),
                                                     F.sum(_time()).alias("c"))
    return summed.select(*keys, "category", *QUALITIES,
                         ratio_round(F.col("c"), F.col("n") * 100, 1).alias("avg"), "n")


def category_time(records: DataFrame, keys: Sequence[str] = RUN, status: bool = False) -> DataFrame:
    """Response-time statistics per category; with ``status`` also API successes and failures."""
    extra = [F.count_if(~truthy_text("error")).alias("ok"),
             F.count_if(truthy_text("error")).alias("failed")] if status else []
    summed = records.groupBy(*keys, "category").agg(
        F.count("*").alias("n"), F.sum(_time()).alias("c"), F.min(_time()).alias("lo"),
        F.max(_time()).alias("hi"), *extra)
    return summed.select(*keys, "category", ratio_round(F.col("c"), F.col("n") * 100, 1).alias("avg"),
                         _seconds(F.col("lo")).alias("min"), _seconds(F.col("hi")).alias("max"), "n",
                         _seconds(F.col("c")).alias("total"), *(["ok", "failed"] if status else []))


def tool_counts(records: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Calls per tool, most frequent first; a call without a name counts as ``?``."""
    return (records.select(*keys, F.explode("tool_calls").alias("call"))
            .groupBy(*keys, F.coalesce("call.tool", F.lit("?")).alias("tool")).agg(F.count("*").alias("n"))
            .orderBy(*keys, F.desc("n"), "tool"))


def tool_accuracy(records: DataFrame, keys: Sequence[str] = RUN, ordered: bool = False) -> DataFrame:
    """Share of records with an expectation whose expected tools were called; 0 when none has one."""
    judged = tool_match(records, ordered)
    summed = judged.groupBy(*keys).agg(F.count_if("tool_matched").alias("correct"),
                                       F.count("tool_matched").alias("total_with_expected"),
                                       (F.sum(F.coalesce(F.size("tool_calls"), F.lit(0))) > 0).alias("tools_visible"))
    pct = ratio_round(F.col("correct") * 100, F.col("total_with_expected"), 1)
    return summed.withColumn("pct", F.coalesce(pct, F.lit(0.0)))


def category_tool_accuracy(records: DataFrame, keys: Sequence[str] = RUN, ordered: bool = False) -> DataFrame:
    """Tool accuracy per category; NULL where nothing is expected."""
    return (tool_match(records, ordered).groupBy(*keys, "category")
            .agg(F.count("tool_matched").alias("total"), F.count_if("tool_matched").alias("correct"))
            .withColumn("pct", ratio_round(F.col("correct") * 100, F.col("total"), 1)))


def step_stats(enriched: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Step statistics with the upper median, the element at n // 2 of the sorted counts."""
    summed = enriched.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("step_count").alias("s"), F.min("step_count").alias("min"),
        F.max("step_count").alias("max"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY step_count DESC)").cast("int").alias("median"))
    return summed.select(*keys, ratio_round(F.col("s"), F.col("n"), 1).alias("avg"), "min", "max", "median")


def category_steps(enriched: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Step statistics per category."""
    summed = enriched.groupBy(*keys, "category").agg(
        F.count("*").alias("n"), F.sum("step_count").alias("s"), F.min("step_count").alias("min"),
        F.max("step_count").alias("max"))
    return summed.select(*keys, "category", ratio_round(F.col("s"), F.col("n"), 1).alias("avg"), "min", "max", "n")


def manifest_row(records: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Manifest figures of each run; the average is over successful records, 0 without any."""
    failed = truthy_text("error")
    summed = records.groupBy(*keys).agg(
        F.count("*").alias("total_queries"), F.count_if(~failed).alias("success"),
        F.count_if(failed).alias("failed"), F.sum(F.when(~failed, _time())).alias("c"))
    avg = ratio_round(F.col("c"), F.col("success") * 100, 2)
    return (summed.withColumn("avg_response_time_seconds", F.coalesce(avg, F.lit(0.0)).cast("decimal(12,2)"))
            .drop("c"))


def most_common(df: DataFrame, column: str, n: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Values by frequency, ties by name; the ``n`` most frequent overall when given."""
    counted = (df.groupBy(*keys, column).agg(F.count("*").alias("n"))
               .orderBy(*keys, F.desc("n"), column))
    return counted if n is None else counted.limit(n)


def category_rank(records: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Categories by average time, slowest first, with the average relative to the slowest."""
    averages = (records.groupBy(*keys, "category").agg(F.count("*").alias("n"), F.sum(_time()).alias("c"))
                .withColumn("avg", ratio_round(F.col("c"), F.col("n") * 100, 1)))
    top = averages.groupBy(*keys).agg(F.max("avg").alias("top"))
    bar = F.when(F.col("top") > 0, F.col("avg") / F.col("top"))
    return (averages.join(top, list(keys)).select(*keys, "category", "avg", bar.alias("bar"))
            .orderBy(*keys, F.desc("avg"), "category"))


def overview(enriched: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Run and category figures in one pass: a grouping-set row per run (category NULL) and per category."""
    sets = [list(keys), [*keys, "category"]]
    columns = [F.col(k) for k in (*keys, "category")]
    return enriched.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        F.grouping("category").alias("is_total"), F.count("*").alias("n"), *_quality_counts(),
        F.count_if("info_leak").alias("leak"), F.sum(_time()).alias("total_cents"),
        F.sum("step_count").alias("steps"))
