"""Comparison of runs across versions and accounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoscope.functions.quality import QUALITIES
from dialoscope.functions.text import cents, ratio_round, truthy_text
from dialoscope.operators.rollups import manifest_row
from dialoscope.operators.tools import called_tools

CHURN_TRUST_PCT = 30  # fixed value: above this share of changed qualities a comparison is not trusted


def version_summary(manifest: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Manifest figures with total minutes and the run date in words; categories counted from records."""
    c = cents("avg_response_time_seconds")
    minutes = ratio_round(F.col("total_queries") * (c + 100), F.lit(6000), 1)
    out = manifest.select("account", F.col("version"), "total_queries", "success", "failed",
                          F.col("avg_response_time_seconds").cast("double").alias("avg_response_time_seconds"),
                          minutes.alias("total_minutes"),
                          F.date_format(F.to_timestamp("timestamp"), "MMMM dd, yyyy").alias("run_date"))
    if records is not None:
        n = records.groupBy("account", F.col("run_version").alias("version")).agg(
            F.count_distinct("category").alias("categories"))
        out = out.join(n, ["account", "version"], "left")
    return out


def version_trend(manifest: DataFrame) -> DataFrame:
    """Change of each run against the account's previous one, in failures and in average time."""
    w = Window.partitionBy("account").orderBy("version")
    now = cents("avg_response_time_seconds")
    base = manifest.select("account", "version", "failed", now.alias("c"),
                           F.lag("failed").over(w).alias("prev_failed"), F.lag(now).over(w).alias("prev_c"))
    first = F.col("prev_failed").isNull()
    f, pf, c, pc = (F.col(x) for x in ("failed", "prev_failed", "c", "prev_c"))
    failures = (F.when(first, "first").when((f == 0) & (pf > 0), "all_clear").when(f < pf, "reduced")
                .when(f > pf, "increased").otherwise("same"))
    latency = (F.when(first, "first").when(pc == 0, F.lit(None)).when(c < pc, "improved")
               .when((c - pc) * 100 > 5 * pc, "slower").otherwise("within_noise"))
    pct = F.when(pc > 0, (c - pc).cast("double") * 100.0 / pc)
    return base.select("account", "version", "failed", "prev_failed", failures.alias("failure_change"),
                       latency.alias("latency_change"), pct.alias("latency_pct"))


def version_diff(enriched: DataFrame, a: int, b: int, on: Sequence[str] = ("account", "query_index")) -> DataFrame:
    """One row per query of either version with what changed between them."""
    def side(v: int, tag: str) -> DataFrame:
        return enriched.where(F.col("run_version") == v).select(
            *on, F.col("response_quality").alias(f"quality_{tag}"),
            F.array_sort(F.array_distinct(called_tools())).alias(f"tools_{tag}"),
            truthy_text("error").alias(f"failed_{tag}"), cents("response_time_seconds").alias(f"c_{tag}"))

    def differs(name: str) -> Column:
        return ~F.col(f"{name}_a").eqNullSafe(F.col(f"{name}_b"))

    both = side(a, "a").join(side(b, "b"), list(on), "full_outer")
    return both.select(*on, "quality_a", "quality_b", differs("quality").alias("quality_changed"),
                       differs("tools").alias("tools_changed"), differs("failed").alias("error_changed"),
                       ((F.col("c_b") - F.col("c_a")).cast("double") / 100.0).alias("seconds_delta"))


def version_churn(enriched: DataFrame, a: int, b: int, on: Sequence[str] = ("account", "query_index")) -> DataFrame:
    """How many queries changed in quality, tools and outcome, and whether the quality churn is trustworthy."""
    diff = version_diff(enriched, a, b, on)
    summed = diff.agg(F.count("*").alias("compared"), F.count_if("quality_changed").alias("quality_changed"),
                      F.count_if("tools_changed").alias("tools_changed"),
                      F.count_if("error_changed").alias("error_changed"))
    churn = ratio_round(F.col("quality_changed") * 100, F.col("compared"), 1)
    return summed.withColumn("churn_pct", churn).withColumn("trusted", churn <= CHURN_TRUST_PCT)


def remark_crosstab(enriched: DataFrame, keys: Sequence[str] = ("category",)) -> DataFrame:
    """Computed quality against the presence of a human remark."""
    remarked = F.when(truthy_text("remarks"), "with_remark").otherwise("without_remark")
    return (enriched.withColumn("__r", remarked).groupBy(*keys, "response_quality")
            .pivot("__r", ["with_remark", "without_remark"]).count()
            .na.fill(0, ["with_remark", "without_remark"]))


def latest_records(records: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Records of each account's highest version."""
    src = records.select("account", F.col("run_version").alias("v")) if manifest is None else \
        manifest.select("account", F.col("version").alias("v"))
    top = src.groupBy("account").agg(F.max("v").alias("run_version"))
    return records.join(top, ["account", "run_version"], "left_semi")


def account_comparison(enriched: DataFrame) -> DataFrame:
    """Latest run of every account side by side, with a grand-total row."""
    newest = latest_records(enriched)
    summed = newest.rollup("account").agg(
        F.grouping("account").alias("g"), F.count("*").alias("total"),
        *[F.count_if(F.col("response_quality") == q).alias(q) for q in QUALITIES],
        F.count_if("info_leak").alias("leak"), F.sum(cents("response_time_seconds")).alias("c"),
        F.sum("step_count").alias("s"))
    return summed.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("account")).alias("account"), "total",
                         *QUALITIES, "leak", ratio_round(F.col("c"), F.col("total") * 100, 2).alias("avg_seconds"),
                         ratio_round(F.col("s"), F.col("total"), 1).alias("avg_steps"))


def slow_categories(records: DataFrame, factor: float = 2.0,
                    keys: Sequence[str] = ("account", "run_version")) -> DataFrame:
    """Categories whose average time is at least ``factor`` times that of all the others together."""
    own = records.groupBy(*keys, "category").agg(F.count("*").alias("n"),
                                                 F.sum(cents("response_time_seconds")).alias("c"))
    whole = own.groupBy(*keys).agg(F.sum("n").alias("all_n"), F.sum("c").alias("all_c"))
    other_n, other_c = F.col("all_n") - F.col("n"), F.col("all_c") - F.col("c")
    ratio = F.when((other_n > 0) & (other_c > 0),
                   (F.col("c") * other_n).cast("double") / (F.col("n") * other_c).cast("double"))
    return (own.join(whole, list(keys)).select(*keys, "category", "n", ratio.alias("times_others"))
            .where(F.col("times_others") >= factor))


def reconcile(records: DataFrame, manifest: DataFrame,
              required: Sequence[str] = ("query_index", "query", "category", "response",
                                         "response_time_seconds")) -> DataFrame:
    """Problem rows: recounted figures against the manifest, gaps in numbering, missing fields."""
    counted = manifest_row(records).withColumnRenamed("run_version", "version")
    health = records.groupBy("account", F.col("run_version").alias("version")).agg(
        F.min("query_index").alias("lo"), F.max("query_index").alias("hi"),
        F.count_distinct("query_index").alias("d"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required])
    stated = manifest.select("account", "version", *[F.col(c).cast("double").alias(f"m_{c}") for c in
                             ("total_queries", "success", "failed", "avg_response_time_seconds")])
    both = counted.join(health, ["account", "version"]).join(stated, ["account", "version"], "full_outer")

    def problem(when: Column, name: str, found: Column, expected: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("problem"), found.cast("double").alias("found"),
                                     expected.cast("double").alias("expected")))

    checks = [problem(F.col("total_queries").isNull(), "no records", F.lit(0), F.col("m_total_queries")),
              problem(F.col("m_total_queries").isNull(), "not in manifest", F.col("total_queries"), F.lit(0))]
    for c in ("total_queries", "success", "failed", "avg_response_time_seconds"):
        checks.append(problem(F.col(c).cast("double") != F.col(f"m_{c}"), f"{c} differs",
                              F.col(c), F.col(f"m_{c}")))
    checks.append(problem((F.col("lo") != 1) | (F.col("hi") != F.col("d")) | (F.col("d") != F.col("total_queries")),
                          "query_index not 1..n", F.col("hi"), F.col("total_queries")))
    for c in required:
        checks.append(problem(F.col(f"null_{c}") > 0, f"{c} missing", F.col(f"null_{c}"), F.lit(0)))
    return (both.select("account", "version", F.explode(F.array_compact(F.array(*checks))).alias("p"))
            .select("account", "version", "p.problem", "p.found", "p.expected"))


def union_runs(*frames: DataFrame) -> DataFrame:
    """Several runs in one frame; columns absent in one become NULL."""
    result = frames[0]
    for other in frames[1:]:
        result = result.unionByName(other, allowMissingColumns=True)
    return result


