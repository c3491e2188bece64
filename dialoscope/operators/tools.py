"""Tool calls: expectation match, registry checks, usage over versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoscope.functions.text import split_expected, truthy_text


def called_tools(calls: str = "tool_calls", name: str = "tool"):
    """Names of the called tools, in call order; NULL calls give an empty array."""
    return F.coalesce(F.transform(F.col(calls), lambda c: F.coalesce(c[name], F.lit(""))),
                      F.array().cast("array<string>"))


def tool_match(records: DataFrame, ordered: bool = False) -> DataFrame:
    """Add ``tool_matched``: were all expected tools called?  NULL without an expectation.

    A single name is compared as it stands; an arrow list is split and trimmed.
    With ``ordered`` the list must occur in that order among the calls.
    """
    actual = called_tools()
    expected = F.when(F.col("expected_tool").contains("→"), split_expected("expected_tool")
                      ).otherwise(F.array("expected_tool"))
    if ordered:
        found = F.aggregate(actual, F.lit(0),
                            lambda i, t: F.when(F.get(expected, i) == t, i + 1).otherwise(i))
        hit = found == F.size(expected)
    else:
        hit = F.size(F.array_except(expected, actual)) == 0
    return records.withColumn("tool_matched", F.when(truthy_text("expected_tool"), hit))


def explode_calls(records: DataFrame, keys: Sequence[str], calls: str = "tool_calls",
                  name: str = "tool") -> DataFrame:
    """One row per call: ``keys`` and ``tool``."""
    return (records.select(*keys, F.explode(calls).alias("call"))
            .select(*keys, F.coalesce(F.col("call")[name], F.lit("?")).alias("tool")))


def phantom_tools(calls: DataFrame, registry: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Called tools missing from the registry, with their call counts, per ``keys`` and tool.

    Calls are counted before the join, so a popular tool is one row in it.
    """
    counted = calls.groupBy(*keys, "tool").agg(F.count("*").alias("calls"))
    known = registry.select(F.col("name").alias("tool"))
    return counted.join(known, "tool", "left_anti")


def split_phantoms(traces: DataFrame, registry: DataFrame) -> DataFrame:
    """Flag traces whose selected tool is unknown; they score 0 and need no judge."""
    known = registry.select(F.col("name").alias("selected_tool"), F.lit(True).alias("__known")).distinct()
    joined = traces.join(known, "selected_tool", "left")
    unknown = F.col("__known").isNull() & (F.col("selected_tool") != "none")
    return (joined.withColumn("is_phantom", unknown)
            .withColumn("auto_score", F.when(unknown, F.lit(0.0))).drop("__known"))


def unused_tools(registry: DataFrame, calls: DataFrame) -> DataFrame:
    """Registered tools that were never called."""
    used = calls.select(F.col("tool").alias("name")).distinct()
    return registry.join(used, "name", "left_anti")


def _deletions(name: str, distance: int):
    """All texts left after deleting up to ``distance`` characters."""
    texts = F.array(F.col(name))
    for _ in range(distance):
        shorter = F.flatten(F.transform(texts, lambda t: F.when(F.length(t) > 0, F.transform(
            F.sequence(F.lit(1), F.length(t)),
            lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))))
            .otherwise(F.array().cast("array<string>"))))
        texts = F.array_distinct(F.concat(texts, shorter))
    return texts


def near_tools(calls: DataFrame, registry: DataFrame, distance: int = 2) -> DataFrame:
    """Registry names within an edit distance of each called but unregistered name.

    Two texts within distance d share a text that both reach by at most d
    deletions.  Joining on those makes this an equi-join instead of comparing
    every pair; ``levenshtein`` then decides.
    """
    unknown = phantom_tools(calls, registry).select(F.col("tool").alias("called"))
    left = unknown.select("called", F.explode(_deletions("called", distance)).alias("stem"))
    right = registry.select(F.col("name").alias("registered"), F.explode(_deletions("name", distance)).alias("stem"))
    pairs = left.join(right, "stem").select("called", "registered").distinct()
    apart = F.levenshtein("called", "registered")
    return pairs.select("called", "registered", apart.alias("distance")).where(F.col("distance") <= distance)


def tool_usage_matrix(calls: DataFrame, versions: Sequence[int]) -> DataFrame:
    """Calls per tool and version as columns ``v<N>``, with the total, first version and new-tool flag."""
    per_version = [F.count_if(F.col("run_version") == v).alias(f"v{v}") for v in versions]
    return (calls.where(F.col("run_version").isin(list(versions))).groupBy("tool")
            .agg(*per_version, F.count("*").alias("total"), F.min("run_version").alias("first_version"))
            .withColumn("is_new", F.col("first_version") == max(versions)))


def tools_in_all(calls: DataFrame, versions: Sequence[int]) -> DataFrame:
    """Tools called in every one of the versions."""
    used = [calls.where(F.col("run_version") == v).select("tool").distinct() for v in versions]
    result = used[0]
    for other in used[1:]:
        result = result.intersect(other)
    return result


def tools_dropped(calls: DataFrame, before: int, after: int) -> DataFrame:
    """Tools called in version ``before`` and not in ``after``."""
    old = calls.where(F.col("run_version") == before).select("tool").distinct()
    new = calls.where(F.col("run_version") == after).select("tool").distinct()
    return old.exceptAll(new)
