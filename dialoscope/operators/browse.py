"""Selecting, filtering, sorting and paging of results and runs."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Columns a result list can be sorted by (fixed values).
SORT_COLUMNS = ("query_id", "bot_name", "category", "query", "response_type", "passed", "response_quality",
                "response_time_seconds")


def select_version(records: DataFrame, manifest: DataFrame, version: int | None = None) -> DataFrame:
    """Records of the given version, or of each account's latest version in the manifest.

    An unknown version fails the query when it runs, naming how many exist and in what range.
    """
    if version is not None:
        text = [F.lit(f"version {version} not found; available: "), F.count_distinct("version").cast("string"), F.lit(" from "),
                F.coalesce(F.min("version").cast("string"), F.lit("-")), F.lit(" to "),
                F.coalesce(F.max("version").cast("string"), F.lit("-"))]
        found = manifest.agg(F.when(F.count_if(F.col("version") == version) > 0, F.lit(version)).otherwise(
            F.raise_error(F.concat(*text)).cast("int")).alias("v"))
        return records.where(F.col("run_version") == found.scalar())
    top = manifest.groupBy("account").agg(F.max("version").alias("run_version"))
    return records.join(top, ["account", "run_version"], "left_semi")


def latest_run(manifest: DataFrame, run_id: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Id of the newest run by timestamp (ties by id), or the requested one."""
    if run_id is not None:
        return manifest.where(F.col("run_id") == run_id).select(*keys, "run_id").distinct()
    return manifest.groupBy(*keys).agg(F.max_by("run_id", F.struct("timestamp", "run_id")).alias("run_id"))


def next_version(manifest: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Highest version plus one; 1 when there is none."""
    return manifest.groupBy(*keys).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def next_version_of_files(files: DataFrame, prefix: str, keys: Sequence[str] = ()) -> DataFrame:
    """As ``next_version`` over file names; names without a number are passed over."""
    pattern = "^" + re.escape(prefix) + r"_v(\d+)\.jsonl$"
    v = F.col("file").try_cast("string")
    number = F.nullif(F.regexp_extract(v, pattern, 1), F.lit("")).try_cast("int")
    return next_version(files.withColumn("version", number), keys)


def parse_since(expression: str, now: datetime | None = None) -> datetime:
    """ISO date or datetime (UTC), or ``Nd`` / ``Nh`` before now."""
    relative = re.fullmatch(r"(\d+)([dh])", expression)
    if relative:
        amount, unit = int(relative[1]), relative[2]
        base = now or datetime.now(timezone.utc)
        return base - (timedelta(days=amount) if unit == "d" else timedelta(hours=amount))
    for layout in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d"):
        try:
            return datetime.strptime(expression, layout).replace(tzinfo=timezone.utc)
        except ValueError:
            continue
    raise ValueError(f"unrecognised since expression {expression!r}")


def since_filter(df: DataFrame, expression: str, column: str = "start_time",
                 now: datetime | None = None) -> DataFrame:
    """Rows at or after the moment; rows without a time fall out.  The literal reaches the scan."""
    moment = parse_since(expression, now).astimezone(timezone.utc).replace(tzinfo=None)
    literal = F.lit(moment.isoformat(sep=" ")).cast(df.schema[column].dataType)
    return df.where(F.col(column) >= literal)


def list_runs(runs: DataFrame, project: str | None = None, run_type: str | None = None,
              since: str | None = None, limit: int | None = None, offset: int = 0,
              now: datetime | None = None) -> DataFrame:
    """Traced runs, newest first, with optional project, type, since, limit and offset."""
    out = runs
    if project is not None:
        out = out.where(F.col("project") == project)
    if run_type is not None:
        out = out.where(F.col("run_type") == run_type)
    if since is not None:
        out = since_filter(out, since, now=now)
    out = out.orderBy(F.col("start_time").desc_nulls_last(), F.col("run_id"))
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def leaks_only(enriched: DataFrame) -> DataFrame:
    return enriched.where("info_leak")


def no_tool(records: DataFrame) -> DataFrame:
    """Records without tool calls."""
    return records.where(F.coalesce(F.size("tool_calls"), F.lit(0)) == 0)


def browse(results: DataFrame, q: str = "", status: str = "all", quality: str = "all", category: str = "all",
           bot: str = "all", text: str = "response_text", ident: str = "query_id") -> DataFrame:
    """Result list filter; all given conditions must hold."""
    keep: Column = F.lit(True)
    if q:
        needle = q.lower()
        fields = [F.coalesce(F.lower(F.col(c).cast("string")), F.lit("")) for c in ("query", text, ident)]
        hit = fields[0].contains(needle)
        for field in fields[1:]:
            hit = hit | field.contains(needle)
        keep = keep & hit
    if status != "all":
        passed = F.coalesce(F.col("passed"), F.lit(False))
        keep = keep & (passed if status == "pass" else ~passed if status == "fail" else F.lit(False))
    for value, name in ((quality, "response_quality"), (category, "category"), (bot, "bot_name")):
        if value != "all":
            keep = keep & (F.col(name) == value)
    return results.where(keep)


def sort_results(results: DataFrame, key: str, asc: bool = True) -> DataFrame:
    """Order by one of the sortable columns: text without case, NULL as empty text."""
    if key not in SORT_COLUMNS:
        raise ValueError(f"cannot sort by {key!r}; one of {SORT_COLUMNS}")
    kind = results.schema[key].dataType.typeName()
    order = F.lower(F.coalesce(F.col(key), F.lit(""))) if kind == "string" else F.col(key)
    return results.orderBy(order.asc_nulls_first() if asc else order.desc_nulls_last())


