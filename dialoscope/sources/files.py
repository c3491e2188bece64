"""Readers of the evaluation files: result JSONL, manifests, scenarios, registry, wire log.

Schemas are explicit, missing keys become NULL, blank lines are passed over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoscope import schemas

# File names and layouts (a name may also be a folder of part files).
RECORD_PATH = r"accounts/([^/]+)/runs/query_results_v(\d+)\.jsonl(?:/[^/]*)?$"
BOT_RESULT_PATH = r"results_([^/]+)\.jsonl(?:/[^/]*)?$"
MANIFEST_PATH = r"accounts/([^/]+)/runs/manifest\.json(?:/[^/]*)?$"
UNKNOWN_BOT, UNKNOWN_CASE = "unknown", "?"


def parse_iso(c: Column | str) -> Column:
    """ISO text with or without offset to TIMESTAMP; text without one is taken as session time."""
    return F.col(c).try_cast("timestamp") if isinstance(c, str) else c.try_cast("timestamp")


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """Result records below ``root``; account and version come from the path."""
    path = F.col("_metadata.file_path")
    rows = spark.read.schema(schemas.RECORDS).json(f"{root}/accounts/*/runs/query_results_v*.jsonl")
    return (rows.withColumn("account", F.regexp_extract(path, RECORD_PATH, 1))
            .withColumn("run_version", F.regexp_extract(path, RECORD_PATH, 2).cast("int"))
            .withColumn("timestamp", parse_iso("timestamp")))


def read_bot_results(spark: SparkSession, root: str) -> DataFrame:
    """Bot results below ``root``; the run id comes from the file name."""
    rows = spark.read.schema(schemas.BOT_RESULTS).json(f"{root}/results_*.jsonl")
    return (rows.withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), BOT_RESULT_PATH, 1))
            .withColumn("timestamp", parse_iso("timestamp")))


def _read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of manifests; a missing file or a corrupt one gives none."""
    try:
        raw = spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE",
                                             columnNameOfCorruptRecord="_corrupt")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], schema).withColumn("__file", F.lit(None).cast("string"))
    else:
        raw = raw.withColumn("__file", F.col("_metadata.file_path"))
    return raw.select("__file", F.inline("runs"))


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Run manifests of all accounts below ``root``."""
    runs = _read_runs(spark, f"{root}/accounts/*/runs/manifest.json", schemas.RUN_MANIFEST)
    return runs.withColumn("account", F.regexp_extract("__file", MANIFEST_PATH, 1)).drop("__file")


def read_bot_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Bot run manifest."""
    runs = _read_runs(spark, path, schemas.RUN_MANIFEST)
    return runs.select("run_id", "timestamp", "results_file", "total_cases", "passed", "failed",
                       "avg_response_time_seconds", "bots_tested")


def read_turn_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Multi-turn manifest."""
    return _read_runs(spark, path, schemas.TURN_MANIFEST).drop("__file")


def read_turn_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Turn verdict JSONL."""
    return spark.read.schema(schemas.TURN_VERDICTS).json(path).withColumn("evaluated_at", parse_iso("evaluated_at"))


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of one scenario file or of all ``*.json`` in a folder, in file and case order."""
    target = path if path.endswith(".json") else f"{path.rstrip('/')}/*.json"
    raw = spark.read.schema(schemas.SCENARIO).json(target, multiLine=True)
    cases = raw.select(F.col("_metadata.file_name").alias("file"),
                       F.coalesce("bot_name", F.lit(UNKNOWN_BOT)).alias("bot_name"), "workspace_id", "customer_id",
                       F.posexplode("test_cases").alias("pos", "t"))
    return cases.select("file", "pos", "bot_name", "workspace_id", "customer_id",
                        F.coalesce("t.id", F.lit(UNKNOWN_CASE)).alias("query_id"), "t.query",
                        F.coalesce("t.category", F.lit("")).alias("category"), "t.expected")


def _piped(line: Column) -> Column:
    return line.startswith("|")


def _is_head(line: Column) -> Column:
    return _piped(line) & line.contains("Tool") & line.contains("Family")


def _tools(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tools of the lines (``keys``, ord, line) between a table's head and its end."""
    line = F.col("line")
    body = lines.where(_piped(line) & ~_is_head(line) & ~line.rlike(r"^[|\- ]*$"))
    rows = body.select(*keys, "ord", F.transform(F.split("line", r"\|"), lambda x: F.trim(x)).alias("c")).where(F.size("c") >= 5)
    plain = lambda x: F.replace(x, F.lit("\\_"), F.lit("_"))
    named = rows.select(
        *keys, "ord", plain(F.trim(F.regexp_replace(F.get("c", F.lit(1)), "^`+|`+$", ""))).alias("name"),
        plain(F.get("c", F.lit(2))).alias("family"),
        (F.get("c", F.lit(3)).contains("✅") | F.lower(F.get("c", F.lit(3))).contains("check")).alias("enabled"),
        F.get("c", F.lit(4)).alias("description"))
    return named.where((F.length("name") > 0) & (F.length("description") > 0))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, from 1 in each file, however large it is.

    Spark reads a file in blocks; a row's place in its block and the lines of the
    blocks before it give its number, so no file passes through one task or row.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    starts = blocks.select("file", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + 1 - F.col("first")).alias("start"))
    return lines.join(starts, ["file", "block"]).select("file", (F.col("row") + F.col("start")).alias("line_no"), F.trim("value").alias("line"))


def read_registry(spark: SparkSession, path: str, by_file: bool = False) -> DataFrame:
    """Registry tables in markdown files: ord, name, family, enabled, description; a missing file gives no tools.

    A file's table starts at the line naming Tool and Family and ends at the first
    later line that is neither blank nor a table row; ord counts the lines behind
    the head.  With ``by_file`` each of several files is a registry of its own,
    named in ``file``.
    """
    try:
        lines = numbered_lines(spark, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        lines = spark.createDataFrame([], "file string, line_no bigint, line string")
    line = F.col("line")
    told = lines.where(F.length(line) > 0)
    heads = told.where(_is_head(line)).groupBy("file").agg(F.min("line_no").alias("head"))
    below = told.join(heads, "file").where(F.col("line_no") > F.col("head"))
    ends = below.where(~_piped(line)).groupBy("file").agg(F.min("line_no").alias("end"))
    table = below.join(ends, "file", "left").where(F.col("end").isNull() | (F.col("line_no") < F.col("end")))
    tools = _tools(table.select("file", (F.col("line_no") - F.col("head")).alias("ord"), "line"), ["file"])
    return tools if by_file else tools.drop("file")


def wire_endpoints(spark: SparkSession, path: str) -> DataFrame:
    """Endpoint inventory of HTTP archive files: calls and time per method, path and status."""
    entries = spark.read.schema(schemas.WIRE_LOG).json(path, multiLine=True).select(F.explode("log.entries").alias("e"))
    return endpoint_inventory(entries.select(
        F.col("e.request.method").alias("method"), F.col("e.request.url").alias("url"),
        F.col("e.response.status").alias("status"), F.col("e.time").alias("time_ms")))


def endpoint_inventory(requests: DataFrame) -> DataFrame:
    """Calls and time per method, path without host and query, and status."""
    bare = F.regexp_replace(F.substring_index(F.substring_index("url", "#", 1), "?", 1), r"^[a-zA-Z]+://[^/]*", "")
    return (requests.groupBy("method", bare.alias("path"), "status")
            .agg(F.count("*").alias("calls"), F.min("time_ms").alias("min_ms"), F.avg("time_ms").alias("avg_ms"),
                 F.max("time_ms").alias("max_ms")).orderBy(F.desc("calls"), "method", "path", "status"))
