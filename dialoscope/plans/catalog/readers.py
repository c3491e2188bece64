"""Readers: files derived from the tables are written to the shared folder, read by the library and compared."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialoscope.plans.catalog import Catalog
from dialoscope.plans.catalog.runs import rec
from dialoscope.plans.fixtures import oracle, scratch, table
from dialoscope.plans.inputs import records
from dialoscope.sources import files

CATALOG = Catalog()
add = CATALOG.add


@add("read_records", rec("""SELECT account, run_version, query_index, query, category, expected_tool, response, response_time_seconds,
 step_count, error, len(tools) AS calls FROM records"""))
def read_records(spark, sf):
    """Result lines of three accounts and two versions, each in its own place."""
    base, rows = scratch(spark, "read-records"), records(spark, sf)
    for account in ("acct0", "acct1", "acct2"):
        for v in (1, 2):
            own = rows.where((F.col("account") == account) & (F.col("run_version") == v)).drop("account", "run_version")
            own.withColumn("tool_calls", F.transform("tool_calls", lambda c: F.struct(c["tool"].alias("tool")))) \
                .withColumn("response_time_seconds", F.col("response_time_seconds").cast("double")) \
                .write.json(f"{base}/accounts/{account}/runs/query_results_v{v}.jsonl")
    return files.read_records(spark, base).select(
        "account", "run_version", "query_index", "query", "category", "expected_tool", "response", "response_time_seconds", "step_count",
        "error", F.size("tool_calls").alias("calls"))


@add("read_manifest", rec("""SELECT account, run_version AS version, count(*) AS total_queries, count(*) FILTER (error IS NULL) AS success
 FROM records GROUP BY 1, 2"""))
def read_manifest(spark, sf):
    """One manifest an account; a fourth account's is cut off in the middle, a fifth has none."""
    base = scratch(spark, "read-manifest")
    runs = records(spark, sf).groupBy("account", F.col("run_version").alias("version")).agg(
        F.count("*").alias("total_queries"), F.count_if(F.col("error").isNull()).alias("success"))
    texts = runs.groupBy("account").agg(F.to_json(F.struct(F.collect_list(F.struct("version", "total_queries", "success")).alias("runs"))).alias("value"))
    for account in ("acct0", "acct1", "acct2"):
        texts.where(F.col("account") == account).select("value").coalesce(1).write.text(f"{base}/accounts/{account}/runs/manifest.json")
    texts.limit(1).select(F.expr("substr(value, 1, 12)").alias("value")).write.text(f"{base}/accounts/torn/runs/manifest.json")
    found = files.read_manifest(spark, base)
    missing = files.read_bot_manifest(spark, f"{base}/accounts/none/manifest.json").select(
        F.lit("none").alias("account"), F.lit(0).alias("version"), F.col("total_cases").alias("total_queries"), F.col("passed").alias("success"))
    return found.select("account", "version", "total_queries", "success").unionByName(missing)


@add("read_scenarios", oracle([], """SELECT 'bot' || CAST(conv_id % 3 AS VARCHAR) AS bot_name, conv_id || '-' || turn AS query_id, text AS query,
 CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS category FROM conversations"""))
def read_scenarios(spark, sf):
    """Scenario files of a hundred conversations of a bot each."""
    base = scratch(spark, "read-scenarios")
    case = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("query"),
                    F.when(F.col("turn") % 2 == 0, F.col("role")).alias("category"))
    rows = table(spark, sf, "conversations").select(
        F.concat(F.lit("bot"), (F.col("conv_id") % 3).cast("string")).alias("bot_name"), F.floor(F.col("conv_id") / 100).alias("k"), case.alias("c"))
    text = rows.groupBy("bot_name", "k").agg(F.collect_list("c").alias("test_cases")).select(F.to_json(F.struct("bot_name", "test_cases")).alias("value"))
    text.write.option("maxRecordsPerFile", 1).text(f"{base}/cases.json")
    return files.read_scenarios(spark, f"{base}/cases.json").select("bot_name", "query_id", "query", "category")


@add("read_registry", oracle([], """SELECT p_partkey // 50 AS registry, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) AS place,
 'tool_' || p_partkey AS name, 'family_' || p_brand AS family, p_partkey % 3 <> 0 AS enabled, p_name || ' of size ' || p_size AS description
 FROM part WHERE p_partkey % 50 < 45"""))
def read_registry(spark, sf):
    """Fifty parts make a registry file; the last five lines stand behind the end of its table."""
    base = scratch(spark, "read-registry")
    k, place = F.floor(F.col("p_partkey") / 50), F.col("p_partkey") % 50
    tick = F.when(F.col("p_partkey") % 3 != 0, "✅").otherwise("❌")
    line = F.concat(F.lit("| `tool\\_"), "p_partkey", F.lit("` | family\\_"), "p_brand", F.lit(" | "), tick, F.lit(" | "), "p_name", F.lit(" of size "), "p_size", F.lit(" |"))
    line = F.concat(F.when((place == 45), F.lit("\n\nThat was all.\n")).when(place % 20 == 7, F.lit("\n")).otherwise(F.lit("")), line)
    rows = table(spark, sf, "part").select(k.alias("k"), place.alias("place"), line.alias("l"))
    bodies = rows.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "l"))), lambda x: x["l"]), "\n").alias("body"))
    head = F.concat(F.repeat(F.lit("# Tools\n"), (F.col("k") % 3).cast("int")), F.lit("\n| Tool | Family | Enabled | Description |\n| --- | --- | --- | --- |\n"))
    bodies.select("k", F.concat(head, "body").alias("value")).write.partitionBy("k").text(base)
    found = files.read_registry(spark, f"{base}/k=*", by_file=True)
    place = F.row_number().over(Window.partitionBy("file").orderBy("ord"))
    return found.select(F.regexp_extract("file", r"/k=(\d+)/", 1).cast("bigint").alias("registry"), place.alias("place"), "name", "family", "enabled", "description")


@add("read_wire_log", oracle([], """SELECT 'GET' AS method, regexp_replace(split_part(split_part(url, '#', 1), '?', 1),
 '^[a-zA-Z]+://[^/]*', '') AS path, 200 AS status, count(*) AS calls, min(length(html)) AS min_ms, avg(length(html)) AS avg_ms,
 max(length(html)) AS max_ms FROM pages GROUP BY 1, 2"""))
def read_wire_log(spark, sf):
    """Page addresses as requests, a hundred in an archive file."""
    base = scratch(spark, "read-wire-log")
    entry = F.struct(F.length("html").cast("double").alias("time"), F.struct(F.lit("GET").alias("method"), "url").alias("request"),
                     F.struct(F.lit(200).alias("status")).alias("response"))
    logs = table(spark, sf, "pages").groupBy(F.floor(F.col("page_id") / 100).alias("k")).agg(F.collect_list(entry).alias("entries"))
    logs.select(F.to_json(F.struct(F.struct(F.lit("1.2").alias("version"), "entries").alias("log"))).alias("value")) \
        .write.option("maxRecordsPerFile", 1).text(f"{base}/log")
    return files.wire_endpoints(spark, f"{base}/log")
