"""Sinks and inventories: what is written is read back and compared."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from dialoscope.operators import browse, rollups
from dialoscope.plans.catalog import Catalog
from dialoscope.plans.catalog.runs import COUNTS, MANIFEST, enr, manifest, rec
from dialoscope.plans.fixtures import fixture, oracle, scratch, table
from dialoscope.plans.inputs import enriched, records
from dialoscope.sources import files, sinks

CATALOG = Catalog()
add = CATALOG.add


@add("append_records", rec("SELECT account, run_version, query_index, category, response FROM records"))
def append_records(spark, sf):
    """Two appends of one version each, read back as one table."""
    path = scratch(spark, "records")
    for v in (1, 2):
        sinks.append_records(records(spark, sf).where(F.col("run_version") == v), path)
    return spark.read.parquet(path).select("account", F.col("run_version").cast("int").alias("run_version"),
                                           "query_index", "category", "response")


@add("write_version", rec("SELECT query_index, query, category, response_time_seconds FROM records WHERE run_version = 2"))
def write_version(spark, sf):
    """One immutable version as JSON lines."""
    chosen = records(spark, sf).where("run_version = 2").drop("account", "tool_calls")
    target = sinks.write_version(chosen, scratch(spark, "versions"), 2)
    schema = "query_index BIGINT, query STRING, category STRING, response_time_seconds DOUBLE"
    return spark.read.schema(schema).json(target)


# The second report of version 2 replaces the first.
@add("manifest_upsert", rec("""SELECT account, version, CASE WHEN version = 2 THEN total_queries + 1 ELSE total_queries END
 AS total_queries FROM m""", m=MANIFEST))
def manifest_upsert(spark, sf):
    rows = manifest(spark, sf).select("account", "version", "total_queries", "timestamp")
    again = rows.where("version = 2").selectExpr("account", "version", "total_queries + 1 AS total_queries",
                                                 "'2024-02-01T00:00:00' AS timestamp")
    return sinks.upsert_manifest(rows, again).select("account", "version", "total_queries")


@add("manifest_publish", rec("SELECT account, version, total_queries, success, failed FROM m", m=MANIFEST))
def manifest_publish(spark, sf):
    """Every account publishes each of its runs, all at once: whoever comes second merges anew, no run is lost."""
    path, rows = scratch(spark, "manifest"), manifest(spark, sf).select("account", "version", "total_queries", "success", "failed", "timestamp").persist()
    runs = [(r.account, r.version) for r in rows.select("account", "version").collect()]

    def report(run):
        sinks.append_manifest(spark, rows.where((F.col("account") == run[0]) & (F.col("version") == run[1])), path)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(report, runs))
    rows.unpersist()
    return sinks.latest_manifest(spark, path)[1].drop("timestamp")


@add("example_set", oracle(["trace_runs"], "SELECT run_id, run_type FROM trace_runs WHERE run_type = 'tool'"))
def example_set(spark, sf):
    """An example set is replaced by another, made of a reader's view of the first."""
    path, runs = scratch(spark, "examples"), fixture(spark, sf, "trace_runs").select("run_id", "run_type")
    sinks.replace_examples(runs, path)
    sinks.replace_examples(sinks.read_examples(spark, path).where("run_type = 'tool'"), path)
    return sinks.read_examples(spark, path)


@add("next_version_files", rec("SELECT account, max(run_version) + 1 AS next_version FROM records GROUP BY 1"))
def next_version_files(spark, sf):
    """Version numbers from the names of result files; other names are passed over."""
    names = records(spark, sf).select("account", F.explode(F.array(
        F.concat(F.lit("query_results_v"), "run_version", F.lit(".jsonl")), F.lit("query_results_vX.jsonl"), F.lit("query_results_v99.json"))).alias("file"))
    return browse.next_version_of_files(names.distinct(), "query_results", ["account"])


@add("payload_records", enr("""SELECT run_version, query_index, '{"query_index":' || query_index || ',"query":' || to_json(query)
 || ',"copilot_response":"","remarks":' || to_json(remarks) || ',"category":' || to_json(category) || ',"expected_tool":'
 || coalesce(CAST(to_json(expected_tool) AS VARCHAR), 'null') || ',"thread_id":"t' || query_index || '","tool_calls":['
 || array_to_string(list_transform(tools, lambda t: '{"tool":"' || t || '","input":{}}'), ',') || '],"response":' || to_json(response)
 || ',"info_leak":' || CASE WHEN len(leaks) > 0 THEN 'true' ELSE 'false' END || ',"leak_indicators":['
 || array_to_string(list_transform(leaks, lambda t: '"' || t || '"'), ',') || '],"response_quality":"' || quality
 || '","response_time_seconds":' || CAST(response_time_seconds AS VARCHAR) || ',"step_count":' || step_count || ',"error":'
 || coalesce(CAST(to_json(error) AS VARCHAR), 'null') || ',"status_sequence":['
 || array_to_string(list_transform(tools, lambda t: '"' || t || '"'), ',')
 || '],"suggestions":[],"timestamp":"2024-01-01T00:00:00"}' AS json FROM enriched"""))
def payload_records(spark, sf):
    e = enriched(spark, sf)
    out, _ = sinks.export_payload(e, {"stats": rollups.run_stats(e)})
    return out.select("run_version", "query_index", "json")


@add("payload_summaries", enr(f"""SELECT 'stats' AS name, '{{"account":"' || account || '","run_version":' || run_version || ',"total":'
 || total || ',"success":' || success || ',"marginal":' || marginal || ',"no_data":' || no_data || ',"fail":' || fail
 || ',"leak":' || leak || '}}' AS json FROM (SELECT account, run_version, count(*) AS total, {COUNTS},
 count(*) FILTER (len(leaks) > 0) AS leak FROM enriched GROUP BY 1, 2)"""))
def payload_summaries(spark, sf):
    e = enriched(spark, sf)
    return sinks.export_payload(e, {"stats": rollups.run_stats(e)})[1]


# Page addresses stand for logged requests: path without host and query.
@add("endpoint_inventory", oracle([], """SELECT 'GET' AS method, regexp_replace(split_part(split_part(url, '#', 1), '?', 1),
 '^[a-zA-Z]+://[^/]*', '') AS path, 200 AS status, count(*) AS calls, min(length(html)) AS min_ms, avg(length(html)) AS avg_ms,
 max(length(html)) AS max_ms FROM pages GROUP BY 1, 2"""))
def endpoint_inventory(spark, sf):
    requests = table(spark, sf, "pages").select(
        F.lit("GET").alias("method"), "url", F.lit(200).alias("status"),
        F.length("html").cast("double").alias("time_ms"))
    return files.endpoint_inventory(requests)
