"""Run analytics over result records."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoscope.functions import quality as ql
from dialoscope.operators import browse, compare, phrases, rollups, suite, tools
from dialoscope.plans.catalog import Catalog
from dialoscope.plans.fixtures import fixture, oracle, table
from dialoscope.plans.inputs import (
    BLANK,
    ENRICHED_CTE,
    RECORDS_CTE,
    enriched,
    half_up,
    q,
    records,
    registry,
    rx,
)
from dialoscope.functions.quality import (
    FIGURE_SIGNS, HEDGE_WORDS, LISTING_WORDS, NO_DATA_PATTERNS, REFUSAL_WORDS)

CATALOG = Catalog()
add = CATALOG.add

VERSION = ["run_version"]


def rec(body: str, **more: str) -> str:
    return oracle(["eval_records"], body, records=RECORDS_CTE, **more)


def enr(body: str, **more: str) -> str:
    return oracle(["eval_records"], body, records=RECORDS_CTE, enriched=ENRICHED_CTE, **more)


COUNTS = ", ".join(f"count(*) FILTER (quality = '{x}') AS {x}" for x in ql.QUALITIES)
CENT_SUM = "CAST(sum(cents) AS BIGINT)"


@add("record_quality", enr("SELECT run_version, query_index, quality AS response_quality FROM enriched"))
def record_quality(spark, sf):
    return enriched(spark, sf).select("run_version", "query_index", "response_quality")


@add("no_data_match", rec("SELECT run_version, query_index, CASE "
     + " ".join(f"WHEN {rx('lower(response)', p)} THEN {i}" for i, p in enumerate(NO_DATA_PATTERNS))
     + " ELSE -1 END AS first_pattern FROM records"))
def no_data_match(spark, sf):
    return records(spark, sf, costly=True).select("run_version", "query_index",
                                     F.coalesce(ql.no_data_match("response"), F.lit(-1)).alias("first_pattern"))


@add("leak_records", enr("SELECT run_version, query_index, array_to_string(leaks, ',') AS labels FROM enriched "
                         "WHERE len(leaks) > 0"))
def leak_records(spark, sf):
    return browse.leaks_only(enriched(spark, sf)).select(
        "run_version", "query_index", F.array_join("leak_indicators", ",").alias("labels"))


@add("record_quality_v1", rec(f"""SELECT run_version, query_index,
 CASE WHEN coalesce(error, '') <> '' OR {BLANK.format('response')} THEN 'fail'
 WHEN {rx('lower(response)', REFUSAL_WORDS)} THEN 'marginal'
 WHEN {rx('response', FIGURE_SIGNS)} OR {rx('lower(response)', LISTING_WORDS)} THEN 'success'
 WHEN {rx('lower(response)', HEDGE_WORDS)} THEN 'marginal'
 WHEN length(response) > 60 THEN 'success' ELSE 'marginal' END AS response_quality FROM records"""))
def record_quality_v1(spark, sf):
    return records(spark, sf, costly=True).select("run_version", "query_index",
                                     ql.classify_quality("response", "error", "v1").alias("response_quality"))


_EXTRA = r"\b(lorem|pipeline|database)\b"


@add("custom_patterns", rec(f"""SELECT run_version, count(*) FILTER ({rx('lower(response)', _EXTRA)}) AS jargon
 FROM records GROUP BY 1"""))
def custom_patterns(spark, sf):
    labels = ql.leak_labels("response", {**ql.LEAK_PATTERNS, "jargon": _EXTRA})
    return (records(spark, sf, costly=True).withColumn("labels", labels).groupBy("run_version")
            .agg(F.count_if(F.array_contains("labels", "jargon")).alias("jargon")))


_PAIRS = """SELECT item_id, w[i] || ' ' || w[i + 1] AS phrase FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i
 FROM (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark))"""


def _phrase_sets(match: str) -> str:
    return oracle([], f"""SELECT doc_id, coalesce(n, 0) AS n_labels, coalesce(ids, '') AS labels FROM documents LEFT JOIN
 (SELECT doc_id, count(*) AS n, string_agg(label, ',' ORDER BY label) AS ids FROM
 (SELECT DISTINCT d.doc_id, CAST(p.item_id AS VARCHAR) AS label FROM documents d JOIN pairs p ON {match}) GROUP BY 1) USING (doc_id)""",
                  pairs=_PAIRS)


def _labelled(spark, sf, **more):
    words = table(spark, sf, "benchmark").select(F.col("item_id").alias("label"), F.split(F.lower("text"), " ").alias("w"))
    pairs = words.select("label", F.explode(F.expr("transform(slice(w, 1, size(w) - 1), (x, i) -> x || ' ' || w[i + 1])")).alias("phrase"))
    found = phrases.label_phrases(table(spark, sf, "documents"), pairs, ["doc_id"], "text", **more)
    return found.select("doc_id", F.size("labels").cast("bigint").alias("n_labels"), F.array_join("labels", ",").alias("labels"))


@add("phrase_sets", _phrase_sets("contains(lower(d.text), p.phrase)"))
def phrase_sets(spark, sf):
    """All word pairs of the benchmark as a phrase table, one label an item, sought in every document."""
    return _labelled(spark, sf)


@add("phrase_sets_sliced", _phrase_sets("contains(lower(d.text), p.phrase)"))
def phrase_sets_sliced(spark, sf):
    """The same with a table that is too large for one automaton."""
    return _labelled(spark, sf, slice_chars=1 << 14)


@add("step_backfill", rec("SELECT run_version, query_index, CASE WHEN step_count = 0 AND len(tools) > 0 "
                          "THEN len(tools) ELSE step_count END AS step_count FROM records"))
def step_backfill(spark, sf):
    return records(spark, sf).select(
        "run_version", "query_index",
        ql.backfill_steps("step_count", "status_sequence").cast("bigint").alias("step_count"))


@add("run_stats", enr(f"SELECT run_version, count(*) AS total, {COUNTS}, "
                      "count(*) FILTER (len(leaks) > 0) AS leak FROM enriched GROUP BY 1"))
def run_stats(spark, sf):
    return rollups.run_stats(enriched(spark, sf), VERSION)


@add("leak_types", enr("SELECT run_version, leak_type, count(*) AS n FROM (SELECT run_version, "
                       "unnest(leaks) AS leak_type FROM enriched) GROUP BY 1, 2"))
def leak_types(spark, sf):
    return rollups.leak_types(enriched(spark, sf), VERSION)


@add("quality_shares", enr("SELECT run_version, count(*) AS total, " + ", ".join(
    half_up(f"100 * count(*) FILTER (quality = '{x}')", "count(*)") + f" AS {x}_pct" for x in ql.QUALITIES)
    + " FROM enriched GROUP BY 1"))
def quality_shares(spark, sf):
    return rollups.quality_shares(enriched(spark, sf), VERSION)


@add("tool_coverage", rec("""SELECT run_version, count(*) FILTER (len(tools) = 0) AS no_tool,
 (SELECT count(DISTINCT t) FROM (SELECT run_version AS v, unnest(tools) AS t FROM records) x
  WHERE x.v = r.run_version) AS tools_used, bool_or(len(tools) > 0) AS tools_visible
 FROM records r GROUP BY 1"""))
def tool_coverage(spark, sf):
    return rollups.tool_coverage(records(spark, sf), VERSION)


@add("no_tool_records", rec("SELECT run_version, query_index FROM records WHERE len(tools) = 0"))
def no_tool_records(spark, sf):
    return browse.no_tool(records(spark, sf)).select("run_version", "query_index")


@add("run_time", rec(f"""SELECT run_version, count(*) AS n, CAST({CENT_SUM} AS DOUBLE) / 100.0 AS total_seconds,
 {half_up(CENT_SUM, '100 * count(*)', 2)} AS avg_seconds,
 {half_up(f'({CENT_SUM} + 100 * count(*))', '6000', 1)} AS total_minutes FROM records GROUP BY 1"""))
def run_time(spark, sf):
    return rollups.run_time(records(spark, sf), VERSION)


@add("category_quality", enr(f"""SELECT run_version, category, {COUNTS},
 {half_up(CENT_SUM, '100 * count(*)', 1)} AS avg, count(*) AS n FROM enriched GROUP BY 1, 2"""))
def category_quality(spark, sf):
    return rollups.category_quality(enriched(spark, sf), VERSION)


@add("category_time", rec(f"""SELECT run_version, category, {half_up(CENT_SUM, '100 * count(*)', 1)} AS avg,
 min(cents) / 100.0 AS min, max(cents) / 100.0 AS max, count(*) AS n, CAST({CENT_SUM} AS DOUBLE) / 100.0 AS total,
 count(*) FILTER (coalesce(error, '') = '') AS ok, count(*) FILTER (coalesce(error, '') <> '') AS failed
 FROM records GROUP BY 1, 2"""))
def category_time(spark, sf):
    return rollups.category_time(records(spark, sf), VERSION, status=True)


@add("tool_counts", rec("SELECT run_version, tool, count(*) AS n FROM (SELECT run_version, unnest(tools) AS tool "
                        "FROM records) GROUP BY 1, 2"))
def tool_counts(spark, sf):
    return rollups.tool_counts(records(spark, sf), VERSION)


MATCHED = """SELECT *, CASE WHEN coalesce(expected_tool, '') <> '' THEN
 CASE WHEN contains(expected_tool, '→') THEN len(list_filter(string_split(expected_tool, '→'),
   lambda x: NOT list_contains(tools, trim(x)))) = 0 ELSE list_contains(tools, expected_tool) END END AS hit
 FROM records"""


@add("tool_match", rec("SELECT run_version, query_index, hit AS tool_matched FROM m WHERE hit IS NOT NULL", m=MATCHED))
def tool_match(spark, sf):
    return (tools.tool_match(records(spark, sf)).where(F.col("tool_matched").isNotNull())
            .select("run_version", "query_index", "tool_matched"))


@add("tool_accuracy", rec(f"""SELECT run_version, count(*) FILTER (hit) AS correct, count(hit) AS total_with_expected,
 sum(len(tools)) > 0 AS tools_visible, {half_up('100 * count(*) FILTER (hit)', 'count(hit)', 1)} AS pct
 FROM m GROUP BY 1""", m=MATCHED))
def tool_accuracy(spark, sf):
    return rollups.tool_accuracy(records(spark, sf), VERSION)


@add("category_tool_accuracy", rec(f"""SELECT run_version, category, count(hit) AS total, count(*) FILTER (hit) AS correct,
 {half_up('100 * count(*) FILTER (hit)', 'count(hit)', 1)} AS pct FROM m GROUP BY 1, 2""", m=MATCHED))
def category_tool_accuracy(spark, sf):
    return rollups.category_tool_accuracy(records(spark, sf), VERSION)


@add("step_stats", enr(f"""SELECT run_version, {half_up('CAST(sum(step_count) AS BIGINT)', 'count(*)', 1)} AS avg,
 min(step_count) AS min, max(step_count) AS max,
 list_sort(list(step_count))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM enriched GROUP BY 1"""))
def step_stats(spark, sf):
    return rollups.step_stats(enriched(spark, sf), VERSION)


@add("category_steps", enr(f"""SELECT run_version, category,
 {half_up('CAST(sum(step_count) AS BIGINT)', 'count(*)', 1)} AS avg, min(step_count) AS min,
 max(step_count) AS max, count(*) AS n FROM enriched GROUP BY 1, 2"""))
def category_steps(spark, sf):
    return rollups.category_steps(enriched(spark, sf), VERSION)


MANIFEST = f"""SELECT account, run_version AS version, count(*) AS total_queries,
 count(*) FILTER (coalesce(error, '') = '') AS success, count(*) FILTER (coalesce(error, '') <> '') AS failed,
 coalesce({half_up("CAST(sum(cents) FILTER (coalesce(error, '') = '') AS BIGINT)",
                   "100 * count(*) FILTER (coalesce(error, '') = '')", 2)}, 0.0) AS avg_response_time_seconds
 FROM records GROUP BY 1, 2"""


def manifest(spark, sf):
    return (rollups.manifest_row(records(spark, sf)).withColumnRenamed("run_version", "version")
            .withColumn("timestamp", F.concat(F.lit("2024-01-0"), F.col("version").cast("string"),
                                              F.lit("T10:00:00"))))


@add("manifest_row", rec("SELECT * FROM m", m=MANIFEST))
def manifest_row(spark, sf):
    return manifest(spark, sf).select(
        "account", "version", "total_queries", "success", "failed",
        F.col("avg_response_time_seconds").cast("double").alias("avg_response_time_seconds"))


@add("version_summary", rec(f"""SELECT account, version, total_queries, success, failed, avg_response_time_seconds,
 {half_up('total_queries * (CAST(round(avg_response_time_seconds * 100) AS BIGINT) + 100)', '6000', 1)} AS total_minutes,
 strftime(CAST('2024-01-0' || version AS TIMESTAMP), '%B %d, %Y') AS run_date,
 (SELECT count(DISTINCT category) FROM records r WHERE r.account = m.account AND r.run_version = m.version) AS categories
 FROM m""", m=MANIFEST))
def version_summary(spark, sf):
    return compare.version_summary(manifest(spark, sf), records(spark, sf))


@add("version_trend", rec("""SELECT account, version, failed, coalesce(pf, -1) AS prev_failed,
 CASE WHEN pf IS NULL THEN 'first' WHEN failed = 0 AND pf > 0 THEN 'all_clear' WHEN failed < pf THEN 'reduced'
  WHEN failed > pf THEN 'increased' ELSE 'same' END AS failure_change,
 CASE WHEN pf IS NULL THEN 'first' WHEN c < pc THEN 'improved' WHEN (c - pc) * 100 > 5 * pc THEN 'slower'
  ELSE 'within_noise' END AS latency_change
 FROM (SELECT *, CAST(round(avg_response_time_seconds * 100) AS BIGINT) AS c,
  lag(failed) OVER w AS pf, lag(CAST(round(avg_response_time_seconds * 100) AS BIGINT)) OVER w AS pc FROM m
  WINDOW w AS (PARTITION BY account ORDER BY version))""", m=MANIFEST))
def version_trend(spark, sf):
    return compare.version_trend(manifest(spark, sf)).withColumn(
        "prev_failed", F.coalesce("prev_failed", F.lit(-1))).drop("latency_pct")


@add("select_version", enr("""SELECT account, run_version, query_index FROM enriched e
 WHERE run_version = (SELECT max(run_version) FROM enriched f WHERE f.account = e.account)"""))
def select_version(spark, sf):
    return browse.select_version(records(spark, sf), manifest(spark, sf)).select("account", "run_version", "query_index")


@add("next_version", rec("SELECT account, max(run_version) + 1 AS next_version FROM records GROUP BY 1"))
def next_version(spark, sf):
    return browse.next_version(manifest(spark, sf), ["account"])


@add("quality_frequency", enr("SELECT run_version, quality AS response_quality, count(*) AS n FROM enriched GROUP BY 1, 2"))
def quality_frequency(spark, sf):
    return rollups.most_common(enriched(spark, sf), "response_quality", keys=VERSION)


@add("category_rank", rec(f"""SELECT run_version, category, avg, avg / max(avg) OVER (PARTITION BY run_version) AS bar
 FROM (SELECT run_version, category, {half_up(CENT_SUM, '100 * count(*)', 1)} AS avg FROM records GROUP BY 1, 2)"""))
def category_rank(spark, sf):
    return rollups.category_rank(records(spark, sf), VERSION)


@add("overview", enr(f"""SELECT run_version, coalesce(category, '(run)') AS category, grouping(category) AS is_total,
 count(*) AS n, {COUNTS}, count(*) FILTER (len(leaks) > 0) AS leak, {CENT_SUM} AS total_cents,
 CAST(sum(step_count) AS BIGINT) AS steps FROM enriched
 GROUP BY GROUPING SETS ((run_version), (run_version, category))"""))
def overview(spark, sf):
    return rollups.overview(enriched(spark, sf), VERSION).withColumn(
        "category", F.coalesce("category", F.lit("(run)")))


@add("version_diff", enr("""SELECT coalesce(a.account, b.account) AS account,
 coalesce(a.query_index, b.query_index) AS query_index, a.quality AS quality_a, b.quality AS quality_b,
 a.quality IS DISTINCT FROM b.quality AS quality_changed,
 list_sort(list_distinct(a.tools)) IS DISTINCT FROM list_sort(list_distinct(b.tools)) AS tools_changed,
 (a.error IS NULL) IS DISTINCT FROM (b.error IS NULL) AS error_changed,
 CAST(b.cents - a.cents AS DOUBLE) / 100.0 AS seconds_delta
 FROM (SELECT * FROM enriched WHERE run_version = 1) a FULL JOIN (SELECT * FROM enriched WHERE run_version = 2) b
 ON a.account = b.account AND a.query_index = b.query_index"""))
def version_diff(spark, sf):
    return compare.version_diff(enriched(spark, sf), 1, 2)


@add("version_churn", enr(f"""SELECT count(*) AS compared, count(*) FILTER (a.quality <> b.quality) AS quality_changed,
 count(*) FILTER (list_sort(list_distinct(a.tools)) <> list_sort(list_distinct(b.tools))) AS tools_changed,
 count(*) FILTER ((a.error IS NULL) <> (b.error IS NULL)) AS error_changed,
 {half_up('100 * count(*) FILTER (a.quality <> b.quality)', 'count(*)', 1)} AS churn_pct,
 count(*) FILTER (a.quality <> b.quality) * 100 <= 30 * count(*) AS trusted
 FROM (SELECT * FROM enriched WHERE run_version = 1) a JOIN (SELECT * FROM enriched WHERE run_version = 2) b
 ON a.query_index = b.query_index"""))
def version_churn(spark, sf):
    return compare.version_churn(enriched(spark, sf), 1, 2)


@add("remark_crosstab", enr("""SELECT category, quality AS response_quality,
 count(*) FILTER (remarks <> '') AS with_remark, count(*) FILTER (remarks = '') AS without_remark
 FROM enriched GROUP BY 1, 2"""))
def remark_crosstab(spark, sf):
    return compare.remark_crosstab(enriched(spark, sf))


@add("account_comparison", enr(f"""SELECT coalesce(account, '(all)') AS account, count(*) AS total, {COUNTS},
 count(*) FILTER (len(leaks) > 0) AS leak, {half_up(CENT_SUM, '100 * count(*)', 2)} AS avg_seconds,
 {half_up('CAST(sum(step_count) AS BIGINT)', 'count(*)', 1)} AS avg_steps
 FROM enriched WHERE run_version = 2 GROUP BY ROLLUP (account)"""))
def account_comparison(spark, sf):
    return compare.account_comparison(enriched(spark, sf))


@add("slow_categories", rec("""SELECT account, run_version, category, n,
 CAST(c * (all_n - n) AS DOUBLE) / CAST(n * (all_c - c) AS DOUBLE) AS times_others
 FROM (SELECT *, CAST(sum(n) OVER w AS BIGINT) AS all_n, CAST(sum(c) OVER w AS BIGINT) AS all_c FROM
  (SELECT account, run_version, category, count(*) AS n, CAST(sum(cents) AS BIGINT) AS c FROM records GROUP BY 1, 2, 3)
  WINDOW w AS (PARTITION BY account, run_version))
 WHERE CAST(c * (all_n - n) AS DOUBLE) / CAST(n * (all_c - c) AS DOUBLE) >= 1.0"""))
def slow_categories(spark, sf):
    return compare.slow_categories(records(spark, sf), 1.0)


@add("reconcile", rec("""SELECT account, version, 'failed differs' AS problem, CAST(failed AS DOUBLE) AS found,
 CAST(failed + 1 AS DOUBLE) AS expected FROM m WHERE version = 1
 UNION ALL SELECT account, run_version, 'query_index not 1..n', CAST(max(query_index) AS DOUBLE),
 CAST(count(*) AS DOUBLE) FROM records GROUP BY 1, 2""", m=MANIFEST))
def reconcile(spark, sf):
    stated = manifest(spark, sf).withColumn(
        "failed", F.col("failed") + F.when(F.col("version") == 1, 1).otherwise(0))
    return compare.reconcile(records(spark, sf), stated)


CALLS = "SELECT run_version, query_index, unnest(tools) AS tool FROM records"


def calls(spark, sf):
    return tools.explode_calls(records(spark, sf), ["run_version", "query_index"])


@add("phantom_tools", oracle(["eval_records", "registry"], """SELECT run_version, tool, count(*) AS calls FROM c
 WHERE tool NOT IN (SELECT name FROM registry) GROUP BY 1, 2""", records=RECORDS_CTE, c=CALLS))
def phantom_tools(spark, sf):
    return tools.phantom_tools(calls(spark, sf), registry(spark, sf), VERSION)


@add("unused_tools", oracle(["eval_records", "registry"], """SELECT name, family FROM registry
 WHERE name NOT IN (SELECT tool FROM c)""", records=RECORDS_CTE, c=CALLS))
def unused_tools(spark, sf):
    return tools.unused_tools(registry(spark, sf), calls(spark, sf)).select("name", "family")


_MISSPELT = """SELECT CASE query_index % 4 WHEN 0 THEN tool WHEN 1 THEN concat(tool, 's')
 WHEN 2 THEN replace(tool, 'e', '') ELSE replace(tool, '_', '-') END AS tool FROM c"""


@add("near_tools", oracle(["eval_records", "registry"], """SELECT called, name AS registered,
 CAST(levenshtein(called, name) AS BIGINT) AS distance FROM (SELECT DISTINCT tool AS called FROM s
  WHERE tool NOT IN (SELECT name FROM registry)) JOIN registry ON levenshtein(called, name) <= 2""",
  records=RECORDS_CTE, c=CALLS, s=_MISSPELT))
def near_tools(spark, sf):
    misspelt = calls(spark, sf).select(F.expr(
        "CASE query_index % 4 WHEN 0 THEN tool WHEN 1 THEN concat(tool, 's') "
        "WHEN 2 THEN replace(tool, 'e', '') ELSE replace(tool, '_', '-') END").alias("tool"))
    return tools.near_tools(misspelt, registry(spark, sf), 2).withColumn("distance", F.col("distance").cast("bigint"))


@add("tool_usage_matrix", rec("""SELECT tool, count(*) FILTER (run_version = 1) AS v1,
 count(*) FILTER (run_version = 2) AS v2, count(*) AS total, min(run_version) AS first_version,
 min(run_version) = 2 AS is_new FROM c GROUP BY 1""", c=CALLS))
def tool_usage_matrix(spark, sf):
    return tools.tool_usage_matrix(calls(spark, sf), [1, 2])


# The second version renames one tool, so the two sets differ.
_RENAMED = """SELECT run_version, CASE WHEN run_version = 2 AND tool = 'get_sales' THEN 'get_sales_v2'
 ELSE tool END AS tool FROM c"""


@add("tools_in_all", rec("""SELECT tool, 'in all' AS status FROM (SELECT tool FROM s WHERE run_version = 1
 INTERSECT SELECT tool FROM s WHERE run_version = 2)
 UNION ALL SELECT tool, 'dropped' FROM (SELECT tool FROM s WHERE run_version = 1
 EXCEPT SELECT tool FROM s WHERE run_version = 2)""", c=CALLS, s=_RENAMED))
def tools_in_all(spark, sf):
    renamed = calls(spark, sf).withColumn("tool", F.when(
        (F.col("run_version") == 2) & (F.col("tool") == "get_sales"), "get_sales_v2").otherwise(F.col("tool")))
    both = tools.tools_in_all(renamed, [1, 2]).withColumn("status", F.lit("in all"))
    return both.unionByName(tools.tools_dropped(renamed, 1, 2).withColumn("status", F.lit("dropped")))


@add("union_runs", rec("""SELECT account, run_version, query_index, '' AS note FROM records WHERE run_version = 1
 UNION ALL SELECT account, run_version, query_index, 'rerun' FROM records WHERE run_version = 2"""))
def union_runs(spark, sf):
    r = records(spark, sf).select("account", "run_version", "query_index")
    second = r.where("run_version = 2").withColumn("note", F.lit("rerun"))
    return compare.union_runs(r.where("run_version = 1"), second).na.fill("", ["note"])


# ---- suites -------------------------------------------------------------------------------------------

_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_HEADER = "coalesce(is_bold, false) AND coalesce(c1, '') <> ''"
SUITE_A = f"""SELECT row_number() OVER (ORDER BY row_idx) AS query_index, {_TRIM.format('c1')} AS query,
 CASE WHEN coalesce(c2, '') <> '' THEN {_TRIM.format('c2')} ELSE '' END AS copilot_response,
 CASE WHEN coalesce(c3, '') <> '' THEN {_TRIM.format('c3')} ELSE '' END AS remarks,
 coalesce(heading, 'General') AS category, nullif({_TRIM.format('c4')}, '') AS expected_tool
 FROM (SELECT *, last_value(CASE WHEN {_HEADER} THEN {_TRIM.format('c1')} END IGNORE NULLS) OVER
  (ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM suite_rows_a)
 WHERE coalesce(c1, '') <> '' AND NOT ({_HEADER})"""
SUITE_B = f"""SELECT row_number() OVER (ORDER BY row_idx) AS query_index, {_TRIM.format('c3')} AS query,
 '' AS copilot_response, '' AS remarks,
 CASE WHEN coalesce(c2, '') <> '' THEN {_TRIM.format('c2')} ELSE 'General' END AS category,
 nullif({_TRIM.format('c4')}, '') AS expected_tool FROM rows_b WHERE coalesce(c3, '') <> ''"""
ROWS_B = "SELECT row_idx, is_bold, NULL AS c1, c2, c1 AS c3, c4 FROM suite_rows_a"


def rows_a(spark, sf):
    return fixture(spark, sf, "suite_rows_a")


def suite_a(spark, sf):
    return suite.normalize_suite_a(rows_a(spark, sf))


@add("suite_layout_a", oracle(["suite_rows_a"], "SELECT * FROM s", s=SUITE_A))
def suite_layout_a(spark, sf):
    return suite_a(spark, sf)


@add("suite_layout_b", oracle(["suite_rows_a"], "SELECT * FROM s", rows_b=ROWS_B, s=SUITE_B))
def suite_layout_b(spark, sf):
    rows = rows_a(spark, sf).selectExpr("row_idx", "is_bold", "CAST(NULL AS string) AS c1", "c2", "c1 AS c3", "c4")
    return suite.normalize_suite_b(rows)


@add("suite_dispatch", oracle(["suite_rows_a"], """SELECT 'one' AS file, query_index, query, category FROM a
 UNION ALL SELECT 'two', query_index, query, category FROM b""", rows_b=ROWS_B, a=SUITE_A, b=SUITE_B))
def suite_dispatch(spark, sf):
    raw = rows_a(spark, sf)
    one = raw.selectExpr("'one' AS file", "'Chat Queries' AS sheet", "1 AS sheet_no", "row_idx", "is_bold",
                         "c1", "c2", "c3", "c4")
    other = raw.selectExpr("'one' AS file", "'Notes' AS sheet", "0 AS sheet_no", "row_idx", "is_bold",
                           "c2 AS c1", "c2", "c3", "c4")
    two = raw.selectExpr("'two' AS file", "'Sheet1' AS sheet", "1 AS sheet_no", "row_idx", "is_bold",
                         "CAST(NULL AS string) AS c1", "c2", "c1 AS c3", "c4")
    return suite.normalize_suite(one.unionByName(other).unionByName(two)).select(
        "file", "query_index", "query", "category")


@add("suite_profile", oracle(["suite_rows_a"], """SELECT category, count(*) AS n,
 count(expected_tool) AS with_expected_tool FROM s GROUP BY 1""", s=SUITE_A))
def suite_profile(spark, sf):
    return suite.suite_profile(suite_a(spark, sf))


@add("remaining_queries", oracle(["suite_rows_a", "eval_records"], """SELECT query_index, category FROM s
 WHERE query_index NOT IN (SELECT query_index FROM records WHERE run_version = 1 AND error IS NULL)""",
 s=SUITE_A, records=RECORDS_CTE))
def remaining_queries(spark, sf):
    partial = records(spark, sf).where("run_version = 1")
    return suite.remaining(suite_a(spark, sf), partial, retry_errors=True).select("query_index", "category")


@add("build_records", oracle(["suite_rows_a", "eval_records"], """SELECT s.query_index, s.category, s.expected_tool,
 coalesce(len(r.tools), 0) AS calls, coalesce(r.response, '') AS response,
 coalesce(r.response_time_seconds, 0.0) AS seconds, coalesce(r.step_count, 0) AS step_count,
 CASE WHEN r.query_index IS NULL THEN 'no captured result' ELSE r.error END AS error
 FROM s LEFT JOIN (SELECT * FROM records WHERE run_version = 2 AND coalesce(error, '') = '') r
 ON s.query_index = r.query_index""", s=SUITE_A, records=RECORDS_CTE))
def build_records(spark, sf):
    captured = records(spark, sf).where("run_version = 2 AND coalesce(error, '') = ''")
    out = suite.build_records(suite_a(spark, sf), captured, 2)
    return out.select("query_index", "category", "expected_tool", F.size("tool_calls").cast("bigint").alias("calls"),
                      "response", F.col("response_time_seconds").cast("double").alias("seconds"),
                      F.col("step_count").cast("bigint").alias("step_count"), "error")
