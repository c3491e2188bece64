"""Bot scenarios and accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoscope.functions.text import split_list
from dialoscope.functions.quality import classify_bot_quality
from dialoscope.operators import bots, browse
from dialoscope.plans.catalog import Catalog
from dialoscope.plans.fixtures import fixture, oracle, table
from dialoscope.plans.inputs import half_up
from dialoscope.sources import accounts

CATALOG = Catalog()
add = CATALOG.add


def results(spark, sf):
    rows = fixture(spark, sf, "bot_results")
    name = lambda t: F.struct(t.alias("name"), F.parse_json(F.lit("{}")).alias("args"))
    return rows.select(
        F.concat(F.lit("run"), (F.col("case_seq") % 3).cast("string")).alias("run_id"), "bot_name",
        F.concat_ws("-", F.col("case_seq").cast("string"), F.col("turn_seq").cast("string")).alias("query_id"),
        (F.col("case_seq") * 1000 + F.col("turn_seq")).alias("pos"), "category", "query", "response_type", "response_text",
        F.transform(split_list("tools_csv"), name).alias("tools_used"), "error",
        F.col("response_time_seconds").cast("decimal(12,2)").alias("response_time_seconds"), "chat_id")


def expectations(spark, sf):
    e = fixture(spark, sf, "bot_expectations")
    return e.select("category", F.col("exp_response_type"), split_list("contains_csv").alias("exp_contains"),
                    split_list("not_contains_csv").alias("exp_not_contains"),
                    F.nullif("exp_tool", F.lit("")).alias("exp_tool"), split_list("not_tool_csv").alias("exp_not_tool"))


def checked(spark, sf):
    return bots.check_expectations(results(spark, sf), expectations(spark, sf), ["category"])


RESULTS = """SELECT 'run' || CAST(case_seq % 3 AS VARCHAR) AS run_id, case_seq || '-' || turn_seq AS query_id,
 case_seq * 1000 + turn_seq AS pos, b.*, CAST(round(response_time_seconds * 100) AS BIGINT) AS cents,
 CASE WHEN tools_csv = '' THEN [] ELSE string_split(tools_csv, ',') END AS used,
 lower(coalesce(response_text, '')) AS low FROM bot_results b"""
QUALITY = """CASE WHEN coalesce(error, '') <> '' OR regexp_replace(low, '^\\s+|\\s+$', '', 'g') = '' THEN 'fail'
 WHEN contains(low, 'sorry') OR contains(low, 'couldn''t') OR contains(low, 'something went wrong')
  OR contains(low, 'unable to') OR contains(low, 'went wrong') THEN 'marginal' ELSE 'success' END"""
_LIST = "CASE WHEN {0} = '' THEN [] ELSE string_split({0}, ',') END"
def literal(x: str) -> str:
    """Text as a quoted literal."""
    return (f"CASE WHEN contains({x}, '''') AND NOT contains({x}, chr(34)) THEN chr(34) || {x} || chr(34) "
            f"ELSE '''' || replace({x}, '''', chr(92) || '''') || '''' END")


CHECKED = f"""SELECT *, fail_reason = '' AS passed FROM (SELECT r.*, {QUALITY} AS quality,
 CASE WHEN coalesce(error, '') <> '' THEN error
 WHEN exp_response_type IS NOT NULL AND response_type IS DISTINCT FROM exp_response_type
  THEN 'expected response_type=' || {literal('exp_response_type')} || ', got ' || coalesce({literal('response_type')}, 'None')
 WHEN len(missing) > 0 THEN 'expected to contain ' || {literal('missing[1]')} || ', not found'
 WHEN len(unwanted) > 0 THEN 'unexpected phrase ' || {literal('unwanted[1]')} || ' found in response'
 WHEN exp_tool <> '' AND NOT list_contains(used, exp_tool) THEN 'expected tool ' || {literal('exp_tool')} || ', used: ['
  || array_to_string(list_transform(used, lambda t: {literal('t')}), ', ') || ']'
 WHEN len(forbidden) > 0 THEN 'forbidden tool ' || {literal('forbidden[1]')} || ' was invoked' ELSE '' END AS fail_reason
 FROM (SELECT r.*, e.exp_response_type, e.exp_tool,
  list_filter({_LIST.format('contains_csv')}, lambda p: NOT contains(low, lower(p))) AS missing,
  list_filter({_LIST.format('not_contains_csv')}, lambda p: contains(low, lower(p))) AS unwanted,
  list_filter({_LIST.format('not_tool_csv')}, lambda t: list_contains(used, t)) AS forbidden
  FROM results r LEFT JOIN bot_expectations e USING (category)) r)"""


def bq(body: str) -> str:
    return oracle(["bot_results", "bot_expectations"], body, results=RESULTS, checked=CHECKED)


@add("bot_quality", bq(f"SELECT query_id, {QUALITY} AS response_quality FROM results"))
def bot_quality(spark, sf):
    return results(spark, sf).select("query_id", classify_bot_quality("response_text", "error").alias("response_quality"))


@add("check_expectations", bq("SELECT query_id, passed, fail_reason, quality AS response_quality FROM checked"))
def check_expectations(spark, sf):
    return checked(spark, sf).select("query_id", "passed", "fail_reason", "response_quality")


@add("carry_chat_id", bq("""SELECT query_id, coalesce(last_value(chat_id IGNORE NULLS) OVER (PARTITION BY bot_name
 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS sent_chat_id FROM results"""))
def carry_chat_id(spark, sf):
    return bots.carry_chat_id(results(spark, sf), block=8000).select(
        "query_id", F.coalesce("sent_chat_id", F.lit("")).alias("sent_chat_id"))


_SUMMARY = f"""run_id, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed,
 {half_up('100 * count(*) FILTER (passed)', 'count(*)')} AS pass_pct, count(*) FILTER (quality = 'success') AS success,
 count(*) FILTER (quality = 'marginal') AS marginal, count(*) FILTER (quality = 'fail') AS fail,
 {half_up('CAST(sum(cents) AS BIGINT)', '100 * count(*)', 1)} AS avg_seconds"""


@add("bot_summary", bq(f"SELECT {_SUMMARY} FROM checked GROUP BY 1"))
def bot_summary(spark, sf):
    return bots.bot_summary(checked(spark, sf)).drop("quality")


@add("bot_stats", bq(f"""SELECT {_SUMMARY}, count(DISTINCT bot_name) AS bots,
 CASE WHEN count(*) FILTER (passed) >= 0.8 * count(*) THEN 'green'
 WHEN count(*) FILTER (passed) >= 0.5 * count(*) THEN 'amber' ELSE 'red' END AS tier FROM checked GROUP BY 1"""))
def bot_stats(spark, sf):
    return bots.bot_stats(checked(spark, sf))


@add("bot_manifest", bq("""SELECT run_id, count(*) AS total_cases, count(*) FILTER (passed) AS passed,
 count(*) FILTER (NOT passed) AS failed FROM checked GROUP BY 1"""))
def bot_manifest(spark, sf):
    stamped = checked(spark, sf).withColumn("timestamp", F.concat(F.lit("2024-01-0"), F.substring("run_id", 4, 1)))
    return bots.bot_manifest_row(stamped).drop("timestamp")


@add("latest_bot_run", bq("SELECT bot_name, max(run_id) AS run_id FROM results GROUP BY 1"))
def latest_bot_run(spark, sf):
    manifest = results(spark, sf).groupBy("bot_name", "run_id").agg(F.count("*").alias("n")).withColumn(
        "timestamp", F.concat(F.lit("2024-01-0"), F.substring("run_id", 4, 1)))
    return browse.latest_run(manifest, keys=["bot_name"])


@add("browse_results", bq("""SELECT query_id FROM checked WHERE (contains(lower(query), 'an') OR contains(low, 'an')
 OR contains(query_id, 'an')) AND passed AND quality = 'success' AND category = 'Finance' AND bot_name = 'bot2'"""))
def browse_results(spark, sf):
    return browse.browse(checked(spark, sf), "AN", "pass", "success", "Finance", "bot2").select("query_id")


@add("sort_results", bq("SELECT query_id, lower(coalesce(response_type, '')) AS sort_key FROM checked ORDER BY 2 DESC"))
def sort_results(spark, sf):
    return browse.sort_results(checked(spark, sf), "response_type", asc=False).select(
        "query_id", F.lower(F.coalesce("response_type", F.lit(""))).alias("sort_key"))


@add("override_workspace", bq("SELECT bot_name, 'ws-qa' AS workspace_id, count(*) AS n FROM results GROUP BY 1"))
def override_workspace(spark, sf):
    cases = results(spark, sf).withColumn("workspace_id", F.lit("ws-old"))
    return bots.override_workspace(cases, "ws-qa").groupBy("bot_name", "workspace_id").agg(F.count("*").alias("n"))


# Replies of the message API made from the conversation texts: one message of each type by turn.
RAW = """SELECT case_seq, turn_seq, concat('{"messages":[{"type":"text","text":{"body":"hello"}},', CASE turn_seq % 5
  WHEN 0 THEN '{"type":"interactive","template":{"body":{"text":"pick one"},"action":{"sections":[{"rows":[{"title":"A","description":"first"},{"title":"B"}]},{"rows":[{"title":"C"}]}]}}}'
  WHEN 1 THEN '{"type":"cta_url","text":{"body":"open the link"}}' WHEN 2 THEN '{"type":"document"}'
  WHEN 3 THEN '{"type":"sticker"}' ELSE '{"type":"sticker","text":{"body":"a sticker"}}' END,
  '],"agentMetadata":{"tools_used":[', CASE WHEN tools_csv = '' THEN '' ELSE concat('{"name":"', tools_csv, '","args":{}}') END,
  '],"knowledge_files_referenced":["f', CAST(case_seq AS VARCHAR(9)), '.pdf"]}}') AS raw FROM bot_results"""


@add("bot_reply", oracle(["bot_results"], """SELECT case_seq, turn_seq, CASE turn_seq % 5 WHEN 0 THEN 'interactive' WHEN 1 THEN 'cta_url'
 WHEN 2 THEN 'document' ELSE 'text' END AS response_type, CASE turn_seq % 5 WHEN 0 THEN 'pick one' WHEN 1 THEN 'open the link'
 WHEN 2 THEN '' WHEN 3 THEN 'hello' ELSE 'a sticker' END AS response_text,
 CASE WHEN turn_seq % 5 = 0 THEN 'A=first,B=,C=' ELSE '' END AS menu,
 coalesce(raw->>'$.agentMetadata.tools_used[0].name', '') AS tools,
 raw->>'$.agentMetadata.knowledge_files_referenced[0]' AS files FROM raws""", raws=RAW))
def bot_reply(spark, sf):
    fixture(spark, sf, "bot_results").createOrReplaceTempView("bot_results")
    raws = spark.sql(RAW).withColumn("raw", F.try_parse_json("raw"))
    r = raws.select("case_seq", "turn_seq", bots.extract_bot_response().alias("r")).select("case_seq", "turn_seq", "r.*")
    pair = lambda m: F.concat_ws("=", m["title"], m["description"])
    return r.select("case_seq", "turn_seq", "response_type", "response_text",
                    F.array_join(F.transform("menu_options", pair), ",").alias("menu"),
                    F.array_join(F.transform("tools_used", lambda t: t["name"]), ",").alias("tools"),
                    F.array_join("knowledge_files", ",").alias("files"))


# Account rows made from customers, with gaps.
ACCOUNTS = """SELECT c_custkey AS account, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS account_name,
 CAST(9000000000 + c_custkey AS VARCHAR(12)) AS phone, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS workspace_id,
 'https://agent.example' AS base_url, 300 AS sse_timeout, CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE 120 END AS sse_read_timeout,
 'wa' AS wa_config_id, 'provider' AS llm_provider, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'First' END AS first_name,
 CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(9000000000 + c_custkey AS VARCHAR(12)) END AS mobile FROM customer"""


@add("audit_accounts", oracle([], """SELECT account, 'missing account_name' AS problem FROM a WHERE account_name = ''
 UNION ALL SELECT account, 'missing workspace_id' FROM a WHERE workspace_id IS NULL
 UNION ALL SELECT account, 'missing sse_read_timeout' FROM a WHERE sse_read_timeout = 0
 UNION ALL SELECT account, 'seller_details malformed' FROM a WHERE first_name IS NULL OR mobile IS NULL
 UNION ALL SELECT account, 'phone mismatch' FROM a WHERE phone <> '9000000001'""", a=ACCOUNTS))
def audit_accounts(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    rows = spark.sql(ACCOUNTS).withColumn(
        "seller_details", F.struct(F.col("first_name").alias("firstName"), "mobile"))
    return accounts.audit_accounts(rows, "9000000001")
