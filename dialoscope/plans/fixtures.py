"""Derived inputs over the driver tables, as SQL text shared by Spark and the oracle.

The text runs unchanged in both engines.  The one engine-specific piece is
repeating each row for a few constants, written ``@each(table, name, 1, 2)``.
Whole tables and whole texts are used throughout.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from dialoscope.session import shared_dir

FIXTURES: dict[str, str] = {
    "eval_records": """
SELECT d.run_version, d.doc_id AS query_index, d.source AS category, d.text AS query,
 CASE WHEN (d.doc_id + d.run_version) % 41 = 0 THEN 'IncompleteRead(395 bytes read)' END AS error,
 CASE (d.doc_id * 7 + d.run_version) % 12
  WHEN 0 THEN '' WHEN 1 THEN 'No products were found for this window.'
  WHEN 2 THEN 'Please try again shortly.' WHEN 3 THEN 'I can''t verify purchase frequency here.'
  WHEN 4 THEN concat('Sorted by amount, 12.5% share: ', d.text)
  WHEN 5 THEN '| sku | qty |
' || '| a | 12 |'
  WHEN 6 THEN 'The request was rejected by the workspace.' WHEN 7 THEN 'If you want, the card has a show more link.'
  WHEN 8 THEN 'Short reply.' WHEN 9 THEN 'I''ll treat this as a customer group question; log out and try again.'
  ELSE d.text END AS response,
 CAST(((d.doc_id * 37 + d.run_version * 1100) % 5000) AS DOUBLE) / 100 AS response_time_seconds,
 CASE d.doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'search_threads' WHEN 2 THEN 'get_channel_data → search_threads' ELSE 'get_sales' END AS expected_tool,
 CASE (d.doc_id + d.run_version) % 5 WHEN 0 THEN '' WHEN 1 THEN 'get_sales' WHEN 2 THEN 'search_threads' WHEN 3 THEN 'get_channel_data,search_threads' ELSE 'get_invoice_data' END AS tools_csv,
 (d.doc_id * 3 + d.run_version) % 17 AS step_count
FROM @each(documents, run_version, 1, 2) d
""",
    "session_messages": """
SELECT c.conv_id AS session_id, c.conv_id * 10 + c.k AS run_id, c.turn AS pos,
 CASE c.role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE c.role END AS role, c.text AS content
FROM @each(conversations, k, 0, 1, 2) c
WHERE c.k = 2 OR c.turn < (c.k + 1) * 3
""",
    "sse_frames": """
SELECT user_id * 1000 + CAST(floor(event_id / 2000) AS BIGINT) AS thread_id, event_id AS seq, ts,
 CASE event_type WHEN 'view' THEN 'status' WHEN 'click' THEN 'token' WHEN 'purchase' THEN 'tool_start' WHEN 'signup' THEN 'suggestions' ELSE 'done' END AS event,
 CASE event_type WHEN 'view' THEN CASE event_id % 3 WHEN 0 THEN '{"phase":"tool_start","tool":"get_sales","input":{"d":1}}' ELSE '{"phase":"thinking"}' END WHEN 'click' THEN concat('{"content":"t', CAST(event_id AS VARCHAR(20)), ' "}')
  WHEN 'purchase' THEN concat('{"tool":"tool_', CAST(event_id % 7 AS VARCHAR(20)), '","input":', props, '}')
  WHEN 'signup' THEN concat('{"suggestions":["s', CAST(event_id AS VARCHAR(20)), '"]}') ELSE '{}' END AS data
FROM events
""",
    "registry": """
SELECT * FROM (VALUES (1,'search_threads','conversation_read',true,'Search threads'),
 (2,'search_messages','conversation_read',true,'Search messages'),(3,'get_channel_data','conversation_read',true,'Channel lookup'),
 (4,'get_sales','sales_analytics',true,'Ranked sales'),(5,'think','agent_internal',true,'Reasoning step'),
 (6,'old_report','sales_analytics',false,'Retired report')) AS t(ord,name,family,enabled,description)
""",
    "suite_rows_a": """
SELECT doc_id + 2 AS row_idx, doc_id % 10 = 3 AS is_bold,
 CASE WHEN doc_id % 10 = 3 THEN concat(' Category ', CAST(CAST(floor(doc_id / 10) AS BIGINT) % 7 AS VARCHAR(9)), ' ') WHEN doc_id % 10 = 7 THEN NULL ELSE concat('  ', text) END AS c1,
 CASE WHEN doc_id % 3 = 0 THEN concat(source, ' ') END AS c2, CASE WHEN doc_id % 5 = 0 THEN 'Report generated' END AS c3,
 CASE doc_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN 'get_sales ' WHEN 2 THEN 'get_channel_data → search_threads' END AS c4
FROM documents
""",
    "bot_results": """
SELECT concat('bot', CAST(conv_id % 5 AS VARCHAR(9))) AS bot_name, conv_id AS case_seq, turn AS turn_seq,
 CASE turn % 3 WHEN 0 THEN 'Finance' WHEN 1 THEN 'Orders' ELSE 'Edge Case' END AS category, text AS query,
 CASE WHEN (conv_id + turn) % 11 = 0 THEN NULL ELSE CASE (conv_id + turn) % 4 WHEN 0 THEN 'interactive' WHEN 1 THEN 'text' WHEN 2 THEN 'cta_url' ELSE 'empty' END END AS response_type,
 CASE (conv_id + turn) % 4 WHEN 0 THEN concat('You are Connected: ', text) WHEN 1 THEN 'Sorry, I couldn''t do that, something went wrong.' WHEN 2 THEN text ELSE ' ' END AS response_text,
 CASE WHEN (conv_id + turn) % 3 = 0 THEN 'handover_to_human' WHEN (conv_id + turn) % 3 = 1 THEN 'handover_to_payment_agent' ELSE '' END AS tools_csv,
 CASE WHEN (conv_id + turn) % 13 = 0 THEN 'timeout (30s)' END AS error,
 CAST((conv_id * 31 + turn * 7) % 1500 AS DOUBLE) / 100 AS response_time_seconds,
 CASE WHEN (conv_id + turn) % 5 <> 0 THEN concat('chat', CAST(conv_id AS VARCHAR(9)), '_', CAST(turn AS VARCHAR(9))) END AS chat_id
FROM conversations
""",
    "bot_expectations": """
SELECT * FROM (VALUES ('Finance', CAST(NULL AS VARCHAR(20)), '', 'couldn''t,sorry,went wrong', '', ''),
 ('Orders', 'interactive', 'connected', '', '', 'handover_to_payment_agent'), ('Edge Case', CAST(NULL AS VARCHAR(20)), '', '', 'handover_to_human', ''))
 AS t(category, exp_response_type, contains_csv, not_contains_csv, exp_tool, not_tool_csv)
""",
    "trace_runs": """
SELECT event_id AS run_id, ts AS start_time, concat('sess', CAST(user_id % 40 AS VARCHAR(9))) AS session_id,
 CASE event_id % 8 WHEN 0 THEN 'tool' WHEN 2 THEN 'llm' ELSE 'chain' END AS run_type,
 CASE event_id % 8 WHEN 0 THEN CASE event_id % 3 WHEN 0 THEN 'get_sales' WHEN 1 THEN 'search_threads' ELSE 'get_invoice_data' END ELSE 'agent_node' END AS name,
 CASE event_id % 8
  WHEN 0 THEN concat('{"zone":', CAST(event_id % 9 AS VARCHAR(9)), '}')
  WHEN 1 THEN concat('{"messages":[{"type":"system","content":"x"},{"type":"human","content":"sales for user ', CAST(user_id AS VARCHAR(9)), '"}]}')
  WHEN 2 THEN concat('{"messages":[[{"type":"constructor","id":["schema","HumanMessage"],"kwargs":{"content":"stock of ', CAST(event_id AS VARCHAR(9)), '"}}]]}')
  WHEN 3 THEN concat('{"input":{"messages":[{"role":"user","content":"ledger ', CAST(user_id AS VARCHAR(9)), '"}]},"output":{"messages":[{"type":"ai","content":"done","tool_calls":[{"type":"tool_call","name":"search_threads","args":{"q":1}},{"type":"other","name":"no"}]}]}}')
  WHEN 4 THEN concat('{"question":"who owes ', CAST(event_id AS VARCHAR(9)), '"}')
  WHEN 5 THEN '{"zeta":"ab","topic":"first long value","alpha":"second long value"}'
  WHEN 6 THEN '{"query":"only definitions here"}'
  ELSE '{"prompt":"You are a helpful assistant for sellers"}' END AS inputs,
 CASE event_id % 8
  WHEN 2 THEN '{"generations":[[{"message":{"kwargs":{"content":"answer","tool_calls":[{"function":{"name":"get_sales","arguments":"{}"}}]}}}]]}'
  WHEN 4 THEN '{"answer":"42","tool_calls":[{"tool":"think","args":{}},{"name":"get_sales","arguments":"{}"}]}' ELSE '{}' END AS outputs,
 CASE event_id % 8 WHEN 0 THEN concat('{"metadata":{"title":"Top sales ', CAST(event_id AS VARCHAR(9)), '"}}')
  WHEN 6 THEN '{"invocation_params":{"tools":[{"function":{"name":"think"}},{"function":{"name":"write_todos"}}]}}' ELSE '{}' END AS extra
FROM events
""",
    "trace_branches": """
SELECT event_id AS run_id, 'chain' AS run_type, 'agent_node' AS name,
 CASE event_id % 4 WHEN 2 THEN concat('{"input":{"messages":[{"type":"ai","additional_kwargs":{"tool_calls":[{"function":{"name":"raw_', CAST(event_id % 5 AS VARCHAR(9)),
   '","arguments":"{}"}},{"function":"no"}]}}]}}') ELSE '{}' END AS inputs,
 '{}' AS outputs, CASE event_id % 2 WHEN 0 THEN concat('{"metadata":{"title":"t', CAST(event_id AS VARCHAR(9)), '"}}') ELSE '{}' END AS extra,
 CASE event_id % 3 WHEN 0 THEN concat('{"owner":"u', CAST(user_id AS VARCHAR(9)), '"}') WHEN 1 THEN '{}' END AS metadata,
 CASE event_id % 4 WHEN 1 THEN concat('[{"run_type":"tool","name":"child_', CAST(event_id % 7 AS VARCHAR(9)), '","inputs":{"d":1}},{"run_type":"llm","name":"no"},{"run_type":"tool"}]')
  ELSE '[]' END AS child_runs
FROM events
""",
    "tool_verdicts": """
SELECT event_id AS run_id, a.attempt,
 CASE (event_id * 3 + a.attempt) % 6 WHEN 0 THEN 'not json' WHEN 1 THEN '{"expected_tool":"get_sales","score":0.5}'
  WHEN 2 THEN '{"expected_tool":"get_sales","selected_tool":"get_sales","score":1.5,"reason":"r","candidate_tools":[]}'
  WHEN 3 THEN '{"expected_tool":"none","selected_tool":"think","score":0.0,"reason":"r","candidate_tools":["think"]}'
  ELSE '{"expected_tool":"get_sales","selected_tool":"get_sales","score":1.0,"reason":"r","candidate_tools":["get_sales","think"]}' END AS reply
FROM @each(events, attempt, 1, 2, 3) a
""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

_EACH = re.compile(r"@each\((\w+), (\w+), ([\d, ]+)\)")


def spark_text(name: str) -> str:
    return _EACH.sub(r"(SELECT *, explode(array(\3)) AS \2 FROM \1)", FIXTURES[name])


def duck_text(name: str) -> str:
    return _EACH.sub(r"(SELECT *, unnest([\3]) AS \2 FROM \1)", FIXTURES[name])


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh shared folder; a local session without one writes below its warehouse."""
    if not spark.conf.get("spark.checkpoint.dir", "") and spark.sparkContext.master.startswith("local["):
        return f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch/{purpose}-{uuid.uuid4().hex}"
    return shared_dir(spark, purpose)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """What several parts of a query read, written once to the shared folder."""
    folder = scratch(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEYS = {"documents": "doc_id", "events": "event_id", "conversations": "conv_id"}


def fixture(spark: SparkSession, sf_dir: str, name: str, costly: bool = False) -> DataFrame:
    """One derived input as a DataFrame; ``costly`` deals the rows over all cores (a table here is one row group, hence one task).

    With a number of partitions, since without one AQE folds small shuffles to a single task.
    """
    text = spark_text(name)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            rows = table(spark, sf_dir, t)
            rows = rows.repartition(spark.sparkContext.defaultParallelism, _KEYS[t]) if costly and t in _KEYS else rows
            rows.createOrReplaceTempView(t)
    return spark.sql(text)


def oracle(names: list[str], body: str, **ctes: str) -> str:
    """DuckDB text: the named fixtures and further CTEs in front of ``body``."""
    parts = [f"{n} AS ({duck_text(n)})" for n in names]
    parts += [f"{n} AS ({sql})" for n, sql in ctes.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
