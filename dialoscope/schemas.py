"""Explicit schemas of the files the library reads.

Missing keys become NULL; nothing is inferred from data.  Kept as DDL text, so
that importing them needs no session.
"""

from __future__ import annotations

RECORDS = """
    query_index INT, query STRING, copilot_response STRING, remarks STRING, category STRING,
    expected_tool STRING, thread_id STRING, tool_calls ARRAY<STRUCT<tool: STRING, input: VARIANT>>,
    response STRING, status_sequence ARRAY<STRING>, suggestions ARRAY<STRING>,
    response_time_seconds DECIMAL(12,2), step_count INT, error STRING, timestamp STRING, run_version INT
"""

RUN_MANIFEST = """
    runs ARRAY<STRUCT<version: INT, run_id: STRING, file: STRING, results_file: STRING, timestamp: STRING,
        total_queries: INT, total_cases: INT, success: INT, passed: INT, failed: INT,
        avg_response_time_seconds: DECIMAL(12,2), bots_tested: ARRAY<STRING>>>,
    _corrupt STRING
"""

TURN_MANIFEST = """
    runs ARRAY<STRUCT<version: INT, file: STRING, timestamp: STRING, conversations: INT, turns: INT,
        succeeded: INT, failed: INT, avg_score: DOUBLE, quality: MAP<STRING, INT>>>,
    _corrupt STRING
"""

BOT_RESULTS = """
    query_id STRING, bot_name STRING, workspace_id STRING, customer_id STRING, query STRING, category STRING,
    response_type STRING, response_text STRING,
    menu_options ARRAY<STRUCT<title: STRING, description: STRING>>,
    tools_used ARRAY<STRUCT<name: STRING, args: VARIANT>>, knowledge_files ARRAY<STRING>,
    response_time_seconds DECIMAL(12,2), status_code INT, error STRING, passed BOOLEAN, fail_reason STRING,
    response_quality STRING, timestamp STRING, chat_id STRING
"""

EXPECTED = "STRUCT<response_type: STRING, contains: ARRAY<STRING>, not_contains: ARRAY<STRING>, tool: STRING, not_tool: ARRAY<STRING>>"

SCENARIO = f"""
    bot_name STRING, workspace_id STRING, customer_id STRING,
    test_cases ARRAY<STRUCT<id: STRING, query: STRING, category: STRING, expected: {EXPECTED}>>
"""

FRAMES = "thread_id BIGINT, seq BIGINT, ts TIMESTAMP, event STRING, data STRING"

CHUNKS = "thread_id STRING, seq BIGINT, chunk STRING"

WIRE_LOG = """
    log STRUCT<entries: ARRAY<STRUCT<time: DOUBLE, request: STRUCT<method: STRING, url: STRING>,
        response: STRUCT<status: INT>>>>
"""

TURN_VERDICTS = """
    session_id STRING, turn_index INT, total_turns INT, query STRING, response STRING,
    tool_calls ARRAY<STRING>, quality STRING, score DOUBLE, data_present BOOLEAN, context_used BOOLEAN,
    new_flow BOOLEAN, reason STRING, judge_seconds DOUBLE, evaluated_at STRING
"""
