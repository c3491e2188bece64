"""Traced runs, judge replies, feedback."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from dialoscope.functions.text import strip_fences
from dialoscope.operators import browse, tools
from dialoscope.operators import traces as tr
from dialoscope.operators import turns as tn
from dialoscope.operators import verdicts as vd
from dialoscope.plans.catalog import Catalog
from dialoscope.plans.catalog.conversations import ROWS, conv, messages
from dialoscope.plans.fixtures import fixture, oracle
from dialoscope.plans.inputs import RECORDS_CTE, records, registry

CATALOG = Catalog()
add = CATALOG.add

NOW = datetime(2024, 1, 20, tzinfo=timezone.utc)

# ---- oracle side of trace normalisation ---------------------------------------------------------------

_DIRECT = ", ".join(f"CASE WHEN json_type(inputs, '$.{k}') = 'VARCHAR' AND length(inputs->>'$.{k}') > 2 "
                    f"THEN inputs->>'$.{k}' END" for k in tr.QUERY_KEYS)
_QUERY = f"""coalesce(
 CASE WHEN inputs->>'$.messages[0][0].type' = 'constructor'
  AND lower(inputs->>'$.messages[0][0].id[#-1]') LIKE '%human%' THEN inputs->>'$.messages[0][0].kwargs.content' END,
 list_filter(json_extract(inputs, '$.messages[*]'), lambda m: coalesce(m->>'$.type' IN ('human', 'user'), false))[1]->>'$.content',
 list_filter(json_extract(inputs, '$.input.messages[*]'), lambda m: coalesce(m->>'$.role' = 'user', false))[1]->>'$.content',
 extra->>'$.metadata.title', {_DIRECT},
 json_extract_string(inputs, '$.' || list_filter(json_keys(inputs), lambda k: json_type(inputs, '$.' || k) = 'VARCHAR'
  AND length(json_extract_string(inputs, '$.' || k)) BETWEEN 4 AND 1999)[1]), '')"""

_FUNCTIONS = ("list_transform(json_extract(outputs, '$.generations[*][*].message.kwargs.tool_calls[*].function'), "
              "lambda f: {'name': f->>'$.name', 'arguments': f->>'$.arguments'})")
_PARSED = " , ".join(
    f"list_transform(list_filter(json_extract(inputs, '$.{s}.messages[*].tool_calls[*]'), "
    "lambda t: coalesce(t->>'$.type' = 'tool_call', false)), "
    "lambda t: {'name': t->>'$.name', 'arguments': CAST(json_extract(t, '$.args') AS VARCHAR)})" for s in ("input", "output"))
_OUT = ("list_transform(json_extract(outputs, '$.tool_calls[*]'), lambda t: {'name': coalesce(t->>'$.name', t->>'$.tool'), "
        "'arguments': coalesce(t->>'$.arguments', t->>'$.args')})")
_DEFS = ("list_transform(json_extract(extra, '$.invocation_params.tools[*].function'), "
         "lambda f: {'name': f->>'$.name', 'arguments': '{}'})")

TRACES = f"""SELECT *, coalesce(calls[1].name, 'none') AS selected_tool, coalesce(calls[1].arguments, '{{}}') AS tool_arguments,
 array_to_string(list_transform(calls, lambda c: c.name), ',') AS called,
 array_to_string(list_sort(list_distinct(list_transform(calls, lambda c: c.name))), ',') AS tool_names
 FROM (SELECT run_id, session_id, start_time, run_type, name AS run_name, {_QUERY} AS user_query,
 CASE WHEN run_type = 'tool' THEN [{{'name': name, 'arguments': inputs}}] WHEN len(found) > 0 THEN found ELSE {_DEFS} END AS calls,
 run_type <> 'tool' AND len(found) = 0 AND len({_DEFS}) > 0 AS from_definitions,
 coalesce(outputs->>'$.generations[0][0].message.kwargs.content', outputs->>'$.answer',
  list_filter(json_extract(inputs, '$.output.messages[*]'), lambda m: coalesce(m->>'$.type' = 'ai', false))[-1]->>'$.content',
  '') AS final_answer, coalesce(CAST(json_extract(extra, '$.metadata') AS VARCHAR), '{{}}') AS metadata
 FROM (SELECT *, list_concat({_FUNCTIONS}, {_PARSED}, {_OUT}) AS found FROM trace_runs))"""
_SYSTEM = " OR ".join(f"contains(lower(user_query), '{m}')" for m in tr.SYSTEM_PROMPT_MARKS)
STATED = f"""SELECT *, CASE WHEN trim(user_query) = '' THEN 'no query' WHEN {_SYSTEM} OR length(user_query) > 500
 THEN 'system prompt' WHEN from_definitions THEN 'definitions only' ELSE '' END AS skip_reason FROM traces"""
# Replies in three dresses: bare, fenced with a language, fenced without.
REPLIES = """SELECT run_id, attempt, CASE run_id % 3 WHEN 0 THEN reply WHEN 1 THEN concat('```json', chr(10), reply, chr(10), '```')
 ELSE concat(' ```', reply, '``` ') END AS reply FROM tool_verdicts"""
BARE = "regexp_replace(regexp_replace(trim(reply), '^```(json)?', ''), '```$', '')"
VALID = f"""SELECT run_id, attempt, CASE WHEN json_valid(b) AND b->>'$.expected_tool' IS NOT NULL
 AND b->>'$.selected_tool' IS NOT NULL AND b->>'$.reason' IS NOT NULL AND json_type(b, '$.candidate_tools') IS NOT NULL
 AND CAST(b->>'$.score' AS DOUBLE) BETWEEN 0 AND 1 THEN b END AS verdict
 FROM (SELECT run_id, attempt, trim({BARE}, ' ' || chr(10)) AS b FROM replies)"""
PICKED = """SELECT run_id, v->>'$.expected_tool' AS expected_tool, v->>'$.selected_tool' AS selected_tool,
 CAST(v->>'$.score' AS DOUBLE) AS score, v->>'$.reason' AS reason,
 CAST(json_extract(v, '$.candidate_tools') AS VARCHAR) AS candidates, v IS NULL AS failed
 FROM (SELECT run_id, min_by(verdict, attempt) FILTER (verdict IS NOT NULL) AS v FROM valid WHERE attempt <= 2 GROUP BY 1)"""
STATES = """SELECT s.*, p.score, CASE WHEN skip_reason <> '' THEN 'skipped'
 WHEN selected_tool <> 'none' AND selected_tool NOT IN (SELECT name FROM registry) THEN 'wrong_phantom'
 WHEN p.score IS NULL THEN 'failed' WHEN p.score >= 1 THEN 'correct' ELSE 'wrong_known' END AS state
 FROM stated s LEFT JOIN (SELECT run_id, score FROM picked WHERE NOT failed) p USING (run_id)"""


def tq(body: str) -> str:
    return oracle(["trace_runs", "tool_verdicts", "registry"], body, traces=TRACES, stated=STATED, replies=REPLIES,
                  valid=VALID, picked=PICKED, states=STATES)


def runs(spark, sf):
    return tr.ingest_runs(fixture(spark, sf, "trace_runs", costly=True))


def traces(spark, sf):
    return tr.normalize_traces(runs(spark, sf))


def replies(spark, sf):
    fixture(spark, sf, "tool_verdicts", costly=True).createOrReplaceTempView("tool_verdicts")
    return spark.sql(REPLIES)


def picked(spark, sf):
    return vd.pick_attempt(replies(spark, sf))


def states(spark, sf):
    return vd.verdict_states(traces(spark, sf), picked(spark, sf), registry(spark, sf))


@add("trace_metadata", tq("SELECT run_id, metadata FROM traces"))
def trace_metadata(spark, sf):
    return runs(spark, sf).select("run_id", F.to_json(tr.trace_metadata()).alias("metadata"))


# Runs with metadata of their own, child runs and raw calls; what each gives follows from its number.
@add("trace_branches", oracle([], """SELECT event_id AS run_id, CASE WHEN event_id % 3 = 0 THEN '{"owner":"u' || user_id || '"}'
 WHEN event_id % 2 = 0 THEN '{"title":"t' || event_id || '"}' ELSE '{}' END AS metadata,
 CASE event_id % 4 WHEN 1 THEN 'child_' || (event_id % 7) || ',unknown' WHEN 2 THEN 'raw_' || (event_id % 5) ELSE '' END AS called,
 CASE event_id % 4 WHEN 1 THEN '{"d":1},{}' WHEN 2 THEN '{}' ELSE '' END AS arguments FROM events"""))
def trace_branches(spark, sf):
    rows = tr.ingest_runs(fixture(spark, sf, "trace_branches", costly=True))
    field = lambda name: F.array_join(F.transform("c", lambda x: x[name]), ",")
    return (rows.select("run_id", F.to_json(tr.trace_metadata()).alias("metadata"), tr.extract_tool_calls().alias("c"))
            .select("run_id", "metadata", field("name").alias("called"), field("arguments").alias("arguments")))


@add("trace_query", tq("SELECT run_id, user_query FROM traces"))
def trace_query(spark, sf):
    return runs(spark, sf).select("run_id", tr.extract_query().alias("user_query"))


@add("trace_tool_calls", tq("SELECT run_id, len(calls) AS calls, called FROM traces"))
def trace_tool_calls(spark, sf):
    return (runs(spark, sf).select("run_id", tr.extract_tool_calls().alias("c"))
            .select("run_id", F.size("c").cast("bigint").alias("calls"),
                    F.array_join(F.transform("c", lambda x: x["name"]), ",").alias("called")))


@add("trace_answer", tq("SELECT run_id, final_answer FROM traces"))
def trace_answer(spark, sf):
    return runs(spark, sf).select("run_id", tr.extract_answer().alias("final_answer"))


@add("normalized_traces", tq("""SELECT run_id, run_type, run_name, user_query, called, tool_names, selected_tool,
 tool_arguments, final_answer FROM traces"""))
def normalized_traces(spark, sf):
    return traces(spark, sf).select(
        "run_id", "run_type", "run_name", "user_query",
        F.array_join(F.transform("tool_calls", lambda x: x["name"]), ",").alias("called"),
        F.array_join("tool_names", ",").alias("tool_names"), "selected_tool", "tool_arguments", "final_answer")


@add("trace_feedback_summary", tq("""SELECT run_id, run_type AS s_type, user_query AS s_query, selected_tool AS s_tool,
 tool_names AS s_candidates FROM traces"""))
def trace_feedback_summary(spark, sf):
    s = traces(spark, sf).select("run_id", tr.feedback_summary().alias("s"))
    return s.select("run_id", F.col("s.run_type").alias("s_type"), F.col("s.query").alias("s_query"),
                    F.col("s.selected_tool").alias("s_tool"),
                    F.array_join("s.all_candidate_tools", ",").alias("s_candidates"))


@add("skip_reasons", tq("SELECT run_id, skip_reason FROM stated"))
def skip_reasons(spark, sf):
    return traces(spark, sf).select("run_id", F.coalesce(tr.skip_reason(), F.lit("")).alias("skip_reason"))


@add("evaluable_traces", tq("SELECT run_id FROM stated WHERE skip_reason = ''"))
def evaluable_traces(spark, sf):
    return tr.evaluable(traces(spark, sf)).select("run_id")


@add("system_prompts", tq(f"SELECT run_id, {_SYSTEM} OR length(user_query) > 500 AS system_prompt FROM traces"))
def system_prompts(spark, sf):
    return traces(spark, sf).select("run_id", tr.is_system_prompt().alias("system_prompt"))


@add("since_filter", oracle(["trace_runs"], """SELECT run_id, run_type FROM trace_runs
 WHERE start_time >= TIMESTAMP '2024-01-13 00:00:00'"""))
def since_filter(spark, sf):
    return browse.since_filter(fixture(spark, sf, "trace_runs"), "7d", now=NOW).select("run_id", "run_type")


@add("list_runs", oracle(["trace_runs"], """SELECT run_id, run_type FROM trace_runs WHERE run_type = 'chain'
 AND start_time >= TIMESTAMP '2024-01-05 00:00:00' ORDER BY start_time DESC, run_id LIMIT 100 OFFSET 100"""))
def list_runs(spark, sf):
    return browse.list_runs(fixture(spark, sf, "trace_runs"), run_type="chain", since="2024-01-05",
                            limit=100, offset=100).select("run_id", "run_type")


@add("list_project_runs", oracle(["trace_runs"], """SELECT run_id, run_type, session_id AS project FROM trace_runs
 WHERE session_id = 'sess7' AND start_time >= TIMESTAMP '2024-01-05 00:00:00'"""))
def list_project_runs(spark, sf):
    """All runs of one project."""
    runs = fixture(spark, sf, "trace_runs").withColumnRenamed("session_id", "project")
    return browse.list_runs(runs, project="sess7", since="2024-01-05").select("run_id", "run_type", "project")


@add("unseen_runs", oracle(["trace_runs"], """SELECT run_id FROM trace_runs
 WHERE start_time >= TIMESTAMP '2024-01-10 00:00:00'"""))
def unseen_runs(spark, sf):
    rows = fixture(spark, sf, "trace_runs")
    seen = rows.where("start_time < timestamp_ntz'2024-01-10 00:00:00'")
    return tr.unseen(rows, seen).select("run_id")


@add("records_as_traces", oracle(["eval_records"], """SELECT run_version, query_index AS run_id, query AS user_query,
 coalesce(tools[1], 'none') AS selected_tool, '{}' AS tool_arguments FROM records""", records=RECORDS_CTE))
def records_as_traces(spark, sf):
    return tr.records_as_traces(records(spark, sf)).select(
        "run_version", "run_id", "user_query", "selected_tool", "tool_arguments")


@add("strip_fences", tq(f"SELECT run_id, attempt, trim({BARE}, ' ' || chr(10)) AS reply FROM replies"))
def strip_fences_query(spark, sf):
    return replies(spark, sf).select("run_id", "attempt", strip_fences("reply").alias("reply"))


@add("validate_verdicts", tq("""SELECT run_id, attempt, verdict IS NOT NULL AS valid,
 coalesce(CAST(verdict->>'$.score' AS DOUBLE), -1.0) AS score FROM valid"""))
def validate_verdicts(spark, sf):
    v = replies(spark, sf).select("run_id", "attempt", vd.read_verdict(vd.validate_verdict("reply")).alias("v"))
    return v.select("run_id", "attempt", F.col("v").isNotNull().alias("valid"),
                    F.coalesce("v.score", F.lit(-1.0)).alias("score"))


@add("pick_attempt", tq("""SELECT run_id, coalesce(expected_tool, '') AS expected_tool, coalesce(score, -1.0) AS score,
 failed FROM picked"""))
def pick_attempt(spark, sf):
    return picked(spark, sf).select("run_id", F.coalesce("expected_tool", F.lit("")).alias("expected_tool"),
                                    F.coalesce("score", F.lit(-1.0)).alias("score"), "failed")


@add("verdicts_dropped", tq("""SELECT t.run_id, p.score, p.expected_tool FROM traces t JOIN picked p USING (run_id)
 WHERE NOT failed"""))
def verdicts_dropped(spark, sf):
    return vd.attach_verdicts(traces(spark, sf), picked(spark, sf)).select("run_id", "score", "expected_tool")


@add("verdicts_zeroed", tq("SELECT t.run_id, coalesce(p.score, 0.0) AS score FROM traces t LEFT JOIN picked p USING (run_id)"))
def verdicts_zeroed(spark, sf):
    return vd.attach_verdicts(traces(spark, sf), picked(spark, sf), "zero").select("run_id", "score")


@add("feedback_rows", tq("""SELECT t.run_id, 'tool_selection' AS key, p.score, '{"reason":"' || p.reason || '","expected_tool":"'
 || p.expected_tool || '","selected_tool":"' || p.selected_tool || '","candidate_tools":' || p.candidates || ',"query":"'
 || user_query || '","run_type":"' || run_type || '"}' AS comment FROM traces t JOIN picked p USING (run_id) WHERE NOT failed"""))
def feedback_rows(spark, sf):
    return vd.to_feedback(vd.attach_verdicts(traces(spark, sf), picked(spark, sf)))


@add("evaluation_examples", tq("""SELECT run_id, run_type, user_query AS query, tool_arguments AS tool_args, selected_tool
 FROM stated WHERE skip_reason = ''"""))
def evaluation_examples(spark, sf):
    ex = vd.build_examples(tr.evaluable(traces(spark, sf)))
    return ex.select("metadata.run_id", "metadata.run_type", "inputs.query", "inputs.tool_args", "outputs.selected_tool")


@add("judge_examples", tq("""SELECT run_id, 'tool_selection' AS key, CASE WHEN selected_tool = 'none' THEN 0.0 ELSE 1.0 END AS score,
 CASE WHEN selected_tool = 'none' THEN 'no tool' ELSE 'tool selected' END AS comment FROM stated WHERE skip_reason = ''"""))
def judge_examples(spark, sf):
    return vd.evaluate(vd.build_examples(tr.evaluable(traces(spark, sf))), target=vd.echo_target)


@add("toolsel_summary", tq("""SELECT count(*) AS seen, count(*) FILTER (state NOT IN ('skipped', 'failed')) AS evaluated,
 count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'skipped') AS skipped FROM states"""))
def toolsel_summary(spark, sf):
    return vd.toolsel_summary(states(spark, sf))


@add("verdict_breakdown", tq("SELECT state, count(*) AS n FROM states GROUP BY 1"))
def verdict_breakdown(spark, sf):
    return vd.verdict_breakdown(states(spark, sf))


@add("score_profile", tq("""SELECT run_type, score, count(*) AS n FROM traces JOIN picked USING (run_id)
 WHERE NOT failed GROUP BY 1, 2"""))
def score_profile(spark, sf):
    return vd.score_profile(vd.attach_verdicts(traces(spark, sf), picked(spark, sf)), ["run_type"])


@add("score_average", tq("""SELECT run_type, count(*) AS n, avg(score) AS avg_score FROM traces JOIN picked USING (run_id)
 WHERE NOT failed GROUP BY 1"""))
def score_average(spark, sf):
    return vd.score_average(vd.attach_verdicts(traces(spark, sf), picked(spark, sf)), ["run_type"])


@add("phantom_traces", tq("""SELECT run_id, selected_tool <> 'none' AND selected_tool NOT IN (SELECT name FROM registry) AS is_phantom
 FROM traces"""))
def phantom_traces(spark, sf):
    return tools.split_phantoms(traces(spark, sf), registry(spark, sf)).select("run_id", "is_phantom")


TEMPLATE = "Tools:\n{{TOOL_REGISTRY}}\nQuery: {{USER_QUERY}}\nTool: {{SELECTED_TOOL}} {{SELECTED_TOOL_ARGS}}"
_PROMPT = """'Tools:' || chr(10) || '| # | Tool | Family | Enabled | Description |' || chr(10)
 || '|---|------|--------|---------|-------------|' || chr(10) || (SELECT string_agg('| ' || ord || ' | `' || name || '` | ' || family
 || ' | ' || CASE WHEN enabled THEN '✅' ELSE '❌' END || ' | ' || description || ' |', chr(10) ORDER BY ord) FROM registry)
 || chr(10) || 'Query: ' || user_query || chr(10) || 'Tool: ' || selected_tool || ' ' || tool_arguments"""


def prompts(spark, sf):
    return vd.build_prompts(tr.evaluable(traces(spark, sf)), registry(spark, sf), TEMPLATE)


@add("judge_prompts", tq(f"SELECT run_id, {_PROMPT} AS prompt FROM stated WHERE skip_reason = ''"))
def judge_prompts(spark, sf):
    return prompts(spark, sf).select("run_id", "prompt")


# The cache holds the prompts of the runs before 10 January.
@add("uncached_prompts", tq(f"""SELECT run_id, sha256({_PROMPT}) AS prompt_hash FROM stated WHERE skip_reason = ''
 AND start_time >= TIMESTAMP '2024-01-10 00:00:00'"""))
def uncached_prompts(spark, sf):
    p = prompts(spark, sf)
    cache = (p.where("start_time < timestamp_ntz'2024-01-10 00:00:00'")
             .select("run_id", vd.prompt_key().alias("prompt_hash")))
    return vd.uncached(p, cache).select("run_id", "prompt_hash")


@add("redundant_calls", tq("""SELECT session_id, c.name AS name, c.arguments AS arguments, count(*) AS calls
 FROM (SELECT session_id, unnest(calls) AS c FROM stated WHERE NOT from_definitions) GROUP BY 1, 2, 3 HAVING count(*) > 1"""))
def redundant_calls(spark, sf):
    t = traces(spark, sf).select("session_id", F.explode("tool_calls").alias("c")).where("NOT c.from_definitions")
    return tn.redundant_calls(t.select("session_id", "c.name", "c.arguments"))


@add("session_keys", oracle(["trace_runs"], """SELECT run_id, CASE run_id % 3 WHEN 0 THEN session_id WHEN 1 THEN 's' || session_id
 ELSE CAST(run_id AS VARCHAR) END AS session_id FROM trace_runs"""))
def session_keys(spark, sf):
    raw = fixture(spark, sf, "trace_runs").selectExpr(
        "run_id", "CASE run_id % 3 WHEN 0 THEN concat('{\"metadata\":{\"session_id\":\"', session_id, '\"}}') "
        "WHEN 1 THEN '{}' ELSE '{\"metadata\":{\"session_id\":\"\"}}' END AS extra",
        "CASE run_id % 3 WHEN 1 THEN concat('{\"langfuse_session_id\":\"s', session_id, '\"}') END AS metadata", "'{}' AS inputs")
    return tn.session_key(tr.ingest_runs(raw)).select("run_id", "session_id")


@add("chain_run_turns", conv("SELECT session_id, turn_index, total_turns, query, response, tools FROM turns"))
def chain_run_turns(spark, sf):
    """From chain runs that each carry a message list, through the fullest one per session, to turns."""
    message = F.struct(F.col("role").alias("type"), "content", F.col("tool_name").alias("name"))
    listed = messages(spark, sf).groupBy("session_id", "run_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", message.alias("m")))).alias("ms"))
    raw = listed.select(
        "run_id", F.timestamp_seconds("run_id").alias("start_time"),
        F.to_json(F.struct(F.transform("ms", lambda x: x["m"]).alias("messages"))).alias("inputs"),
        F.to_json(F.struct(F.struct(F.col("session_id").cast("string").alias("session_id")).alias("metadata"))).alias("extra"))
    chains = tn.session_key(tn.run_messages(tr.ingest_runs(raw)))
    turns = tn.to_turns(tn.message_rows(tn.fullest_conversations(chains)))
    return turns.select(F.col("session_id").cast("bigint").alias("session_id"), "turn_index", "total_turns", "query",
                        "response", F.array_join("tool_calls", ",").alias("tools"))


# Every seventh session has no user message left.
SILENT = ROWS.replace("WHEN (session_id + pos) % 5 = 3 THEN 'tool'", "WHEN (session_id + pos) % 5 = 3 OR session_id % 7 = 0 THEN 'tool'")


@add("skipped_conversations", conv("""SELECT DISTINCT session_id FROM rows_ WHERE session_id NOT IN
 (SELECT session_id FROM turns)""").replace(ROWS, SILENT))
def skipped_conversations(spark, sf):
    messages(spark, sf)
    rows = spark.sql(SILENT)
    turns = tn.to_turns(tn.fullest_message_rows(rows))
    return tn.skipped_conversations(rows, turns)


