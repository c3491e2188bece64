"""Conversations, turns, turn verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoscope.functions.text import clip
from dialoscope.operators import turns as tn
from dialoscope.operators import verdicts as vd
from dialoscope.plans.catalog import Catalog
from dialoscope.plans.fixtures import fixture, oracle, stored, table
from dialoscope.plans.inputs import half_up

CATALOG = Catalog()
add = CATALOG.add

# Message rows with some tool messages and blank user texts, so that every rule meets data.
ROWS = """SELECT session_id, run_id, pos, CASE WHEN (session_id + pos) % 5 = 3 THEN 'tool' ELSE role END AS role,
 CASE WHEN (session_id * 3 + pos) % 11 = 0 THEN ' ' ELSE content END AS content,
 concat('tool_', CAST(pos % 3 AS VARCHAR(3))) AS tool_name FROM session_messages"""


def messages(spark, sf):
    fixture(spark, sf, "session_messages").createOrReplaceTempView("session_messages")
    return spark.sql(ROWS)


WINNERS = """SELECT session_id, run_id, size FROM (SELECT *, row_number() OVER (PARTITION BY session_id
 ORDER BY size DESC, run_id DESC) AS rn FROM (SELECT session_id, run_id, count(*) AS size FROM rows_ GROUP BY 1, 2))
 WHERE rn = 1"""
FULL = "SELECT r.* FROM rows_ r JOIN winners w ON r.session_id = w.session_id AND r.run_id = w.run_id"
OPENED = """SELECT *, sum(CASE WHEN role IN ('human', 'user') THEN 1 ELSE 0 END) OVER
 (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opened FROM full_"""
TURNS = """SELECT session_id, row_number() OVER w AS turn_index, count(*) OVER (PARTITION BY session_id) AS total_turns,
 query, response, tools FROM (SELECT session_id, opened, max(content) FILTER (role IN ('human', 'user')) AS query,
  coalesce(max_by(content, pos) FILTER (role IN ('ai', 'assistant') AND content <> ''), '') AS response,
  (SELECT coalesce(string_agg(tool_name, ',' ORDER BY p), '') FROM (SELECT tool_name, min(pos) AS p FROM opened_ i
   WHERE i.session_id = o.session_id AND i.opened = o.opened AND role = 'tool' GROUP BY 1)) AS tools
  FROM opened_ o WHERE opened > 0 GROUP BY 1, 2)
 WHERE regexp_replace(query, '^\\s+|\\s+$', '', 'g') <> '' WINDOW w AS (PARTITION BY session_id ORDER BY opened)"""
# Verdicts derived from the turns; one in five turns has none.
VERDICTS = """SELECT session_id, turn_index, CASE (session_id + turn_index) % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'no_data'
 WHEN 2 THEN 'marginal' ELSE 'fail' END AS quality, CAST((session_id * 1237 + turn_index * 311) % 10001 AS DOUBLE) / 10000 AS score,
 turn_index % 2 = 0 AS context_used, turn_index % 3 = 0 AS new_flow, 'r' AS reason
 FROM turns WHERE (session_id + 2 * turn_index) % 5 <> 0"""


def conv(body: str, **more: str) -> str:
    return oracle(["session_messages"], body, rows_=ROWS, winners=WINNERS, full_=FULL, opened_=OPENED, turns=TURNS,
                  verdicts=VERDICTS, **more)


def full(spark, sf):
    return tn.fullest_message_rows(messages(spark, sf))


def turns(spark, sf):
    return tn.to_turns(full(spark, sf), block=4)


def verdicts(spark, sf):
    turns(spark, sf).createOrReplaceTempView("turns")
    return spark.sql(VERDICTS)


def one_pass(spark, sf):
    """Fullest conversations, their turns and verdicts: the messages are read once, each step is stored for those after it."""
    own = stored(full(spark, sf), "conversations")
    cut = stored(tn.to_turns(own, block=4), "turns")
    cut.createOrReplaceTempView("turns")
    return own, cut, spark.sql(VERDICTS)


@add("fullest_conversations", conv("SELECT session_id, run_id, pos FROM full_"))
def fullest_conversations(spark, sf):
    return full(spark, sf).select("session_id", "run_id", "pos")


@add("turns", conv("SELECT session_id, turn_index, total_turns, query, response, tools FROM turns"))
def turns_query(spark, sf):
    return turns(spark, sf).withColumn("tools", F.array_join("tool_calls", ",")).drop("tool_calls")


_TURN_TEXT = """concat('TURN ', turn_index, ' — USER: ', substr(query, 1, 400), chr(10), '  TOOLS: ',
 CASE WHEN tools = '' THEN 'none' ELSE replace(tools, ',', ', ') END, chr(10), '  AGENT: ',
 CASE WHEN response = '' THEN '(no text response)' ELSE substr(response, 1, 800) END)"""


@add("turn_context", conv(f"""SELECT t.session_id, t.turn_index, string_agg({_TURN_TEXT.replace('turn_index', 'p.turn_index')
 .replace('query', 'p.query').replace('tools', 'p.tools').replace('response,', 'p.response,')
 .replace('response =', 'p.response =')}, chr(10) || chr(10) ORDER BY p.turn_index) AS context
 FROM turns t JOIN turns p ON t.session_id = p.session_id AND p.turn_index BETWEEN t.turn_index - 8 AND t.turn_index
 GROUP BY 1, 2"""))
def turn_context(spark, sf):
    return tn.turn_context(turns(spark, sf), block=16).select("session_id", "turn_index", "context")


@add("turn_results", conv("""SELECT t.session_id, t.turn_index, t.total_turns, substr(t.query, 1, 500) AS query,
 substr(t.response, 1, 800) AS response, coalesce(v.quality, '') AS quality, coalesce(v.score, -1.0) AS score,
 v.session_id IS NOT NULL AS judged FROM turns t LEFT JOIN verdicts v USING (session_id, turn_index)"""))
def turn_results(spark, sf):
    _, cut, judged = one_pass(spark, sf)
    out = tn.turn_results(cut, judged)
    return out.select("session_id", "turn_index", "total_turns", "query", "response",
                      F.coalesce("quality", F.lit("")).alias("quality"), F.coalesce("score", F.lit(-1.0)).alias("score"),
                      "judged")


@add("multiturn_summary", conv(f"""SELECT (SELECT count(DISTINCT session_id) FROM full_) AS conversations,
 (SELECT count(*) FROM turns) AS turns, count(*) AS succeeded, (SELECT count(*) FROM turns) - count(*) AS failed,
 (SELECT count(DISTINCT session_id) FROM full_ WHERE session_id NOT IN (SELECT session_id FROM turns)) AS skipped,
 {half_up('CAST(sum(CAST(round(score * 10000) AS BIGINT)) AS BIGINT) * 100000', 'count(*) * 1000000', 0)} / 1000.0 AS avg_score,
 count(*) FILTER (quality = 'success') AS success, count(*) FILTER (quality = 'marginal') AS marginal,
 count(*) FILTER (quality = 'no_data') AS no_data, count(*) FILTER (quality = 'fail') AS fail FROM verdicts"""))
def multiturn_summary(spark, sf):
    return vd.multiturn_summary(*one_pass(spark, sf))


# Judge replies for turns, some without a field, with a score out of range or of another kind.
_REPLIES = """SELECT event_id, CASE event_id % 5
 WHEN 0 THEN concat('{"quality":"success","score":', CAST(event_id % 10 AS VARCHAR(9)), 'e-1,"data_present":true,"context_used":false,"new_flow":true,"reason":"r"}')
 WHEN 1 THEN '{"quality":"success","score":0.5,"data_present":true,"context_used":false,"new_flow":true}'
 WHEN 2 THEN '{"quality":"fail","score":1.5,"data_present":true,"context_used":false,"new_flow":true,"reason":"r"}'
 WHEN 3 THEN '{"quality":"fail","score":true,"data_present":true,"context_used":false,"new_flow":true,"reason":"r"}'
 ELSE '```json
{"quality":"no_data","score":1,"data_present":false,"context_used":true,"new_flow":false,"reason":"r"}
```' END AS reply FROM events"""


@add("validate_turn_verdicts", oracle([], """SELECT event_id, event_id % 5 IN (0, 4) AS valid,
 CASE event_id % 5 WHEN 0 THEN 'success' WHEN 4 THEN 'no_data' ELSE '' END AS quality FROM events"""))
def validate_turn_verdicts(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("events")
    v = spark.sql(_REPLIES).select("event_id", vd.validate_verdict("reply", vd.TURN_FIELDS).alias("v"))
    return v.select("event_id", F.col("v").isNotNull().alias("valid"),
                    F.coalesce(F.try_variant_get("v", "$.quality", "string"), F.lit("")).alias("quality"))


@add("conversation_scores", conv("""SELECT session_id, count(*) AS judged, avg(score) AS avg_score, min(score) AS min_score,
 CAST(count(*) FILTER (quality = 'success') AS DOUBLE) / count(*) AS success_share FROM verdicts GROUP BY 1"""))
def conversation_scores(spark, sf):
    return vd.conversation_scores(verdicts(spark, sf))


@add("context_dependent", conv("""SELECT session_id, count(*) FILTER (NOT new_flow AND context_used) AS context_dependent,
 count(*) AS turns FROM verdicts GROUP BY 1"""))
def context_dependent(spark, sf):
    return tn.context_dependent(verdicts(spark, sf), ["session_id"])


@add("clipped_messages", oracle(["session_messages"], """SELECT session_id, run_id, pos, substr(content, 1, 500) AS query,
 substr(content, 1, 800) AS response FROM session_messages"""))
def clipped_messages(spark, sf):
    return fixture(spark, sf, "session_messages").select(
        "session_id", "run_id", "pos", clip("content", 500).alias("query"), clip("content", 800).alias("response"))
