"""Conversations and turns, from chain runs or from message rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoscope.functions import variant as v
from dialoscope.functions.ordered import DEFAULT_BLOCK, running_counts, trailing_rows
from dialoscope.functions.text import (
    CLIP_QUERY,
    CLIP_RESPONSE,
    CLIP_TRANSCRIPT_QUERY,
    clip,
    first_text,
    is_blank,
)

# Role names, context width, transcript layout.
USER_ROLES = ("human", "user")
AGENT_ROLES = ("ai", "assistant")
CONTEXT_TURNS = 8
TURN_LAYOUT = "TURN {n} — USER: {query}\n  TOOLS: {tools}\n  AGENT: {response}"
NO_TOOLS = "none"
NO_RESPONSE = "(no text response)"


def run_messages(runs: DataFrame) -> DataFrame:
    """Add ``messages`` (array<variant>) to runs; runs without a list of objects fall out.

    ``inputs.messages`` unless that is absent or empty, else ``inputs.input``.
    """
    chosen = (f"CASE WHEN {v.truthy(v.node('inputs', '$.messages'))} THEN {v.list_at('inputs', '$.messages')} "
              f"ELSE {v.list_at('inputs', '$.input')} END")
    listed = runs.withColumn("messages", F.expr(chosen))
    return listed.where(F.expr(v.is_object("get(messages, 0)")))


def session_key(runs: DataFrame) -> DataFrame:
    """Add ``session_id``: one of two metadata keys, else the run id."""
    keys = ("langfuse_session_id", "session_id")
    # extra.metadata wins over metadata when it holds anything
    md = (f"CASE WHEN {v.truthy(v.node('extra', '$.metadata'))} THEN {v.node('extra', '$.metadata')} "
          "ELSE metadata END")
    rows = runs.withColumn("__md", F.expr(md))
    found = [F.expr(f"CASE WHEN {v.truthy(v.node('__md', f'$.{k}'))} THEN {v.stringify(v.node('__md', f'$.{k}'))} END")
             for k in keys]
    return rows.withColumn("session_id", F.coalesce(*found, F.col("run_id").cast("string"))).drop("__md")


def fullest_runs(sizes: DataFrame, run: str = "run_id", arrival: str = "start_time") -> DataFrame:
    """Per session the run with the longest message list; on ties the one that came last in time.

    Takes (session_id, run id, size, arrival) only: bodies are joined back for the winners alone.
    """
    return sizes.groupBy("session_id").agg(
        F.max_by(run, F.struct("size", arrival, run)).alias(run), F.max("size").alias("size"))


def fullest_conversations(runs: DataFrame) -> DataFrame:
    """Chain runs with ``messages`` and ``session_id`` reduced to the fullest one per session."""
    sizes = runs.select("session_id", "run_id", F.size("messages").alias("size"), "start_time")
    winners = fullest_runs(sizes).select("session_id", "run_id")
    return runs.join(winners, ["session_id", "run_id"], "left_semi")


def fullest_message_rows(messages: DataFrame, run: str = "run_id") -> DataFrame:
    """The same over message rows (session_id, run id, pos, ...), where run ids grow with arrival."""
    sizes = messages.groupBy("session_id", run).agg(F.count("*").alias("size"))
    winners = fullest_runs(sizes, run, run).select("session_id", run)
    return messages.join(winners, ["session_id", run], "left_semi")


def message_rows(conversations: DataFrame) -> DataFrame:
    """Messages of each conversation as rows: pos, role, content, tool_name."""
    rows = conversations.select("session_id", F.posexplode("messages").alias("pos", "m"))
    rows = rows.where(F.expr(v.is_object("m")))
    text = {k: F.expr(v.text_at("m", f"$.{k}")) for k in ("role", "type", "name", "tool_name")}
    return rows.select("session_id", F.col("pos").cast("bigint").alias("pos"),
                       F.coalesce(first_text(text["role"], text["type"]), F.lit("")).alias("role"),
                       F.expr(v.message_text("m")).alias("content"),
                       F.coalesce(first_text(text["name"], text["tool_name"]), F.lit("tool")).alias("tool_name"))


def to_turns(messages: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """User turns of each session, numbered from 1: query, response, tool_calls, total_turns.

    A user message opens a turn; the last non-empty agent text answers it; tool
    names are kept once each, in order of first use.  Messages before the first
    user message are ignored and turns with a blank query are dropped before
    numbering.
    """
    is_user = F.col("role").isin(*USER_ROLES)
    counted = running_counts(
        messages.select("session_id", "pos", "role", "content", "tool_name"), ["session_id"], "pos",
        {"opened": is_user, "turn_index": is_user & ~is_blank("content")},
        totals={"total_turns": "turn_index"}, block=block)
    says = F.col("role").isin(*AGENT_ROLES) & (F.length("content") > 0)
    tool = F.when(F.col("role") == "tool", F.col("tool_name"))
    # per tool first, so that a turn with very many tool messages is condensed before it meets
    per_tool = counted.where(F.col("opened") > 0).groupBy("session_id", "opened", tool.alias("tool")).agg(
        F.min("pos").alias("tool_pos"),
        F.max(F.when(is_user, F.struct("content", "turn_index"))).alias("asked"),
        F.max(F.when(says, F.struct("pos", "content"))).alias("said"),
        F.max("total_turns").alias("total_turns"))
    turns = per_tool.groupBy("session_id", "opened").agg(
        F.max("asked").alias("asked"), F.max("said").alias("said"), F.max("total_turns").alias("total_turns"),
        F.array_sort(F.collect_list(F.when(F.col("tool").isNotNull(), F.struct("tool_pos", "tool")))).alias("used"))
    return turns.select(
        "session_id", F.col("asked.turn_index").alias("turn_index"), "total_turns",
        F.col("asked.content").alias("query"), F.coalesce("said.content", F.lit("")).alias("response"),
        F.transform("used", lambda u: u["tool"]).alias("tool_calls")).where(~is_blank("query"))


def turn_context(turns: DataFrame, template: str | None = None, block: int = 4096) -> DataFrame:
    """Add ``context``: up to eight earlier turns and this one; with a template also ``prompt``."""
    tools = F.when(F.size("tool_calls") > 0, F.array_join("tool_calls", ", ")).otherwise(NO_TOOLS)
    said = clip(F.when(F.length("response") > 0, F.col("response")).otherwise(NO_RESPONSE), CLIP_RESPONSE)
    head, rest = TURN_LAYOUT.split("{n}")
    before, rest = rest.split("{query}")
    between, tail = rest.split("{tools}")
    text = F.concat(F.lit(head), F.col("turn_index").cast("string"), F.lit(before),
                    clip("query", CLIP_TRANSCRIPT_QUERY), F.lit(between), tools,
                    F.lit(tail.replace("{response}", "")), said)
    out = trailing_rows(turns, ["session_id"], "turn_index", CONTEXT_TURNS, text, "__lines", block)
    out = out.withColumn("context", F.array_join("__lines", "\n\n")).drop("__lines")
    if template is not None:
        filled = F.replace(F.lit(template), F.lit("{{CONVERSATION}}"), F.col("context"))
        out = out.withColumn("prompt", F.replace(filled, F.lit("{{TURN_INDEX}}"), F.col("turn_index").cast("string")))
    return out


def turn_results(turns: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Turns with their verdict; ``judged`` is false where the judge gave none."""
    cols = [c for c in ("quality", "score", "data_present", "context_used", "new_flow", "reason", "judge_seconds",
                        "evaluated_at") if c in verdicts.columns]
    v_rows = verdicts.select("session_id", "turn_index", *cols, F.lit(True).alias("__j"))
    return turns.join(v_rows, ["session_id", "turn_index"], "left").select(
        "session_id", "turn_index", "total_turns", clip("query", CLIP_QUERY).alias("query"),
        clip("response", CLIP_RESPONSE).alias("response"), "tool_calls", *cols,
        F.coalesce("__j", F.lit(False)).alias("judged"))


def skipped_conversations(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Conversations that yield no turn."""
    return conversations.select("session_id").distinct().join(
        turns.select("session_id").distinct(), "session_id", "left_anti")


def redundant_calls(calls: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Same tool with the same arguments called more than once in a session."""
    return (calls.groupBy(*keys, "name", "arguments").agg(F.count("*").alias("calls"))
            .where(F.col("calls") > 1))


def context_dependent(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of turns that follow up on earlier ones and use them."""
    flag = ~F.coalesce(F.col("new_flow"), F.lit(False)) & F.coalesce(F.col("context_used"), F.lit(False))
    return results.groupBy(*keys).agg(F.count_if(flag).alias("context_dependent"), F.count("*").alias("turns"))
