"""Traced runs to one normalised row each.

``ingest_runs`` parses the JSON bodies to VARIANT once.  ``normalize_traces``
is a single narrow projection over them: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoscope.functions import variant as v
from dialoscope.functions.text import CLIP_ANSWER, is_blank

# Texts that give away a system prompt, and the length that does.
SYSTEM_PROMPT_MARKS: tuple[str, ...] = (
    "you are an expert",
    "you are a helpful assistant",
    "your task is to",
    "you are a tool selector",
    "do not evaluate the quality",
    "evaluate whether the agent selected",
)
SYSTEM_PROMPT_LENGTH = 500
QUERY_KEYS = ("question", "query", "input", "user_query", "prompt")
ANSWER_KEYS = ("answer", "response", "result", "text", "content")
CALL_KEYS = ("tool_calls", "tools", "function_calls")


def ingest_runs(raw: DataFrame, bodies: Sequence[str] = ("inputs", "outputs", "extra", "metadata", "child_runs"),
                ) -> DataFrame:
    """Parse JSON text bodies to VARIANT (absent ones become NULL) and keep the first long input text.

    VARIANT sorts object keys, so the one rule that depends on document order
    is evaluated here, on the text: the first string input of 4 to 1999 characters.
    """
    first_long = ("get(filter(map_entries(from_json(inputs, 'map<string,variant>')), e -> "
                  "coalesce(schema_of_variant(e.value) = 'STRING', false) AND "
                  "length(try_variant_get(e.value, '$', 'string')) BETWEEN 4 AND 1999), 0).value")
    out = raw.withColumn("first_long_input", F.expr(f"try_variant_get({first_long}, '$', 'string')"))
    for name in bodies:
        out = out.withColumn(name, F.try_parse_json(name) if name in raw.columns
                             else F.lit(None).cast("variant"))
    return out


def trace_metadata() -> Column:
    """``metadata``, else ``extra.metadata``, else an empty object."""
    nested = v.node("extra", "$.metadata")
    return F.expr(f"CASE WHEN {v.truthy('metadata')} THEN metadata WHEN {v.truthy(nested)} THEN {nested} "
                  "ELSE parse_json('{}') END")


def extract_query() -> Column:
    """User query: the first place that holds one."""
    lead = "$.messages[0][0]"
    ids = f"try_variant_get(inputs, '{lead}.id', 'array<string>')"
    serialized = (f"if({v.as_text('inputs', lead + '.type')} = 'constructor' AND "
                  f"contains(lower(try_element_at({ids}, -1)), 'human'), "
                  f"{v.some_text_at('inputs', lead + '.kwargs.content')}, NULL)")

    def first_content(path: str, who: str, roles: str) -> str:
        texts = (f"transform(filter({v.items_at('inputs', path)}, m -> coalesce({v.as_text('m', who)} IN ({roles}), "
                 f"false)), m -> {v.some_text_at('m', '$.content')})")
        return f"get(filter({texts}, x -> x IS NOT NULL), 0)"

    simple = first_content("$.messages", "$.type", "'human', 'user'")
    by_role = first_content("$.input.messages", "$.role", "'user'")
    title_node = v.node("extra", "$.metadata.title")
    title = f"CASE WHEN {v.truthy(title_node)} THEN {v.stringify(title_node, 2147483647)} END"
    direct = [f"CASE WHEN length({v.text_at('inputs', '$.' + k)}) > 2 THEN {v.as_text('inputs', '$.' + k)} END"
              for k in QUERY_KEYS]
    return F.expr("coalesce(" + ", ".join([serialized, simple, by_role, title, *direct, "first_long_input", "''"]) + ")")


def _call(name: str, arguments: str, as_object: str, defined: bool = False) -> str:
    return (f"named_struct('name', {name}, 'arguments', {arguments}, 'arguments_dict', {as_object}, "
            f"'from_definitions', {str(defined).lower()})")


def _object_or_empty(x: str) -> str:
    return f"if({v.is_object(x)}, {x}, parse_json('{{}}'))"


def _run_call(name: str, inputs: str) -> str:
    """A tool run or tool child as a call: its name and its inputs, an empty object for falsy ones."""
    text = f"if({v.truthy(inputs)}, {v.stringify(inputs)}, '{{}}')"
    return _call(name, text, _object_or_empty(inputs))


def message_calls(m: str) -> str:
    """Calls carried by one message: serialized, parsed and raw forms, in that order, not deduplicated."""
    def function_call(t: str) -> str:
        raw = v.node(t, "$.function.arguments")
        as_object = (f"if({v.is_object(v.node(t, '$.function'))}, "
                     f"{v.try_object(v.text_at(t, '$.function.arguments'))}, parse_json('{{}}'))")
        return _call(f"coalesce({v.as_text(t, '$.function.name')}, '')", v.stringify(raw, 2147483647), as_object)

    serialized = f"transform({v.objects(v.list_at(m, '$.kwargs.tool_calls'))}, t -> {function_call('t')})"
    args = v.node("t", "$.args")
    parsed = (f"transform(filter({v.items_at(m, '$.tool_calls')}, "
              f"t -> coalesce({v.as_text('t', '$.type')} = 'tool_call', false)), t -> "
              + _call(f"coalesce({v.as_text('t', '$.name')}, '')", v.stringify(args), _object_or_empty(args)) + ")")
    raw = (f"transform(filter({v.items_at(m, '$.additional_kwargs.tool_calls')}, "
           f"t -> {v.is_object(v.node('t', '$.function'))}), t -> {function_call('t')})")
    return f"concat({serialized}, {parsed}, {raw})"


def _generations() -> str:
    """All generation elements of the outputs."""
    return f"flatten(transform({v.items_at('outputs', '$.generations')}, g -> {v.items_at('g', '$')}))"


def extract_tool_calls(dedupe: bool = False) -> Column:
    """All tool calls of a run.

    A tool run is its own call.  Otherwise calls of child runs, generations,
    evaluated messages and outputs add up in that order; tool definitions serve
    only when there is no call at all.
    """
    own = f"array({_run_call('coalesce(name, \'unknown\')', 'inputs')})"
    children = (f"transform(filter({v.items_at('child_runs', '$')}, "
                f"c -> coalesce({v.as_text('c', '$.run_type')} = 'tool', false)), c -> "
                + _run_call(f"coalesce({v.as_text('c', '$.name')}, 'unknown')", v.node("c", "$.inputs")) + ")")
    generations = f"flatten(transform({_generations()}, g -> {message_calls(v.node('g', '$.message'))}))"
    judged = ", ".join(
        f"flatten(transform({v.items_at('inputs', f'$.{side}.messages')}, m -> {message_calls('m')}))"
        for side in ("input", "output"))
    args = f"coalesce({v.node('t', '$.arguments')}, {v.node('t', '$.args')})"
    outputs = ", ".join(
        f"transform({v.objects(v.list_at('outputs', f'$.{k}'))}, t -> "
        + _call(f"coalesce({v.as_text('t', '$.name')}, {v.as_text('t', '$.tool')}, 'unknown')",
                v.stringify(args), _object_or_empty(args)) + ")" for k in CALL_KEYS)
    named = f"coalesce({v.as_text('t', '$.function.name')} <> '', false)"
    defined = _call(v.as_text("t", "$.function.name"), "'{}'", "parse_json('{}')", True)
    definitions = f"transform(filter({v.items_at('extra', '$.invocation_params.tools')}, t -> {named}), t -> {defined})"
    called = f"concat({children}, {generations}, {judged}, {outputs})"
    if dedupe:
        called = (f"transform(array_distinct(transform({called}, c -> struct(c.name AS n, c.arguments AS a))), "
                  f"d -> {_call('d.n', 'd.a', v.try_object('d.a'))})")
    return F.expr(f"CASE WHEN run_type = 'tool' THEN {own} ELSE "
                  f"transform(array({called}), cs -> if(size(cs) > 0, cs, {definitions}))[0] END")


def primary_tool(calls: str = "tool_calls") -> Column:
    return F.coalesce(F.get(calls, F.lit(0))["name"], F.lit("none"))


def primary_arguments(calls: str = "tool_calls") -> Column:
    return F.coalesce(F.get(calls, F.lit(0))["arguments"], F.lit("{}"))


def tool_names(calls: str = "tool_calls") -> Column:
    """Distinct names, sorted."""
    return F.array_sort(F.array_distinct(F.transform(calls, lambda c: c["name"])))


def extract_answer() -> Column:
    """Final answer: the first place that holds a non-empty text, clipped."""
    output = v.some_text_at("outputs", "$.output.content")
    generated = (f"get(filter(transform({_generations()}, g -> {v.some_text_at('g', '$.message.kwargs.content')}), "
                 "x -> x IS NOT NULL), 0)")
    direct = [v.some_text_at("outputs", f"$.{k}") for k in ANSWER_KEYS]
    said = [(f"try_element_at(filter(transform(filter({v.items_at('inputs', f'$.{side}.messages')}, "
             f"m -> coalesce({v.as_text('m', '$.type')} = 'ai', false)), m -> {v.some_text_at('m', '$.content')}), "
             "x -> x IS NOT NULL), -1)") for side in ("output", "input")]
    return F.expr(f"substring(coalesce({', '.join([output, generated, *direct, *said])}, ''), 1, {CLIP_ANSWER})")


def normalize_traces(runs: DataFrame, dedupe: bool = False) -> DataFrame:
    """Ingested runs to traces; bodies are dropped here."""
    keep = [c for c in ("session_id", "start_time", "project") if c in runs.columns]
    # The generator keeps filters on these two columns from being pushed below
    # it, where each mention of a column would evaluate its extraction again.
    found = F.inline(F.array(F.struct(extract_query().alias("user_query"),
                                      extract_tool_calls(dedupe).alias("tool_calls"))))
    base = runs.select(
        "run_id", *keep, F.coalesce("run_type", F.lit("unknown")).alias("run_type"),
        F.coalesce("name", F.lit("")).alias("run_name"), trace_metadata().alias("metadata"), found,
        extract_answer().alias("final_answer"))
    return (base.withColumn("tool_names", tool_names()).withColumn("selected_tool", primary_tool())
            .withColumn("tool_arguments", primary_arguments()))


def feedback_summary() -> Column:
    """What a feedback comment tells about the trace."""
    return F.struct("run_type", F.col("user_query").alias("query"), "selected_tool",
                    F.col("tool_names").alias("all_candidate_tools"))


def is_system_prompt(query: Column | str = "user_query", more_marks: Sequence[str] = ()) -> Column:
    """Does the text look like a system prompt?  Add a deployment's own self-introduction to the marks."""
    c = F.col(query) if isinstance(query, str) else query
    low = F.lower(c)
    hit = F.length(c) > SYSTEM_PROMPT_LENGTH
    for mark in (*SYSTEM_PROMPT_MARKS, *more_marks):
        hit = hit | low.contains(mark)
    return hit


def skip_reason(more_marks: Sequence[str] = ()) -> Column:
    """Why a trace is not evaluated; NULL when it is."""
    defined = F.coalesce(F.get("tool_calls", F.lit(0))["from_definitions"], F.lit(False))
    no_id = F.coalesce(F.length(F.col("run_id").cast("string")) == 0, F.lit(True))
    return (F.when(no_id, "no id").when(is_blank("user_query"), "no query")
            .when(is_system_prompt("user_query", more_marks), "system prompt")
            .when(defined, "definitions only"))


def evaluable(traces: DataFrame, more_marks: Sequence[str] = ()) -> DataFrame:
    """Traces worth judging."""
    return traces.where(skip_reason(more_marks).isNull())


def records_as_traces(records: DataFrame) -> DataFrame:
    """Result records in the trace shape, to be judged offline."""
    first = F.get("tool_calls", F.lit(0))
    return records.select(
        "account", "run_version", F.col("query_index").alias("run_id"), F.lit("record").alias("run_type"),
        F.col("query").alias("user_query"), F.coalesce(first["tool"], F.lit("none")).alias("selected_tool"),
        F.coalesce(F.to_json(first["input"]), F.lit("{}")).alias("tool_arguments"),
        F.col("response").alias("final_answer"))


def unseen(runs: DataFrame, seen: DataFrame, on: str = "run_id") -> DataFrame:
    """Runs not processed before; each id once."""
    return runs.join(seen.select(on), on, "left_anti").dropDuplicates([on])
