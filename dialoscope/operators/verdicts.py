"""Judge prompts, judge replies and what is made of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoscope.functions.quality import QUALITIES
from dialoscope.functions.text import ratio_round, strip_fences
from dialoscope.operators.traces import skip_reason

# The fields a reply must carry, the attempts allowed, the feedback key, registry layout.
TOOL_FIELDS = ("expected_tool", "selected_tool", "score", "reason", "candidate_tools")
TURN_FIELDS = ("quality", "score", "data_present", "context_used", "new_flow", "reason")
MAX_ATTEMPTS = 2
FEEDBACK_KEY = "tool_selection"
REGISTRY_HEADER = "| # | Tool | Family | Enabled | Description |\n|---|------|--------|---------|-------------|"
EMPTY_REGISTRY = "(No tools registered.)"
TOOL_PROMPT_SLOTS = ("{{TOOL_REGISTRY}}", "{{USER_QUERY}}", "{{SELECTED_TOOL}}", "{{SELECTED_TOOL_ARGS}}")


def registry_block(registry: DataFrame) -> DataFrame:
    """The registry as one markdown text (one row, column ``block``), which is what a prompt needs."""
    tick = F.when(F.col("enabled"), "✅").otherwise("❌")
    rows = F.array_sort(F.collect_list(F.struct("ord", "name", "family", tick.alias("tick"), "description")))
    lines = F.transform(rows, lambda r, i: F.concat(
        F.lit("| "), (i + 1).cast("string"), F.lit(" | `"), r["name"], F.lit("` | "), r["family"], F.lit(" | "),
        r["tick"], F.lit(" | "), r["description"], F.lit(" |")))
    return registry.agg(F.when(F.count("*") == 0, EMPTY_REGISTRY).otherwise(
        F.concat_ws("\n", F.lit(REGISTRY_HEADER), F.array_join(lines, "\n"))).alias("block"))


def build_prompts(traces: DataFrame, registry: DataFrame, template: str) -> DataFrame:
    """Add ``prompt``: the template with its four slots replaced one after the other.

    A slot name inside a query is replaced too, by a later step.
    """
    block = registry_block(registry).scalar()
    values = (block, F.col("user_query"), F.col("selected_tool"), F.col("tool_arguments"))
    text: Column = F.lit(template)
    for slot, value in zip(TOOL_PROMPT_SLOTS, values):
        text = F.replace(text, F.lit(slot), value)
    return traces.withColumn("prompt", text)


def prompt_key(prompt: Column | str = "prompt") -> Column:
    return F.sha2(F.col(prompt) if isinstance(prompt, str) else prompt, 256)


def uncached(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """Prompts without a verdict in the cache, which is keyed by (run_id, prompt_hash)."""
    keyed = prompts.withColumn("prompt_hash", prompt_key())
    return keyed.join(cache.select("run_id", "prompt_hash"), ["run_id", "prompt_hash"], "left_anti")


def validate_verdict(reply: Column | str, required: Sequence[str] = TOOL_FIELDS) -> Column:
    """Reply text to VARIANT verdict; NULL unless it is an object with all fields and a numeric score in [0, 1].

    A surrounding code fence is removed first.  A boolean is no score.
    """
    parsed = F.try_parse_json(strip_fences(reply))
    return _let(parsed, lambda x: F.when(_valid(x, required), x))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _valid(x: Column, required: Sequence[str]) -> Column:
    ok = F.try_variant_get(x, "$", "map<string,variant>").isNotNull()
    for name in required:
        ok = ok & F.try_variant_get(x, f"$.{name}", "variant").isNotNull()
    numeric = F.schema_of_variant(F.try_variant_get(x, "$.score", "variant")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    in_range = F.try_variant_get(x, "$.score", "double").between(0.0, 1.0)
    return ok & F.coalesce(numeric & in_range, F.lit(False))


def _typed(verdict: Column | str, fields: dict[str, str]) -> Column:
    c = F.col(verdict) if isinstance(verdict, str) else verdict
    return _let(c, lambda x: F.when(x.isNotNull(), F.struct(
        *[F.try_variant_get(x, f"$.{k}", t).alias(k) for k, t in fields.items()])))


def read_verdict(verdict: Column | str) -> Column:
    """Tool-selection verdict VARIANT to a typed struct."""
    return _typed(verdict, {"expected_tool": "string", "selected_tool": "string", "score": "double",
                            "reason": "string", "candidate_tools": "array<string>"})


def read_turn_verdict(verdict: Column | str) -> Column:
    """Turn verdict VARIANT to a typed struct."""
    return _typed(verdict, {"quality": "string", "score": "double", "data_present": "boolean",
                            "context_used": "boolean", "new_flow": "boolean", "reason": "string"})


def pick_attempt(replies: DataFrame, keys: Sequence[str] = ("run_id",), attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """First valid reply among the allowed attempts, per item; ``failed`` when there is none."""
    typed = replies.where(F.col("attempt") <= attempts).select(
        *keys, "attempt", read_verdict(validate_verdict("reply")).alias("verdict"))
    best = typed.groupBy(*keys).agg(
        F.min_by("verdict", F.when(F.col("verdict").isNotNull(), F.col("attempt"))).alias("verdict"))
    return best.select(*keys, "verdict.*", F.col("verdict").isNull().alias("failed"))


def attach_verdicts(traces: DataFrame, verdicts: DataFrame, on_missing: str = "drop") -> DataFrame:
    """Traces with their verdict.  Without one: ``drop`` the trace, or ``zero`` its score."""
    if on_missing not in ("drop", "zero"):
        raise ValueError(f"unknown policy {on_missing!r}")
    judged = verdicts.where(~F.col("failed")).select(
        "run_id", "expected_tool", F.col("selected_tool").alias("judged_tool"), "score", "reason", "candidate_tools")
    if on_missing == "drop":
        return traces.join(judged, "run_id")
    return traces.join(judged, "run_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def to_feedback(judged: DataFrame) -> DataFrame:
    """Feedback rows: run id, key, score and a JSON comment."""
    comment = F.to_json(F.struct(
        F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("expected_tool", F.lit("")).alias("expected_tool"),
        F.coalesce("judged_tool", F.lit("")).alias("selected_tool"),
        F.coalesce("candidate_tools", F.array().cast("array<string>")).alias("candidate_tools"),
        F.col("user_query").alias("query"), "run_type"))
    return judged.select("run_id", F.lit(FEEDBACK_KEY).alias("key"),
                         F.coalesce("score", F.lit(0.0)).alias("score"), comment.alias("comment"))


def build_examples(traces: DataFrame) -> DataFrame:
    """Evaluation examples; written with overwrite, they replace the earlier set."""
    return traces.select(
        F.struct(F.col("user_query").alias("query"), F.col("tool_arguments").alias("tool_args")).alias("inputs"),
        F.struct("selected_tool").alias("outputs"), F.struct("run_id", "run_type").alias("metadata"))


JudgeFn = Callable[[pd.DataFrame], pd.DataFrame]


def rule_judge(batch: pd.DataFrame) -> pd.DataFrame:
    """Deterministic judge for tests: 1 when a tool was selected, 0 for none."""
    hit = batch["selected_tool"].ne("none")
    return pd.DataFrame({"run_id": batch["run_id"], "key": FEEDBACK_KEY, "score": hit.astype("float64"),
                         "comment": hit.map({True: "tool selected", False: "no tool"})})


def evaluate(examples: DataFrame, judge: JudgeFn = rule_judge,
             target: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a batch judge over examples: ``key, score, comment`` per run.

    ``target`` may first add output columns with any Column or pandas_udf.
    Only the columns a judge needs cross into Python.
    """
    run_type = examples.schema["metadata"].dataType["run_id"].dataType.simpleString()
    flat = examples.select(F.col("metadata.run_id").alias("run_id"), F.col("inputs.query").alias("query"),
                           F.col("inputs.tool_args").alias("tool_args"),
                           F.col("outputs.selected_tool").alias("selected_tool"))
    prepared = target(flat) if target else flat

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield judge(batch)

    return prepared.mapInPandas(run, f"run_id {run_type}, key string, score double, comment string")


def echo_target(examples: DataFrame) -> DataFrame:
    """The plain target: the output repeats the query."""
    return examples.withColumn("selected_tool_from_query", F.col("query"))


def multiturn_summary(conversations: DataFrame, turns: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: conversations, turns, judged, failed, skipped, average score and quality counts."""
    # one count per session from each input; scores are summed exactly and the average is rounded once
    zero = F.lit(0).cast("bigint")
    none = [F.lit(None).cast("decimal(38,9)").alias("sum_score"), *[zero.alias(q) for q in QUALITIES]]
    sessions = conversations.groupBy("session_id").agg(F.lit(1).cast("bigint").alias("seen")).select(
        "session_id", "seen", zero.alias("n_turns"), zero.alias("succeeded"), *none)
    cut = turns.groupBy("session_id").agg(F.count("*").alias("n_turns")).select(
        "session_id", zero.alias("seen"), "n_turns", zero.alias("succeeded"), *none)
    judged = verdicts.groupBy("session_id").agg(
        F.count("*").alias("succeeded"), F.sum(F.col("score").cast("decimal(18,9)")).cast("decimal(38,9)").alias("sum_score"),
        *[F.count_if(F.col("quality") == q).alias(q) for q in QUALITIES])
    judged = judged.select("session_id", zero.alias("seen"), zero.alias("n_turns"), "succeeded", "sum_score", *QUALITIES)
    sums = sessions.unionByName(cut).unionByName(judged).groupBy("session_id").agg(
        *[F.sum(c).alias(c) for c in ("seen", "n_turns", "succeeded", "sum_score", *QUALITIES)])
    total = lambda c: F.coalesce(F.sum(c), zero)
    nano = (F.sum("sum_score") * 1_000_000_000).cast("decimal(38,0)")
    average = ratio_round(nano, F.sum("succeeded") * 1_000_000, 0) / 1000.0
    return sums.agg(
        total("seen").alias("conversations"), total("n_turns").alias("turns"), total("succeeded").alias("succeeded"),
        (total("n_turns") - total("succeeded")).alias("failed"),
        F.count_if((F.col("seen") > 0) & (F.col("n_turns") == 0)).alias("skipped"),
        F.coalesce(average, F.lit(0.0)).alias("avg_score"), *[total(q).alias(q) for q in QUALITIES])


def conversation_scores(verdicts: DataFrame) -> DataFrame:
    """Turn verdicts per session: average and lowest score, share of success."""
    return verdicts.groupBy("session_id").agg(
        F.count("*").alias("judged"), F.avg("score").alias("avg_score"), F.min("score").alias("min_score"),
        (F.count_if(F.col("quality") == "success") / F.count("*")).alias("success_share"))


def verdict_states(traces: DataFrame, verdicts: DataFrame, known_tools: DataFrame | None = None) -> DataFrame:
    """Every trace with its state: skipped, failed, phantom, correct or wrong."""
    named = traces.withColumn("skip_reason", skip_reason())
    judged = verdicts.where(~F.col("failed")).select("run_id", F.col("score").alias("__score"))
    joined = named.join(judged, "run_id", "left")
    phantom = F.lit(False)
    if known_tools is not None:
        from dialoscope.operators.tools import split_phantoms
        joined = split_phantoms(joined, known_tools)
        phantom = F.col("is_phantom")
    state = (F.when(F.col("skip_reason").isNotNull(), "skipped").when(phantom, "wrong_phantom")
             .when(F.col("__score").isNull(), "failed").when(F.col("__score") >= 1.0, "correct")
             .otherwise("wrong_known"))
    return joined.withColumn("state", state).withColumnRenamed("__score", "score")


def toolsel_summary(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Runs seen, evaluated, failed and skipped."""
    s = F.col("state")
    return states.groupBy(*keys).agg(
        F.count("*").alias("seen"), F.count_if(~s.isin("skipped", "failed")).alias("evaluated"),
        F.count_if(s == "failed").alias("failed"), F.count_if(s == "skipped").alias("skipped"))


def verdict_breakdown(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Runs per state."""
    return states.groupBy(*keys, "state").agg(F.count("*").alias("n"))


def score_profile(verdicts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Verdicts per score value."""
    return verdicts.where(F.col("score").isNotNull()).groupBy(*keys, "score").agg(F.count("*").alias("n"))


def score_average(verdicts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of verdicts and average score."""
    return verdicts.groupBy(*keys).agg(F.count("score").alias("n"), F.avg("score").alias("avg_score"))


