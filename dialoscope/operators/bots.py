"""Bot scenarios: reply flattening, expectation checks, chat carry, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoscope.functions import variant as v
from dialoscope.functions.ordered import DEFAULT_BLOCK, fill_forward
from dialoscope.functions.quality import BOT_QUALITIES, classify_bot_quality
from dialoscope.functions.text import cents, ratio_round, truthy_text
from dialoscope.operators.tools import called_tools

# Pass-rate tiers of the dashboard.
GREEN_RATE, AMBER_RATE = 80, 50
# Message types that set both the reply type and the text.
_BODY_TYPES = ("text", "cta_url", "document")
_MENU = "array<struct<title: string, description: string>>"
_TOOLS = "array<struct<name: string, args: variant>>"


def override_workspace(scenarios: DataFrame, workspace_id: str) -> DataFrame:
    """Run all scenarios against one workspace."""
    return scenarios.withColumn("workspace_id", F.lit(workspace_id))


def extract_bot_response(raw: str = "raw") -> Column:
    """Reply of the message API (VARIANT) to type, text, menu options, tools and knowledge files.

    The last message decides type and text.  A message of another type keeps
    the type, and the text too unless it carries one.  Menu rows add up.
    """
    messages = v.objects(v.list_at(raw, "$.messages"))
    body = "try_variant_get(m, '$.text.body', 'string')"
    menu_text = "try_variant_get(m, '$.template.body.text', 'string')"
    kinds = ", ".join(f"'{k}'" for k in _BODY_TYPES)
    step = (f"CASE WHEN {v.as_text('m', '$.type')} IN ({kinds}) THEN "
            f"named_struct('kind', {v.as_text('m', '$.type')}, 'text', coalesce({body}, '')) "
            f"WHEN {v.as_text('m', '$.type')} = 'interactive' THEN "
            f"named_struct('kind', 'interactive', 'text', coalesce({menu_text}, '')) "
            f"ELSE named_struct('kind', acc.kind, 'text', coalesce({body}, acc.text)) END")
    last = f"aggregate({messages}, named_struct('kind', 'empty', 'text', ''), (acc, m) -> {step})"
    sections = v.objects(v.list_at("m", "$.template.action.sections"))
    menu = (f"flatten(flatten(transform(filter({messages}, m -> coalesce({v.as_text('m', '$.type')} = 'interactive', false)), "
            f"m -> transform({sections}, s -> transform({v.objects(v.list_at('s', '$.rows'))}, r -> named_struct("
            f"'title', coalesce({v.as_text('r', '$.title')}, ''), 'description', coalesce({v.as_text('r', '$.description')}, '')))))))")
    tools = (f"transform({v.objects(v.list_at(raw, '$.agentMetadata.tools_used'))}, t -> named_struct("
             f"'name', coalesce({v.as_text('t', '$.name')}, ''), 'args', {v.node('t', '$.args')}))")
    files = (f"coalesce(try_variant_get({raw}, '$.agentMetadata.knowledge_files_referenced', 'array<string>'), "
             "CAST(array() AS array<string>))")
    return F.expr(f"transform(array({last}), x -> named_struct('response_type', x.kind, 'response_text', x.text, "
                  f"'menu_options', CAST({menu} AS {_MENU}), 'tools_used', CAST({tools} AS {_TOOLS}), "
                  f"'knowledge_files', {files}))[0]")


def literal(c: Column) -> Column:
    """Text as a quoted literal: in double quotes if it holds an apostrophe and no double quote, else in single ones."""
    plain = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for sign, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(sign), F.lit(shown))
    double = c.contains("'") & ~c.contains('"')
    single = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(single)


def _failures(text: Column, kind: Column, used: Column) -> list[Column]:
    """Reason texts of the failed checks, in checking order; NULL for a check that holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    want = F.col("exp_response_type")
    shown = F.concat(F.lit("["), F.array_join(F.transform(used, literal), ", "),
                     F.lit("]"))
    missing = F.get(F.filter("exp_contains", lambda p: ~low.contains(F.lower(p))), 0)
    unwanted = F.get(F.filter("exp_not_contains", lambda p: low.contains(F.lower(p))), 0)
    forbidden = F.get(F.filter("exp_not_tool", lambda t: F.array_contains(used, t)), 0)

    def quoted(c: Column) -> Column:
        return F.when(c.isNull(), "None").otherwise(literal(c))

    return [
        F.when(want.isNotNull() & ~kind.eqNullSafe(want),
               F.concat(F.lit("expected response_type="), quoted(want), F.lit(", got "), quoted(kind))),
        F.when(missing.isNotNull(), F.concat(F.lit("expected to contain "), quoted(missing), F.lit(", not found"))),
        F.when(unwanted.isNotNull(), F.concat(F.lit("unexpected phrase "), quoted(unwanted),
                                              F.lit(" found in response"))),
        F.when(F.col("exp_tool").isNotNull() & ~F.array_contains(used, F.col("exp_tool")),
               F.concat(F.lit("expected tool "), quoted(F.col("exp_tool")), F.lit(", used: "), shown)),
        F.when(forbidden.isNotNull(), F.concat(F.lit("forbidden tool "), quoted(forbidden), F.lit(" was invoked"))),
    ]


def check_expectations(results: DataFrame, expectations: DataFrame, on: Sequence[str] = ("bot_name", "query_id"),
                       all_reasons: bool = False) -> DataFrame:
    """Add passed, fail_reason and response_quality to bot results.

    A result without expectation passes.  An error fails it, with the error
    text as reason unless a check already gave one.  Only an error lowers the
    quality; a failed expectation does not.
    """
    joined = results.join(expectations, list(on), "left")
    used = called_tools("tools_used", "name")
    failures = _failures(F.col("response_text"), F.col("response_type"), used)
    errored = truthy_text("error")
    reason = (F.nullif(F.concat_ws("; ", *failures), F.lit("")) if all_reasons else F.coalesce(*failures))
    # an errored result has no reply to check
    reason = F.when(errored, F.col("error")).otherwise(F.coalesce(reason, F.lit("")))
    extra = [c for c in expectations.columns if c not in on]
    return (joined.withColumn("fail_reason", reason).withColumn("passed", ~errored & (F.length("fail_reason") == 0))
            .withColumn("response_quality", classify_bot_quality("response_text", "error")).drop(*extra))


def expectation_columns(expected: str = "expected") -> list[Column]:
    """Columns of ``check_expectations`` from an expectation struct."""
    return [F.col(f"{expected}.{k}").alias(f"exp_{k}")
            for k in ("response_type", "contains", "not_contains", "tool", "not_tool")]


def carry_chat_id(results: DataFrame, pos: str = "pos", keys: Sequence[str] = ("bot_name",), on: bool = True,
                  block: int = DEFAULT_BLOCK) -> DataFrame:
    """Add ``sent_chat_id``: the last chat id among the bot's earlier cases, NULL when carrying is off."""
    if not on:
        return results.withColumn("sent_chat_id", F.lit(None).cast("string"))
    return fill_forward(results, keys, pos, F.nullif(F.col("chat_id"), F.lit("")), "sent_chat_id", block,
                        include_current=False)


def bot_summary(checked: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Total, passed, failed, pass percentage, quality counts, average seconds."""
    summed = checked.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        *[F.count_if(F.col("response_quality") == q).alias(q) for q in BOT_QUALITIES],
        F.sum(cents("response_time_seconds")).alias("c"))
    histogram = F.map_from_arrays(F.array(*[F.lit(q) for q in BOT_QUALITIES]), F.array(*BOT_QUALITIES))
    return summed.select(*keys, "total", "passed", "failed",
                         ratio_round(F.col("passed") * 100, F.col("total")).alias("pass_pct"), *BOT_QUALITIES,
                         histogram.alias("quality"),
                         ratio_round(F.col("c"), F.col("total") * 100, 1).alias("avg_seconds"))


def bot_stats(checked: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """The summary with the number of bots and the pass-rate tier."""
    bots = checked.groupBy(*keys).agg(F.count_distinct("bot_name").alias("bots"))
    summary = bot_summary(checked, keys).drop("quality")
    joined = summary.join(bots, list(keys)) if keys else summary.withColumn(
        "bots", bots.scalar())
    hundred = F.col("passed") * 100
    tier = (F.when(hundred >= GREEN_RATE * F.col("total"), "green")
            .when(hundred >= AMBER_RATE * F.col("total"), "amber").otherwise("red"))
    return joined.withColumn("tier", tier)


def bot_manifest_row(checked: DataFrame) -> DataFrame:
    """Manifest figures of each bot run."""
    return checked.groupBy("run_id").agg(
        F.max("timestamp").alias("timestamp"), F.count("*").alias("total_cases"),
        F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
