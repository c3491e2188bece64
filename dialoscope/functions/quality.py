"""Response-quality and leak classification as Column expressions.

The pattern sets are data: pass your own to extend them.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoscope.functions.text import col, is_blank, truthy_text

# --- Fixed values: these word lists define the buckets and must stay as they are. ---

LEAK_PATTERNS: dict[str, str] = {
    "ui_component": r"\b(card|result preview|show more|scroll|view more|the card has)\b",
    "tool_capability": r"\b(available tools|current tools|tool called|i can use|my tools|i have access to)\b",
    "workspace_ref": r"\b(workspace)\b",
    "auth_session": r"\b(log out|log back in|session expired|reauthenticate)\b",
    "internal_data_model": r"\b(lifecycle group|debtor group|customer group|aging bucket)\b",
    "analytics_categorization": r"(i'll treat this as|i'll categorize|i'll group this under)",
}

NO_DATA_PATTERNS: list[str] = [
    r"no\s+(products|items|data|sales|rows|results|customers|feedback|inventory|records|transactions|matching)\s+(were\s+found|found|returned|available|recorded|matched|populated|were\s+available)",
    r"no\s+matching\s+(threads|records|conversations|products|results|sales|items|rows)",
    r"(data\s+isn't|isn't\s+available|not\s+available)\s+right\s+now",
    r"couldn't\s+(complete\s+that\s+request|find\s+any|calculate|rank|identify\s+declining|build\s+a\s+top|group\s+inventory)",
    r"there\s+isn'?t\s+(any|a\s+co-purchase|product-level|sales\s+rows)",
    r"(0\s+products|zero\s+products|₹0\.00)\s+for",
    r"\*\*0\*\*\s+records",
    r"category\s+name\s+wasn'?t\s+populated",
    r"i\s+can'?t\s+(reliably\s+find|verify\s+purchase\s+frequency|identify\s+declining)",
    r"no\s+low-stock\s+items\s+were\s+found",
    r"no\s+slow-moving\s+items\s+were\s+found",
    r"there\s+aren'?t\s+any\s+(products|matching|sales)",
    r"couldn't\s+find\s+any\s+sales\s+rows",
    r"i\s+couldn't\s+find\s+any\s+paracetamol",
    r"no\s+product\s+sales\s+were\s+found",
    r"that\s+breakdown\s+isn'?t\s+available",
    r"i\s+couldn't\s+complete\s+that\s+request\s+right\s+now",
    r"please\s+try\s+again\s+(in\s+a\s+moment|shortly)",
]

FIGURE_SIGNS = r"[₹%]"
LISTING_WORDS = r"(sorted by|ranked|showing \d|found \d)"
PIPE_TABLE = r"\|.*\|.*\|"
NUMBERISH = r"[\d,.]"
REFUSAL_WORDS = r"(couldn't|cannot|unable to|was rejected|didn't find|i couldn't)"
HEDGE_WORDS = r"(try again|i don't want to guess|i'd recommend|if you want|you can try)"
SUBSTANCE_LENGTH = 120
SUBSTANCE_LENGTH_V1 = 60

BOT_FALLBACK_PHRASES: list[str] = ["sorry", "couldn't", "something went wrong", "unable to", "went wrong"]

# --- End of fixed values. ---

# For each no-data pattern, in order: words of which any match must hold one.  A plain substring
# test on them spares most texts the regular expression; the result is the same.
_NO_DATA_CLUES: list[tuple[str, ...]] = [
    ("found", "returned", "available", "recorded", "matched", "populated"),
    ("matching",),
    ("right",),
    ("couldn't",),
    ("there",),
    ("products", "₹0.00"),
    ("**0**",),
    ("populated",),
    ("reliably", "purchase", "declining"),
    ("low-stock",),
    ("slow-moving",),
    ("aren't", "arent"),
    ("couldn't",),
    ("paracetamol",),
    ("product",),
    ("breakdown",),
    ("couldn't",),
    ("please",),
]
_CLUES: dict[str, tuple[str, ...]] = dict(zip(NO_DATA_PATTERNS, _NO_DATA_CLUES, strict=True))
_CLUES[LISTING_WORDS] = ("sorted by", "ranked", "showing ", "found ")

QUALITIES = ("success", "marginal", "no_data", "fail")
BOT_QUALITIES = ("success", "marginal", "fail")

# U: Unicode \s \w \d \b.  d: only a newline ends what a dot matches.
_FLAGS = "(?Ud)"


def _matches(c: Column, pattern: str) -> Column:
    return c.rlike(_FLAGS + pattern)


# A bare list of words, with or without word borders around it.
_WORD_LIST = re.compile(r"(\\b)?\(([^()\[\]{}\\.*+?^$]+)\)(\\b)?")


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _search(pattern: str, x: str) -> str:
    """SQL for a pattern search in the column ``x``, with a substring test in front wherever one is implied."""
    listed = _WORD_LIST.fullmatch(pattern)
    words = listed[2].split("|") if listed else _CLUES.get(pattern, ())
    hinted = "(" + " OR ".join(f"contains({x}, {_literal(w)})" for w in words) + ")"
    search = f"{x} RLIKE {_literal(_FLAGS + pattern)}"
    if listed and not listed[1] and not listed[3]:
        return hinted
    return f"({hinted} AND {search})" if words else search


def _found(c: Column | str, patterns: Sequence[str]) -> Column:
    """Does any of the patterns occur?

    For a named column one SQL text is parsed for the whole set: put together
    Column by Column, the rules cost seconds of driver time.
    """
    if isinstance(c, str):
        name = f"`{c}`"
        return F.expr(" OR ".join(_search(p, name) for p in patterns))
    hit = F.lit(False)
    for p in patterns:
        hit = hit | _matches(c, p)
    return hit


def _plain_quotes(c: Column, normalize: bool) -> Column:
    """Typographic apostrophes to straight ones, when asked for."""
    return F.translate(c, "’‘", "''") if normalize else c


def no_data_match(response: Column | str, patterns: Sequence[str] = NO_DATA_PATTERNS,
                  normalize_quotes: bool = False) -> Column:
    """0-based index of the first no-data pattern found in the text, else NULL."""
    low = F.lower(_plain_quotes(col(response), normalize_quotes))
    return F.coalesce(*[F.when(_matches(low, p), F.lit(i)) for i, p in enumerate(patterns)])


def is_no_data(low: Column | str, patterns: Sequence[str] = NO_DATA_PATTERNS) -> Column:
    """Any no-data pattern present in the lower-cased text."""
    return _found(low, patterns)


def lowered(response: Column | str, normalize_quotes: bool = False) -> Column:
    """Lower-cased text, empty for NULL, as the rules read it."""
    return F.lower(_plain_quotes(F.coalesce(col(response), F.lit("")), normalize_quotes))


def classify_quality(response: Column | str, error: Column | str, rubric: str = "v2",
                     no_data_patterns: Sequence[str] = NO_DATA_PATTERNS,
                     normalize_quotes: bool = False, low: Column | str | None = None) -> Column:
    """Quality bucket of a response; the first rule that applies decides.

    ``low`` may name a column that holds ``lowered(response)`` already.

    ``rubric='v2'`` has four buckets.  ``'v1'`` is the older written rubric
    without ``no_data``, kept so that runs judged under it stay comparable.
    """
    text = _plain_quotes(F.coalesce(col(response), F.lit("")), normalize_quotes)
    low = lowered(response, normalize_quotes) if low is None else low
    failed = truthy_text(error) | is_blank(low)
    has_figures = _matches(text, FIGURE_SIGNS) | _found(low, [LISTING_WORDS])
    has_table = _matches(text, PIPE_TABLE) & _matches(text, NUMBERISH)
    refuses, hedges = _found(low, [REFUSAL_WORDS]), _found(low, [HEDGE_WORDS])
    if rubric == "v1":
        return (F.when(failed, "fail").when(refuses, "marginal").when(has_figures, "success")
                .when(hedges, "marginal")
                .when(F.length(text) > SUBSTANCE_LENGTH_V1, "success").otherwise("marginal"))
    if rubric != "v2":
        raise ValueError(f"unknown rubric {rubric!r}")
    return (F.when(failed, "fail")
            .when(is_no_data(low, no_data_patterns), "no_data")
            .when(has_figures | has_table, "success")
            .when(refuses | hedges, "marginal")
            .otherwise(F.when(F.length(text) > SUBSTANCE_LENGTH, "success").otherwise("marginal")))


def leak_labels(response: Column | str, patterns: Mapping[str, str] = LEAK_PATTERNS,
                normalize_quotes: bool = False, low: Column | str | None = None) -> Column:
    """Labels of all leak patterns found, in the order of the pattern set."""
    low = lowered(response, normalize_quotes) if low is None else low
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(_found(low, [p]), F.array(F.lit(name))).otherwise(none) for name, p in patterns.items()])


def detect_leaks(response: Column | str, patterns: Mapping[str, str] = LEAK_PATTERNS,
                 normalize_quotes: bool = False, low: Column | str | None = None) -> Column:
    """Struct of ``info_leak`` and ``leak_indicators``."""
    labels = leak_labels(response, patterns, normalize_quotes, low)
    return F.struct((F.size(labels) > 0).alias("info_leak"), labels.alias("leak_indicators"))


def classify_bot_quality(text: Column | str, error: Column | str,
                         phrases: Sequence[str] = BOT_FALLBACK_PHRASES) -> Column:
    """Three-bucket quality of a bot reply."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    fallback = F.lit(False)
    for phrase in phrases:
        fallback = fallback | low.contains(phrase)
    return (F.when(truthy_text(error) | is_blank(low), "fail")
            .when(fallback, "marginal").otherwise("success"))


def backfill_steps(step_count: Column | str, status_sequence: Column | str) -> Column:
    """Step count, taken from the status list where it is missing or 0."""
    n = F.coalesce(F.size(col(status_sequence)), F.lit(0))
    return F.when((F.coalesce(col(step_count), F.lit(0)) == 0) & (n > 0), n).otherwise(col(step_count))
