"""String, number and truthiness helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators that Python's strip() removes.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_INK = r"(?U)[^\s\x1c-\x1f]"

# Truncation widths of the capture and judging formats (fixed values).
CLIP_QUERY = 500
CLIP_RESPONSE = 800
CLIP_TRANSCRIPT_QUERY = 400
CLIP_ANSWER = 5000
CLIP_HTTP_ERROR = 300
CLIP_BOT_ERROR = 200


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c: Column | str) -> Column:
    """Trim Unicode white space on both ends (SQL ``trim`` strips blanks only)."""
    return F.regexp_replace(col(c), _EDGE_SPACE, "")


def is_blank(c: Column | str) -> Column:
    """True for NULL, empty and white-space-only text; stops at the first other character."""
    return ~F.coalesce(col(c).rlike(_INK), F.lit(False))


def truthy_text(c: Column | str) -> Column:
    """True for non-NULL, non-empty text (blanks count as text)."""
    return F.coalesce(F.length(col(c)) > 0, F.lit(False))


def first_text(*cols: Column | str) -> Column:
    """First non-empty text of a default chain, else NULL."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols])


def clip(c: Column | str, n: int) -> Column:
    """Keep the first ``n`` code points."""
    return F.substring(col(c), 1, n)


def strip_fences(c: Column | str) -> Column:
    """Drop a leading ```json / ``` fence and a trailing ``` fence, trimming as it goes."""
    opened = utrim(F.regexp_replace(utrim(c), r"^```(?:json)?", ""))
    return utrim(F.regexp_replace(opened, r"```$", ""))


def cents(c: Column | str) -> Column:
    """Two-decimal amount as a whole number of hundredths; exact to sum."""
    return (col(c).cast("decimal(18,2)") * 100).cast("bigint")


def ratio_round(num: Column, den: Column, places: int = 0) -> Column:
    """``num / den`` rounded half-up to ``places``, by whole-number arithmetic.

    For non-negative ``num``.  NULL when ``den`` is 0 or NULL.  No binary
    fraction takes part, so every engine and every row order agrees.
    """
    twice = F.nullif(den.cast("decimal(38,0)") * 2, F.lit(0))
    scaled = num.cast("decimal(38,0)") * (2 * 10**places) + den
    whole = (scaled - F.pmod(scaled, twice)) / twice
    return whole.cast("double") / float(10**places)


def split_list(c: Column | str, sep: str = ",") -> Column:
    """Delimited text to array; NULL and empty text give an empty array."""
    return F.coalesce(F.split(F.nullif(col(c), F.lit("")), sep), F.array().cast("array<string>"))


def split_expected(c: Column | str) -> Column:
    """Expected-tool text split on the arrow, parts trimmed."""
    return F.transform(F.split(col(c), "→"), utrim)
