"""Secret scans: assigned secrets, access keys, hex runs, and strings of high entropy.

The first three kinds are patterns.  The fourth slides a window over candidate
strings (long runs of key characters): Shannon entropy per character class, kept
by incremental counts as the window moves, is held against the threshold of the
class; windows over it merge to spans.  A candidate is cut behind each ``=``, so that
a name says nothing about its value.  An allow-list suppresses spans that hold a
harmless word, and spans of which paths and names of many words cover half or more.

A window of letters alone or of digits alone belongs to no class, so a secret of
that kind is found by its name only.

No shuffle.  Whole texts of any length are scanned, candidates in time that grows
with their length; a null text is empty, an empty text has no spans.  Repeated rows give equal rows; further columns pass through; an empty
table gives an empty result.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoscope.llm import frames
from dialoscope.llm.hashing import runs

#: Kinds in their order.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 16
HEX = re.compile(r"[0-9a-f]+")
HEX_LEAST = 32
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

HEX_BYTES = b"0123456789abcdef"
DIGITS = frozenset("0123456789")
LOW_HEX, HIGH_HEX = DIGITS | frozenset("abcdef"), DIGITS | frozenset("ABCDEF")
KEY_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Characters of a window, and the bits a character that a window of a class needs.
WINDOW = 20
THRESHOLDS = {"hex": 3.0, "mixed": 3.6}
#: Spans with a match of one of these, in the span or in the whole cut string, are not reported.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|redacted",
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)abcdefghij|0123456789",
)
#: Spans are not reported if matches of these cover half of them or more.
ALLOWED_PARTS = (
    r"//|(?:/[a-z]+)+/[a-z]+/",
    r"(?:[A-Za-z]+[_-]){3,}",
)
#: A candidate's strings: a name ends with its ``=``, a value may end with padding.
STRINGS = re.compile("[^=]+=*")


def byte_mask(members: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(members)] = True
    return mask


def entropy_spans(text: str, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> list[tuple[int, int]]:
    """Merged windows of ``text`` whose entropy reaches the threshold of their class.

    The class is hex (digits and letters of one case up to f) or mixed; windows of
    letters alone or digits alone have none: words and numbers are no candidates.
    """
    n = len(text)
    if n < window:
        return []
    share = [0.0] + [c / window * math.log2(window / c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    entropy, digits, beyond_low, beyond_high = 0.0, 0, 0, 0  # the last two: characters that are no lower, no upper hex
    spans: list[tuple[int, int]] = []
    for end, new in enumerate(text, 1):
        if end > window:
            old = text[end - window - 1]
            c = counts[old]
            counts[old] = c - 1
            entropy += share[c - 1] - share[c]
            digits -= old in DIGITS
            beyond_low -= old not in LOW_HEX
            beyond_high -= old not in HIGH_HEX
        c = counts.get(new, 0)
        counts[new] = c + 1
        entropy += share[c + 1] - share[c]
        digits += new in DIGITS
        beyond_low += new not in LOW_HEX
        beyond_high += new not in HIGH_HEX
        if end >= window and 0 < digits < window:
            start = end - window
            if entropy >= thresholds["mixed" if beyond_low and beyond_high else "hex"] - 1e-9:
                if spans and start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], end)
                else:
                    spans.append((start, end))
    return spans


def pattern_of(allowed: tuple[str, ...]) -> re.Pattern | None:
    return re.compile("|".join(f"(?:{a})" if not a.startswith("(?i)") else f"(?i:{a[4:]})" for a in allowed)) if allowed else None


def secret_spans(candidate: str, window: int, thresholds: dict[str, float], allowed: re.Pattern | None,
                 parts: re.Pattern | None) -> list[tuple[int, int]]:
    """Entropy spans of a candidate that the allow-list does not suppress."""
    out = []
    for string in STRINGS.finditer(candidate):
        own, at = string[0], string.start()
        for a, b in entropy_spans(own, window, thresholds):
            if allowed and (allowed.search(own[a:b]) or allowed.fullmatch(own)):
                continue
            if parts and 2 * sum(max(0, min(m.end(), b) - max(m.start(), a)) for m in parts.finditer(own)) >= b - a:
                continue
            out.append((at + a, at + b))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the pattern kinds."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= HEX_LEAST]
    return sorted(out)


def scan_texts(column: pa.Array, window: int, thresholds: dict[str, float], allowed: re.Pattern | None,
               parts: re.Pattern | None = None) -> list[list[tuple[int, int, int]]]:
    """Spans of each text of a column; texts without any candidate are never decoded."""
    keys, hexes = byte_mask(KEY_BYTES), byte_mask(HEX_BYTES)
    digits = byte_mask(b"0123456789")
    out: list[list] = []
    for first, end, at, data in frames.slices(column):
        raw = data.tobytes()
        # candidate strings: long enough runs of key characters that hold a digit
        start, stop = runs(keys[data], at)
        numbers = np.concatenate([[0], np.cumsum(digits[data])])
        good = (stop - start >= window) & (numbers[stop] > numbers[start])
        start, stop = start[good], stop[good]
        h_start, h_stop = runs(hexes[data], at)
        hex_rows = set((np.searchsorted(at, h_start[h_stop - h_start >= HEX_LEAST], side="right") - 1).tolist())
        low = raw.lower()
        patterns = set(hex_rows)
        for name in (*NAMES, b"akia"):
            here = low.find(name)
            while here >= 0:
                patterns.add(int(np.searchsorted(at, here, side="right")) - 1)
                here = low.find(name, here + 1)
        rows: list[list] = [[] for _ in range(end - first)]
        for r in patterns:
            rows[r] = base_spans(raw[at[r]:at[r + 1]].decode())
        owner = np.searchsorted(at, start, side="right") - 1
        for r, a, b in zip(owner.tolist(), start.tolist(), stop.tolist()):
            candidate = raw[a:b].decode()
            found = secret_spans(candidate, window, thresholds, allowed, parts)
            if found:
                before = len(raw[at[r]:a].decode())  # code points before the candidate
                rows[r] = rows[r] + [(before + x, 3, before + y) for x, y in found]
        out += [sorted(r) for r in rows]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, text: str = "text", window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS,
         allowed: tuple[str, ...] = ALLOWED, parts: tuple[str, ...] = ALLOWED_PARTS) -> DataFrame:
    """``docs`` without ``text``, with n_assign, n_access, n_hex, n_entropy, base_sha256, spans and spans_list.

    ``spans_list`` holds (kind, start, end); ``spans`` is its text form ``kind:start:end``.
    """
    frames.bounded_batches(docs.sparkSession)
    made = ["n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans", "spans_list"]
    kept = [c for c in docs.columns if c != text and c not in made]
    source = docs.select(*(docs[c] for c in kept), F.coalesce(docs[text].cast("string"), F.lit("")).alias("__text"))
    pattern, part = pattern_of(allowed), pattern_of(parts)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scan_texts(batch.column("__text"), window, thresholds, pattern, part)
            columns = [batch.column(c) for c in kept]
            for kind in range(4):
                columns.append(pa.array([sum(s[1] == kind for s in row) for row in found], pa.int64()))
            base = [joined([s for s in row if s[1] < 3]) for row in found]
            columns.append(pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()))
            columns.append(pa.array([joined(row) for row in found], pa.string()))
            columns.append(pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in row] for row in found], pa.list_(span)))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *made])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    fields += [f"{c} long" for c in made[:4]] + ["base_sha256 string", "spans string",
                                                "spans_list array<struct<kind:string,start:int,end:int>>"]
    return source.mapInArrow(run, ", ".join(fields))
