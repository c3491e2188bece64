"""Benchmark decontamination by templates, to catch questions whose numbers, names or units were changed.

A text becomes tokens (runs of letters, digits and bytes above 0x7F) and these a
template: tokens that begin with a digit become <number>, unit words behind a
number <unit>, capitalised words inside a sentence <name>, all others their lower
case.  What a placeholder replaced is its slot.

1. Windows of ``n`` template tokens, at least half of them literal, are hashed for
   benchmark and documents alike; all windows of ``n`` tokens are also hashed as they
   stand (lower case), which finds copies of passages full of numbers and names.
   An item with fewer than ``n`` tokens has one such window of its whole length.
2. The benchmark's hashes set bits in a bitmap of a fixed size, which is broadcast;
   document windows that miss it are dropped where they are made.  The bitmap has
   false hits only, which the join removes: it loses nothing, however large the
   benchmark is.
3. The rest is hash-joined with the benchmark's windows.
4. Per document and item the joined windows are judged by places: a place is a
   document position minus an item position, so that each window meets only its
   own token of one occurrence.  Slots are consistent if each of the item's values
   always became the same value; different ones may have become the same.  A place
   that covers ``least`` of the item's tokens or more with consistent slots is a
   leak: ``exact`` if all slots are equal, else ``changed``.  Tokens in no template
   window can't be found changed: ``least`` of the others will do, if two windows'
   length of tokens is covered, and such a leak is ``changed``.  So is, in an item
   of any length, a run of ``passage`` tokens with consistent slots a leak.  Other
   places have no say in it.  Where words were put in or left out, an occurrence falls apart to
   several places: consistent places with equal slots are taken together, then
   those near each other that agree, then all places if none contradict.  Of
   several occurrences the one reported is exact if any is, then the fullest.

Null texts are empty; items with fewer than ``SHORTEST`` tokens take no part: one or
two words are no evidence of anything, and common ones would mark most documents.
Texts of any length are read whole, in slices; a row is one window.  Rows with
a null doc_id have the number ``frames.NO_ID``; rows that share a doc_id are
judged one by one by their text.  Repeated rows give one result row.  Further
columns are not read.  Empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoscope.llm import frames
from dialoscope.llm.hashing import U, Rolling, mix, runs

#: Tokens of a window, covered share of an item, tokens of a run that is a leak by itself, bits of the bitmap (2**).
WINDOW, LEAST, PASSAGE, BITMAP = 8, 0.6, 24, 23
#: Tokens that an item must have.
SHORTEST = 3
#: Sets hashes of tokens as they stand apart from those of templates.
AS_IS = U(0x5851F42D4C957F2D)
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters", "mg", "g", "kg", "gram",
    "grams", "ton", "tons", "lb", "lbs", "pound", "pounds", "ounce", "ounces", "ml", "l", "liter", "liters", "gallon", "gallons", "second",
    "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "cent", "cents",
    "dollar", "dollars", "euro", "euros", "percent", "degree", "degrees")
NUMBER, UNIT, NAME = 1, 2, 3


def _members(*ranges: tuple[int, int]) -> np.ndarray:
    mask = np.zeros(256, bool)
    for a, b in ranges:
        mask[a:b + 1] = True
    return mask


def lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case of A-Z and of the letters U+00C0-U+00DE, and where a capital begins."""
    capital = (data >= 65) & (data <= 90)
    out = data + capital * np.uint8(32)
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out += second * np.uint8(32)
    capital[:-1] |= second[1:]
    return out, capital


def template(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, template hash, slot kind (0: literal) and value hash of every token of a slice."""
    low, capital = lowered(data)
    start, end = runs(_members((48, 57), (65, 90), (97, 122), (128, 255))[data], at)
    value = Rolling(low).ranges(start, end)
    row = np.searchsorted(at, start, side="right") - 1
    stops = np.concatenate([[0], np.cumsum(_members((46, 46), (33, 33), (63, 63), (10, 10))[data])])
    inside = np.zeros(len(start), bool)  # not the first token of a text or sentence
    inside[1:] = (row[1:] == row[:-1]) & (stops[start[1:]] == stops[end[:-1]])
    capitals = np.concatenate([[0], np.cumsum(capital)])
    name = inside & capital[start] & (capitals[end] - capitals[start] == 1) & (end - start > 1)
    number = (data[start] >= 48) & (data[start] <= 57)
    texts = b"".join(u.encode() for u in UNITS)
    ends = np.cumsum([len(u) for u in UNITS])
    units = Rolling(np.frombuffer(texts, np.uint8)).ranges(np.concatenate([[0], ends[:-1]]), ends)
    behind = np.zeros(len(start), bool)
    behind[1:] = number[:-1] & (row[1:] == row[:-1])
    kind = np.where(number, NUMBER, np.where(behind & np.isin(value, units), UNIT, np.where(name, NAME, 0)))
    return row, np.where(kind > 0, mix(kind.astype(U) + U(77)), value), kind, value


def windows(data: np.ndarray, at: np.ndarray, n: int, short: list[int] | None = None):
    """The windows of a slice, one part for each kind and length: (raw, length, row, first token in its row, hash, first token).

    Raw windows are hashed as they stand.  Below ``n`` tokens they have the lengths ``short``, each hash once a row, or
    (None) are rows as a whole.  Further the tokens of each row, those of them in template windows, kinds and values.
    """
    row, code, kind, value = template(data, at)
    tokens = np.bincount(row, minlength=len(at) - 1)
    first = np.cumsum(tokens) - tokens
    literal = np.concatenate([[0], np.cumsum(kind == 0)])
    rolling, parts = Rolling(value), []

    def part(raw: bool, length: int, h: np.ndarray, good: np.ndarray) -> None:
        begin = np.flatnonzero(good)
        parts.append((raw, length, row[begin], begin - first[row[begin]], h[begin], begin))

    for length in sorted({n, *(range(1, n) if short is None else short)}):
        begin = np.arange(max(len(row) - length + 1, 0))
        good = row[begin] == row[begin + length - 1]
        h = mix(rolling.windows(length) ^ (AS_IS + U(length)))
        if length == n:
            part(True, n, h, good)
            part(False, n, Rolling(code).windows(n), good & (2 * (literal[begin + n] - literal[begin]) >= n))
        elif short is None:
            part(True, length, h, good & (tokens[row[begin]] == length))
        else:
            order = np.lexsort((h, row[begin]))
            again = np.zeros(len(begin), bool)
            again[order[1:]] = (row[order[1:]] == row[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
            part(True, length, h, good & ~again)
    begin = parts[-1][-1]  # of the template windows
    steps = np.zeros(len(row) + 1, np.int64)
    np.add.at(steps, begin, 1)
    np.add.at(steps, begin + n, -1)
    plain = np.bincount(row[np.cumsum(steps)[:-1] > 0], minlength=len(at) - 1)
    return parts, tokens, plain, kind, value


def window_rows(texts: DataFrame, n: int, bitmap=None, short: list[int] | None = None) -> DataFrame:
    """(id, mark, tokens, plain, w, position, length, raw, slots) of the windows; with a bitmap only of those that hit it."""
    names = ["id", "mark", "tokens", "plain", "w", "position", "length", "raw", "slots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8) if bitmap is not None else None
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for low, _, at, data in frames.slices(batch.column(2)):
                parts, tokens, plain, kind, value = windows(data, at, n, short)
                slotted = np.flatnonzero(kind > 0)
                for raw, length, row, position, h, begin in parts:
                    if bits is not None:
                        slot = h >> U(64 - BITMAP)
                        hit = (bits[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8)) & 1 == 1
                        row, position, h, begin = row[hit], position[hit], h[hit], begin[hit]
                    if not len(row):
                        continue
                    start = np.searchsorted(slotted, begin)
                    # a document's raw window has the slots of the item that it meets
                    sizes = np.searchsorted(slotted, begin + length) - start if bits is None or not raw else np.zeros(len(row), np.int64)
                    own = slotted[np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
                    slots = frames.lists(value[own].view(np.int64), sizes, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[low + row]), pa.array(marks[low + row]), pa.array(tokens[row].astype(np.int32)), pa.array(plain[row].astype(np.int32)),
                         pa.array(h.view(np.int64)), pa.array(position.astype(np.int32)), pa.array(np.full(len(row), length, np.int32)),
                         pa.array(np.full(len(row), raw)), slots], names=names)

    return texts.mapInArrow(run, "id long, mark long, tokens int, plain int, w long, position int, length int, raw boolean, slots array<long>")


def bitmap_of(found: DataFrame) -> bytes:
    """The bitmap of window hashes: at most 2**BITMAP bits, put together from 2**(BITMAP - 6) rows at most."""
    slot = F.shiftrightunsigned("w", 64 - BITMAP)
    rows = found.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).cast("int").alias("word")) \
        .agg(F.expr("bit_or(shiftleft(1L, CAST(slot & 63 AS INT)))").alias("bits")).collect()
    words = np.zeros(2**(BITMAP - 6), np.int64)
    for r in rows:
        words[r.word] = r.bits
    return words.tobytes()


def consistent_slots(pairs: set[tuple[int, int]]) -> bool:
    """Did each value of the item become one value only? Different ones may have become the same."""
    return len({a for a, _ in pairs}) == len(pairs)


def longest_run(windows: dict[tuple, set]) -> tuple[set, set]:
    """Of the windows of one place the longest run without a gap and with consistent slots, and its pairs."""
    order, best, begin, clashes = sorted(windows), (0, 0, 0), 0, 0
    pairs, values = Counter(), Counter()  # of the open run: pairs by windows, the item's values by pairs

    def count(window: tuple, by: int) -> None:
        nonlocal clashes
        for p in windows[window]:
            pairs[p] += by
            if pairs[p] == (by > 0):  # came or went
                clashes += by if values[p[0]] >= 1 + (by < 0) else 0
                values[p[0]] += by

    for k, (q, length, _) in enumerate(order):
        count(order[k], 1)
        while clashes or (begin < k and k and q > order[k - 1][0] + order[k - 1][1]):
            count(order[begin], -1)
            begin += 1
        if begin <= k:
            best = max(best, (q + length - order[begin][0], begin, k + 1), key=lambda x: x[0])
    run = order[best[1]:best[2]]
    return set(run), set().union(*(windows[w] for w in run))


def judged(size: int, plain: int, met: list[dict], n: int, least: float, passage: int) -> tuple[str, float, int, int] | None:
    """(kind, coverage, windows, changed slots) of the best occurrence of an item of ``size`` tokens in a document.

    plain: the item's tokens that lie in template windows.
    """
    places: dict[int, dict[tuple, set]] = defaultdict(dict)  # of each place the windows (item position, length, raw) and their pairs of slots
    for m in met:
        places[m["position"] - m["at"]][m["at"], m["length"], m["raw"]] = set(zip(m["own"], m["own"] if m["raw"] else m["slots"]))
    found = {shift: (set(windows), set().union(*windows.values())) for shift, windows in places.items()}
    consistent = [(shift + min(at)[0], at, pairs) for shift, (at, pairs) in found.items() if consistent_slots(pairs)]
    consistent.sort(key=lambda place: place[0])
    results = []

    def hold(at: set[tuple], pairs: set[tuple[int, int]], whole: bool = False) -> None:
        covered = {t for q, length, _ in at for t in range(q, q + length)}
        coverage = len(covered) / size
        changed = sum(a != b for a, b in pairs)
        exact = changed == 0 and (coverage >= least or whole)
        if plain and len(covered) >= 2 * n and not exact:
            coverage = max(coverage, len({t for q, length, raw in at if not raw for t in range(q, q + length)}) / plain)
        if coverage >= least or whole:
            results.append((exact, coverage, -changed, len({q for q, _, _ in at})))

    for _, at, pairs in consistent:
        hold(at, pairs)
    if size > passage:
        for windows in places.values():
            at, pairs = longest_run(windows)
            if at and max(q + length for q, length, _ in at) - min(at)[0] >= passage:
                hold(at, pairs, True)
    if len(consistent) > 1 and not any(r[0] for r in results):
        same = [(at, pairs) for _, at, pairs in consistent if all(a == b for a, b in pairs)]
        hold(*(set().union(*(x[k] for x in same)) for k in (0, 1)))
    if len(consistent) > 1 and not results:
        for k, (begin, at, pairs) in enumerate(consistent):
            at, pairs = set(at), set(pairs)
            for other, more_at, more in consistent[k + 1:]:
                if other > begin + 2 * size:
                    break
                if consistent_slots(pairs | more):
                    at |= more_at
                    pairs |= more
            hold(at, pairs)
    if len(found) > 1 and not results:
        at, pairs = (set().union(*(x[k] for x in found.values())) for k in (0, 1))
        if consistent_slots(pairs):
            hold(at, pairs)
    if not results:
        return None
    exact, coverage, changed, count = max(results)
    return "exact" if exact else "changed", coverage, count, -changed


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, least: float = LEAST, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text", passage: int = PASSAGE, shortest: int = SHORTEST) -> DataFrame:
    """(doc, mark, item_id, kind, coverage, n_windows, n_changed) of every document and item that it holds."""
    spark = docs.sparkSession
    own = frames.records(benchmark, item_id, item_text).distinct()
    items = frames.stored(window_rows(own.select("doc", F.xxhash64("text").alias("mark"), "text"), n).where(F.col("tokens") >= shortest))
    bits = spark.sparkContext.broadcast(bitmap_of(items))
    short = [r[0] for r in items.where(F.col("length") < n).select("length").distinct().collect()]  # fewer than n
    found = window_rows(frames.records(docs, doc_id, text).select("doc", F.xxhash64("text").alias("mark"), "text"), n, bits, short)
    right = items.select(F.col("id").alias("item_id"), F.col("mark").alias("item_mark"), "w", F.col("tokens").alias("size"), "plain",
                         F.col("position").alias("at"), "length", "raw", F.col("slots").alias("own"))
    met = found.select("id", "mark", "w", "position", "slots").dropDuplicates().join(right, "w")
    # the windows of one document that meet one item: bounded by the two texts
    hits = met.groupBy("id", "mark", "item_id", "item_mark", "size", "plain").agg(
        F.collect_list(F.struct("position", "at", "length", "raw", "own", "slots")).alias("met"))
    names = ["doc", "mark", "item_id", "kind", "coverage", "n_windows", "n_changed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [judged(*(c.as_py() for c in row), n, least, passage) for row in zip(*(batch.column(c) for c in ("size", "plain", "met")))]
            here = pa.array([r is not None for r in out], pa.bool_())
            columns = [batch.column(c).filter(here) for c in ("id", "mark", "item_id")]
            for k, kind in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64())):
                columns.append(pa.array([r[k] for r in out if r], kind))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return hits.mapInArrow(run, "doc long, mark long, item_id long, kind string, coverage double, n_windows long, n_changed long")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    key, mark = F.coalesce(docs[doc_id].cast("long"), F.lit(frames.NO_ID)), F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit("")))
    found = frames.stored(leaks(docs, benchmark, doc_id=doc_id, text=text, **more).select("doc", "mark").distinct())
    return docs.join(found.toDF("__doc", "__mark"), (key == F.col("__doc")) & (mark == F.col("__mark")), "left_anti")
