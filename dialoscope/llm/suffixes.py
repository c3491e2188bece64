"""Suffix-array deduplication: bytes covered by long strings that start twice are removed.

Candidates.  A string of ``size`` bytes that starts twice has the same winnowed
anchor at both places (``anchors``).  Anchors that occur once are done; stretches
(all the windows of an anchor, as one string) that occur twice are repeats as a
whole.  Anchors met with different stretches send one delegate of each stretch to a
shard; all stretches of an anchor meet in one shard, so no match is lost.

Shards.  A shard is a text of about ``SHARD`` bytes: the delegates' stretches with
separators.  Its suffix array is made by induced sorting: suffixes are classified
as S or L, leftmost S (LMS) substrings are sorted by an induction and named, the
string of names is sorted recursively, and from the sorted LMS suffixes the array
is induced in two passes, bucket by bucket (each bucket's work is vectorised; on the
string of names, whose alphabet is large, the passes go element by element).  The
permuted common prefixes follow: positions whose left neighbours differ are
measured, all others are one less than the position before.  A window whose
common prefix with its neighbour in the array reaches ``size`` starts elsewhere.

An anchor with more delegates than a shard holds is a crowded group.  Its windows
are parted by the number of bytes in front of the anchor, the lower and the upper
half of that range, and each half again by the bytes that all its windows share with
the gram.  Equal windows stay together; equal stretches of a narrower group are
settled as repeats, one of them stands for all.  The narrower groups go through the
same shards in another round; after at most eight rounds a group's windows are equal.

Texts are UTF-8 bytes; a null text is empty.  Rows with a null doc_id count as one
document; rows that share doc_id and text are one document.  What goes is judged
on the input.  Cutting inside a character leaves bytes that are no UTF-8: the kept
bytes are binary.  Further columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoscope.llm import anchors, frames
from dialoscope.llm.anchors import covered, gathered, unpacked
from dialoscope.llm.hashing import Rolling, runs

SIZE, GRAM = 200, 100
#: Bytes of a shard's text.
SHARD = 1 << 20


def s_types(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one (the last, a unique smallest value, is)."""
    head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    rising = np.ones(len(head), bool)
    rising[:-1] = t[head[1:]] > t[head[:-1]]
    return np.repeat(rising, np.diff(np.append(head, len(t))))


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """The suffix array from LMS suffixes in order: L suffixes left to right, then S suffixes right to left."""
    n = len(t)
    size_l = np.bincount(t[~small], minlength=alphabet)
    size_s = np.bincount(t[small], minlength=alphabet)
    base_l, base_s = np.cumsum(size_l) - size_l, np.cumsum(size_s) - size_s
    fill_l, fill_s = base_l.copy(), base_s.copy()
    by_l, by_s = np.zeros(n - int(small.sum()), np.int64), np.zeros(int(small.sum()), np.int64)  # S from the bucket's end
    seeds = lms[np.argsort(t[lms], kind="stable")]
    seed_at = np.searchsorted(t[seeds], np.arange(alphabet + 1))

    def give(found: np.ndarray, into: np.ndarray, fill: np.ndarray) -> None:
        """Append suffixes to the buckets of their first characters, in order."""
        code = t[found]
        order = np.argsort(code, kind="stable")
        code = code[order]
        head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        count = np.diff(np.append(head, len(code)))
        into[np.repeat(fill[code[head]] - head, count) + np.arange(len(code))] = found[order]
        fill[code[head]] += count

    def pass_over(buckets, base, fill, into, wanted: bool, rest) -> None:
        for c in buckets:
            done, parts = base[c], []
            while done < fill[c]:  # the bucket's own, also those that it induces in itself
                mine = into[done:fill[c]]
                done = fill[c]
                found = mine[mine > 0] - 1
                found = found[small[found] == wanted]
                own = t[found] == c
                same = found[own]
                into[fill[c]:fill[c] + len(same)] = same
                fill[c] += len(same)
                parts.append(found[~own])
            others = rest(c)
            found = others[others > 0] - 1
            parts.append(found[small[found] == wanted])
            found = np.concatenate(parts)
            if len(found):
                give(found, into, fill)

    pass_over(range(alphabet), base_l, fill_l, by_l, False, lambda c: seeds[seed_at[c]:seed_at[c + 1]])
    by_s[base_s[t[-1]]] = n - 1  # the sentinel is nobody's left neighbour
    fill_s[t[-1]] += 1
    pass_over(range(alphabet - 1, -1, -1), base_s, fill_s, by_s, True, lambda c: by_l[base_l[c]:base_l[c] + size_l[c]][::-1])
    out = np.empty(n, np.int64)
    where = np.cumsum(size_l + size_s) - size_l - size_s
    place_l = np.repeat(where - base_l, size_l) + np.arange(len(by_l))
    place_s = np.repeat(where + size_l + size_s - 1 + base_s, size_s) - np.arange(len(by_s))
    out[place_l], out[place_s] = by_l, by_s
    return out


def induce_elements(t: list[int], small: list[bool], lms: list[int], alphabet: int) -> list[int]:
    """As ``induce``, element by element, for large alphabets."""
    n = len(t)
    count = np.bincount(np.array(t), minlength=alphabet)
    head = (np.cumsum(count) - count).tolist()
    tail = np.cumsum(count).tolist()
    array = [-1] * n
    end = tail.copy()
    for i in reversed(lms):
        end[t[i]] -= 1
        array[end[t[i]]] = i
    for i in array:  # grows to the right of the reader
        if i > 0 and not small[i - 1]:
            i -= 1
            array[head[t[i]]] = i
            head[t[i]] += 1
    end = tail
    for k in range(n - 1, -1, -1):
        i = array[k]
        if i > 0 and small[i - 1]:
            i -= 1
            end[t[i]] -= 1
            array[end[t[i]]] = i
    return array


def suffix_array(t: np.ndarray, alphabet: int) -> np.ndarray:
    """Suffix array of ``t``, whose last value is its unique smallest."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    small = s_types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    narrow = alphabet <= 1024
    lists = None if narrow else (t.tolist(), small.tolist())

    def induced(order: np.ndarray) -> np.ndarray:
        if narrow:
            return induce(t, small, order, alphabet)
        return np.array(induce_elements(*lists, order.tolist(), alphabet), np.int64)

    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    array = induced(lms)
    order = array[is_lms[array]]  # sorted by LMS substrings
    end = np.append(lms[1:], n - 1) + 1  # a substring ends with the next one's first value
    number = np.zeros(n, np.int64)
    number[lms] = np.arange(len(lms))
    length = (end - lms)[number[order]]
    name = Rolling(t).ranges(order, order + length)
    differs = np.ones(len(order), bool)
    differs[1:] = (name[1:] != name[:-1]) | (length[1:] != length[:-1])
    names = np.cumsum(differs) - 1
    if names[-1] + 1 < len(order):
        reduced = np.empty(len(lms), np.int64)
        reduced[number[order]] = names
        order = lms[suffix_array(reduced, int(names[-1]) + 1)]
    return induced(order)


def common_prefixes(t: np.ndarray, array: np.ndarray, fresh: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Permuted common prefixes: of each position with its left neighbour in the array; and that neighbour (-1: none).

    ``fresh`` positions are measured in any case; lengths above ``most`` may come out shorter, but not below it
    within ``most`` positions behind a measured one.
    """
    n = len(t)
    before = np.full(n, -1)
    before[array[1:]] = array[:-1]
    at = np.arange(n)
    measure = fresh | (before < 1) | (at == 0)
    inner = np.flatnonzero(~measure)
    measure[inner] = t[inner - 1] != t[before[inner] - 1]
    here = np.flatnonzero(measure & (before >= 0))
    there = before[here]
    limit = np.minimum(2 * most, n - np.maximum(here, there))
    rolling = Rolling(t)
    length = np.zeros(len(here), np.int64)
    step = 1 << (2 * most).bit_length()
    while step:
        fits = np.flatnonzero(length + step <= limit)
        a, b = here[fits] + length[fits], there[fits] + length[fits]
        equal = rolling.ranges(a, a + step) == rolling.ranges(b, b + step)
        length[fits[equal]] += step
        step >>= 1
    known = np.zeros(n, np.int64)
    known[here] = length
    last = np.maximum.accumulate(np.where(measure, at, -1))
    return np.maximum(known[last] - (at - last), 0), before


def repeated_starts(texts: list[np.ndarray], size: int) -> np.ndarray:
    """Over the texts laid end to end: which positions start a string of ``size`` that starts elsewhere, too."""
    lengths = np.array([len(x) for x in texts])
    t = np.ones(int(lengths.sum()) + len(texts) + 1, np.uint16)
    begin = np.cumsum(lengths + 1) - lengths - 1
    inside = np.ones(len(t), bool)
    inside[begin + lengths] = False
    inside[-1] = False
    t[inside] = np.concatenate(texts).astype(np.uint16) + 2
    t[-1] = 0
    array = suffix_array(t, 258)
    fresh = np.zeros(len(t), bool)
    fresh[begin] = True
    prefix, before = common_prefixes(t, array, fresh, max(size, int(lengths.max(initial=0))))
    room = np.zeros(len(t), np.int64)
    room[inside] = np.repeat(begin + lengths, lengths) - np.flatnonzero(inside)
    hit = np.flatnonzero((prefix >= size) & (room >= size))
    out = np.zeros(len(t), bool)
    out[hit] = True
    out[before[hit]] = True
    return out[inside]


def byte_units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, at


def content(body: bytes) -> int:
    """A 64-bit number of some bytes."""
    return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)


#: A delegate: anchor, hash of the stretch, document, text, place, the stretch; where the gram lies in it (-1: not yet
#: looked for) and how many bytes in front of the gram the windows of its group may have.
DELEGATE = "a long, g long, doc long, mark long, at long, stretch binary, q int, low int, high int"
_NAMES = [f.split(" ")[0] for f in DELEGATE.split(", ")]
_KINDS = [*[pa.int64()] * 5, pa.binary(), *[pa.int32()] * 3]


def stretches(texts: DataFrame, size: int) -> DataFrame:
    """Delegates with their stretches; ``texts``: (mark, text, doc, open), open being structs of a and at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            at, data = frames.buffers(batch.column(1))
            a_out, doc_out, mark_out, at_out, bodies = [], [], [], [], []
            for r, own in enumerate(batch.column(3)):
                a, place = (own.values.field(k).to_numpy() for k in (0, 1))
                _, first, more = unpacked(place)
                a_out.append(a)
                at_out.append(place)
                doc_out.append(np.full(len(a), ids[r]))
                mark_out.append(np.full(len(a), marks[r]))
                bodies += [data[at[r] + f:at[r] + f + m + size].tobytes() for f, m in zip(first.tolist(), more.tolist())]
            if bodies:
                none = np.full(len(bodies), -1, np.int32)
                columns = [np.concatenate(a_out), [content(b) for b in bodies], *(np.concatenate(c) for c in (doc_out, mark_out, at_out)), bodies, none, none, none]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_NAMES)

    return texts.select("mark", "text", "doc", "open").mapInArrow(run, DELEGATE)


def halves(row: tuple, size: int, gram: int) -> Iterator[tuple]:
    """A delegate of a crowded group as one or two delegates of narrower ones.

    The windows of a group have low .. high bytes in front of the gram, so equal ones share the gram, low bytes in
    front of it and size - gram - high bytes behind it: these bytes name the group.
    """
    a, _, doc, mark, at, stretch, q, low, high = row
    first, more = at >> 8, at & 255
    if q < 0:
        # the last gram with the anchor's hash among the bytes that all windows share
        h = Rolling(np.frombuffer(stretch, np.uint8)).windows(gram).view(np.int64)
        q, low, high = more + int(np.flatnonzero(h[more:size - gram + 1] == a)[-1]), 0, size - gram
    middle = (low + high + 1) // 2
    for least, most in ((low, middle - 1), (middle, high)):
        fewest, fullest = max(least, q - more), min(most, q)  # the windows that this delegate has
        if fewest <= fullest:
            start, end = q - fullest, q - fewest
            body = stretch[start:end + size]
            name = content(b"%d %d " % (least, most) + stretch[q - least:q + size - most])
            yield name, content(body), doc, mark, ((first + start) << 8) | (end - start), body, q - start, least, most


def shard_repeats(delegates: DataFrame, size: int, gram: int, shard: int = SHARD) -> DataFrame:
    """(kind, delegate): kind 0 are places that go, kind 1 delegates of narrower groups of anchors too large for a shard."""

    def rows_of(kind: int, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 9
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), *(pa.array(c, k) for c, k in zip(columns, _KINDS))], names=["kind", *_NAMES])

    def gone(doc, mark, at) -> pa.RecordBatch:
        n = len(doc)
        columns = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *(pa.array(np.asarray(c, np.int64)) for c in (doc, mark, at)),
                   pa.nulls(n, pa.binary()), *[pa.nulls(n, pa.int32())] * 3]
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), *columns], names=["kind", *_NAMES])

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        """Places of the windows that repeat among the rows' stretches, by their suffix array."""
        texts = [np.frombuffer(r[5], np.uint8) for r in rows]
        doc, mark, at = (np.array([r[k] for r in rows], np.int64) for k in (2, 3, 4))
        _, first, _ = unpacked(at)
        lengths = np.array([len(x) for x in texts])
        hit = repeated_starts(texts, size) if len(rows) > 1 else np.zeros(int(lengths.sum()), bool)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        start, end = runs(hit, bounds)
        owner = np.searchsorted(bounds, start, side="right") - 1
        return gone(doc[owner], mark[owner], ((first[owner] + start - bounds[owner]) << 8) | (end - start - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # whole groups, waiting for company
        group: list[tuple] = []  # the open group
        held = grown = 0
        crowded, last, told = False, None, False
        for batch in batches:
            repeated, narrower = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if last and row[:5] == last[:5]:  # a repeated row of the table
                    continue
                if last and row[:2] == last[:2]:  # the same stretch elsewhere
                    repeated += [row[2:5]] if told else [last[2:5], row[2:5]]
                    last, told = row, True
                    continue
                if last and row[0] != last[0]:
                    if not crowded and len(group) > 1:
                        rows += group
                        held += grown
                        if held >= shard:
                            yield solve(rows)
                            rows, held = [], 0
                    group, grown, crowded = [], 0, False
                last, told = row, False
                if crowded:
                    narrower += halves(row, size, gram)
                    continue
                group.append(row)
                grown += len(row[5])
                if grown >= shard:
                    crowded = True
                    narrower += [h for r in group for h in halves(r, size, gram)]
                    group = []
            if repeated:
                yield gone(*zip(*repeated))
            if narrower:
                yield rows_of(1, narrower)
        if not crowded and len(group) > 1:
            rows += group
        if rows:
            yield solve(rows)

    tasks = int(delegates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return delegates.repartition(tasks, "a").sortWithinPartitions("a", "g", "doc", "mark", "at").mapInArrow(run, f"kind int, {DELEGATE}")


def repeats(own: DataFrame, size: int = SIZE, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(doc, mark, at) of every run of window starts that goes; ``own``: (doc, text)."""
    found = frames.stored(anchors.seeds(own, byte_units, gram, size, keep_first=False))
    texts = own.select("doc", F.xxhash64("text").alias("mark"), "text")
    wanted = found.where("a IS NOT NULL").groupBy("doc", "mark").agg(F.collect_list(F.struct("a", "at")).alias("open"))
    out = found.where("a IS NULL").select("doc", "mark", "at")
    delegates = stretches(texts.join(wanted, ["doc", "mark"]), size)
    while True:  # a group's range of bytes in front of the gram halves each time, down to equal windows
        judged = frames.stored(shard_repeats(delegates, size, gram, shard))
        out = out.unionByName(judged.where("kind = 0").select("doc", "mark", "at"))
        delegates = judged.where("kind = 1").drop("kind")
        if delegates.isEmpty():
            return out


def dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text",
          outputs: tuple[str, ...] = ("kept",)) -> DataFrame:
    """``docs`` without ``text``, with what is left of it.

    outputs: any of ``kept`` (bytes), ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``spans`` (removed byte ranges).
    """
    own = frames.records(docs, doc_id, text)
    gone = gathered(frames.stored(repeats(own, size, gram)), "__gone").toDF("__doc", "__mark", "__gone")
    types = {"kept": "binary", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string",
             "spans": "array<struct<start:long,end:long>>"}
    arrow = {"kept": pa.binary(), "kept_sha256": pa.string(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
    kept = [c for c in docs.columns if c != text and c not in outputs]
    left = docs.select(*(docs[c] for c in kept), F.coalesce(docs[text].cast("string"), F.lit("")).alias("__text"),
                       F.coalesce(docs[doc_id].cast("long"), F.lit(frames.NO_ID)).alias("__doc")) \
        .withColumn("__mark", F.xxhash64("__text"))
    joined = left.join(gone, ["__doc", "__mark"], "left").select(*kept, "__text", "__gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {c: [] for c in types}
            lists = batch.column("__gone")
            at, data = frames.buffers(batch.column("__text"))
            for row in range(batch.num_rows):
                own_bytes = data[at[row]:at[row + 1]]
                n = len(own_bytes)
                start = end = np.zeros(0, np.int64)
                left_over = own_bytes
                if lists[row].is_valid:
                    _, first, more = unpacked(lists[row].values.to_numpy())
                    removed = covered(n, first, more, size)
                    start, end = runs(removed, np.array([0, n]))
                    left_over = own_bytes[~removed]
                made["n_bytes"].append(n)
                made["n_removed"].append(n - len(left_over))
                made["n_spans"].append(len(start))
                if "kept" in outputs:
                    made["kept"].append(left_over.tobytes())
                if "kept_sha256" in outputs:
                    made["kept_sha256"].append(hashlib.sha256(left_over.tobytes()).hexdigest())
                if "spans" in outputs:
                    made["spans"].append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(made[c], arrow.get(c, pa.int64())) for c in outputs)],
                                             names=[*kept, *outputs])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"`{c}` {types[c]}" for c in outputs]
    return joined.mapInArrow(run, ", ".join(fields))
