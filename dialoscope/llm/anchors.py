"""Seeds shared by the operators that look for repeated passages.

Every window of ``size`` units (bytes or words) of a text has one anchor: among
its grams the one of smallest hash.  Equal windows have equal anchors at equal
places.  An anchor stands for a run of window starts; the passage that these
windows cover is its stretch.  So two anchors of one hash are compared by their
stretches first: equal stretches repeat each other window by window.  Anchors
whose hash occurs with several stretches remain to be looked at closely, by one
delegate of each stretch, the first.

Rows are (a, g, doc, mark, at): hashes of the anchor and of its stretch, the
document, the text's hash (it tells texts of one doc_id apart, so places are always
grouped and joined by both), and packed into ``at`` the first window start and the
number of further ones.  A batch of
documents settles what repeats inside it and sends one row for each (a, g), so a
stretch that very many documents hold comes as one row a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoscope.llm import frames
from dialoscope.llm.hashing import U, Rolling, mix, winnow

#: In place of a stretch's hash: the row is settled, its windows go.
SETTLED = -(2**63)
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def packed(start: np.ndarray, more: np.ndarray | int) -> np.ndarray:
    return (start << 8) | more


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last and the first window start, the number of further ones."""
    return (at >> 8) + (at & 255), at >> 8, at & 255


def anchors(seq: np.ndarray, bounds: np.ndarray, gram: int, size: int):
    """Row, anchor hash, stretch hash, first and last window start (in the slice) of the anchors of a slice."""
    rolling = Rolling(seq)
    h = rolling.windows(gram)
    place, first, last = winnow(h, bounds, gram, size)
    stretch = rolling.ranges(first, last + size)
    g = mix(stretch ^ mix((place - first).astype(U))).view(np.int64)
    row = np.searchsorted(bounds, first, side="right") - 1
    return row, h[place].view(np.int64), np.maximum(g, SETTLED + 1), first, last


def seeds(docs: DataFrame, units: Units, gram: int, size: int, keep_first: bool) -> DataFrame:
    """(a, doc, mark, at) of what is settled (a null) and of the delegates that are not.

    keep_first: the first occurrence (smallest doc, mark and place) stays; else all occurrences go.
    """
    if not 0 <= size - gram < 256:
        raise ValueError("a window must hold its gram and at most 255 units more")
    names = ["a", "g", "doc", "mark", "at"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts = []
            for low, _, at, data in frames.slices(batch.column(2)):
                seq, bounds = units(data, at)
                row, a, g, first, last = anchors(seq, bounds, gram, size)
                parts.append((a, g, ids[low + row], marks[low + row], packed(first - bounds[row], last - first)))
            a, g, doc, mark, at = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5
            order = np.lexsort((at, mark, doc, g, a))
            a, g, doc, mark, at = distinct(*(c[order] for c in (a, g, doc, mark, at)))
            again = np.zeros(len(a), bool)
            again[1:] = (a[1:] == a[:-1]) & (g[1:] == g[:-1])
            gone = again.copy()
            if not keep_first:
                gone[:-1] |= again[1:]
            yield rows_of(*(c[~again] for c in (a, g, doc, mark, at)))
            # settled rows travel along, dealt by their own place
            yield rows_of(mix((doc ^ mark ^ at)[gone].view(U)).view(np.int64), np.full(int(gone.sum()), SETTLED), *(c[gone] for c in (doc, mark, at)))

    def rows_of(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last row; whether it went; whether it is the delegate of its anchor's first stretch so far
        pending = None  # delegate of the first stretch of the open anchor, until another stretch shows up

        def out(*columns):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "doc", "mark", "at"])

        for batch in batches:
            a, g, doc, mark, at = (c.to_numpy() for c in batch.columns)
            done = g == SETTLED
            if done.any():
                yield out(pa.nulls(int(done.sum()), pa.int64()), doc[done], mark[done], at[done])
                a, g, doc, mark, at = (c[~done] for c in (a, g, doc, mark, at))
            a, g, doc, mark, at = distinct(a, g, doc, mark, at, last=last)
            if not len(a):
                continue
            same_a, same_g = np.zeros(len(a), bool), np.zeros(len(a), bool)
            same_a[1:] = a[1:] == a[:-1]
            same_g[1:] = same_a[1:] & (g[1:] == g[:-1])
            if last is not None:
                same_a[0] = a[0] == last[0]
                same_g[0] = same_a[0] and g[0] == last[1]
            gone = same_g.copy()
            if not keep_first:
                gone[:-1] |= same_g[1:]
                if same_g[0] and last is not None and not last[5]:
                    yield out(pa.nulls(1, pa.int64()), *([x] for x in last[2:5]))
            yield out(pa.nulls(int(gone.sum()), pa.int64()), doc[gone], mark[gone], at[gone])
            heads = np.flatnonzero(~same_g)  # delegates: the first row of each stretch
            if len(heads):
                if pending is not None and same_a[heads[0]]:
                    yield out(*([x] for x in pending))
                follows = np.zeros(len(heads), bool)
                follows[:-1] = same_a[heads[1:]]
                open_ = heads[same_a[heads] | follows]
                yield out(a[open_], doc[open_], mark[open_], at[open_])
                end = heads[-1]
                pending = None if same_a[end] else (a[end], doc[end], mark[end], at[end])
            last = (a[-1], g[-1], doc[-1], mark[-1], at[-1], bool(gone[-1]))

    sent = docs.select("doc", F.xxhash64("text").alias("mark"), "text").mapInArrow(send, "a long, g long, doc long, mark long, at long")
    return sent.repartition("a").sortWithinPartitions("a", "g", "doc", "mark", "at").mapInArrow(settle, "a long, doc long, mark long, at long")


def distinct(*columns: np.ndarray, last: tuple | None = None) -> tuple[np.ndarray, ...]:
    """Sorted rows, each once: repeated rows of a table are one document."""
    if not len(columns[0]):
        return columns
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    new[0] = last is None or tuple(last[:len(columns)]) != tuple(c[0] for c in columns)
    return tuple(c[new] for c in columns)


def gathered(rows: DataFrame, name: str) -> DataFrame:
    """(doc, mark, name): the places of a document, bounded by the document itself."""
    return rows.groupBy("doc", "mark").agg(F.collect_list("at").alias(name))


def covered(n: int, starts: np.ndarray, more: np.ndarray, size: int) -> np.ndarray:
    """Which of ``n`` units lie in windows that begin at starts .. starts + more."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + more + size, n), -1)
    return np.cumsum(steps)[:n] > 0
