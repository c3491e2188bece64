"""Substring deduplication: seeds joined on winnowed anchors, extended both ways, maximal repeats removed.

A window of ``size`` consecutive words goes if its words also begin earlier
(smaller document, or same document and earlier word); what goes is judged on the
input.  Seeds are winnowed word grams (``anchors``): one for each window, about one
in seven words.  Seeds with the same hash are joined; a seed extends to the left
and right over the windows that it stands for, and if the whole extension equals
that of an earlier seed, all its windows are repeats.  Where a seed meets others
with different extensions, one delegate of each extension is looked at again: its
windows are hashed one by one (128 bits) and every one but the first goes.  All
joins are sorted streams over one shuffle: no pairs are made, whatever the number
of copies.  Repeats that touch or overlap merge to maximal runs.

Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged.  A null text has
none.  Rows with a null doc_id count as one document behind all others; rows that
share a doc_id are one document, ordered by a hash of their texts.  Repeated rows
(same doc_id and text) get equal results.  Further columns pass through.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoscope.llm import anchors, frames
from dialoscope.llm.anchors import SETTLED, covered, gathered, packed, unpacked
from dialoscope.llm.hashing import BASE, U, Rolling, mix, runs, word_hashes, word_table

SIZE, GRAM = 20, 6
OTHER_BASE = 0xC2B2AE3D27D4EB4F


def word_units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, _, h, bounds = word_hashes(data, at, word_table())
    return h, bounds


def window_repeats(texts: DataFrame, size: int) -> DataFrame:
    """(doc, mark, at) of the delegates' windows that begin earlier elsewhere; ``texts``: (mark, text, doc, open)."""
    names = ["w1", "w2", "doc", "mark", "at"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            ids, marks = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            lists = batch.column(3)
            for low, _, at, data in frames.slices(batch.column(1)):
                both = [word_hashes(data, at, word_table(), b) for b in (BASE, OTHER_BASE)]
                bounds = both[0][3]
                rolls = [Rolling(both[i][2], b) for i, b in enumerate((BASE, OTHER_BASE))]
                for r in range(len(at) - 1):
                    _, first, more = unpacked(np.unique(lists[low + r].values.to_numpy()))
                    own = np.repeat(first - (np.cumsum(more + 1) - more - 1), more + 1) + np.arange(int((more + 1).sum()))
                    begin = bounds[r] + own
                    h1, h2 = (x.ranges(begin, begin + size).view(np.int64) for x in rolls)
                    parts.append((h1, np.maximum(h2, SETTLED + 1), np.full(len(own), ids[low + r]), np.full(len(own), marks[low + r]),
                                  packed(own, np.zeros(len(own), np.int64))))
            if not parts:
                continue
            w1, w2, doc, mark, at = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((at, mark, doc, w2, w1))
            w1, w2, doc, mark, at = anchors.distinct(*(c[order] for c in (w1, w2, doc, mark, at)))
            again = np.zeros(len(w1), bool)
            again[1:] = (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(c[~again]) for c in (w1, w2, doc, mark, at)], names=names)
            settled = (mix((doc ^ mark ^ at)[again].view(U)).view(np.int64), np.full(int(again.sum()), SETTLED), *(c[again] for c in (doc, mark, at)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in settled], names=names)

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            w1, w2, doc, mark, at = anchors.distinct(*(c.to_numpy() for c in batch.columns), last=last)
            if not len(w1):
                continue
            gone = np.zeros(len(w1), bool)
            gone[1:] = (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])
            gone[0] = last is not None and last[:2] == (w1[0], w2[0])
            gone |= w2 == SETTLED
            last = (w1[-1], w2[-1], doc[-1], mark[-1], at[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c[gone]) for c in (doc, mark, at)], names=["doc", "mark", "at"])

    sent = texts.select("mark", "text", "doc", "open").mapInArrow(send, "w1 long, w2 long, doc long, mark long, at long")
    return sent.repartition("w1").sortWithinPartitions("w1", "w2", "doc", "mark", "at").mapInArrow(later, "doc long, mark long, at long")


def repeats(own: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(doc, mark, at) of every run of window starts that goes; ``own``: (doc, text)."""
    found = frames.stored(anchors.seeds(own, word_units, gram, size, keep_first=True))
    texts = own.select("doc", F.xxhash64("text").alias("mark"), "text")
    delegates = gathered(found.where("a IS NOT NULL"), "open")
    return found.where("a IS NULL").select("doc", "mark", "at").unionByName(window_repeats(texts.join(delegates, ["doc", "mark"]), size))


def dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text",
          outputs: tuple[str, ...] = ("text",)) -> DataFrame:
    """``docs`` without repeated words in ``text`` (kept words joined by one space).

    outputs: any of ``text`` (replaced), ``n_words``, ``n_removed``, ``kept_sha256``, ``runs`` (removed word ranges).
    """
    own = frames.records(docs, doc_id, text)
    gone = gathered(frames.stored(repeats(own, size, gram)), "__gone").toDF("__doc", "__mark", "__gone")
    types = {"text": "string", "n_words": "long", "n_removed": "long", "kept_sha256": "string", "runs": "array<struct<start:long,end:long>>"}
    kept = [c for c in docs.columns if c != text and c not in outputs]
    left = docs.select(*(docs[c] for c in kept), F.coalesce(docs[text].cast("string"), F.lit("")).alias("__text"),
                       F.coalesce(docs[doc_id].cast("long"), F.lit(frames.NO_ID)).alias("__doc")) \
        .withColumn("__mark", F.xxhash64("__text"))
    joined = left.join(gone, ["__doc", "__mark"], "left").select(*kept, "__text", "__gone")
    arrow = {"text": pa.string(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(),
             "runs": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {c: [] for c in outputs}
            lists = batch.column("__gone")
            for row, value in enumerate(batch.column("__text")):
                words = value.as_py().encode().split()
                removed = np.zeros(len(words), bool)
                if lists[row].is_valid:
                    _, first, more = unpacked(lists[row].values.to_numpy())
                    removed = covered(len(words), first, more, size)
                    stay = [words[i] for i in np.flatnonzero(~removed).tolist()]
                else:
                    stay = words
                if "text" in made or "kept_sha256" in made:
                    left_over = b" ".join(stay)
                for name, get in (("text", lambda: left_over.decode()), ("n_words", lambda: len(words)), ("n_removed", lambda: int(removed.sum())),
                                  ("kept_sha256", lambda: hashlib.sha256(left_over).hexdigest()),
                                  ("runs", lambda: [{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in runs(removed, np.array([0, len(removed)]))))])):
                    if name in made:
                        made[name].append(get())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(made[c], arrow[c]) for c in outputs)],
                                             names=[*kept, *(text if c == "text" else c for c in outputs)])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    fields += [f"`{text if c == 'text' else c}` {types[c]}" for c in outputs]
    return joined.mapInArrow(run, ", ".join(fields))
