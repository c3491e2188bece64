"""Line deduplication: range-partitioned line hashes, first occurrences streamed, keep bitmaps returned.

A line's key is the line without the white space bytes 0x20 and 0x09-0x0D at its
ends, with A-Z lower-cased.  Keys of ``least`` code points or more that occur in
two documents or more keep their lines in the smallest document only.

1. Each document's long enough lines become (hash, document, mark, position)
   rows; the mark is a hash of the text and tells rows of one doc_id apart.
2. Rows are range-partitioned and sorted by hash, document, position, so that a
   key found in every third document is spread over partitions.  Each partition
   streams its rows and keeps the document that opened the current hash.
3. Where a partition begins inside a hash it can't know the opener: those rows
   come out undecided, and every partition reports the opener of its first and
   last hash.  These reports (two rows a partition) decide the undecided ones.
4. Dropped positions meet their document and become a bitmap.

A null text is one empty line.  Rows with a null doc_id count as one document
behind all others; rows that share a doc_id count as one document.  Repeated
rows get equal bitmaps.  Texts of any length are read whole: one row a line, one bitmap
a document.  Further columns pass through; those named like the outputs are replaced.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoscope.llm import frames
from dialoscope.llm.hashing import SPACES, Rolling, lower_table, runs

#: Odd bases of the two halves of a key's hash.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def line_rows(docs: DataFrame, least: int = 10) -> DataFrame:
    """(hash of 2 longs, doc, mark, position) of every line whose key has ``least`` code points."""
    lower = lower_table()
    spaces = np.zeros(256, bool)
    spaces[list(SPACES)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy() for c in (0, 2))
            for first, end, at, data in frames.slices(batch.column(1)):
                data = lower[data]
                start, stop = runs(data != 10, at)  # lines that aren't empty
                # strip: from each line's first to its last byte that is no space
                solid = np.flatnonzero(~spaces[data])
                a = np.searchsorted(solid, start)
                b = np.searchsorted(solid, stop)
                full = a < b
                start, a, b = start[full], a[full], b[full]
                key_start, key_stop = solid[a], solid[b - 1] + 1
                heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points
                long = heads[key_stop] - heads[key_start] >= least
                start, key_start, key_stop = start[long], key_start[long], key_stop[long]
                row = np.searchsorted(at, start, side="right") - 1
                breaks = np.concatenate([[0], np.cumsum(data == 10)])
                position = breaks[start] - breaks[at[row]]
                hashes = [Rolling(data, base).ranges(key_start, key_stop).view(np.int64) for base in BASES]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h) for h in hashes] + [pa.array(ids[first + row]), pa.array(marks[first + row]), pa.array(position.astype(np.int32))],
                    names=["h1", "h2", "doc", "mark", "position"])

    return docs.select("doc", "text", F.xxhash64("text").alias("mark")).mapInArrow(
        run, "h1 long, h2 long, doc long, mark long, position int")


def first_occurrences(rows: DataFrame) -> DataFrame:
    """Stream the sorted ranges: rows to drop, undecided rows, and the openers at the ends of each partition.

    Returns (kind, h1, h2, doc, mark, position): kind 0 a row to drop, 1 undecided, 2 an opener.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "h1", "h2", "doc", "position").sortWithinPartitions("h1", "h2", "doc", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = None  # (h1, h2, doc) of the hash that is open at the end of the last batch
        head = None  # the partition's first hash while it is open: its rows stay undecided
        none = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, mark, position = (c.to_numpy() for c in batch.columns)
            if opened is None:
                opened = head = (h1[0], h2[0], doc[0])
                yield events(2, *(np.array([x]) for x in (*opened, 0, 0)))
            # the document that opened each row's hash
            new = np.empty(len(h1), bool)
            new[0] = (h1[0], h2[0]) != opened[:2]
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            group = np.cumsum(new)
            openers = np.concatenate([[opened[2]], doc[new]])
            undecided = (group == 0) & (head is not None)
            drop = ~undecided & (doc != openers[group])
            yield events(1, h1[undecided], h2[undecided], doc[undecided], mark[undecided], position[undecided])
            yield events(0, none, none, doc[drop], mark[drop], position[drop])
            if group[-1]:
                head = None
                opened = (h1[-1], h2[-1], openers[-1])
        if opened is not None:
            yield events(2, *(np.array([x]) for x in (*opened, 0, 0)))

    def events(kind, h1, h2, doc, mark, position):
        if kind == 0:
            h1 = h2 = np.zeros(len(doc), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(doc), kind, np.int32)), *(pa.array(np.asarray(c, np.int64)) for c in (h1, h2, doc, mark)),
             pa.array(np.asarray(position, np.int32))], names=["kind", "h1", "h2", "doc", "mark", "position"])

    return ranged.mapInArrow(run, "kind int, h1 long, h2 long, doc long, mark long, position int")


def dropped(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc, mark, position) of every line that goes."""
    # the rows are read twice, once for the bounds of the ranges
    events = frames.stored(first_occurrences(frames.stored(line_rows(docs, least))))
    sure = events.where("kind = 0").select("doc", "mark", "position")
    # at most one row for each of the two ends of a partition, whatever the data
    openers = events.where("kind = 2").groupBy("h1", "h2").agg(F.min("doc").alias("opener"))
    rest = events.where("kind = 1").join(F.broadcast(openers), ["h1", "h2"]).where("doc > opener").select("doc", "mark", "position")
    return sure.unionByName(rest)


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """(doc, mark, keep): the compressed bitmap of the lines to keep, for documents that lose any.

    Lines past the bitmap's end are kept.  ``unpack`` reads a bitmap.
    """
    gone = dropped(frames.records(docs, doc_id, text), least)

    @F.pandas_udf("binary")
    def pack(positions):
        return positions.map(pack_bitmap)

    # positions of one document: bounded by the document itself
    return gone.groupBy("doc", "mark").agg(F.collect_set("position").alias("positions")).select("doc", "mark", pack("positions").alias("keep"))


def pack_bitmap(positions: np.ndarray) -> bytes:
    bits = np.ones(int(max(positions)) // 8 * 8 + 8, bool)
    bits[positions] = False
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpack(keep: bytes | None, n: int) -> np.ndarray:
    """Which of ``n`` lines stay."""
    out = np.ones(n, bool)
    if keep is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n].astype(bool)
        out[:len(bits)] = bits
    return out


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  outputs: tuple[str, ...] = ("text",)) -> DataFrame:
    """``docs`` with the kept lines of ``text``.

    outputs: any of ``text`` (replaced), ``n_lines``, ``n_dropped``, ``kept_sha256``.
    """
    frames.bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != text and c not in outputs]
    types = {"text": "string", "n_lines": "long", "n_dropped": "long", "kept_sha256": "string"}
    left = docs.select(*(docs[c] for c in kept), docs[text].cast("string").alias("__text"),
                       F.coalesce(docs[doc_id].cast("long"), F.lit(frames.NO_ID)).alias("__doc"),
                       F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))).alias("__mark"))
    joined = left.join(bitmaps.toDF("__doc", "__mark", "__keep"), ["__doc", "__mark"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {c: [] for c in types}
            for value, keep in zip(batch.column("__text").to_pylist(), batch.column("__keep").to_pylist()):
                lines = (value or "").split("\n")
                stay = unpack(keep, len(lines))
                out = value if keep is None else "\n".join(x for x, s in zip(lines, stay) if s)
                own["text"].append(out)
                own["n_lines"].append(len(lines))
                own["n_dropped"].append(int((~stay).sum()))
                if "kept_sha256" in outputs:
                    own["kept_sha256"].append(hashlib.sha256((out or "").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array(own[c], pa.string() if types[c] == "string" else pa.int64()) for c in outputs)],
                names=[*kept, *(text if c == "text" else c for c in outputs)])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    fields += [f"`{text if c == 'text' else c}` {types[c]}" for c in outputs]
    return joined.select(*kept, "__text", "__keep").mapInArrow(run, ", ".join(fields))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 10,
                outputs: tuple[str, ...] = ("text",)) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, doc_id, text, least), doc_id, text, outputs)
