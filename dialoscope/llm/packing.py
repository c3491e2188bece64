"""Best-fit packing of token sequences, improved by a swap-based local search between underfull bins.

1. Texts become token ids and an end id; only those longer than a sequence are
   cut, from the end, so that the first piece is the shorter one.
2. Whole pieces are sequences of their own.  The others are dealt at random into
   shards of about ``SHARD`` pieces; each shard is packed by one task: best fit,
   longest first, then the local search.
3. The local search takes the emptiest underfull bin and gives its pieces away:
   it moves one into a bin with room, exchanges one for a shorter one, two for
   one, or one for two, always so that the sum of squared fills grows (the fuller
   bin gets fuller), until the bin is empty or nothing fits.  Receivers are found
   by their room per held length, not by trying all pairs.  It ends early when
   the number of bins meets the lower bound of total length.
4. Full bins are final.  Underfull bins of all shards are dealt anew and searched
   together; with every round they become fewer, until one shard holds them all,
   or until ``PATIENCE`` rounds empty no bin.

Only numbers travel (document, piece, length), never tokens.  A shard is bounded
in pieces, whatever lengths are hot; equal lengths or copies need no treatment of
their own, since dealing is by row, not by key.

A null text is empty: one piece with the end id alone.  Null numbers pass
through; repeated rows are packed as often as they occur.  A text of any length
is cut whole; its pieces may lie anywhere.  Further columns are not carried; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoscope.llm import frames
from dialoscope.llm.bpe import PATTERN, byte_letters

#: Tokens of a sequence, and the id behind each document.
CAPACITY, END = 2048, 0
#: Pieces of one shard: what one task packs at a time.
SHARD = 8192
#: Rounds in a row that empty no bin before the search ends: shards are dealt anew each time.
PATIENCE = 2
#: Columns of a piece.
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"

_WHITE = "\t-\r \x85\xa0  -     　"
#: Between the last two of a run of white space in front of something else: there, and only there, the pattern looks ahead.
_CUT = re.compile(f"[{_WHITE}](?=[{_WHITE}][^{_WHITE}])")


def encoder(file: str) -> Callable[[str], list[int]]:
    """Ids of a text by a byte-level vocabulary whose merge order is the order of ids.

    The pattern without its look-ahead is cheaper by half; a text is cut where the look-ahead would cut it.
    """
    own = json.loads(file)
    back = {v: k for k, v in byte_letters().items()}
    special = {t["content"]: t["id"] for t in own["added_tokens"]}
    ranks = {bytes(back[c] for c in s): i for s, i in own["model"]["vocab"].items() if s not in special}
    merged = [ranks[bytes(back[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in own["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError("merges are not in the order of their ids")
    plain = PATTERN.replace(r"|\p{White_Space}+(?!\P{White_Space})", "").replace(r"\p{White_Space}", r"\s")
    library = tiktoken.Encoding("packing", pat_str=plain, mergeable_ranks=ranks, special_tokens={})
    cuts = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def ordinary(text: str) -> list[int]:
        at, out = 0, []
        for m in _CUT.finditer(text):
            out += library.encode_ordinary(text[at:m.end()])
            at = m.end()
        return out + library.encode_ordinary(text[at:])

    def encode(text: str) -> list[int]:
        if not cuts or not any(s in text for s in special):
            return ordinary(text)
        out = []
        for part in cuts.split(text):
            out += [special[part]] if part in special else ordinary(part)
        return out

    return encode


def pieces(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END,
           with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, and its ids where asked for."""
    with open(vocabulary, encoding="utf-8") as f:  # a megabyte or two, whatever the input
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    frames.bounded_batches(docs.sparkSession)
    named = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(file.value)
        for batch in batches:
            rows: list[tuple] = []
            for number, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(own.as_py()), end], "<u4")
                at, k = 0, 0
                while at < len(ids):
                    size = (len(ids) - at) % capacity or capacity
                    part = ids[at:at + size]
                    rows.append((number, k, at, size, zlib.crc32(part.tobytes()), *([part] if with_ids else [])))
                    at, k = at + size, k + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names[:len(columns)])

    return named.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of row numbers: longest first, each into the fullest bin with room for it."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room
    rooms = 0  # bit r: some bin has room r
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        open_bins[left].append(b)
        rooms |= 1 << left
    return bins


class Search:
    """Local search between underfull bins.

    ``held[0][s]`` is a heap of (room, bin) for bins that hold a piece of length s, ``held[1][s]`` for two pieces of
    length s together, ``held[2][0]`` for all bins; entries that no longer hold are skipped.  ``top`` has the room of
    each heap's first entry, or more.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.lengths, self.capacity, self.bins = lengths, capacity, bins
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.version = [0] * len(bins)
        self.held: tuple = (defaultdict(list), defaultdict(list), defaultdict(list))
        self.top = [np.full(capacity + 1, -1, np.int64) for _ in self.held]
        self.size = np.arange(capacity + 1)
        self.emptiest: list = []
        self.donor = -1
        for b in range(len(bins)):
            self.enter(b)

    def sums(self, b: int) -> tuple[dict[int, tuple], dict[int, tuple]]:
        """The pieces of bin b by length, and pairs of them by common length: one example each."""
        by: dict[int, list[int]] = defaultdict(list)
        for i in self.bins[b]:
            by[self.lengths[i]].append(i)
        sizes = sorted(by)
        twos = {x + y: (by[x][0], by[y][0]) for k, x in enumerate(sizes) for y in sizes[k + 1:]}
        twos |= {2 * x: tuple(own[:2]) for x, own in by.items() if len(own) > 1}
        return {x: (own[0],) for x, own in by.items()}, twos

    def enter(self, b: int) -> None:
        """Index bin b as a receiver and as a later donor."""
        self.version[b] += 1
        room = self.capacity - self.fill[b]
        if not room or not self.bins[b]:
            return
        heapq.heappush(self.emptiest, (self.fill[b], b, self.version[b]))
        for held, top, sizes in zip(self.held, self.top, (*self.sums(b), (0,))):
            for s in sizes:
                heapq.heappush(held[s], (-room, b, self.version[b]))
                top[s] = max(top[s], room)

    def best(self, kind: int, s: int) -> tuple[int, int]:
        """(room, bin) of the roomiest bin but the donor that holds s; (-1, -1) if none does."""
        heap, aside, found = self.held[kind][s], None, (-1, -1)
        while heap:
            room, b, version = heap[0]
            if version != self.version[b]:
                heapq.heappop(heap)
            elif b == self.donor:
                aside = heapq.heappop(heap)
            else:
                found = (-room, b)
                break
        if aside:
            heapq.heappush(heap, aside)
        self.top[kind][s] = found[0]
        return found

    def receiver(self, kind: int, given: int) -> tuple[int, int, int] | None:
        """(gain, bin, length it gives back): a bin that takes ``given`` for less, with the largest gain."""
        for s in np.flatnonzero(self.top[kind][:given] + self.size[:given] >= given).tolist():
            room, b = self.best(kind, s)
            gain = given - s
            if room >= gain and self.fill[b] + gain > self.fill[self.donor]:  # the sum of squared fills grows
                return gain, b, s
        return None

    def step(self) -> bool:
        """One improving exchange of the donor, the largest gain first; False if there is none."""
        singles, twos = self.sums(self.donor)
        best: tuple | None = None
        # what goes against what comes back: one for nothing, one for one, one for two, two for one
        for given, kind in ((singles, 2), (singles, 0), (singles, 1), (twos, 0)):
            for total, out in given.items():
                found = self.receiver(kind, total)
                if found and (best is None or found[0] > best[0][0]):
                    best = (found, out, kind)
        if best is None:
            return False
        (gain, b, s), out, kind = best
        back = () if kind == 2 else self.sums(b)[kind][s]
        for here, there, moved in ((self.donor, b, out), (b, self.donor, back)):
            for i in moved:
                self.bins[here].remove(i)
                self.bins[there].append(i)
        self.fill[self.donor] -= gain
        self.fill[b] += gain
        self.enter(b)
        self.enter(self.donor)
        return True

    def run(self, least: int) -> list[list[int]]:
        """Try each bin once as donor, the emptiest first, until ``least`` bins are left."""
        left, tried = sum(1 for b in self.bins if b), set()
        while left > least and self.emptiest:
            _, b, version = heapq.heappop(self.emptiest)
            if version != self.version[b] or b in tried:
                continue
            tried.add(b)
            self.donor = b
            while self.bins[b] and self.step():
                pass
            self.donor = -1
            left -= not self.bins[b]
            self.enter(b)
        return [b for b in self.bins if b]


def pack_shard(lengths: list[int], before: list[int], capacity: int) -> list[list[int]]:
    """Bins of the rows of one shard; ``before`` is the bin of each row so far, kept if nothing is won."""
    least = -(-sum(lengths) // capacity)
    bins = best_fit(lengths, capacity)
    if len(bins) > least:
        full = [b for b in bins if sum(lengths[i] for i in b) == capacity]
        rest = [b for b in bins if sum(lengths[i] for i in b) < capacity]
        bins = full + Search(rest, lengths, capacity).run(least - len(full))
    old = defaultdict(list)
    for i, b in enumerate(before):
        old[b].append(i)
    return list(old.values()) if min(before, default=-1) >= 0 and len(old) <= len(bins) else bins


def place(parts: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``parts`` (with a column length of at most ``capacity``) with (sequence_id, offset).

    Every row is placed once; rows of a sequence lie behind each other without gaps.
    """
    spark = parts.sparkSession
    names = parts.columns
    longest = parts.agg(F.max("length")).first()[0]
    if longest is not None and longest > capacity:
        raise ValueError(f"a piece of {longest} tokens does not fit into {capacity}")
    whole = F.col("length") == capacity
    # a sequence is named by the round, the task's shard and its bin there; round 0 are whole pieces
    done = [parts.where(whole).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})]
    left = parts.where(~whole).withColumns({"__bin": F.lit(-1).cast("long"), "__row": F.monotonically_increasing_id()})
    left = left.withColumn("__deal", F.xxhash64("__row"))
    count, bins, turn, idle = left.count(), None, 1, 0
    while count:
        packed = frames.stored(pack_round(left, names, turn, -(-count // shard), capacity))
        got = packed.agg(F.count_distinct("__bin"), F.count_if(~F.col("__full")),
                         F.count_distinct(F.when(~F.col("__full"), F.col("__bin")))).first()
        idle = idle + 1 if bins is not None and got[0] >= bins else 0
        if count <= shard or idle >= PATIENCE or not got[1]:
            done.append(final(packed, names))
            break
        done.append(final(packed.where("__full"), names))
        count, bins, turn = got[1], got[2], turn + 1
        # whole bins are dealt, so that a shard can keep what it can't better
        left = packed.where("NOT __full").drop("__full", "offset").withColumn("__deal", F.xxhash64("__bin", F.lit(turn)))
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return out


def final(packed: DataFrame, names: list[str]) -> DataFrame:
    return packed.select(*names, F.col("__bin").alias("sequence_id"), "offset")


def pack_round(left: DataFrame, names: list[str], turn: int, shards: int, capacity: int) -> DataFrame:
    """Pack each shard; the number of a bin tells round, shard and place."""
    spark = left.sparkSession
    tasks = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = left.withColumn("__shard", F.pmod("__deal", F.lit(shards)).cast("int")).drop("__deal") \
        .repartition(tasks, "__shard").sortWithinPartitions("__shard", F.col("length").desc(), "__bin", "__row")
    fields = dealt.schema.fieldNames()

    def settle(own: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(own).combine_chunks().to_batches()[0]
        lengths = rows.column(fields.index("length")).to_pylist()
        shard = rows.column(fields.index("__shard"))[0].as_py()
        bins = pack_shard(lengths, rows.column(fields.index("__bin")).to_pylist(), capacity)
        number, offset, full = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                number[i], offset[i] = (turn << 56) + (shard << 24) + k, at
                at += lengths[i]
            full[b] = at == capacity
        return pa.RecordBatch.from_arrays(
            [*(rows.column(fields.index(c)) for c in (*names, "__row")), pa.array(number), pa.array(offset), pa.array(full)],
            names=[*names, "__row", "__bin", "offset", "__full"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.RecordBatch] = []
        for batch in batches:
            shard = batch.column(fields.index("__shard")).to_numpy()
            edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(shard)]
            for a, b in zip(edges, edges[1:]):
                if own and own[0].column(fields.index("__shard"))[0].as_py() != shard[a]:
                    yield settle(own)
                    own = []
                own.append(batch.slice(a, b - a))
        if own:
            yield settle(own)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields if f.name in (*names, "__row"))
    return dealt.mapInArrow(run, f"{kinds}, __bin long, offset long, __full boolean")


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END,
         shard: int = SHARD, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece."""
    return place(frames.stored(pieces(docs, vocabulary, doc_id, text, capacity, end, with_ids)), capacity, shard)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, spans) of pieces packed with their ids: at most ``capacity`` tokens a row."""
    span = F.struct("offset", "length", "doc_id", "piece", "ids")
    gathered = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(span)).alias("own"))
    return gathered.select("sequence_id", F.flatten(F.transform("own", lambda s: s["ids"])).alias("ids"),
                           F.transform("own", lambda s: s.dropFields("ids")).alias("spans"))
