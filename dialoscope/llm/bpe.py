"""Byte-level BPE: encoding by a queue of merge ranks, decoding by concatenating vocabulary strings.

A text is cut at special tokens and then into pieces by the vocabulary's
pattern.  The symbols of a piece form a doubly linked list; a priority queue
holds rank and position of adjacent pairs.  The smallest entry is merged if the
pair at that position still has that rank; otherwise it is stale and skipped.  No shuffle: encoding is a narrow projection.

Null texts are empty texts; an empty text has no ids.  Repeated rows give
repeated results; further columns pass through, but those named like the output
(``ids``, ``decoded``) are replaced; a text of any length is encoded as a whole, in
memory of its own size; an empty table gives an empty
one.  Bytes that are no UTF-8 after decoding become U+FFFD.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoscope.llm import frames

# fixed values: the published splitting pattern of byte-level BPE; white space is the Unicode property
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Pieces kept with their ids in a task; longer pieces and those beyond the number are encoded anew.
KEPT_PIECES, KEPT_LENGTH = 500_000, 64
#: Bytes of one Arrow batch: texts are handled one by one, so larger ones only take memory.
BATCH = 2 << 20


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b if b in plain else next(spare)) for b in range(256)}


def token_strings(file: dict) -> list[bytes]:
    """The bytes of each id of a vocabulary file."""
    back = {v: k for k, v in byte_letters().items()}
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    strings = {i: bytes(back[c] for c in s) for s, i in file["model"]["vocab"].items() if s not in special}
    strings |= {i: s.encode() for s, i in special.items()}
    return [strings.get(i, b"") for i in range(max(strings) + 1)]


class Vocabulary:
    """Ids, merge ranks and special tokens of a vocabulary file."""

    def __init__(self, text: str):
        file = json.loads(text)
        letters = byte_letters()
        ids = file["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.strings = token_strings(file)
        self.bytes = [ids[letters[b]] for b in range(256)]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"])
        self.wide = len(self.strings)
        self.merges = {ids[a] * self.wide + ids[b]: ((rank + 1) << 32) + ids[a + b] for rank, (a, b) in enumerate(pairs)}
        self.pieces = regex.compile(PATTERN)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece."""
        symbols = list(map(self.bytes.__getitem__, piece.encode()))
        n = len(symbols)
        if n < 2:
            return symbols
        wide, find = self.wide, self.merges.get
        # the pair that starts at each symbol: its merge (rank and made symbol in one number), or 0
        pairs = [find(a * wide + b, 0) for a, b in zip(symbols, symbols[1:])]
        # a queue entry: rank above, position below; larger ranks and, among equals, later positions come later
        queue = [(pair >> 32 << 32) + i for i, pair in enumerate(pairs) if pair]
        pairs.append(0)
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            pair = pairs[i]
            if pair >> 32 != entry >> 32:
                continue  # stale
            made = symbols[i] = pair & 0xFFFFFFFF
            j = after[i]
            k = after[i] = after[j]
            symbols[j] = -1
            pairs[j] = 0
            if k < n:
                before[k] = i
                pairs[i] = pair = find(made * wide + symbols[k], 0)
                if pair:
                    push(queue, (pair >> 32 << 32) + i)
            else:
                pairs[i] = 0
            h = before[i]
            if h >= 0:
                pairs[h] = pair = find(symbols[h] * wide + made, 0)
                if pair:
                    push(queue, (pair >> 32 << 32) + h)
        return [s for s in symbols if s >= 0]


class Encoder(dict):
    """Piece to its ids (as packed 32-bit numbers); pieces met before are looked up."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.vocabulary.merge(piece), np.int32).tobytes()
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        v = self.vocabulary
        if not v.cuts or not any(s in text for s in v.special):
            return b"".join(map(self.__getitem__, v.pieces.findall(text)))
        return b"".join(np.int32(v.special[part]).tobytes() if part in v.special else
                        b"".join(map(self.__getitem__, v.pieces.findall(part))) for part in v.cuts.split(text))


def _file(docs: DataFrame, vocabulary: str):
    with open(vocabulary, encoding="utf-8") as f:  # a megabyte or two, whatever the input
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _clean(docs: DataFrame, column: str) -> DataFrame:
    frames.bounded_batches(docs.sparkSession, BATCH)
    return docs.withColumn(column, F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")))


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids (replacing one of that name)."""
    file = _file(docs, vocabulary)
    docs = _clean(docs.drop(ids), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(file.value))
        for batch in batches:
            names = batch.schema.names
            found = [encoder.encode(t) for t in batch.column(names.index(text)).to_pylist()]
            column = frames.lists(np.frombuffer(b"".join(found), np.int32), np.array([len(x) // 4 for x in found]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*names, ids])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``tokens`` with the text that the ids stand for; special tokens are kept as their strings."""
    frames.bounded_batches(tokens.sparkSession, BATCH)
    file = _file(tokens, vocabulary)
    tokens = tokens.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = token_strings(json.loads(file.value))  # no merges: they are only for encoding
        flat = np.frombuffer(b"".join(strings), np.uint8)
        size = np.array([len(s) for s in strings], np.int64)
        start = np.cumsum(size) - size
        for batch in batches:
            names = batch.schema.names
            column = batch.column(names.index(ids))
            out = []
            for row in range(len(column)):
                own = column[row].values
                own = own.to_numpy(zero_copy_only=False).astype(np.int64) if own is not None else np.zeros(0, np.int64)
                n = size[own]
                end = np.cumsum(n)
                where = np.repeat(start[own] - (end - n), n) + np.arange(int(n.sum()))
                out.append(flat[where].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, text])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(text, T.StringType())]))
