"""Fill-in-middle: texts cut at two unit counts, the parts put in prefix-suffix-middle or suffix-prefix-middle order.

A text is cut into units, matched left to right over its code points: each code
point is a unit, or each match of a pattern (what lies between two matches goes
with the later one, what follows the last match with the last one).  The text's
UTF-8 bytes are cut into fixed blocks; a Fenwick tree over the blocks stores how
many units end and how many code points begin in each.  A cut after k units is
found by a binary-lifting descent to the block that holds the k-th unit's end;
only that block is then looked at byte by byte.  The tree's second count gives
the code points before the cut, so no text is decoded for its length.

Cuts and form of a row depend on its number alone: h1 to h4 are the first four
8-digit groups of the hex sha256 of ``salt:number``.  So any task, or a repeated
one, forms the same sample.  No shuffle: the operator is a narrow projection.

A null text is empty and stays plain; so does a text that holds a control string.
A null number has the empty string for its digits.  Repeated rows give repeated
results.  A text of any length is handled as a whole (its tree has one entry for
``BLOCK`` bytes).  Further columns pass through; columns named like the results
are replaced.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoscope.llm import frames

# fixed values: control strings of prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of one block.
BLOCK = 4096
#: Percent of texts that are transformed, and percent of those in suffix-prefix-middle order.
RATE, SPM = 90, 20


class Fenwick:
    """Prefix sums of several counts over blocks, with descent by the first of them."""

    def __init__(self, counts: np.ndarray):
        """counts: one row per block, one column per count."""
        n = len(counts)
        # node i sums the blocks (i - lowbit(i), i], read off plain prefix sums
        sums = np.concatenate([np.zeros((1, counts.shape[1]), np.int64), np.cumsum(counts, axis=0)])
        i = np.arange(1, n + 1)
        self.tree = np.concatenate([np.zeros((1, counts.shape[1]), np.int64), sums[i] - sums[i - (i & -i)]])
        self.n = n

    def descend(self, k: int) -> tuple[int, np.ndarray]:
        """The last block before which fewer than k of the first count lie, and all counts before it."""
        at, before = 0, np.zeros(self.tree.shape[1], np.int64)
        step = 1 << self.n.bit_length()
        while step:
            if at + step <= self.n and before[0] + self.tree[at + step, 0] < k:
                at += step
                before = before + self.tree[at]
            step >>= 1
        return min(at, self.n - 1), before


class Blocks:
    """A text's bytes, where its code points and units are, and the tree over its blocks."""

    def __init__(self, data: np.ndarray, ends: np.ndarray | None = None, block: int = BLOCK):
        """ends: byte offset behind each unit; None: units are code points."""
        self.data, self.block = data, block
        starts = (data & 0xC0) != 0x80
        self.ends = ends
        edges = np.arange(0, len(data), block)
        points = np.add.reduceat(starts, edges, dtype=np.int64)
        # a unit belongs to the block of its first byte (code points) or of its last one (matches)
        units = points if ends is None else np.bincount((ends - 1) // block, minlength=len(edges))
        self.tree = Fenwick(np.stack([units, points], axis=1))
        self.units, self.points = int(units.sum()), int(points.sum())

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first k units."""
        if k <= 0:
            return 0, 0
        if k >= self.units:
            return len(self.data), self.points
        # a cut in front of unit k + 1 for code points, behind unit k for matches
        b, (units, points) = self.tree.descend(k + 1 if self.ends is None else k)
        low, high = b * self.block, min((b + 1) * self.block, len(self.data))
        starts = (self.data[low:high] & 0xC0) != 0x80
        if self.ends is None:
            return low + int(np.flatnonzero(starts)[k - units]), k
        first = int(np.searchsorted(self.ends, low, side="right"))
        end = int(self.ends[first + k - units - 1])
        return end, int(points) + int(starts[:end - low].sum())


def units_of(text: str, unit: regex.Pattern) -> np.ndarray:
    """Byte offsets behind the units of a text."""
    ends = [m.end() for m in unit.finditer(text) if m.end() > m.start()]
    ends[-1:] = [len(text)]
    return np.cumsum([len(text[a:b].encode()) for a, b in zip([0, *ends], ends)], dtype=np.int64)


def draws(number: int | None, salt: str) -> tuple[int, ...]:
    """h1 to h4 of a row."""
    digest = hashlib.sha256(f"{salt}:{'' if number is None else number}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4))


def restore(output: str, form: str) -> str:
    """The text of a sample."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = head.removeprefix(PREFIX).split(SUFFIX)
    else:
        suffix, prefix = head.removeprefix(SUFFIX).split(PREFIX)
    return prefix + middle + suffix


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", output: str = "fim", unit: str | None = None,
              salt: str = "1", rate: int = RATE, spm: int = SPM, block: int = BLOCK) -> DataFrame:
    """``docs`` with the sample in ``output`` and n (units), form, prefix_chars, middle_chars (null for plain).

    unit: pattern of a unit; None takes code points.
    """
    frames.bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (output, "n", "form", "prefix_chars", "middle_chars")]
    named = docs.select(*(docs[c] for c in kept), docs[doc_id].cast("long").alias("__doc"),
                        F.coalesce(docs[text].cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = regex.compile(unit) if unit else None
        marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
        for batch in batches:
            at, data = frames.buffers(batch.column(len(kept) + 1))
            made: list[tuple] = []
            for row, number in enumerate(batch.column(len(kept)).to_pylist()):
                raw = data[at[row]:at[row + 1]]
                own = raw.tobytes()
                if not own:
                    made.append((own, 0, "plain", None, None))
                    continue
                ends = units_of(own.decode(), pattern) if pattern else None
                blocks = Blocks(raw, ends, block)
                h1, h2, h3, h4 = draws(number, salt)
                if h3 % 100 >= rate or any(m in own for m in marks):
                    made.append((own, blocks.units, "plain", None, None))
                    continue
                low, high = sorted((h1 % (blocks.units + 1), h2 % (blocks.units + 1)))
                (a, chars), (b, upto) = blocks.cut(low), blocks.cut(high)
                p, s, m = marks
                if h4 % 100 < spm:
                    sample = (s + own[b:] + p + own[:a] + m + own[a:b], "spm")
                else:
                    sample = (p + own[:a] + s + own[b:] + m + own[a:b], "psm")
                made.append((sample[0], blocks.units, sample[1], chars, upto - chars))
            columns = list(zip(*made)) or [()] * 5
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            arrays[0] = arrays[0].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays],
                                             names=[*kept, output, "n", "form", "prefix_chars", "middle_chars"])

    schema = T.StructType([*named.select(*kept).schema.fields, T.StructField(output, T.StringType()), T.StructField("n", T.LongType()),
                           T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())])
    return named.mapInArrow(run, schema)


def restored(output: Column | str = "fim", form: Column | str = "form") -> Column:
    """The text rebuilt from sample and form, in the JVM."""
    out, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    middle = F.substring_index(out, MIDDLE, -1)
    head = F.substring_index(out, MIDDLE, 1)
    # the first control string has three characters
    first = F.when(form == "psm", F.substring_index(head, SUFFIX, 1)).otherwise(F.substring_index(head, PREFIX, 1))
    second = F.when(form == "psm", F.substring_index(head, SUFFIX, -1)).otherwise(F.substring_index(head, PREFIX, -1))
    first = F.substr(first, F.lit(4))
    return F.when(form == "plain", out).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))
