"""Chat formatting: conversations as a prefix tree, shared turns emitted once, depth first.

Conversations are sorted by the hashes of their turns, so that those with equal
first turns are neighbours; a hot first turn, or very many copies of one
conversation, are spread over ranges because the number of the conversation is
part of the order.  One range is one pack.  Streaming a pack, each conversation
emits the turns that differ from the path of the conversation before it (compared
by role and text, not by hash) and a closing row that names the conversation.
That is the depth-first order of the pack's prefix tree.

A turn row carries its formatted text once, its ``position`` on the path (token
positions run on from the parent: position .. position + length), its ``start``
in the pack's emitted sequence, and the intervals of that sequence that its
tokens attend to: those of its ancestors, merged where they touch, the own turn
being causal after them.  Tokens are code points.  ``loss`` marks the part of the
formatted text that is trained on: the text of assistant turns.

Template: ``### role\\ntext</turn>\\n``.  In roles and texts ``\\`` becomes
``\\\\``, ``###`` becomes ``\\h``, ``</turn>`` becomes ``\\e``, and in roles a
line break becomes ``\\n``.  So no control string occurs inside a turn, and
unescaping gives the turn back.

A null role or text is empty.  Rows with a null conv_id form one conversation.
Rows are ordered by turn (nulls first), then role and text; repeated rows are
repeated turns.  Texts of any length are formatted whole; a conversation is one row while it is
formatted, so it must fit into a task.  Other columns are not read.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoscope.llm import frames

TURN, END = "### ", "</turn>\n"
#: Roles whose text is trained on.
LEARNED = ("assistant",)
_CODES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\e", "\n": "\\n"}
_BACK = {v: k for k, v in _CODES.items()}

PACKED = ("pack int, seq long, kind string, depth int, conv_id long, role string, piece string, position long, start long, length int, "
          "attends array<struct<start:long,end:long>>, loss struct<start:int,end:int>")


def escape(text: str, role: bool = False) -> str:
    return re.sub(r"\\|###|</turn>|\n" if role else r"\\|###|</turn>", lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\[\\hen]", lambda m: _BACK[m[0]], text)


def format_turn(role: str, text: str) -> str:
    return f"{TURN}{escape(role, True)}\n{escape(text)}{END}"


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(TURN).partition("\n")
        turns.append((unescape(role), unescape(text)))
    return turns


def gather(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): one row per conversation, which is one training sample."""
    own = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text")))).alias("t"))
    return own.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t.dropFields("turn")).alias("turns"))


def pack(conversations: DataFrame, learned: tuple[str, ...] = LEARNED, packs: int | None = None, **columns: str) -> DataFrame:
    """Rows of the packs, in depth-first order: (pack, seq) is the order of emission."""
    spark = conversations.sparkSession
    frames.bounded_batches(spark)
    packs = packs or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))
    ranged = gather(conversations, **columns).withColumn("path", path).repartitionByRange(packs, "path", "conv_id") \
        .sortWithinPartitions("path", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seq, emitted = TaskContext.get().partitionId(), 0, 0
        open_path: list[tuple] = []  # (role, text, start, end, position behind it) of the turns of the last conversation
        for batch in batches:
            rows, size = [], 0
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1)):
                turns = [(t["role"], t["text"]) for t in turns.as_py()]
                same = 0
                while same < min(len(open_path), len(turns)) and open_path[same][:2] == turns[same]:
                    same += 1
                del open_path[same:]
                for depth in range(same, len(turns)):
                    role, text = turns[depth]
                    piece = format_turn(role, text)
                    position = open_path[-1][4] if open_path else 0
                    attends: list[dict] = []
                    for _, _, a, b, _ in open_path:
                        if attends and attends[-1]["end"] == a:
                            attends[-1]["end"] = b
                        else:
                            attends.append({"start": a, "end": b})
                    head = len(piece) - len(END) - len(escape(text))
                    loss = {"start": head, "end": len(piece) - len(END)} if role in learned else None
                    rows.append((number, seq, "turn", depth, None, role, piece, position, emitted, len(piece), attends, loss))
                    open_path.append((role, text, emitted, emitted + len(piece), position + len(piece)))
                    emitted += len(piece)
                    seq += 1
                    size += len(piece)
                rows.append((number, seq, "end", len(turns), conv, None, None, open_path[-1][4] if open_path else 0, emitted, 0, [], None))
                seq += 1
                if size > frames.SLICE:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    return ranged.select("conv_id", "turns").mapInArrow(run, PACKED)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    interval = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    text, long, int32 = pa.string(), pa.int64(), pa.int32()
    kinds = [int32, long, text, int32, long, text, text, long, long, int32, pa.list_(interval), span]
    names = ["pack", "seq", "kind", "depth", "conv_id", "role", "piece", "position", "start", "length", "attends", "loss"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_back(packed: DataFrame) -> DataFrame:
    """What the packs say of each conversation: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, turns)."""
    frames.bounded_batches(packed.sparkSession)
    ordered = packed.select("pack", "seq", "kind", "depth", "conv_id", "piece", "loss").repartition("pack").sortWithinPartitions("pack", "seq")
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for _, _, kind, depth, conv, piece, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == "turn":
                    path[depth:] = [(piece, loss)]
                    continue
                own = path[:depth]  # a conversation ends on the path that is open
                formatted = "".join(p for p, _ in own)
                turns = parse(formatted)
                learned = [unescape(p[m["start"]:m["end"]]) for p, m in own if m]
                digest = hashlib.sha256()
                for r, t in turns:
                    digest.update(f"{r}\n{t}\n".encode())
                out.append((conv, len(turns), digest.hexdigest(), sum(map(len, learned)),
                            hashlib.sha256("".join(learned).encode()).hexdigest(), len(formatted), [{"role": r, "text": t} for r, t in turns]))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(turn)]
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "turns"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                   "formatted_chars long, turns array<struct<role:string,text:string>>")
