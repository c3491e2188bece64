"""State of many small keys, read and written in bulk.

A call to the state store costs a tenth of a millisecond or more in Python, so a
store entry per thread makes a stream of short threads slow.  Here threads are
dealt by hash to ``SHARDS`` grouping keys.  A shard holds a log of small entries (one
element a micro-batch, read as a whole) and rows of kept parts (texts), which are
read only when one of their threads needs them and go when the last of them has.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

#: Grouping keys to which threads are dealt.
SHARDS = 8192
#: Text of one row of kept parts; a longer part has a row of its own.
ROW_CHARS = 16_384
#: Elements of a log from which it is written anew as one.
LOG_ELEMENTS = 64


def dump(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def sharded(rows: DataFrame) -> DataFrame:
    """``rows`` with ``thread`` (the text of thread_id) in place of thread_id, and its ``shard``."""
    thread = F.col("thread_id").cast("string")
    return rows.withColumns({"thread": thread, "shard": F.pmod(F.xxhash64(thread), F.lit(SHARDS)).cast("int")}).drop("thread_id")


class Shard:
    """The threads of the shard at hand: ``known[thread]`` holds its facts (a list of numbers) and the rows with its parts.

    ``load`` begins and ``save`` ends what a call does with them.
    """

    def __init__(self, handle: StatefulProcessorHandle, key: str) -> None:
        self._handle = handle
        self._log = handle.getListState("log", "entries string")
        # thread_id is always null, it tells the type
        self._rows = handle.getMapState("blocks", "block bigint", f"body string, thread_id {key}")
        self._shard = handle.getValueState("shard", "elements bigint, next bigint, timer bigint")

    def load(self) -> None:
        self._elements, self._next, self.timer = self._shard.get() or (0, 0, 0)
        self.known: dict[str | None, tuple[list, list[int]]] = {}
        self._read: dict[int, dict] = {}
        self._changed: set[int] = set()
        self._new: list[list] = []
        self._filling: list[str] = []
        self._filled, self._entries = 0, 0
        if self._elements:
            for (text,) in self._log.get():
                entries = json.loads(text)
                self._entries += len(entries)
                for entry in entries:
                    self._apply(*entry)

    def _apply(self, thread: str | None, facts: list | None, rows: list[int], alone: int) -> None:
        if facts is None:
            self.known.pop(thread, None)
        else:
            self.known[thread] = (facts, rows if alone or thread not in self.known else self.known[thread][1] + rows)

    def put(self, thread: str | None, facts: list | None, part: str | None = None, alone: bool = False) -> None:
        """New facts of a thread (None: forget it) and one more part, as JSON text; ``alone``: the parts before were taken."""
        rows = []
        if part is not None:
            text = f'{{"thread":{dump(thread)},"part":{part}}}'
            if self._filling and self._filled + len(text) > ROW_CHARS:
                self._flush()
            self._filling.append(text)
            self._filled += len(text)
            rows = [self._next]
        entry = [thread, facts, rows, int(alone)]
        self._new.append(entry)
        self._apply(*entry)

    def take(self, thread: str | None) -> list[dict]:
        """The parts of a thread, oldest first, which leave the state."""
        if thread not in self.known:
            return []
        facts, rows = self.known[thread]
        found = []
        for number in rows:
            if number not in self._read:
                (body, _) = self._rows.getValue((number,))
                self._read[number] = {e["thread"]: e["part"] for e in json.loads(body)}
            found.append(self._read[number].pop(thread))
            self._changed.add(number)
        self.known[thread] = (facts, [])
        return found

    def _flush(self) -> None:
        self._rows.updateValue((self._next,), (f"[{','.join(self._filling)}]", None))
        self._next += 1
        self._filling, self._filled = [], 0

    def wake(self, due: int | None) -> None:
        """Have the shard called at ``due``, if it is not called earlier."""
        if due is not None and (not self.timer or due < self.timer):
            if self.timer:
                self._handle.deleteTimer(self.timer)
            self._handle.registerTimer(due)
            self.timer = due

    def save(self) -> None:
        for number in sorted(self._changed):
            if left := self._read[number]:
                self._rows.updateValue((number,), (dump([{"thread": t, "part": p} for t, p in left.items()]), None))
            else:
                self._rows.removeKey((number,))
        if self._filling:
            self._flush()
        if self._elements >= LOG_ELEMENTS or self._entries + len(self._new) > 1000 + 2 * len(self.known):
            whole = [[t, facts, rows, 1] for t, (facts, rows) in self.known.items()]
            if whole:
                self._log.put([(dump(whole),)])
            else:
                self._log.clear()
            self._elements = 1 if whole else 0
        elif self._new:
            self._log.appendValue((dump(self._new),))
            self._elements += 1
        self._shard.update((self._elements, self._next, self.timer))
