"""Event streams as they arrive: chunks to frames, frames to records.

The stateful steps work row by row on what a micro-batch brings for a thread and
keep little: the splitter an unfinished tail and the chunks that wait for an
earlier one, the fold one condensed block a micro-batch (texts, calls and runs of
equal event names), never single frames.  A block is written once and read once,
when its thread ends.  Reading the JSON and putting the record together are
Column expressions, as in batch.

State lives in RocksDB, by shards of threads (``shards.py``), and ends: tails, closed
marks and open threads by the timer of their shard, or when the source ends.
The rows one thread adds within a micro-batch are sorted in memory, so bound the
batch at the source (``maxFilesPerTrigger``, ``maxBytesPerTrigger`` or the like).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from dialoscope.functions.text import utrim
from dialoscope.operators.capture import READ_TIMEOUT_SECONDS, TOTAL_TIMEOUT_SECONDS, read_frames
from dialoscope.streaming.shards import Shard, dump, sharded

#: How long an unfinished tail and the mark of a closed thread are remembered.
REMEMBER_SECONDS = 86_400
#: How far a frame's time may lie behind the latest one of an earlier micro-batch; Spark drops what is as far behind or farther.
LATENESS = "10 seconds"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State in RocksDB; a micro-batch uploads its changes, not the files of the store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class _BlockSplitter(StatefulProcessor):
    """Keeps the unfinished tail of each thread and emits the finished blocks.

    With ``order`` a chunk waits until all chunks before it have come.
    """

    def __init__(self, key: str, order: str | None, remember_ms: int | None) -> None:
        self._key, self._order, self._remember_ms = key, order, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # facts of a thread: blocks so far, the next chunk, when it is forgotten (0: never); parts: tail and waiting chunks
        self._shard = Shard(handle, self._key)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs() if self._remember_ms is not None else 0
        self._shard.load()
        for thread, arrived in by_thread(rows):
            yield from self._split(thread, arrived, now)
        if self._remember_ms is not None:
            self._shard.wake(now + self._remember_ms)
        self._shard.save()

    def _split(self, thread: str | None, arrived: list[Row], now: int) -> Iterator[Row]:
        shard = self._shard
        if thread in shard.known and 0 < shard.known[thread][0][2] <= now:
            shard.take(thread)
            shard.put(thread, None)
        n, following, _ = shard.known[thread][0] if thread in shard.known else (0, 0, 0)
        forget = 0 if self._remember_ms is None else now + self._remember_ms
        early: dict[int, str] = {}
        if self._order is not None:
            for r in arrived:  # what is smaller has come before
                if r.seq >= following and (r.chunk or self._order == "count"):
                    early.setdefault(r.seq, r.chunk)
            if following not in early:
                part = dump({"text": "", "early": list(early.items())}) if early else None
                shard.put(thread, [n, following, forget], part)
                return
        parts, waiting = [], {}
        for kept in shard.take(thread):
            parts.append(kept["text"])
            for seq, chunk in kept["early"]:
                waiting.setdefault(seq, chunk)
        if self._order is None:
            parts += [r.chunk for r in arrived]
        early |= waiting
        while following in early:
            chunk = early.pop(following)
            parts.append(chunk)
            following += 1 if self._order == "count" else len(chunk)
        *blocks, text = "".join(parts).split("\n\n")
        early = {seq: chunk for seq, chunk in early.items() if seq > following}
        part = dump({"text": text, "early": list(early.items())}) if text or early else None
        shard.put(thread, [n + len(blocks), following, forget], part, alone=True)
        for i, block in enumerate(blocks):
            yield Row(thread=thread, seq=n + i, block=block)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        shard, at = self._shard, expiredTimerInfo.getExpiryTimeInMs()
        shard.load()
        if at != shard.timer:
            return
        now, shard.timer = max(at, timerValues.getCurrentProcessingTimeInMs()), 0
        for thread, (facts, _) in list(shard.known.items()):
            if facts[2] <= now:
                shard.take(thread)
                shard.put(thread, None)
        shard.wake(min((facts[2] for facts, _ in shard.known.values()), default=None))
        shard.save()
        yield from ()

    def close(self) -> None:
        pass


def by_thread(rows: Iterator[Row]) -> Iterator[tuple[str | None, list[Row]]]:
    """What a micro-batch brings for each thread of a shard, in order."""
    threads: dict[str | None, list[Row]] = {}
    for r in rows:
        threads.setdefault(r.thread, []).append(r)
    for thread, own in threads.items():
        yield thread, sorted(own, key=lambda r: r.seq)


def stream_frames(chunks: DataFrame, remember_seconds: float | None = REMEMBER_SECONDS, order: str | None = None) -> DataFrame:
    """Chunks (thread_id, seq, chunk) to frames (thread_id, seq, event, data), across chunk borders.

    order: ``count`` if chunks of a thread are numbered 0, 1, 2, ..., ``length`` if
    seq is the offset of the chunk's first character: then a chunk that overtakes
    another, in its micro-batch or by several, waits for it, and one that comes
    again is left out.  None joins the chunks of a micro-batch by seq, and
    micro-batches as they come.

    Text not yet closed by a blank line waits in the state, for ``remember_seconds``
    after the thread's last chunk.  A time to live needs a stream that keeps running;
    None drains a backlog (``availableNow``).
    """
    if order not in (None, "count", "length"):
        raise ValueError(f"unknown order {order!r}")
    use_rocksdb(chunks.sparkSession)
    key = chunks.schema["thread_id"].dataType.simpleString()
    blocks = sharded(chunks.where("chunk IS NOT NULL AND seq IS NOT NULL")).groupBy("shard").transformWithState(
        _BlockSplitter(key, order, None if remember_seconds is None else int(remember_seconds * 1000)),
        StructType.fromDDL("thread string, seq bigint, block string"), "Append", "None" if remember_seconds is None else "ProcessingTime")
    lines = F.split("block", "\n")
    names = F.filter(lines, lambda x: x.startswith("event: "))
    datas = F.filter(lines, lambda x: x.startswith("data: "))
    return blocks.select(
        F.col("thread").cast(key).alias("thread_id"), "seq", utrim(F.substring(F.try_element_at(names, F.lit(-1)), 8, 1 << 30)).alias("event"),
        F.array_join(F.transform(datas, lambda x: F.substring(x, 7, 1 << 30)), "").alias("data")
    ).where((F.length("event") > 0) & (F.length("data") > 0))


#: A condensed block of frames: how many, runs of event names, calls, the last offer, the first text and what follows it.
BLOCK = "n bigint, events array<struct<event:string,n:int>>, calls array<string>, offer string, head string, message boolean, tail string"
#: A block as the state of an open thread keeps it: with the thread's first and last time.
KEPT = f"array<struct<thread:string,part:struct<{BLOCK}, began bigint, latest bigint>>>"


def condense(frames: list[Row], **times: int | None) -> str:
    """One block of the frames of a thread, as JSON text."""
    events: list[list] = []
    head, message, tail, offer, calls = None, False, [], None, []
    for f in frames:
        if events and events[-1][0] == f.event:
            events[-1][1] += 1
        else:
            events.append([f.event, 1])
        if f.call is not None:
            calls.append(f.call)
        if f.offer is not None:
            offer = f.offer
        if f.piece is not None:
            if head is None:
                head, message = f.piece, f.event == "message"
            elif f.event != "message":
                tail.append(f.piece)
    return json.dumps({"n": len(frames), "events": [{"event": e, "n": n} for e, n in events], "calls": calls, "offer": offer,
                       "head": head, "message": message, "tail": "".join(tail)} | times, ensure_ascii=False)


class _RecordCollector(StatefulProcessor):
    """Remembers the condensed blocks of open threads; emits them on ``done`` or when time runs out.

    clock: ``arrival`` (timers by the time at which frames come), ``frames`` (by the
    frames' own times: the first frame behind a thread's deadline ends it, and so
    does the watermark), or None.  A thread gives one record: what closed it leaves
    a mark, which outlives late frames by ``remember``.
    """

    def __init__(self, key: str, idle_ms: int, total_ms: int, remember_ms: int, clock: str | None) -> None:
        self._key, self._idle_ms, self._total_ms, self._remember_ms, self._clock = key, idle_ms, total_ms, remember_ms, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        # facts of an open thread: its first and last time; of a closed one: when its mark goes (0: never)
        self._shard = Shard(handle, self._key)

    def _deadline(self, began: int, latest: int) -> int:
        return min(latest + self._idle_ms, began + self._total_ms)

    def _error(self, began: int, latest: int) -> str:
        idle = latest + self._idle_ms <= began + self._total_ms
        return f"SSE hang: no data for {self._idle_ms / 1000:g}s" if idle else "timed out"

    def _due(self, facts: list) -> int | None:
        """When the thread times out, or its mark goes."""
        if len(facts) == 1:
            return facts[0] or None
        return None if facts[0] is None else self._deadline(*facts)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs() if self._clock == "arrival" else 0
        shard, dues = self._shard, []
        shard.load()
        for thread, arrived in by_thread(rows):
            yield from self._collect(thread, arrived, now)
            dues.append(self._due(shard.known[thread][0]))
        shard.wake(min((d for d in dues if d is not None), default=None))
        shard.save()

    def _collect(self, thread: str | None, arrived: list[Row], now: int) -> Iterator[Row]:
        facts = self._shard.known[thread][0] if thread in self._shard.known else [None, None]
        if len(facts) == 1:
            if self._clock != "arrival" or facts[0] > now:
                yield Row(thread=thread, blocks=[], error=None, late=len(arrived))
                return
            facts = [None, None]
        began, latest = facts
        taken, error, ended = len(arrived), None, False
        for i, f in enumerate(arrived):
            if self._clock is not None:
                at = now if self._clock == "arrival" else f.at_ms
                at = latest if at is None else at
                if at is not None:
                    if self._clock == "frames" and began is not None and at > self._deadline(began, latest):
                        taken, error, ended = i, self._error(began, latest), True
                        break
                    began, latest = at if began is None else began, at if latest is None else max(latest, at)
            if f.event == "done":
                taken, ended = i + 1, True
                break
        if ended:
            yield self._close(thread, arrived[:taken], error, latest, now)
            if taken < len(arrived):
                yield Row(thread=thread, blocks=[], error=None, late=len(arrived) - taken)
            return
        times = {} if self._clock is None else {"began": began, "latest": latest}
        self._shard.put(thread, [began, latest], condense(arrived, **times))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        shard, at = self._shard, expiredTimerInfo.getExpiryTimeInMs()
        shard.load()
        if at != shard.timer:
            return
        clock = timerValues.getCurrentProcessingTimeInMs() if self._clock == "arrival" else timerValues.getCurrentWatermarkInMs()
        now, shard.timer = max(at, clock), 0
        for thread, (facts, _) in list(shard.known.items()):
            due = self._due(facts)
            if due is None or due > now:
                continue
            if len(facts) == 1:  # remembered long enough
                shard.put(thread, None)
            else:
                yield self._close(thread, [], self._error(*facts), facts[1], now)
        dues = (self._due(facts) for facts, _ in shard.known.values())
        shard.wake(min((max(d, now + 1) for d in dues if d is not None), default=None))
        shard.save()

    def _close(self, thread: str | None, last: list[Row], error: str | None, latest: int | None, now: int) -> Row:
        """The record of a thread; its state shrinks to the mark."""
        blocks = [dump(part) for part in self._shard.take(thread)] + ([condense(last)] if last else [])
        forget = {None: 0, "arrival": now + self._remember_ms, "frames": (latest or 0) + self._idle_ms + self._remember_ms}[self._clock]
        self._shard.put(thread, [forget], alone=True)
        return Row(thread=thread, blocks=blocks, error=error, late=0)

    def close(self) -> None:
        pass


def _records(folded: DataFrame, error: Column | str = "error") -> DataFrame:
    """Records from the condensed blocks of threads: (thread_id, parts, error)."""
    parts = folded.select("thread_id", "parts", F.col(error).alias("error") if isinstance(error, str) else error.alias("error"))
    said = F.filter("parts", lambda p: p["head"].isNotNull())
    text = F.array_join(F.transform(said, lambda p, i: F.concat(F.when((i > 0) & p["message"], F.lit("")).otherwise(p["head"]), p["tail"])), "")
    events = F.flatten(F.transform("parts", lambda p: F.flatten(F.transform(p["events"], lambda e: F.array_repeat(e["event"], e["n"])))))
    offers = F.filter(F.transform("parts", lambda p: p["offer"]), lambda o: o.isNotNull())
    none = F.array().cast("array<string>")
    return parts.select(
        "thread_id", text.alias("response"),
        F.transform(F.flatten(F.transform("parts", lambda p: p["calls"])), lambda c: F.from_json(c, "tool string, input string")).alias("tool_calls"),
        events.alias("status_sequence"), F.coalesce(F.from_json(F.try_element_at(offers, F.lit(-1)), "array<string>"), none).alias("suggestions"),
        F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + p["n"]).cast("int").alias("step_count"), "error")


def _fold(frames: DataFrame, phases: str, idle_seconds: float, total_seconds: float, clock: str | None, remember_seconds: float,
          lateness: str) -> DataFrame:
    """(thread_id, parts, error, late): closed threads, and how many frames came behind a thread's end."""
    if clock not in (None, "arrival", "frames"):
        raise ValueError(f"unknown clock {clock!r}")
    use_rocksdb(frames.sparkSession)
    key = frames.schema["thread_id"].dataType.simpleString()
    rows, times = frames, []
    if clock == "frames":
        rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
        times = [F.col("ts"), F.unix_millis("ts").alias("at_ms")]
    read = sharded(read_frames(rows, phases)).select(
        "shard", "thread", "seq", "event", "piece", F.to_json("call").alias("call"), F.to_json("offer").alias("offer"), *times)
    out = StructType.fromDDL("thread string, blocks array<string>, error string, late bigint")
    mode = {None: "None", "arrival": "ProcessingTime", "frames": "EventTime"}[clock]
    return read.groupBy("shard").transformWithState(
        _RecordCollector(key, int(idle_seconds * 1000), int(total_seconds * 1000), int(remember_seconds * 1000), clock), out, "Append", mode
    ).select(F.col("thread").cast(key).alias("thread_id"), F.transform("blocks", lambda b: F.from_json(b, BLOCK)).alias("parts"), "error", "late")


def stream_fold(frames: DataFrame, phases: str = "code", idle_seconds: float = READ_TIMEOUT_SECONDS,
                total_seconds: float = TOTAL_TIMEOUT_SECONDS, timed: bool = True, remember_seconds: float = REMEMBER_SECONDS,
                clock: str = "arrival", lateness: str = LATENESS) -> DataFrame:
    """Frames to one record per thread, emitted at its ``done`` frame or when a timeout strikes.

    Frames after ``done`` or a timeout are ignored for ``remember_seconds``.  A hung
    thread gives a record with an error and what it said until then.

    clock: ``arrival`` takes the time at which frames come, and needs a stream that
    keeps running.  ``frames`` takes the frames' own times (column ``ts``): a thread ends
    where a frame comes later than the idle or the total time allows, or when the
    watermark (the latest time less ``lateness``) passes that point.  So a replay cuts
    where the live stream did, however frames are dealt over micro-batches, if none is later than that.
    ``timed=False`` knows no timeouts.  What is open where a drained source ends
    (``availableNow``) is read with ``open_records``.
    """
    folded = _fold(frames, phases, idle_seconds, total_seconds, clock if timed else None, remember_seconds, lateness)
    return _records(folded.where("late = 0"))


def late_frames(frames: DataFrame, idle_seconds: float = READ_TIMEOUT_SECONDS, total_seconds: float = TOTAL_TIMEOUT_SECONDS,
                remember_seconds: float = REMEMBER_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """(thread_id, late): frames that a micro-batch brought behind the end of their thread, by the frames' own times."""
    return _fold(frames, "code", idle_seconds, total_seconds, "frames", remember_seconds, lateness).where("late > 0").select("thread_id", "late")


def open_records(spark: SparkSession, checkpoint: str, now: Column | None = None, idle_seconds: float = READ_TIMEOUT_SECONDS,
                 total_seconds: float = TOTAL_TIMEOUT_SECONDS) -> DataFrame:
    """Records of the threads that are open where a drained stream ended: the body ended without ``done``.

    Reads the state that the stream left in its checkpoint.  With ``now`` (the time of
    the source's end, for a stream by the frames' clock) threads whose time is over by
    then get their error.
    """
    rows = spark.read.format("statestore").option("stateVarName", "blocks").load(checkpoint)
    key = rows.schema["user_map_value"].dataType["thread_id"].dataType
    kept = rows.select("user_map_key.block", F.explode(F.from_json("user_map_value.body", KEPT)).alias("k")).select(
        F.col("k.thread").cast(key).alias("thread_id"), F.struct("block", "k.part").alias("b"))
    whole = kept.groupBy("thread_id").agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["part"]).alias("parts"))
    if now is None:
        return _records(whole, F.lit(None).cast("string"))
    idle_at = F.element_at("parts", -1)["latest"] + int(idle_seconds * 1000)
    total_at = F.element_at("parts", 1)["began"] + int(total_seconds * 1000)
    error = F.when(F.least(idle_at, total_at) < F.unix_millis(now), F.when(idle_at <= total_at, F.lit(f"SSE hang: no data for {idle_seconds:g}s")).otherwise(F.lit("timed out")))
    return _records(whole, error)
