"""From captured event-stream bodies to one result record per thread.

The fold is two-level: frames are condensed inside (thread, block of seq) and
only the condensed blocks of a thread meet.  A thread with very many frames is
spread over many tasks; what finally lands in one row is the record itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoscope.functions import variant as v
from dialoscope.functions.ordered import block_of, fill_forward
from dialoscope.functions.text import utrim

READ_TIMEOUT_SECONDS = 120  # fixed value: idle time after which a stream counts as hung
TOTAL_TIMEOUT_SECONDS = 300  # fixed value: time after which a stream is given up

_EMPTY_TEXTS = "CAST(array() AS array<string>)"


def parse_frames(bodies: DataFrame, body: str = "body", keys: Sequence[str] = ("thread_id",)) -> DataFrame:
    """Event-stream bodies to frames ``seq, event, data``.

    A frame ends at a blank line, so text after the last one is no frame.  The
    last ``event: `` line of a block names it, its ``data: `` lines are joined
    without a separator; blocks lacking either, and comment lines, are dropped.
    """
    blocks = F.split(F.col(body), "\n\n")
    complete = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))
    rows = bodies.select(*keys, F.posexplode(complete).alias("seq", "block"))
    lines = F.split("block", "\n")
    names = F.filter(lines, lambda x: x.startswith("event: "))
    datas = F.filter(lines, lambda x: x.startswith("data: "))
    name = utrim(F.substring(F.try_element_at(names, F.lit(-1)), 8, 1 << 30))
    data = F.array_join(F.transform(datas, lambda x: F.substring(x, 7, 1 << 30)), "")
    return (rows.select(*keys, F.col("seq").cast("bigint").alias("seq"), name.alias("event"), data.alias("data"))
            .where((F.length("event") > 0) & (F.length("data") > 0)))


def _first_truthy(obj: str, *paths: str) -> str:
    """VARIANT: the first truthy value among the paths, else NULL."""
    cases = " ".join(f"WHEN {v.truthy(v.node(obj, p))} THEN {v.node(obj, p)}" for p in paths)
    return f"CASE {cases} END"


def _string_or_null(variant: str) -> str:
    return f"if(schema_of_variant({variant}) = 'STRING', try_variant_get({variant}, '$', 'string'), NULL)"


def read_frames(frames: DataFrame, phases: str = "code") -> DataFrame:
    """Frames with what each contributes: ``kind``, ``piece``, ``call``, ``offer``.

    ``phases='status'`` lets a ``status`` frame stand for the event named in
    its ``phase``, which is how tool calls travel on some streams.
    """
    if phases not in ("code", "status"):
        raise ValueError(f"unknown phases {phases!r}")
    obj = v.try_object("data")
    rows = frames.withColumn("__o", F.expr(obj))
    if phases == "status":
        phase = F.expr(v.some_text_at("__o", "$.phase"))
        rows = rows.withColumn("event", F.when(F.col("event") == "status", F.coalesce(phase, F.col("event")))
                               .otherwise(F.col("event")))
    tool_name = v.stringify(_first_truthy("__o", "$.tool", "$.tool_name", "$.name"))
    named = _first_truthy("__o", "$.tool", "$.tool_name", "$.name")
    message = _string_or_null(v.node("__o", "$.content"))
    token = _string_or_null(_first_truthy("__o", "$.content", "$.token"))
    shown = _string_or_null(_first_truthy("__o", "$.content", "$.data"))
    offered = _first_truthy("__o", "$.suggestions", "$.data")
    event = F.col("event")
    piece = (F.when(event == "message", F.expr(message)).when(event == "token", F.expr(token))
             .when(event == "ui", F.expr(shown)))
    call = F.when(event == "tool_start", F.struct(
        F.expr(f"CASE WHEN {named} IS NULL THEN coalesce({v.text_at('__o', '$.name')}, '?') ELSE {tool_name} END"
               ).alias("tool"),
        F.expr(f"coalesce(to_json({_first_truthy('__o', '$.input', '$.arguments')}), '{{}}')").alias("input")))
    offer = F.when(event == "suggestions", F.expr(
        f"CASE WHEN {offered} IS NULL THEN {_EMPTY_TEXTS} "
        f"ELSE try_variant_get({offered}, '$', 'array<string>') END"))
    return (rows.withColumn("piece", F.nullif(piece, F.lit(""))).withColumn("call", call)
            .withColumn("offer", offer).drop("__o", "data"))


def _ordered(field: str) -> Column:
    """Non-NULL values of ``field`` in frame order."""
    pairs = F.collect_list(F.when(F.col(field).isNotNull(), F.struct("seq", field)))
    return F.transform(F.array_sort(pairs), lambda x: x[field])


def fold_frames(frames: DataFrame, phases: str = "code", key: str = "thread_id", block: int = 16384,
                stop_at_done: bool = False) -> DataFrame:
    """One record per thread: response, tool calls, status sequence, suggestions, step count.

    A ``message`` fills the response only while that is still empty; tokens and
    ui text are appended.  Suggestions are replaced by each later list.
    """
    rows = frames
    if stop_at_done:
        ends = rows.where(F.col("event") == "done").groupBy(F.col(key).alias("__t")).agg(F.min("seq").alias("__end"))
        rows = (rows.join(ends, rows[key] == F.col("__t"), "left")
                .where(F.col("__end").isNull() | (F.col("seq") <= F.col("__end"))).drop("__t", "__end"))
    read = read_frames(rows, phases).withColumn("__b", block_of("seq", block))
    texts = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(),
                                           F.struct("seq", (F.col("event") == "message").alias("m"), "piece")))),
        lambda x: F.struct(x["m"].alias("m"), x["piece"].alias("piece")))
    blocks = read.groupBy(key, "__b").agg(
        F.count("*").alias("n"), _ordered("event").alias("events"), _ordered("call").alias("calls"),
        texts.alias("texts"),
        F.max_by("offer", F.when(F.col("offer").isNotNull(), F.col("seq"))).alias("offer"))
    appended = F.array_join(F.transform(
        F.filter(F.slice("texts", 2, F.greatest(F.size("texts") - 1, F.lit(0))), lambda x: ~x["m"]),
        lambda x: x["piece"]), "")
    condensed = blocks.select(
        key, "__b", "n", "events", "calls", "offer", F.get("texts", 0)["piece"].alias("head"),
        F.coalesce(F.get("texts", 0)["m"], F.lit(False)).alias("head_is_message"), appended.alias("tail"))
    parts = F.array_sort(F.collect_list(F.struct("__b", "events", "calls", "head", "head_is_message", "tail")))
    whole = condensed.groupBy(key).agg(
        F.sum("n").alias("step_count"), parts.alias("parts"),
        F.max_by("offer", F.when(F.col("offer").isNotNull(), F.col("__b"))).alias("offer"))
    with_text = F.filter("parts", lambda p: p["head"].isNotNull())
    response = F.array_join(F.transform(with_text, lambda p, i: F.concat(
        F.when((i > 0) & p["head_is_message"], F.lit("")).otherwise(p["head"]), p["tail"])), "")
    return whole.select(
        key, response.alias("response"),
        F.flatten(F.transform("parts", lambda p: p["calls"])).alias("tool_calls"),
        F.flatten(F.transform("parts", lambda p: p["events"])).alias("status_sequence"),
        F.coalesce("offer", F.expr(_EMPTY_TEXTS)).alias("suggestions"), "step_count")


def cut_hangs(frames: DataFrame, timeout: float = READ_TIMEOUT_SECONDS, key: str = "thread_id",
              block: int = 16384) -> tuple[DataFrame, DataFrame]:
    """Drop the frames after an idle gap longer than ``timeout``.

    Returns the frames kept and one error row per thread that hung.
    """
    timed = frames.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp")))
    gaps = fill_forward(timed, [key], "seq", F.col("__us"), "__prev", block, include_current=False)
    hung = (gaps.where(F.col("__us") - F.col("__prev") > F.lit(int(timeout * 1_000_000)))
            .groupBy(key).agg(F.min("seq").alias("cut_seq")))
    kept = (frames.join(hung, key, "left").where(F.col("cut_seq").isNull() | (F.col("seq") < F.col("cut_seq")))
            .drop("cut_seq"))
    errors = hung.select(key, "cut_seq", F.lit(f"SSE hang: no data for {timeout:g}s").alias("error"))
    return kept, errors


def response_times(frames: DataFrame, requests: DataFrame | None = None, key: str = "thread_id") -> DataFrame:
    """Seconds from the request to the last ``done`` frame, two decimals.

    Without request times the first frame of the thread counts as the start.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = frames.groupBy(key).agg(F.max(F.when(F.col("event") == "done", us)).alias("end_us"),
                                   F.min(us).alias("first_us"))
    if requests is not None:
        starts = requests.groupBy(key).agg(F.min(F.unix_micros(F.col("start_ts").cast("timestamp"))).alias("start_us"))
        ends = ends.join(starts, key, "left")
        begin = F.coalesce("start_us", "first_us")
    else:
        begin = F.col("first_us")
    centis = F.floor((F.col("end_us") - begin + 5000) / 10000)
    return ends.select(key, (centis.cast("double") / 100.0).alias("response_time_seconds"))
