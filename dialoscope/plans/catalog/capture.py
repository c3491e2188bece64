"""Records from captured frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoscope.operators import capture
from dialoscope.plans.catalog import Catalog
from dialoscope.plans.fixtures import fixture, oracle

CATALOG = Catalog()
add = CATALOG.add


def frames(spark, sf):
    return fixture(spark, sf, "sse_frames", costly=True)


# Threads as raw stream bodies: frames of a thread in order, one keep-alive comment each, the last frame unfinished.
BODIES = """SELECT thread_id, string_agg(': ping' || chr(10) || 'event: ' || event || chr(10) || 'data: ' || data,
 chr(10) || chr(10) ORDER BY seq) AS body FROM sse_frames GROUP BY 1"""


@add("parse_frames", oracle(["sse_frames"], """SELECT thread_id, row_number() OVER w - 1 AS seq, event, data
 FROM sse_frames WINDOW w AS (PARTITION BY thread_id ORDER BY seq)
 QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC) > 1"""))
def parse_frames(spark, sf):
    block = F.concat(F.lit(": ping\nevent: "), "event", F.lit("\ndata: "), "data")
    bodies = frames(spark, sf).groupBy("thread_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", block.alias("x")))), lambda s: s["x"]), "\n\n").alias("body"))
    return capture.parse_frames(bodies)


def _folded(out):
    return out.select(
        "thread_id", "response", F.size("tool_calls").cast("bigint").alias("calls"),
        F.array_join(F.transform("tool_calls", lambda c: c["tool"]), ",").alias("tools"),
        F.array_join(F.transform("tool_calls", lambda c: c["input"]), "|").alias("inputs"),
        F.array_join("status_sequence", ",").alias("events"), F.array_join("suggestions", ",").alias("suggestions"),
        F.col("step_count").alias("step_count"))


def _fold_sql(event: str, extra: str = "") -> str:
    """Fold of the fixture frames, whose response text comes from tokens only."""
    return oracle(["sse_frames"], """SELECT thread_id,
 coalesce(string_agg(json_extract_string(data, '$.content'), '' ORDER BY seq) FILTER (ev = 'token'), '') AS response,
 count(*) FILTER (ev = 'tool_start') AS calls,
 coalesce(string_agg(json_extract_string(data, '$.tool'), ',' ORDER BY seq) FILTER (ev = 'tool_start'), '') AS tools,
 coalesce(string_agg(replace(CAST(json_extract(data, '$.input') AS VARCHAR), ' ', ''), '|' ORDER BY seq)
   FILTER (ev = 'tool_start'), '') AS inputs,
 string_agg(ev, ',' ORDER BY seq) AS events,
 coalesce(max_by(json_extract_string(data, '$.suggestions[0]'), seq) FILTER (ev = 'suggestions'), '') AS suggestions,
 count(*) AS step_count FROM e GROUP BY 1""", e=f"SELECT *, {event} AS ev FROM sse_frames{extra}")


_PHASED = "CASE WHEN event = 'status' THEN coalesce(json_extract_string(data, '$.phase'), event) ELSE event END"


@add("fold_frames", _fold_sql("event"))
def fold_frames(spark, sf):
    return _folded(capture.fold_frames(frames(spark, sf), block=64))


@add("fold_frames_phases", _fold_sql(_PHASED))
def fold_frames_phases(spark, sf):
    return _folded(capture.fold_frames(frames(spark, sf), phases="status"))


@add("fold_frames_until_done", _fold_sql("event", """ f WHERE seq <= coalesce((SELECT min(seq) FROM sse_frames g
 WHERE g.thread_id = f.thread_id AND g.event = 'done'), 9223372036854775807)"""))
def fold_frames_until_done(spark, sf):
    return _folded(capture.fold_frames(frames(spark, sf), stop_at_done=True))


# The fixture's frames are minutes apart, so the idle limit is set to one day here.
_DAY = 86400
_GAPS = f"""SELECT thread_id, min(seq) AS cut_seq FROM (SELECT thread_id, seq,
 epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY thread_id ORDER BY seq)) AS gap FROM sse_frames)
 WHERE gap > {_DAY} * CAST(1000000 AS BIGINT) GROUP BY 1"""


@add("cut_hangs", oracle(["sse_frames"], """SELECT f.thread_id, f.seq FROM sse_frames f LEFT JOIN g
 ON f.thread_id = g.thread_id WHERE g.cut_seq IS NULL OR f.seq < g.cut_seq""", g=_GAPS))
def cut_hangs(spark, sf):
    kept, _ = capture.cut_hangs(frames(spark, sf), _DAY, block=64)
    return kept.select("thread_id", "seq")


@add("hang_errors", oracle(["sse_frames"], f"SELECT thread_id, cut_seq, 'SSE hang: no data for {_DAY}s' AS error FROM g",
                           g=_GAPS))
def hang_errors(spark, sf):
    return capture.cut_hangs(frames(spark, sf), _DAY)[1]


# Two of three threads have a request of their own, some seconds before their first frame.
@add("request_times", oracle(["sse_frames"], """SELECT thread_id, coalesce(CAST((max(epoch_us(ts)) FILTER (event = 'done') - min(epoch_us(ts))
 + CASE WHEN thread_id % 3 > 0 THEN (thread_id % 3) * 1500000 ELSE 0 END + 5000) // 10000 AS DOUBLE) / 100.0, -1.0) AS response_time_seconds
 FROM sse_frames GROUP BY 1"""))
def request_times(spark, sf):
    rows = frames(spark, sf)
    start = F.timestamp_micros(F.min(F.unix_micros(F.col("ts").cast("timestamp"))) - F.col("thread_id") % 3 * 1500000)
    requests = rows.where("thread_id % 3 > 0").groupBy("thread_id").agg(start.alias("start_ts"))
    return capture.response_times(rows, requests).na.fill(-1.0)


@add("response_times", oracle(["sse_frames"], """SELECT thread_id, coalesce(CAST((max(epoch_us(ts)) FILTER (event = 'done')
 - min(epoch_us(ts)) + 5000) // 10000 AS DOUBLE) / 100.0, -1.0) AS response_time_seconds FROM sse_frames GROUP BY 1"""))
def response_times(spark, sf):
    return capture.response_times(frames(spark, sf)).na.fill(-1.0)
