"""Structured Streaming jobs run to the end of the given data, with the result read back."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from dialoscope.functions.ordered import serial_number
from dialoscope.plans.catalog import Catalog
from dialoscope.plans.catalog.capture import _folded
from dialoscope.plans.fixtures import fixture, oracle, scratch
from dialoscope.streaming import frames as sf_
from dialoscope.streaming import runs as sr

CATALOG = Catalog()
add = CATALOG.add


def run_to_end(stream, purpose, more=None):
    """Write the stream to its end, then read the table it wrote; ``more`` gives rows from the state at the end."""
    spark = stream.sparkSession
    base = scratch(spark, purpose)
    query = sr.stream_records(stream, f"{base}/out", f"{base}/state")
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{base}/out")
    return rows.unionByName(more(spark, f"{base}/state")) if more else rows


def dealt(rows, purpose, column, batches):
    """Rows as a stream whose micro-batch ``k`` brings the rows with ``column`` k, in as many files as there are tasks."""
    spark = rows.sparkSession
    base, tasks = scratch(spark, purpose), spark.sparkContext.defaultParallelism
    rows.write.partitionBy(column).parquet(f"{base}/all")
    every = spark.read.schema(rows.schema).parquet(f"{base}/all")
    for k in range(batches):
        every.where(F.col(column) == k).drop(column).repartition(tasks).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(rows.drop(column).schema).option("maxFilesPerTrigger", tasks).parquet(f"{base}/in")


def batch_of(rows, column):
    """The number of each row's micro-batch, in order of ``column``, and how many there are: more for larger tables."""
    batches = max(4, min(64, rows.count() // 1_000_000))
    cuts = ", ".join(str(k / batches) for k in range(1, batches))
    bounds = rows.selectExpr(f"approx_percentile({column}, array({cuts}))").first()[0] or []
    return F.size(F.filter(F.lit(bounds), lambda b: b < F.col(column))), batches


def in_files(rows, purpose, column):
    """Rows as a stream in order of ``column``."""
    which, batches = batch_of(rows, column)
    return dealt(rows.withColumn("arrives", which), purpose, "arrives", batches)


@add("stream_frames", oracle(["sse_frames"], """SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY seq) - 1 AS seq,
 event, data FROM sse_frames"""))
def stream_frames(spark, sf):
    """Every frame is cut into two chunks; some second halves come a micro-batch later, some first halves come behind their second ones."""
    frames = serial_number(fixture(spark, sf, "sse_frames"), ["thread_id"], "seq", "place")
    which, batches = batch_of(frames, "seq")
    text = F.concat(F.lit("event: "), "event", F.lit("\ndata: "), "data", F.lit("\n\n"))
    half = F.floor(F.length("t") / 2).cast("int")
    halves = F.array(
        F.struct((F.col("place") * 2 - 2).alias("seq"), F.substring("t", F.lit(1), half).alias("chunk"), (F.col("b") + F.when(F.col("seq") % 5 == 1, 1).otherwise(0)).alias("arrives")),
        F.struct((F.col("place") * 2 - 1).alias("seq"), F.substring("t", half + 1, F.length("t")).alias("chunk"), (F.col("b") + F.when(F.col("seq") % 5 == 0, 1).otherwise(0)).alias("arrives")))
    chunks = frames.withColumns({"t": text, "b": which}).select("thread_id", F.explode(halves).alias("c")).select("thread_id", "c.*")
    stream = dealt(chunks, "chunks-in-files", "arrives", batches + 1)
    return run_to_end(sf_.stream_frames(stream, remember_seconds=None, order="count"), "stream-frames")


@add("stream_fold", oracle(["sse_frames"], """SELECT f.thread_id,
 coalesce(string_agg(json_extract_string(data, '$.content'), '' ORDER BY seq) FILTER (event = 'token'), '') AS response,
 count(*) FILTER (event = 'tool_start') AS calls,
 coalesce(string_agg(json_extract_string(data, '$.tool'), ',' ORDER BY seq) FILTER (event = 'tool_start'), '') AS tools,
 coalesce(string_agg(replace(CAST(json_extract(data, '$.input') AS VARCHAR), ' ', ''), '|' ORDER BY seq)
   FILTER (event = 'tool_start'), '') AS inputs, string_agg(event, ',' ORDER BY seq) AS events,
 coalesce(max_by(json_extract_string(data, '$.suggestions[0]'), seq) FILTER (event = 'suggestions'), '') AS suggestions,
 count(*) AS step_count FROM (SELECT f.* FROM sse_frames f LEFT JOIN (SELECT thread_id, min(seq) AS last FROM sse_frames
  WHERE event = 'done' GROUP BY 1) d ON f.thread_id = d.thread_id WHERE last IS NULL OR seq <= last) f GROUP BY 1"""))
def stream_fold(spark, sf):
    """Several micro-batches; threads that are still open at the end of the source come out of its state."""
    frames = in_files(fixture(spark, sf, "sse_frames").drop("ts"), "frames-in-files", "seq")
    return _folded(run_to_end(sf_.stream_fold(frames, timed=False), "stream-fold", sf_.open_records))


# Frames by their own times: a thread ends where a frame comes more than a day after the one before or three days after the first.
_IDLE, _TOTAL = 86400, 3 * 86400
_ENDED = f"""SELECT f.*, CASE WHEN cut IS NOT NULL AND (done IS NULL OR cut <= done) THEN cut - 1 ELSE done END AS last,
 CASE WHEN cut IS NOT NULL AND (done IS NULL OR cut <= done) THEN cut_why WHEN done IS NULL THEN late_why END AS error FROM (
 SELECT *, min(seq) FILTER (event = 'done') OVER w AS done, min(seq) FILTER (ms > due) OVER w AS cut,
  min_by(why, seq) FILTER (ms > due) OVER w AS cut_why, max_by(CASE WHEN least(ms + {_IDLE * 1000}, began + {_TOTAL * 1000}) < now THEN CASE WHEN ms + {_IDLE * 1000} <= began + {_TOTAL * 1000}
   THEN 'SSE hang: no data for {_IDLE}s' ELSE 'timed out' END END, seq) OVER w AS late_why
 FROM (SELECT *, least(prev + {_IDLE * 1000}, began + {_TOTAL * 1000}) AS due,
   CASE WHEN prev + {_IDLE * 1000} <= began + {_TOTAL * 1000} THEN 'SSE hang: no data for {_IDLE}s' ELSE 'timed out' END AS why
  FROM (SELECT *, epoch_us(ts) // 1000 AS ms, lag(epoch_us(ts) // 1000) OVER (PARTITION BY thread_id ORDER BY seq) AS prev,
    first_value(epoch_us(ts) // 1000) OVER (PARTITION BY thread_id ORDER BY seq) AS began, max(epoch_us(ts) // 1000) OVER () AS now FROM sse_frames))
 WINDOW w AS (PARTITION BY thread_id)) f"""


def replayed(spark, sf, purpose):
    return in_files(fixture(spark, sf, "sse_frames").withColumn("ts", F.col("ts").cast("timestamp")), purpose, "seq")


@add("stream_hangs", oracle(["sse_frames"], """SELECT thread_id, coalesce(string_agg(json_extract_string(data, '$.content'), '' ORDER BY seq)
 FILTER (event = 'token'), '') AS response, string_agg(event, ',' ORDER BY seq) AS events, CAST(count(*) AS INTEGER) AS step_count, max(error) AS error
 FROM ended WHERE last IS NULL OR seq <= last GROUP BY 1""", ended=_ENDED))
def stream_hangs(spark, sf):
    """A replay in several micro-batches; timeouts strike by the frames' times, from frames or from the watermark."""
    stream, limits = replayed(spark, sf, "replay"), {"idle_seconds": _IDLE, "total_seconds": _TOTAL}
    now = fixture(spark, sf, "sse_frames").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    folded = sf_.stream_fold(stream, clock="frames", remember_seconds=_REMEMBER, **limits)
    out = run_to_end(folded, "stream-hangs", lambda s, state: sf_.open_records(s, state, F.lit(now), **limits))
    return out.select("thread_id", "response", F.array_join("status_sequence", ",").alias("events"), "step_count", "error")


#: Longer than the events last, so that no thread begins anew.
_REMEMBER = 400 * 86400


@add("stream_late_frames", oracle(["sse_frames"], "SELECT thread_id, count(*) AS late FROM ended WHERE seq > last GROUP BY 1", ended=_ENDED))
def stream_late_frames(spark, sf):
    """Frames that come behind the end of their thread, be it in the same micro-batch or later."""
    late = sf_.late_frames(replayed(spark, sf, "replay-late"), _IDLE, _TOTAL, remember_seconds=_REMEMBER)
    return run_to_end(late, "stream-late").groupBy("thread_id").agg(F.sum("late").alias("late"))


@add("stream_resume", oracle(["sse_frames"], "SELECT thread_id, seq, event FROM sse_frames"))
def stream_resume(spark, sf):
    """The third micro-batch is written, its job fails before the commit; the restarted stream gives every row once."""
    frames, base = in_files(fixture(spark, sf, "sse_frames").select("thread_id", "seq", "event"), "resume-in", "seq"), scratch(spark, "resume")

    def fail(rows, number):
        if number == 2:
            raise RuntimeError("lost between write and commit")

    first = sr.stream_batches(frames, f"{base}/out", f"{base}/state", written=fail)
    try:
        first.awaitTermination()
        raise AssertionError("the first run was to fail")
    except StreamingQueryException:
        pass
    sr.stream_batches(frames, f"{base}/out", f"{base}/state").awaitTermination()
    return sr.read_batches(spark, f"{base}/out", frames.schema).drop("batch")


def backlog(spark, sf, purpose):
    """The runs as a stream, newest first in several micro-batches; some runs of every micro-batch come again in the last."""
    runs = fixture(spark, sf, "trace_runs").select("run_id", "run_type", "start_time")
    which, batches = batch_of(runs, "run_id")
    own = runs.withColumn("arrives", F.lit(batches - 1) - which)
    again = own.where("run_id % 40 = 0 AND arrives < " + str(batches - 1)).withColumn("arrives", F.lit(batches - 1))
    return dealt(own.unionByName(again), purpose, "arrives", batches)


@add("watch_runs", oracle(["trace_runs"], "SELECT run_id, run_type FROM trace_runs WHERE start_time >= TIMESTAMP '2024-01-03 00:00:00'"))
def watch_runs(spark, sf):
    runs = backlog(spark, sf, "runs-backlog")
    return run_to_end(sr.watch_runs(runs, since="2024-01-03"), "watch-runs").select("run_id", "run_type")


@add("poll_summary", oracle(["trace_runs"], "SELECT run_type, count(*) AS new_runs FROM trace_runs GROUP BY 1"))
def poll_summary(spark, sf):
    runs = backlog(spark, sf, "polls-backlog")
    base = scratch(spark, "polls")

    def keep(batch, poll):
        sr.poll_summary(batch, poll).write.mode("overwrite").parquet(f"{base}/polls/poll={poll}")

    sr.watch(runs, f"{base}/state", keep, seconds=None).awaitTermination()
    return (spark.read.parquet(f"{base}/polls").groupBy("run_type").agg(F.sum("new_runs").alias("new_runs")))
