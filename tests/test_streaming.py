"""Streams over several micro-batches against the batch result."""

import datetime
import time

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from dialoscope.operators import capture
from dialoscope.streaming import frames as st
from dialoscope.streaming import runs as sr

FRAMES = [("a", 0, "token", '{"content":"x"}'), ("a", 1, "message", '{"content":"no"}'), ("b", 0, "message", '{"content":"m"}'),
          ("a", 2, "tool_start", '{"tool":"t","input":{"k":1}}'), ("b", 1, "token", '{"token":"n"}'),
          ("a", 3, "suggestions", '{"suggestions":["s"]}'), ("a", 4, "done", "{}"), ("a", 5, "token", '{"content":"late"}'),
          ("b", 2, "status", "{}"), ("b", 3, "done", "{}"), ("c", 0, "token", '{"content":"open"}')]
SCHEMA = "thread_id string, seq bigint, event string, data string"


def land(spark, path, rows, schema, per_file):
    for i in range(0, len(rows), per_file):
        spark.createDataFrame(rows[i:i + per_file], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream, tmp_path, name):
    sr.stream_records(stream, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / name))


def plain(df):
    return sorted((r.thread_id, r.response, [(c.tool, c.input) for c in r.tool_calls], r.status_sequence, r.suggestions,
                   r.step_count) for r in df.collect())


def test_stream_fold_equals_batch(spark, tmp_path):
    stream = land(spark, str(tmp_path / "in"), FRAMES, SCHEMA, 2)
    out = drain(st.stream_fold(stream, timed=False), tmp_path, "out")
    rest = st.open_records(spark, str(tmp_path / "out-state"))
    batch = capture.fold_frames(spark.createDataFrame(FRAMES, SCHEMA), stop_at_done=True)
    assert plain(out.unionByName(rest)) == plain(batch)
    assert [r.thread_id for r in rest.collect()] == ["c"]


def test_chunks_across_borders(spark, tmp_path):
    body = "event: a\ndata: 1\n\n: ping\n\nevent: b\ndata: {\"é\": 2}\n\nevent: lost\ndata: 3"
    for size, per_file in ((7, 2), (1, 40)):
        rows = [("t", i, body[i:i + size]) for i in range(0, len(body), size)]
        stream = land(spark, str(tmp_path / f"in{size}"), rows, "thread_id string, seq bigint, chunk string", per_file)
        out = drain(st.stream_frames(stream, remember_seconds=None), tmp_path, f"out{size}")
        assert [tuple(r) for r in out.orderBy("seq").collect()] == [("t", 0, "a", "1"), ("t", 2, "b", '{"é": 2}')]


def test_idle_thread_times_out(spark, tmp_path):
    stream = land(spark, str(tmp_path / "in"), [("c", 0, "token", '{"content":"open"}')], SCHEMA, 1)
    folded = st.stream_fold(stream, idle_seconds=2, total_seconds=300)
    query = (folded.writeStream.format("memory").queryName("timed_out").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start())
    try:
        for _ in range(60):
            time.sleep(1)
            if spark.table("timed_out").count():
                break
        row = spark.table("timed_out").first()
        assert (row.response, row.error) == ("open", "SSE hang: no data for 2s")
    finally:
        query.stop()


def test_total_timeout_gives_one_record(spark, tmp_path):
    """Frames keep a thread busy until its total time is over; later ones open no second record."""
    schema, path = SCHEMA, str(tmp_path / "in")
    put = lambda i: spark.createDataFrame([("t", i, "token", f'{{"content":"{i}"}}')], schema).coalesce(1).write.mode("append").parquet(path)
    put(0)
    stream = spark.readStream.schema(schema).parquet(path)
    folded = st.stream_fold(stream, idle_seconds=60, total_seconds=4)
    query = (folded.writeStream.format("memory").queryName("total").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start())
    try:
        for i in range(1, 40):
            time.sleep(1)
            if spark.table("total").count():
                break
            put(i)
        put(98)
        time.sleep(4)
        put(99)
        time.sleep(6)
        rows = spark.table("total").collect()
        assert [r.error for r in rows] == ["timed out"] and rows[0].response.startswith("0")
    finally:
        query.stop()


def test_watch_takes_each_run_once(spark, tmp_path):
    rows = [(1, "tool", "2024-01-01 00:00:00"), (2, "llm", "2024-01-01 01:00:00"), (1, "tool", "2024-01-01 00:00:00"),
            (3, "tool", "2024-01-02 00:00:00"), (2, "llm", "2024-01-01 01:00:00")]
    src = spark.createDataFrame(rows, "run_id bigint, run_type string, t string").withColumn(
        "start_time", F.col("t").cast("timestamp")).drop("t")
    data = [tuple(r) for r in src.collect()]
    stream = land(spark, str(tmp_path / "in"), data, src.schema, 2)
    seen = []
    sr.watch(stream, str(tmp_path / "state"), lambda b, n: seen.extend(r.run_id for r in b.collect()), seconds=None).awaitTermination()
    assert sorted(seen) == [1, 2, 3]


def test_watch_loses_nothing_of_a_backlog(spark, tmp_path):
    """Sixty days, newest first, one file in a micro-batch; some runs come again much later."""
    days = list(range(60, 0, -1))
    rows = [(d, "tool", f"2024-{1 + d // 31:02d}-{1 + d % 28:02d} 00:00:00") for d in days] + [(d, "tool", "2023-01-01 00:00:00") for d in days[::7]]
    src = spark.createDataFrame(rows, "run_id bigint, run_type string, t string").withColumn("start_time", F.col("t").cast("timestamp")).drop("t")
    data = [tuple(r) for r in src.collect()]
    stream = land(spark, str(tmp_path / "in"), data, src.schema, 10)
    seen = []
    sr.watch(stream, str(tmp_path / "state"), lambda b, n: seen.extend(r.run_id for r in b.collect()), seconds=None).awaitTermination()
    assert sorted(seen) == sorted(days)
    # a restarted watch passes on nothing twice
    sr.watch(stream, str(tmp_path / "state"), lambda b, n: seen.extend(r.run_id for r in b.collect()), seconds=None).awaitTermination()
    assert sorted(seen) == sorted(days)
    out = drain(sr.watch_runs(stream), tmp_path, "once")
    assert sorted(r.run_id for r in out.collect()) == sorted(days)


def test_chunks_that_overtake(spark, tmp_path):
    """Chunks swapped within and across micro-batches wait for those before them; repeated ones are left out."""
    body = "".join(f"event: e{i}\ndata: {{\"n\": {i}}}\n\n" for i in range(12))
    cut = [body[i:i + 9] for i in range(0, len(body), 9)]
    order = list(range(len(cut)))
    order[1], order[9] = order[9], order[1]
    order[4], order[5] = order[5], order[4]
    order += [3, 0]
    for how, seq in (("count", lambda i: i), ("length", lambda i: 9 * i)):
        rows = [(t, seq(i), cut[i]) for i in order for t in ("a", "b")]
        stream = land(spark, str(tmp_path / f"in-{how}"), rows, "thread_id string, seq bigint, chunk string", 5)
        out = drain(st.stream_frames(stream, remember_seconds=None, order=how), tmp_path, f"out-{how}")
        want = [(t, i, f"e{i}", f'{{"n": {i}}}') for t in ("a", "b") for i in range(12)]
        assert [tuple(r) for r in out.orderBy("thread_id", "seq").collect()] == want


TIMED = "thread_id string, seq bigint, ts timestamp, event string, data string"


def timed(rows):
    start = datetime.datetime(2024, 1, 1)
    return [(t, i, start + datetime.timedelta(seconds=s), e, d) for t, i, s, e, d in rows]


def test_timeouts_by_the_frames_own_times(spark, tmp_path):
    """Idle and total limits cut where the frames' times say, however frames are dealt over micro-batches."""
    say = lambda t, i, s: (t, i, s, "token", f'{{"content":"{t}{i}"}}')
    rows = [say("idle", 0, 0), say("long", 0, 0), ("fine", 0, 0, "done", "{}"), say("idle", 1, 50), say("long", 1, 100), say("long", 2, 200), say("idle", 2, 201),
            say("long", 3, 290), say("fine", 1, 291), say("long", 4, 301), say("idle", 3, 302), say("open", 0, 400), say("quiet", 0, 390), say("open", 1, 495)]
    want = {"idle": ("idle0idle1", "SSE hang: no data for 120s"), "long": ("long0long1long2long3", "timed out"), "fine": ("", None),
            "open": ("open0open1", None), "quiet": ("quiet0", None)}
    for per_file in (1, 4, 20):
        stream = land(spark, str(tmp_path / f"in{per_file}"), timed(rows), TIMED, per_file)
        out = drain(st.stream_fold(stream, clock="frames"), tmp_path, f"out{per_file}")
        now = F.lit(timed(rows)[-1][2])
        rest = st.open_records(spark, str(tmp_path / f"out{per_file}-state"), now)
        got = out.unionByName(rest).collect()
        assert {r.thread_id: (r.response, r.error) for r in got} == want and len(got) == 5
        late = drain(st.late_frames(stream), tmp_path, f"late{per_file}").groupBy("thread_id").agg(F.sum("late").alias("n"))
        assert {r.thread_id: r.n for r in late.collect()} == {"idle": 2, "fine": 1, "long": 1}


def test_state_holds_blocks_not_frames(spark, tmp_path):
    """A thread of thousands of token frames leaves one condensed row a micro-batch."""
    rows = [("t", i, "token", '{"content":"x"}') for i in range(3000)]
    stream = land(spark, str(tmp_path / "in"), rows, SCHEMA, 1000)
    drain(st.stream_fold(stream, timed=False), tmp_path, "out")
    state = spark.read.format("statestore").option("stateVarName", "blocks").load(str(tmp_path / "out-state")).collect()
    assert len(state) == 3 and sum(len(r.user_map_value.body) for r in state) < 3000 + 3 * 200
    (row,) = st.open_records(spark, str(tmp_path / "out-state")).collect()
    assert (row.response, row.step_count, row.status_sequence) == ("x" * 3000, 3000, ["token"] * 3000)


def test_failed_batch_is_repeated_as_a_whole(spark, tmp_path):
    """A job lost between write and commit, at each batch in turn: rows come once."""
    rows = [(i, f"r{i}") for i in range(20)]
    stream = land(spark, str(tmp_path / "in"), rows, "n bigint, t string", 4)
    left, counts = {1, 3}, {}

    def check(batch, number):
        counts[number] = batch.count()
        if number in left:
            left.discard(number)
            raise RuntimeError("lost")

    for _ in range(3):
        query = sr.stream_batches(stream, str(tmp_path / "out"), str(tmp_path / "state"), written=check)
        try:
            query.awaitTermination()
        except StreamingQueryException:
            pass
    out = sr.read_batches(spark, str(tmp_path / "out"), stream.schema).collect()
    assert sorted((r.n, r.t) for r in out) == rows and not left and set(counts.values()) == {4}


def test_polls_read_by_the_batch(spark, tmp_path):
    """Over twenty polls, what a poll looks up in the state follows its own rows, not those of all polls before."""
    rows = [(i if i % 5 else i // 2, "tool", datetime.datetime(2024, 1, 1)) for i in range(400)]
    stream = land(spark, str(tmp_path / "in"), rows, "run_id bigint, run_type string, start_time timestamp", 20)
    seen = []
    query = sr.watch(stream, str(tmp_path / "state"), lambda b, n: seen.extend(r.run_id for r in b.collect()), seconds=None)
    query.awaitTermination()
    assert sorted(seen) == sorted({r[0] for r in rows})
    polls = [p for p in query.recentProgress if p["numInputRows"]]
    gets = [p["stateOperators"][0]["customMetrics"]["rocksdbGetCount"] for p in polls]
    assert len(polls) == 20 and max(gets) <= 3 * 20 and all(p["numInputRows"] <= 20 for p in polls)


def test_short_threads_cost_few_state_calls(spark, tmp_path):
    """Threads are read and written by shards, so a micro-batch of many short threads makes fewer look-ups than it has threads."""
    n = 60_000
    rows = spark.range(n).selectExpr("id * 7 AS thread_id", "id AS seq", "if(id % 3 = 0, 'done', 'token') AS event", "concat('{\"content\":\"', id, '\"}') AS data")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = sr.stream_records(st.stream_fold(stream, timed=False), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    rest = st.open_records(spark, str(tmp_path / "state"))
    assert rest.schema["thread_id"].dataType.simpleString() == "bigint"
    assert spark.read.parquet(str(tmp_path / "out")).count() + rest.count() == n
    assert rest.selectExpr("sum(thread_id)").first()[0] == sum(7 * i for i in range(n) if i % 3)
    (op,) = query.recentProgress[0]["stateOperators"]
    assert op["customMetrics"]["rocksdbGetCount"] < n and op["customMetrics"]["rocksdbPutCount"] < n


def test_waiting_chunks_and_open_threads_share_rows(spark, tmp_path, monkeypatch):
    """Threads of one shard over many micro-batches: waiting chunks, late closing, small rows and a log that is rewritten."""
    from dialoscope.streaming import shards
    monkeypatch.setattr(shards, "SHARDS", 1)
    threads = [f"t{i}" for i in range(6)]
    rows = [(t, 0, "token", '{"content":"a"}') for t in threads] + [(t, i, "token", f'{{"content":"{t}{i}"}}') for i in range(1, 12) for t in threads[i % 3::2]]
    rows += [(threads[k], 20 + k, "done", "{}") for k in (0, 3)] + [(t, 40, "token", '{"content":"z"}') for t in threads]
    stream = land(spark, str(tmp_path / "in"), rows, SCHEMA, 4)
    out = drain(st.stream_fold(stream, timed=False), tmp_path, "out")
    batch = capture.fold_frames(spark.createDataFrame(rows, SCHEMA), stop_at_done=True)
    assert plain(out.unionByName(st.open_records(spark, str(tmp_path / "out-state")))) == plain(batch)
    body = "".join(f"event: e{i}\ndata: {{\"n\": {i}}}\n\n" for i in range(9))
    cut = [body[i:i + 7] for i in range(0, len(body), 7)]
    chunks = [(t, i, cut[i]) for i in [*range(len(cut) - 1, 0, -1), 3, 0] for t in threads[:3]]
    stream = land(spark, str(tmp_path / "chunks"), chunks, "thread_id string, seq bigint, chunk string", 7)
    got = drain(st.stream_frames(stream, remember_seconds=None, order="count"), tmp_path, "frames")
    assert sorted(map(tuple, got.collect())) == [(t, i, f"e{i}", f'{{"n": {i}}}') for t in threads[:3] for i in range(9)]
