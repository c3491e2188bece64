"""Operators on tiny literal inputs."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from dialoscope.operators import bots, browse, capture, compare, rollups, suite, tools, turns, verdicts
from dialoscope.operators import reports as rp
from dialoscope.operators import traces as tr


def ingest(spark, **body):
    import json
    row = {k: (json.dumps(x) if k not in ("name", "run_type") else x) for k, x in body.items()}
    cols = ("run_id", "name", "run_type", "inputs", "outputs", "extra", "metadata", "child_runs")
    values = ["1", row.get("name", "n"), row.get("run_type", "chain"), *[row.get(c) for c in cols[3:]]]
    return tr.ingest_runs(spark.createDataFrame([values], ", ".join(f"{c} string" for c in cols)))


def human(text, kind="HumanMessage"):
    return [[{"type": "constructor", "id": ["x", kind], "kwargs": {"content": text}}]]


@pytest.mark.parametrize("body,expected", [
    ({"inputs": {"messages": human("hi")}}, "hi"),
    ({"inputs": {"messages": human("hi", "AIMessage"), "question": "why"}}, "why"),
    ({"inputs": {"messages": [{"type": "ai", "content": "a"}, {"type": "user", "content": ""},
                              {"type": "human", "content": "b"}]}}, "b"),
    ({"inputs": {"input": {"messages": [{"role": "user", "content": "c"}]}}}, "c"),
    ({"inputs": {"question": "q?!"}, "extra": {"metadata": {"title": "T"}}}, "T"),
    ({"inputs": {"question": "ab", "query": "abc"}}, "abc"),
    ({"inputs": {"z": "abc", "y": "first", "a": "later"}}, "first"),
    ({"inputs": {"n": 5, "messages": "text"}}, "text"),
    ({"inputs": {"n": 5}}, ""), ({}, ""),
])
def test_query_strategies(spark, body, expected):
    assert ingest(spark, **body).select(tr.extract_query()).first()[0] == expected


def calls(spark, **body):
    rows = ingest(spark, **body).select(tr.extract_tool_calls().alias("c")).first().c
    return [(c.name, c.arguments, c.from_definitions) for c in rows]


def test_tool_call_sources(spark):
    assert calls(spark, run_type="tool", name="t", inputs={"b": 1, "a": [2]}) == [("t", '{"a":[2],"b":1}', False)]
    assert calls(spark, run_type="tool", name="t") == [("t", "{}", False)]
    message = {"kwargs": {"tool_calls": [{"function": {"name": "k", "arguments": '{"x":1}'}}, "junk"]},
               "tool_calls": [{"type": "tool_call", "name": "p", "args": {"y": 2}}, {"type": "x", "name": "no"}],
               "additional_kwargs": {"tool_calls": [{"function": {"name": "r"}}, {"function": "no"}]}}
    got = calls(spark, child_runs=[{"run_type": "tool", "name": "c"}, {"run_type": "llm", "name": "no"}],
                outputs={"generations": [[{"message": message}]], "tools": [{"tool": "o", "args": {"z": 3}}]},
                inputs={"output": {"messages": [{"tool_calls": [{"type": "tool_call", "name": "e", "args": {}}]}]}},
                extra={"invocation_params": {"tools": [{"function": {"name": "defined"}}]}})
    assert got == [("c", "{}", False), ("k", '{"x":1}', False), ("p", '{"y":2}', False), ("r", "{}", False),
                   ("e", "{}", False), ("o", '{"z":3}', False)]
    assert calls(spark, extra={"invocation_params": {"tools": [{"function": {"name": "d"}}, {"function": {}}]}}) == [
        ("d", "{}", True)]
    twice = ingest(spark, outputs={"tool_calls": [{"name": "a"}, {"name": "a"}]})
    assert len(twice.select(tr.extract_tool_calls().alias("c")).first().c) == 2
    assert len(twice.select(tr.extract_tool_calls(dedupe=True).alias("c")).first().c) == 1


@pytest.mark.parametrize("body,expected", [
    ({"outputs": {"output": {"content": "o"}, "answer": "a"}}, "o"),
    ({"outputs": {"generations": [[{"message": {"kwargs": {"content": ""}}}, {"message": {"kwargs": {"content": "g"}}}]]}}, "g"),
    ({"outputs": {"text": "t", "result": "r"}}, "r"),
    ({"inputs": {"output": {"messages": [{"type": "ai", "content": "1"}, {"type": "ai", "content": "2"},
                                         {"type": "ai", "content": ""}]}}}, "2"),
    ({"inputs": {"input": {"messages": [{"type": "ai", "content": "in"}]}}}, "in"),
    ({"outputs": {"answer": "x" * 6000}}, "x" * 5000), ({}, ""),
])
def test_answer_places(spark, body, expected):
    assert ingest(spark, **body).select(tr.extract_answer()).first()[0] == expected


def test_trace_metadata_and_skips(spark):
    meta = [ingest(spark, metadata=m, extra=e).select(F.to_json(tr.trace_metadata())).first()[0] for m, e in
            (({"a": 1}, {"metadata": {"b": 2}}), ({}, {"metadata": {"b": 2}}), (None, None))]
    assert meta == ['{"a":1}', '{"b":2}', "{}"]
    long = tr.normalize_traces(ingest(spark, inputs={"question": "w " * 300}))
    assert long.select(tr.skip_reason()).first()[0] == "system prompt"
    mine = tr.normalize_traces(ingest(spark, inputs={"question": "You are the shop agent"}))
    assert mine.select(tr.skip_reason(), tr.skip_reason(["you are the shop agent"])).first()[:] == (None, "system prompt")


def messages(spark, rows):
    return spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)],
                                 "session_id string, pos bigint, role string, content string, tool_name string")


def test_turn_rules(spark):
    rows = [("ai", "before", "x"), ("user", "q1", "x"), ("tool", "", "b"), ("tool", "", "a"), ("tool", "", "b"),
            ("ai", "r1", "x"), ("ai", "", "x"), ("user", "  ", "x"), ("ai", "lost", "x"), ("human", "q2", "x")]
    for block in (2, 100):
        for df in (messages(spark, rows), messages(spark, rows).orderBy(F.rand(1))):
            got = sorted(turns.to_turns(df, block).collect(), key=lambda r: r.turn_index)
            assert [(r.turn_index, r.total_turns, r.query, r.response, r.tool_calls) for r in got] == [
                (1, 2, "q1", "r1", ["b", "a"]), (2, 2, "q2", "", [])]


def test_turn_context_text(spark):
    df = turns.to_turns(messages(spark, [("user", "q1", ""), ("tool", "", "t"), ("user", "q2", "")]))
    last = turns.turn_context(df, "{{TURN_INDEX}}|{{CONVERSATION}}").where("turn_index = 2").first()
    assert last.prompt == ("2|TURN 1 — USER: q1\n  TOOLS: t\n  AGENT: (no text response)\n\n"
                           "TURN 2 — USER: q2\n  TOOLS: none\n  AGENT: (no text response)")


def frames(spark, rows):
    return spark.createDataFrame([("t", i, *r) for i, r in enumerate(rows)],
                                 "thread_id string, seq bigint, event string, data string")


def test_fold_rules(spark):
    rows = [("token", '{"content":""}'), ("message", '{"content":"M1"}'), ("token", '{"token":"a"}'),
            ("message", '{"content":"M2"}'), ("ui", '{"data":"<u>"}'), ("ui", '{"data":{"x":1}}'),
            ("token", "broken"), ("tool_start", '{"tool_name":"x","arguments":{"k":1}}'), ("tool_start", "{}"),
            ("suggestions", '{"suggestions":["a"]}'), ("suggestions", '{"data":["b","c"]}'),
            ("suggestions", '{"data":"no list"}'), ("status", '{"phase":"tool_start","tool":"y","input":{}}'),
            ("done", "{}"), ("token", '{"content":"late"}')]
    for block in (1, 4, 1000):
        r = capture.fold_frames(frames(spark, rows).orderBy(F.rand(3)), block=block).first()
        assert r.response == "M1a<u>late" and r.suggestions == ["b", "c"] and r.step_count == 15
        assert [(c.tool, c.input) for c in r.tool_calls] == [("x", '{"k":1}'), ("?", "{}")]
        done = capture.fold_frames(frames(spark, rows), block=block, stop_at_done=True).first()
        assert done.response == "M1a<u>" and done.step_count == 14
        promoted = capture.fold_frames(frames(spark, rows), phases="status", block=block).first()
        assert [c.tool for c in promoted.tool_calls] == ["x", "?", "y"]


def test_parse_frames(spark):
    body = ("event: a\ndata: 1\ndata: 2\n\n: ping\n\nevent: no data\n\ndata: no event\n\n"
            "event: x\nevent: b \ndata:  s \n\nevent: lost\ndata: 1\n")
    df = spark.createDataFrame([("t", body)], "thread_id string, body string")
    assert [tuple(r)[2:] for r in capture.parse_frames(df).orderBy("seq").collect()] == [("a", "12"), ("b", " s ")]


def test_hang_cut(spark):
    df = spark.createDataFrame([("t", i, datetime(2024, 1, 1, 0, m)) for i, m in enumerate((0, 1, 5, 6))],
                               "thread_id string, seq bigint, ts timestamp")
    kept, errors = capture.cut_hangs(df, 120, block=2)
    assert kept.count() == 2
    assert errors.first()[:] == ("t", 2, "SSE hang: no data for 120s")


def test_expected_tools(spark):
    df = spark.createDataFrame([("a → b", ["b", "a"]), ("a", ["a"]), ("a ", ["a"]), ("", ["a"]), (None, []), ("a", None)],
                               "expected_tool string, t array<string>")
    df = df.withColumn("tool_calls", F.transform("t", lambda x: F.struct(x.alias("tool"))))
    assert [r[0] for r in tools.tool_match(df).select("tool_matched").collect()] == [True, True, False, None, None, False]
    assert tools.tool_match(df, ordered=True).first().tool_matched is False


def test_near_tools_equals_all_pairs(spark):
    names = ["get_sales", "getsales", "get_sale", "set_sales", "sales", "", "gte_sales", "get__sales"]
    known = ["get_sales", "get_stock", "sale", "ab"]
    calls_df = spark.createDataFrame([(n,) for n in names], "tool string")
    reg = spark.createDataFrame([(n,) for n in known], "name string")
    got = {tuple(r) for r in tools.near_tools(calls_df, reg, 2).collect()}

    def apart(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
        return d[-1]

    assert got == {(a, b, apart(a, b)) for a in names for b in known if a not in known and apart(a, b) <= 2}


def test_suite_partition_invariant(spark):
    rows = spark.createDataFrame([(2, "q0", None, None, None, False), (3, " Cat ", "", "", "", True), (4, "q1", " r ", "m", " t ", False),
                                  (5, None, "x", "", "", True), (6, "q2", "", "", " ", False), (1, "header", "", "", "", True)],
                                 "row_idx bigint, c1 string, c2 string, c3 string, c4 string, is_bold boolean")
    s = suite.normalize_suite_a(rows, block=2)
    got = [tuple(r) for r in s.orderBy("query_index").collect()]
    assert got == [(1, "q0", "", "", "General", None), (2, "q1", "r", "m", "Cat", "t"), (3, "q2", "", "", "Cat", None)]
    done = spark.createDataFrame([(1, None), (2, "err")], "query_index bigint, error string")
    assert suite.remaining(s, done).count() == 1 and suite.remaining(s, done, retry_errors=True).count() == 2


def test_picked_sheets_are_spread(spark):
    """One workbook of many rows is dealt to many tasks when its sheet is picked."""
    rows = spark.range(20_000).selectExpr("'one' AS file", "if(id % 2 = 0, 'Chat Queries', 'Notes') AS sheet", "CAST(id % 2 AS int) AS sheet_no", "id AS row_idx")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("false", "-1", "8")):
            spark.conf.set(k, v)
        picked = suite.pick_sheets(rows, block=100).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.min("sheet").alias("s")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(r.n for r in picked) == 10_000 and {r.s for r in picked} == {"Chat Queries"}
    assert max(r.n for r in picked) < 4_000


def test_versions_and_since(spark):
    m = spark.createDataFrame([("a", 1), ("a", 3)], "account string, version int")
    r = spark.createDataFrame([("a", 1, 7), ("a", 3, 8)], "account string, run_version int, query_index int")
    assert browse.select_version(r, m).first().query_index == 8
    assert browse.select_version(r, m, 1).first().query_index == 7
    with pytest.raises(Exception, match="version 2 not found; available: 2 from 1 to 3"):
        browse.select_version(r, m, 2).collect()
    files = spark.createDataFrame([("query_results_v2.jsonl",), ("query_results_vx.jsonl",), ("other",)], "file string")
    assert browse.next_version_of_files(files, "query_results").first()[0] == 3
    now = datetime(2024, 1, 10, tzinfo=timezone.utc)
    assert browse.parse_since("7d", now).day == 3 and browse.parse_since("24h", now).day == 9
    assert browse.parse_since("2024-02-01T01:02:03").hour == 1
    with pytest.raises(ValueError):
        browse.parse_since("soon")


def test_trend_classes(spark):
    rows = [("a", 1, 2, 10.0), ("a", 2, 0, 9.0), ("a", 3, 1, 9.45), ("a", 4, 1, 9.93), ("a", 5, 0, 0.0), ("a", 6, 0, 1.0)]
    m = spark.createDataFrame(rows, "account string, version int, failed int, avg_response_time_seconds double")
    got = [(r.failure_change, r.latency_change) for r in compare.version_trend(m).orderBy("version").collect()]
    assert got == [("first", "first"), ("all_clear", "improved"), ("increased", "within_noise"), ("same", "slower"),
                   ("all_clear", "improved"), ("same", None)]


def test_upper_median_and_empty_accuracy(spark):
    for values, median in (([1, 2, 3, 4], 3), ([5, 1, 9], 5), ([2], 2)):
        df = spark.createDataFrame([("a", 1, x) for x in values], "account string, run_version int, step_count int")
        assert rollups.step_stats(df).first()["median"] == median
    none = spark.createDataFrame([("a", 1, "c", None, [])], "account string, run_version int, category string, "
                                 "expected_tool string, tool_calls array<struct<tool: string>>")
    assert rollups.tool_accuracy(none).first().pct == 0.0
    assert rollups.category_tool_accuracy(none).first().pct is None


REPLY = '{"expected_tool":"a","selected_tool":"a","score":%s,"reason":"r","candidate_tools":[]}'


def test_verdict_validation(spark):
    cases = [(REPLY % "1", True), (REPLY % "0.25", True), (REPLY % "1.01", False), (REPLY % "-0.1", False),
             (REPLY % "true", False), (REPLY % '"1"', False), ("[1]", False), ("", False), (None, False),
             ('{"score":1}', False), ("```json\n" + REPLY % "0" + "\n```", True)]
    df = spark.createDataFrame(cases, "reply string, ok boolean")
    for r in df.select("ok", verdicts.validate_verdict("reply").isNotNull().alias("got"), "reply").collect():
        assert r.ok == r.got, r.reply


def test_registry_block_and_prompt_order(spark):
    reg = spark.createDataFrame([(2, "b", "f", False, "d2"), (1, "a", "f", True, "d1")],
                                "ord int, name string, family string, enabled boolean, description string")
    block = verdicts.registry_block(reg).first()[0]
    assert block.splitlines()[2:] == ["| 1 | `a` | f | ✅ | d1 |", "| 2 | `b` | f | ❌ | d2 |"]
    assert verdicts.registry_block(reg.limit(0)).first()[0] == verdicts.EMPTY_REGISTRY
    t = spark.createDataFrame([("say {{SELECTED_TOOL}}", "a", "{}")], "user_query string, selected_tool string, tool_arguments string")
    assert verdicts.build_prompts(t, reg, "{{USER_QUERY}}").first().prompt == "say a"


def test_expectation_rules(spark):
    base = {"bot_name": "b", "query_id": "1", "response_type": "text", "response_text": "Hello", "tools": ["t"], "error": None}
    exp = dict(rt=None, c=None, nc=None, tool=None, nt=None)
    cases = [({}, {}, True, ""), ({}, {"rt": "menu"}, False, "expected response_type='menu', got 'text'"),
             ({}, {"c": ["hello", "zz"]}, False, "expected to contain 'zz', not found"),
             ({}, {"nc": ["HELL"]}, False, "unexpected phrase 'HELL' found in response"),
             ({}, {"tool": "u"}, False, "expected tool 'u', used: ['t']"),
             ({}, {"nt": ["x", "t"]}, False, "forbidden tool 't' was invoked"),
             ({"error": "boom"}, {"rt": "menu"}, False, "boom"), ({}, {"rt": "text", "c": ["ELL"], "tool": "t"}, True, "")]
    for change, want, passed, reason in cases:
        r, e = {**base, **change}, {**exp, **want}
        res = spark.createDataFrame([(r["bot_name"], r["query_id"], r["response_type"], r["response_text"], r["tools"], r["error"])],
                                    "bot_name string, query_id string, response_type string, response_text string, "
                                    "t array<string>, error string")
        res = res.withColumn("tools_used", F.transform("t", lambda x: F.struct(x.alias("name"))))
        ex = spark.createDataFrame([("b", "1", e["rt"], e["c"], e["nc"], e["tool"], e["nt"])],
                                   "bot_name string, query_id string, exp_response_type string, exp_contains array<string>, "
                                   "exp_not_contains array<string>, exp_tool string, exp_not_tool array<string>")
        got = bots.check_expectations(res, ex).first()
        assert (got.passed, got.fail_reason) == (passed, reason)


def test_bot_reply_without_messages(spark):
    df = spark.createDataFrame([("{}",), ('{"messages":[{"type":"x"}]}',)], "s string").select(F.try_parse_json("s").alias("raw"))
    rows = df.select(bots.extract_bot_response().alias("r")).collect()
    assert [(r.r.response_type, r.r.response_text, r.r.menu_options) for r in rows] == [("empty", "", [])] * 2


def test_report_requests_are_checked(spark):
    df = spark.createDataFrame([("a", 1)], "g string, x int")
    metrics = {"n": F.count("*")}
    with pytest.raises(ValueError, match="metric"):
        rp.analytics(df, {"metrics": ["drop"], "groupBy": ["g"]}, metrics, ["g"])
    with pytest.raises(ValueError, match="group"):
        rp.analytics(df, {"metrics": ["n"], "groupBy": ["x"]}, metrics, ["g"])
    with pytest.raises(ValueError, match="limit"):
        rp.analytics(df, {"metrics": ["n"], "groupBy": ["g"], "limit": 0}, metrics, ["g"])
    days = spark.createDataFrame([(None,), (-1,), (0,), (30,), (31,), (60,), (61,)], "d int")
    assert [r[0] for r in days.select(rp.ageing_bucket(F.col("d"))).collect()] == [
        "other", "other", "0-30", "0-30", "31-60", "31-60", ">60"]


def test_reconcile_reports_missing_runs(spark):
    recs = spark.createDataFrame([("a", 1, 1, "q", "c", "r", 1.0, None), ("a", 1, 3, None, "c", "r", 1.0, "e")],
                                 "account string, run_version int, query_index int, query string, category string, "
                                 "response string, response_time_seconds double, error string")
    man = spark.createDataFrame([("a", 1, 2, 1, 1, 1.0), ("a", 2, 9, 9, 0, 1.0)],
                                "account string, version int, total_queries int, success int, failed int, "
                                "avg_response_time_seconds double")
    got = {(r.version, r.problem) for r in compare.reconcile(recs, man).collect()}
    assert got == {(1, "query_index not 1..n"), (1, "query missing"), (2, "no records")}


def test_a_customers_facts_come_from_one_pass(spark):
    """Orders and invoice lines are read once for everything a visit brief says."""
    from dialoscope.operators import reports
    from dialoscope.plans.fixtures import table
    sf = "/root/testdata/sf0.001"
    facts = reports.customer_facts(table(spark, sf, "orders"), table(spark, sf, "lineitem"), "2000-06-30")
    assert facts._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    keys = [r[0] for r in facts.where("total_sales IS NOT NULL").orderBy("total_sales").limit(1).select("c_custkey").collect()]
    (one,) = reports.visit_brief(table(spark, sf, "customer"), facts, table(spark, sf, "nation"), custkey=keys[0]).collect()
    assert one.sales_rank == facts.where("total_sales IS NOT NULL").count()
