"""Readers and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from dialoscope.sources import files, sinks


def record(i, **more):
    return json.dumps({"query_index": i, "query": "q", "response": "r", "response_time_seconds": 1.5,
                       "tool_calls": [{"tool": "t", "input": {"deep": [1]}}], "timestamp": "2024-05-01T10:00:00", **more})


def test_records_and_manifest(spark, tmp_path):
    runs = tmp_path / "accounts" / "shop" / "runs"
    runs.mkdir(parents=True)
    (runs / "query_results_v2.jsonl").write_text(record(1) + "\n\n" + record(2, step_count=4, expected_tool="t") + "\n")
    (runs / "query_results_v10.jsonl").write_text(record(1, error="e") + "\n")
    (runs / "manifest.json").write_text(json.dumps({"runs": [{"version": 2, "file": "f", "total_queries": 2, "success": 2}]}, indent=1))
    rows = files.read_records(spark, str(tmp_path)).orderBy("run_version", "query_index").collect()
    assert [(r.account, r.run_version, r.query_index, r.step_count, r.error) for r in rows] == [
        ("shop", 2, 1, None, None), ("shop", 2, 2, 4, None), ("shop", 10, 1, None, "e")]
    assert rows[0].timestamp.year == 2024
    assert files.read_records(spark, str(tmp_path)).select(F.to_json(F.col("tool_calls")[0]["input"])).first()[0] == '{"deep":[1]}'
    m = files.read_manifest(spark, str(tmp_path)).first()
    assert (m.account, m.version, m.success, m.failed) == ("shop", 2, 2, None)


def test_missing_and_corrupt_manifests(spark, tmp_path):
    assert files.read_turn_manifest(spark, str(tmp_path / "none.json")).count() == 0
    bad = tmp_path / "bad.json"
    bad.write_text('{"runs": [')
    assert files.read_turn_manifest(spark, str(bad)).count() == 0
    good = tmp_path / "good.json"
    good.write_text(json.dumps({"runs": [{"version": 1, "turns": 11, "avg_score": 0.5, "quality": {"fail": 2}}]}))
    assert files.read_turn_manifest(spark, str(good)).first().quality == {"fail": 2}


def test_bot_results_absorb_drift(spark, tmp_path):
    (tmp_path / "results_run_v1.jsonl").write_text(json.dumps({"query_id": "1", "response_type": None, "passed": True}))
    r = files.read_bot_results(spark, str(tmp_path)).first()
    assert (r.run_id, r.passed, r.status_code, r.chat_id) == ("run_v1", True, None, None)


def test_scenarios(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"workspace_id": "w", "test_cases": [{"query": "x"}, {
        "id": "2", "query": "y", "category": "c", "expected": {"contains": ["z"]}}]}))
    (tmp_path / "a.json").write_text(json.dumps({"bot_name": "bot", "test_cases": [{"id": "9", "query": "k"}]}))
    rows = files.read_scenarios(spark, str(tmp_path)).orderBy("file", "pos").collect()
    assert [(r.bot_name, r.query_id, r.category) for r in rows] == [("bot", "9", ""), ("unknown", "?", ""), ("unknown", "2", "c")]
    assert rows[2].expected.contains == ["z"] and rows[1].expected is None
    assert files.read_scenarios(spark, str(tmp_path / "a.json")).count() == 1


def test_registry(spark, tmp_path):
    path = tmp_path / "r.md"
    path.write_text("# Tools\n| x | y |\n\n| Tool | Family | Enabled | Description |\n| --- | --- | --- | --- |\n"
                    "| `get\\_a` | fam\\_b | ✅ | First |\n\n| `b` | f | Check | Second |\n| c | f | no | |\n| short |\n"
                    "text\n| `late` | f | ✅ | Not in the table |\n")
    rows = files.read_registry(spark, str(path)).orderBy("ord").collect()
    assert [tuple(r)[1:] for r in rows] == [("get_a", "fam_b", True, "First"), ("b", "f", True, "Second")]
    assert files.read_registry(spark, str(tmp_path / "none.md")).count() == 0


def test_wire_log(spark, tmp_path):
    entries = [{"time": t, "request": {"method": "GET", "url": f"https://h.example/a/b?x={t}"}, "response": {"status": 200}}
               for t in (1.0, 3.0)]
    (tmp_path / "w.har").write_text(json.dumps({"log": {"version": "1", "entries": entries}}, indent=1))
    assert files.wire_endpoints(spark, str(tmp_path / "w.har")).first()[:] == ("GET", "/a/b", 200, 2, 1.0, 2.0, 3.0)


def test_versions_are_immutable(spark, tmp_path):
    df = spark.range(3)
    sinks.write_version(df, str(tmp_path), 1)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_version(df, str(tmp_path), 1)


def test_manifest_generations(spark, tmp_path):
    path = str(tmp_path / "m")
    row = lambda v, n, ts: spark.createDataFrame([("a", v, n, ts)], "account string, version int, n int, timestamp string")
    sinks.append_manifest(spark, row(1, 5, "2024-01-01"), path)
    sinks.append_manifest(spark, row(2, 6, "2024-01-02"), path)
    sinks.append_manifest(spark, row(1, 7, "2024-01-03"), path)
    generation, rows = sinks.latest_manifest(spark, path)
    assert generation == 3
    assert sorted((r.version, r.n) for r in rows.collect()) == [(1, 7), (2, 6)]


def test_registry_over_many_blocks(spark, tmp_path):
    """A large file is read in blocks by many tasks; line numbers and the table's end are those of the whole file."""
    body = "".join(f"| `t\\_{i}` | f{i % 3} | ✅ | number {i} |\n" + ("\n" if i % 7 == 0 else "") for i in range(2000))
    path = tmp_path / "r.md"
    path.write_text("intro\n\n| Tool | Family | Enabled | Text |\n| --- | --- | --- | --- |\n" + body + "end\n" + body, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
        rows = files.read_registry(spark, str(path)).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.name for r in rows] == [f"t_{i}" for i in range(2000)]
    assert [r.ord for r in rows[:3]] == [2, 4, 5]


def test_publishers_at_once_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    path = str(tmp_path / "m")
    row = lambda v: spark.createDataFrame([("a", v, v, "2024-01-01")], "account string, version int, n int, timestamp string")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda v: sinks.append_manifest(spark, row(v), path), range(12)))
    generation, rows = sinks.latest_manifest(spark, path)
    assert generation == 12 and sorted(r.version for r in rows.collect()) == list(range(12))
    # what lost a race is gone: one folder of rows a generation
    assert len([p for p in (tmp_path / "m").iterdir() if p.name.startswith("rows-")]) == 12


def test_examples_are_replaced_by_a_new_generation(spark, tmp_path):
    path = str(tmp_path / "e")
    assert sinks.read_examples(spark, path) is None
    sinks.replace_examples(spark.range(3), path)
    first = sinks.read_examples(spark, path)
    sinks.replace_examples(spark.range(5), path)
    assert first.count() == 3 and sinks.read_examples(spark, path).count() == 5
