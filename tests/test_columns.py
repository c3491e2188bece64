"""Classification, text and JSON rules, one literal row per branch."""

import pytest
from pyspark.sql import functions as F

from dialoscope.functions import quality as q
from dialoscope.functions import text as t
from dialoscope.functions import variant as v

LONG = "word " * 30

QUALITY_CASES = [
    ("fine answer", "boom", "fail"), ("   \n", None, "fail"), (None, None, "fail"), ("ok", "", "marginal"),
    ("No products were found.", None, "no_data"), ("Please try again shortly", None, "no_data"),
    ("no matching records", None, "no_data"), ("₹0.00 for May", None, "no_data"),
    ("Total ₹5", None, "success"), ("up 3%", None, "success"), ("showing 7 rows", None, "success"),
    ("| a | b |\n| 1 | 2 |", None, "success"), ("| a | b |", None, "marginal"), ("| a |\n b |", None, "marginal"),
    ("I cannot do it. " + LONG, None, "marginal"), ("if you want, " + LONG, None, "marginal"),
    (LONG, None, "success"), ("short", None, "marginal"), ("I couldn’t find any sales rows", None, "marginal"),
]


@pytest.mark.parametrize("response,error,expected", QUALITY_CASES)
def test_quality_branches(spark, response, error, expected):
    df = spark.createDataFrame([(response, error)], "response string, error string")
    assert df.select(q.classify_quality("response", "error")).first()[0] == expected


def test_quality_options(spark):
    df = spark.createDataFrame([("I couldn’t find any sales rows", "x" * 70)], "a string, b string")
    row = df.select(q.classify_quality("a", F.lit(None), normalize_quotes=True), q.classify_quality("b", F.lit(None), "v1"),
                    q.classify_quality("b", F.lit(None))).first()
    assert tuple(row) == ("no_data", "success", "marginal")
    with pytest.raises(ValueError):
        q.classify_quality("a", "b", rubric="v9")


def test_each_no_data_pattern_is_reachable(spark):
    texts = {0: "no sales recorded", 1: "no matching threads", 2: "data isn't right now", 3: "couldn't rank them",
             4: "there isn't any", 5: "zero products for x", 6: "**0** records", 7: "category name wasnt populated",
             8: "i cant verify purchase frequency", 9: "no low-stock items were found",
             10: "no slow-moving items were found", 11: "there arent any sales", 14: "no product sales were found",
             15: "that breakdown isnt available", 17: "please try again in a moment"}
    df = spark.createDataFrame(list(texts.items()), "i int, x string")
    assert all(r.i == r.m for r in df.select("i", q.no_data_match("x").alias("m")).collect())


def test_leak_labels_keep_order(spark):
    df = spark.createDataFrame([("I'll treat this as a debtor group in the workspace; my tools; log out; the card has",),
                                ("workspaces scorecard",)], "x string")
    rows = df.select(q.detect_leaks("x").alias("l")).collect()
    assert rows[0].l.leak_indicators == list(q.LEAK_PATTERNS)
    assert not rows[1].l.info_leak


def test_bot_quality(spark):
    df = spark.createDataFrame([("Sorry!", None), (" ", None), ("fine", "e"), ("Unable to go", None), ("hi", None)],
                               "x string, e string")
    assert [r[0] for r in df.select(q.classify_bot_quality("x", "e")).collect()] == [
        "marginal", "fail", "fail", "marginal", "success"]


def test_step_backfill(spark):
    df = spark.createDataFrame([(0, ["a", "b"]), (None, ["a"]), (5, ["a"]), (0, []), (None, None)],
                               "n int, s array<string>")
    assert [r[0] for r in df.select(q.backfill_steps("n", "s")).collect()] == [2, 1, 5, 0, None]


def test_text_helpers(spark):
    df = spark.createDataFrame([("  x  ", "```json\n{\"a\":1}\n```", "a → b"), ("\t", "```\nz```", "→")],
                               "a string, b string, c string")
    rows = df.select(t.utrim("a"), t.strip_fences("b"), t.split_expected("c"), t.is_blank("a")).collect()
    assert tuple(rows[0]) == ("x", '{"a":1}', ["a", "b"], False)
    assert tuple(rows[1]) == ("", "z", ["", ""], True)


def test_ratio_round_is_half_up_and_exact(spark):
    df = spark.createDataFrame([(225, 100, 2.3), (2249999999, 1000000000, 2.2), (1, 0, None), (0, 7, 0.0)],
                               "n bigint, d bigint, e double")
    assert all(r[0] == r.e for r in df.select(t.ratio_round(F.col("n"), F.col("d"), 1), "e").collect())


def test_variant_rules(spark):
    df = spark.createDataFrame([('{"content":[{"text":"a"},{"no":1},{"text":""},{"text":"b"}]}',), ('{"content":"x"}',),
                                ('{"content":null}',), ('{"content":0}',), ("{}",)], "s string")
    rows = df.select(F.expr(v.message_text("try_parse_json(s)"))).collect()
    assert [r[0] for r in rows] == ["a b", "x", "", "", ""]
    objs = spark.createDataFrame([('{"a":1}',), ("[1]",), ("nope",), (None,)], "s string")
    assert [r[0] for r in objs.select(F.expr(f"to_json({v.try_object('s')})")).collect()] == ['{"a":1}', "{}", "{}", "{}"]
    texts = spark.createDataFrame([('"abc"',), ('{"a": [1, 2]}',), ("null",), ("true",), (None,)], "s string")
    assert [r[0] for r in texts.select(F.expr(v.stringify("try_parse_json(s)"))).collect()] == [
        "abc", '{"a":[1,2]}', "{}", "True", "{}"]
