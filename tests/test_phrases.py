"""Phrase tables against plain substring tests."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from dialoscope.operators import phrases as ph

TABLE = [("a", "log out"), ("a", "Session"), ("b", "session"), ("b", "session"), ("c", "out"), ("c", "ou"), ("d", ""), (None, "log"), ("e", None),
         ("f", "été"), ("g", "+1"), ("h", "zzz")]
TEXTS = ["Please LOG OUT now", "about sessions", "session", "", None, "L'ÉTÉ dernier, 2+1", "x" * 200_000 + " zzz", "out-ou"]


def tables(spark):
    rows = spark.createDataFrame([(i, t, "kept out", "x") for i, t in enumerate(TEXTS)], "id int, response string, labels string, phrase string")
    return rows, spark.createDataFrame(TABLE, "label string, phrase string")


def plain(text, whole):
    low = (text or "").lower()
    hits = set()
    for label, phrase in TABLE:
        if label is None or not phrase:
            continue
        p = re.escape(phrase.lower())
        if whole:
            p = (r"\b" if phrase[0].isalnum() else "") + p + (r"\b" if phrase[-1].isalnum() else "")
        if re.search(p, low):
            hits.add(label)
    return sorted(hits)


def test_labels_match_plain_search(spark):
    rows, table = tables(spark)
    for whole in (False, True):
        for chars in (ph.SLICE_CHARS, 8):
            found = ph.label_phrases(rows, table, ["id"], whole_words=whole, slice_chars=chars)
            assert found.columns == ["id", "labels"]
            assert {r.id: r.labels for r in found.collect()} == {i: plain(t, whole) for i, t in enumerate(TEXTS)}


def test_empty_tables(spark):
    rows, table = tables(spark)
    assert ph.label_phrases(rows.limit(0), table, ["id"]).collect() == []
    assert all(r.labels == [] for r in ph.label_phrases(rows, table.limit(0), ["id"]).collect())


def test_rows_are_not_shuffled(spark):
    rows, table = tables(spark)
    plan = ph.label_phrases(rows, table, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


@settings(max_examples=300, deadline=None)
@given(st.text("ab _.", max_size=12), st.text("ab _.", min_size=1, max_size=4))
def test_stands_alone(text, phrase):
    for m in re.finditer(f"(?={re.escape(phrase)})", text):
        start, end = m.start(), m.start() + len(phrase)
        left = not re.match(r"\w", phrase) or re.compile(r"\b").match(text, start) is not None
        right = not re.match(r"\w", phrase[-1]) or re.compile(r"\b").match(text, end) is not None
        assert ph.stands_alone(text, start, end) == (left and right)
