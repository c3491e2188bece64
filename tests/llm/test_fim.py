"""Fill-in-middle: cuts by the tree against plain slices, samples against a plain version, exact round trips."""

import hashlib

import numpy as np
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialoscope.llm import fim


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, max_size=60), st.integers(1, 9))
def test_cuts_of_code_points(text, block):
    blocks = fim.Blocks(np.frombuffer(text.encode(), np.uint8), block=block)
    assert blocks.units == blocks.points == len(text)
    for k in range(len(text) + 1):
        assert blocks.cut(k) == (len(text[:k].encode()), k)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é漢\n😀", min_size=1, max_size=60), st.integers(1, 9))
def test_cuts_of_words(text, block):
    unit = regex.compile(r"\s*\S+")
    ends = [m.end() for m in unit.finditer(text)]
    ends[-1:] = [len(text)]
    blocks = fim.Blocks(np.frombuffer(text.encode(), np.uint8), fim.units_of(text, unit), block)
    assert blocks.points == len(text)
    for k, end in enumerate([0, *ends] if unit.search(text) else [0]):
        assert blocks.cut(k) == (len(text[:end].encode()), end)


def plain(number, text):
    h = hashlib.sha256(f"1:{'' if number is None else number}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return text, n, "plain", None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}", n, "spm", a, b - a
    return f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", n, "psm", a, b - a


def test_samples(spark, docs, nothing):
    """All forms, nulls, repeated rows, clashing names (n_chars, score, keep pass through), an empty table, long texts."""
    long = spark.range(100, 160).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("aé漢😀 <P"), 3000).alias("text"))
    marked = spark.createDataFrame([(7, "x <M> y"), (8, "<P"), (9, "S>")], "doc_id long, text string")
    table = docs.unionByName(long, allowMissingColumns=True).unionByName(marked, allowMissingColumns=True)
    out = fim.transform(table.withColumn("form", F.lit("old")), block=64)
    assert out.columns == [*docs.columns, "fim", "n", "form", "prefix_chars", "middle_chars"]
    rows = out.withColumn("back", fim.restored()).collect()
    assert len(rows) == table.count()
    for r in rows:
        assert (r.fim, r.n, r.form, r.prefix_chars, r.middle_chars) == plain(r.doc_id, r.text or "")
        assert r.back == (r.text or "") == fim.restore(r.fim, r.form)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fim.transform(nothing).collect() == []


def test_word_units_keep_words_whole(spark, docs):
    for r in fim.transform(docs, unit=r"\s*\S+", block=32).where("form = 'psm'").collect():
        head, middle = r.fim.split("<M>")
        prefix, suffix = head.removeprefix("<P>").split("<S>")
        assert prefix + middle + suffix == r.text and r.prefix_chars == len(prefix) and r.middle_chars == len(middle)
        for a, b in ((prefix, middle + suffix), (prefix + middle, suffix)):
            assert not a or not b or a[-1].isspace() or b[0].isspace()
