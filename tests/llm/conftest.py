import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("doc", T.StringType()), T.StructField("keep", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("ids", T.StringType()), T.StructField("key", T.StringType())])


@pytest.fixture(scope="session")
def texts():
    """Numbered texts: copies, near copies, shared passages and lines, empty, null, white space, control characters, one long text."""
    import random
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijkléüñ") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line, base = some(45), "A Common Line of the Corpus", some(120)
    out = [base, base, base.upper(), base.replace(" ", "\n", 7)]
    for k in range(12):  # near copies of one text, some linked by others only
        w = base.split()
        for i in range(k // 2 + 1):
            w[(17 * k + 11 * i) % len(w)] = words[(k + i) % len(words)]
        out.append(" ".join(w))
    out += [f"{some(30)} {passage} {some(25)}" for _ in range(4)] + [passage, passage + " " + passage]
    out += [f"{some(8)}\n  {line}\t\n{some(9)}\r\n{line.upper()}" for _ in range(4)] + [line + "\n" + line]
    out += ["", None, " \n\t ", "one", "one two three", "one two three", "a " * 60, "z" * 700, "\x00\x1f\x85 <|endoftext|> 's ''ll   x",
            some(3000) + " " + base, "ab" * 350]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "src", len(t or ""), "x", None, "y", "z", "k") for i, t in texts]
    rows += [rows[0], rows[18], (None, texts[1][1], None, None, None, None, None, None, None, None), (None, None) + (None,) * 8]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
