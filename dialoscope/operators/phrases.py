"""Large phrase sets as a table: every text is read once, whatever the number of phrases."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of phrases and labels that one automaton may hold; larger tables are cut into slices of about that size.
SLICE_CHARS = 1 << 22

_WORD = re.compile(r"\w")

# The automaton of the slice this Python worker met last, by the name of its slice.
_built: dict[str, ahocorasick.Automaton] = {}


def automaton(name: str, shared: Broadcast) -> ahocorasick.Automaton:
    """One search automaton for a slice of (phrase, labels), built once in a worker."""
    if name not in _built:
        _built.clear()
        found = ahocorasick.Automaton()
        for phrase, labels in shared.value:
            found.add_word(phrase, (len(phrase), labels))
        found.make_automaton()
        _built[name] = found
    return _built[name]


def stands_alone(text: str, start: int, end: int) -> bool:
    """No word character touches the match from outside where the match itself begins or ends with one."""
    before = start > 0 and _WORD.match(text[start]) and _WORD.match(text[start - 1])
    after = end < len(text) and _WORD.match(text[end - 1]) and _WORD.match(text[end])
    return not before and not after


def _labels_of(shared: Broadcast, whole_words: bool):
    name = uuid.uuid4().hex

    @F.pandas_udf("array<string>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = automaton(name, shared)
        for texts in batches:
            rows = []
            for text in texts:
                hits: set[str] = set()
                if text:
                    for last, (size, labels) in machine.iter(text):
                        if not whole_words or stands_alone(text, last + 1 - size, last + 1):
                            hits.update(labels)
                rows.append(sorted(hits))
            yield pd.Series(rows, dtype=object)
    return search


def _slices(phrases: DataFrame, slice_chars: int) -> Iterator[list[tuple[str, list[str]]]]:
    """The distinct phrases, lower-cased, in slices that are bounded in characters."""
    known = (phrases.select(F.col("label").cast("string").alias("label"), F.lower("phrase").alias("phrase"))
             .where("label IS NOT NULL AND length(phrase) > 0").distinct())
    size = known.agg(F.sum(F.length("phrase") + F.length("label"))).first()[0] or 0
    parts = -(-size // slice_chars)
    for part in range(parts):
        own = known.where(F.pmod(F.xxhash64("label", "phrase"), F.lit(parts)) == part)
        yield [(r.phrase, r.labels) for r in own.groupBy("phrase").agg(F.sort_array(F.collect_set("label")).alias("labels")).collect()]


def label_phrases(rows: DataFrame, phrases: DataFrame, key: Sequence[str], text: str | Column = "response",
                  whole_words: bool = False, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(key columns, ``labels``): the sorted labels of all phrases that occur in the text, case ignored.

    ``phrases`` has the columns ``label`` and ``phrase``; a label may have many phrases and a phrase many labels.
    ``key`` names the columns that identify a row.  ``whole_words`` refuses matches inside a longer word.

    A phrase table of up to ``slice_chars`` becomes one automaton that travels to the executors, and the rows are not
    shuffled.  A larger one is measured first and cut into slices by hash; each is a pass over the rows, so a worker
    holds one slice at a time, and the labels of a row meet by its key.

    NULL or empty texts, and an empty phrase table, give an empty array; phrases that are NULL or empty, and NULL
    labels, say nothing; repeated (label, phrase) rows count once.  Other columns are not looked at.  Texts are searched whole.
    """
    texts = rows.select(*key, F.lower(text).alias("__text"))
    context = rows.sparkSession.sparkContext
    passes = [texts.select(*key, _labels_of(context.broadcast(own), whole_words)("__text").alias("labels"))
              for own in _slices(phrases, slice_chars) if own]
    if not passes:
        return texts.select(*key, F.array().cast("array<string>").alias("labels"))
    if len(passes) == 1:
        return passes[0]
    merged = reduce(DataFrame.unionAll, passes).groupBy(*key).agg(F.flatten(F.collect_list("labels")).alias("labels"))
    return merged.withColumn("labels", F.sort_array(F.array_distinct("labels")))
