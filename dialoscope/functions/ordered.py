"""Running computations along a sequence without one task per sequence.

A plain ``Window.partitionBy(key).orderBy(pos)`` sends a whole sequence to one
task, which fails the cluster when one sequence holds a large share of all
rows.  Here the sequence is cut into blocks of consecutive positions: the
window runs inside (key, block), a small per-block summary is scanned over the
blocks, and the result is joined back on (key, block).  The summary reads only
the key, position and measured column, and holds one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 65536
_BLK = "__blk"


def block_of(pos: Column | str, block: int) -> Column:
    c = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(c / F.lit(block)).cast("bigint")


def _carry(df: DataFrame, keys: Sequence[str], pos: str, block: int, summaries: dict[str, Column],
           carried: dict[str, Column]) -> DataFrame:
    """Attach columns computed over the per-block ``summaries`` of the key.

    A ``carried`` column that is not a window already ranges over all earlier
    blocks.  The block id stays in the result as ``__blk``.
    """
    per_block = df.groupBy(*keys, block_of(pos, block).alias(_BLK)).agg(
        *[c.alias(name) for name, c in summaries.items()])
    prefix = per_block.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                              F.col(_BLK).alias("__b"), *[c.alias(name) for name, c in carried.items()])
    main = df.withColumn(_BLK, block_of(pos, block))
    on = main[_BLK].eqNullSafe(prefix["__b"])
    for i, k in enumerate(keys):
        on = on & main[k].eqNullSafe(prefix[f"__k{i}"])
    return main.join(prefix, on, "left").drop("__b", *[f"__k{i}" for i in range(len(keys))])


def _earlier(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)


def running_counts(df: DataFrame, keys: Sequence[str], pos: str, flags: dict[str, Column],
                   totals: dict[str, str] | None = None, block: int = DEFAULT_BLOCK) -> DataFrame:
    """For each ``out: flag``, the number of rows of the key up to and including this one where it holds.

    ``totals`` maps a further output column to the name of the count it totals over the whole key.
    """
    marked, summaries, carried = df, {}, {}
    for i, (out, flag) in enumerate(flags.items()):
        marked = marked.withColumn(f"__f{i}", F.when(flag, 1).otherwise(0).cast("bigint"))
        summaries[f"__s{i}"] = F.sum(f"__f{i}")
        carried[f"__c{i}"] = F.sum(f"__s{i}").over(_earlier(keys))
        for name, of in (totals or {}).items():
            if of == out:
                carried[name] = F.sum(f"__s{i}").over(Window.partitionBy(*keys))
    joined = _carry(marked, keys, pos, block, summaries, carried)
    local = Window.partitionBy(*keys, _BLK).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    for i, out in enumerate(flags):
        joined = joined.withColumn(out, F.coalesce(F.col(f"__c{i}"), F.lit(0)) + F.sum(f"__f{i}").over(local))
    return joined.drop(_BLK, *[f"__{x}{i}" for i in range(len(flags)) for x in "fc"])


def serial_number(df: DataFrame, keys: Sequence[str], pos: str, out: str,
                  block: int = DEFAULT_BLOCK) -> DataFrame:
    """1-based row number of the key in order of ``pos``."""
    return running_counts(df, keys, pos, {out: F.lit(True)}, block=block)


def fill_forward(df: DataFrame, keys: Sequence[str], pos: str, value: Column, out: str,
                 block: int = DEFAULT_BLOCK, include_current: bool = True) -> DataFrame:
    """Last non-NULL ``value`` at or before this row (strictly before without ``include_current``)."""
    marked = df.withColumn("__v", value)
    newest = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(pos)))
    joined = _carry(marked, keys, pos, block, {"__s": newest},
                    {"__carry": F.last("__s", ignorenulls=True).over(_earlier(keys))})
    local = (Window.partitionBy(*keys, _BLK).orderBy(pos)
             .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1))
    return (joined.withColumn(out, F.coalesce(F.last("__v", ignorenulls=True).over(local), F.col("__carry")))
            .drop("__v", "__carry", _BLK))


def running(df: DataFrame, keys: Sequence[str], pos: str, fills: dict[str, Column], counts: dict[str, Column],
            block: int = DEFAULT_BLOCK) -> DataFrame:
    """``fill_forward`` of several values and ``running_counts`` of several flags in one step: one summary, one join."""
    marked, summaries, carried, outs = df, {}, {}, {}
    local = Window.partitionBy(*keys, _BLK).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    for i, (out, value) in enumerate(fills.items()):
        marked = marked.withColumn(f"__v{i}", value)
        summaries[f"__n{i}"] = F.max_by(f"__v{i}", F.when(F.col(f"__v{i}").isNotNull(), F.col(pos)))
        carried[f"__l{i}"] = F.last(f"__n{i}", ignorenulls=True).over(_earlier(keys))
        outs[out] = F.coalesce(F.last(f"__v{i}", ignorenulls=True).over(local), F.col(f"__l{i}"))
    for i, (out, flag) in enumerate(counts.items()):
        marked = marked.withColumn(f"__f{i}", F.when(flag, 1).otherwise(0).cast("bigint"))
        summaries[f"__s{i}"] = F.sum(f"__f{i}")
        carried[f"__c{i}"] = F.sum(f"__s{i}").over(_earlier(keys))
        outs[out] = F.coalesce(F.col(f"__c{i}"), F.lit(0)) + F.sum(f"__f{i}").over(local)
    joined = _carry(marked, keys, pos, block, summaries, carried).withColumns(outs)
    return joined.drop(_BLK, *[f"__{x}{i}" for i in range(len(fills)) for x in "vl"], *[f"__{x}{i}" for i in range(len(counts)) for x in "fc"])


def trailing_rows(df: DataFrame, keys: Sequence[str], index: str, width: int, value: Column, out: str,
                  block: int = 4096) -> DataFrame:
    """Array of ``value`` over the ``width`` rows before this one and this one.

    ``index`` must count 1, 2, 3, ... within the key.  Only the last ``width``
    rows of each block are copied into the next one.
    """
    if width > block:
        raise ValueError("width must not exceed the block size")
    own = block_of(index, block)
    near_end = F.pmod(F.col(index), F.lit(block)) >= block - width
    spread = (df.withColumn("__v", value).withColumn("__own", own)
              .withColumn(_BLK, F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own)))))
    frame = Window.partitionBy(*keys, _BLK).orderBy(index).rowsBetween(-width, 0)
    return (spread.withColumn(out, F.collect_list("__v").over(frame))
            .where(F.col(_BLK) == F.col("__own")).drop("__v", "__own", _BLK))


def global_rank(df: DataFrame, measure: str, out: str, buckets: int | None = None) -> DataFrame:
    """Competition rank (1 = largest ``measure``) over the whole frame.

    Equal values are folded first, so ties never pile up.  The distinct values
    are cut at their approximate quantiles into ``buckets`` ranges; the window
    runs inside a range and only ``buckets`` range totals are scanned in one
    place.  The cut points steer balance alone: any cut gives the exact rank.
    By default there are as many ranges as shuffle partitions.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.groupBy(F.col(measure).alias("__m")).agg(F.count("*").alias("__n"))
    points = values.agg(F.percentile_approx(
        "__m", [i / buckets for i in range(1, buckets)], F.lit(100 * buckets)).alias("p"))
    ranged = (values.withColumn("__pts", points.scalar())
              .withColumn(_BLK, F.size(F.filter("__pts", lambda p: p > F.col("__m")))).drop("__pts"))
    totals = ranged.groupBy(F.col(_BLK).alias("__b")).agg(F.sum("__n").alias("__t"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select("__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__p"))
    inside = (Window.partitionBy(_BLK).orderBy(F.col("__m").desc())
              .rowsBetween(Window.unboundedPreceding, -1))
    ranks = (ranged.join(F.broadcast(prefix), F.col(_BLK) == F.col("__b"))
             .select("__m", (F.col("__p") + F.coalesce(F.sum("__n").over(inside), F.lit(0)) + 1).alias(out)))
    return df.join(ranks, df[measure].eqNullSafe(ranks["__m"]), "left").drop("__m")
