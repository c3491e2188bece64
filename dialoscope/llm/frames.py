"""Tables, keys, scratch tables and Arrow buffers shared by the operators of this package.

Documents may hold nulls in any column, repeated rows and further columns.
Every operator works on ``record`` rows: a non-null document number (nulls count
as one document behind all others), the text (null: empty) and a fingerprint of
the text, so that rows sharing a doc_id but not the text stay apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document number; sorts behind every real one.
NO_ID = 2**63 - 1
#: Text of one slice that the vectorised code works on at a time.
SLICE = 1 << 20
#: Bytes of one Arrow batch between Spark and a Python worker.
BATCH = 8 << 20
#: Spark's setting: shuffle files go when their query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, most: int = BATCH) -> None:
    """Long texts: bound Arrow batches by bytes, not by rows alone. Results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text) with nulls replaced, and nothing else."""
    bounded_batches(docs.sparkSession)
    return docs.select(
        F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID)).alias("doc"),
        F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))


def shown_id(column: str) -> F.Column:
    """The document number as it was: null again where it stood for null."""
    return F.nullif(F.col(column), F.lit(NO_ID))


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared folder of the cluster.

    Only a local session without such a folder gets a default (its warehouse).
    """
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if not shared:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir") + "/llm-scratch"
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder; the shuffle files it was made with are removed."""
    folder, conf = scratch(df.sparkSession), df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column without nulls, not copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    return at.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``most`` bytes: first row, end row, own offsets, own bytes."""
    at, data = buffers(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        end = int(np.searchsorted(at, at[first] + most, side="right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end, at[first:end + 1] - at[first], data[at[first]:at[end]]
        first = end


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a list column from their values, row by row, and their sizes."""
    at = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))
