"""Sinks: appended records, immutable versions, manifest upsert, dashboard payload.

A version is published by writing a folder that must not exist yet, so a lost
executor or a repeated job never mixes two attempts.  Generations (manifest,
example set) are published optimistically: rows go to a folder of their own, then
one small claim file, created only if there is none of that number, makes them the
next generation.  Who finds the number taken reads again, merges again and retries.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_PARTITIONS = ("account", "run_version")


def append_records(df: DataFrame, path: str, partitions: Sequence[str] = RECORD_PARTITIONS) -> None:
    """Add finished runs as Parquet, each run as a whole: a job that is repeated replaces what it wrote.

    Rows are rebalanced by size at run time, so a run that holds most of the rows
    is written by as many tasks as it needs, and small runs by one.
    """
    (df.hint("rebalance", *[F.col(c) for c in partitions]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partitions).parquet(path))


def write_version(df: DataFrame, path: str, version: int | str, fmt: str = "json") -> str:
    """Write one version; fails when it exists already.  Returns the folder."""
    target = f"{path.rstrip('/')}/results_v{version}"
    df.write.mode("errorifexists").format(fmt).save(target)
    return target


def existing_version_folders(spark: SparkSession, path: str) -> DataFrame:
    """Folder and file names below ``path`` (column ``file``), as seen by the file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [(s.getPath().getName(),) for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
    return spark.createDataFrame(names, "file string")


def upsert_manifest(existing: DataFrame, rows: DataFrame, keys: Sequence[str] = ("account", "version"),
                    newest: str = "timestamp") -> DataFrame:
    """Manifest with the new rows in it; per key the newest entry stays (resumed runs report twice)."""
    both = existing.unionByName(rows, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    return (both.groupBy(*keys).agg(F.max_by(F.struct(*rest), newest).alias("r")).select(*keys, "r.*"))


#: Times that a writer retries when others publish first.
ATTEMPTS = 50


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def _claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file unless there is one of that name; the store decides who was first."""
    hadoop, fs = _file_system(spark, path)
    if fs.getUri().getScheme() == "file":  # Hadoop's local files have no exclusive creation
        local = hadoop.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        # whole before it has its name: a reader never sees half a claim
        draft = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
        with open(draft, "x", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(draft, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    try:
        out = fs.create(hadoop, False)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        return False
    out.write(bytearray(text.encode()))
    out.close()
    return True


def publish(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame]) -> tuple[int, str]:
    """Publish ``change(rows of the latest generation)`` as the next generation below ``path``: its number and folder.

    Writers may run at once: each change is applied to what the generation before
    holds.  The rows of an attempt that came second are removed.
    """
    base = path.rstrip("/")
    for _ in range(ATTEMPTS):
        generation, current = latest_generation(spark, base)
        folder = f"{base}/rows-{uuid.uuid4().hex}"
        change(current).write.mode("errorifexists").parquet(folder)
        if _claim(spark, f"{base}/generations/{generation + 1:012d}", os.path.basename(folder)):
            return generation + 1, folder
        hadoop, fs = _file_system(spark, folder)
        fs.delete(hadoop, True)
    raise RuntimeError(f"{base}: others published first, {ATTEMPTS} times")


def latest_generation(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """Highest generation number and its rows; 0 and None before the first."""
    base = path.rstrip("/")
    hadoop, fs = _file_system(spark, f"{base}/generations")
    names = [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
    numbers = [n for n in names if n.isdigit()]
    if not numbers:
        return 0, None
    folder = spark.read.text(f"{base}/generations/{max(numbers)}").first()[0]
    return int(max(numbers)), spark.read.parquet(f"{base}/{folder}")


def append_manifest(spark: SparkSession, rows: DataFrame, path: str,
                    keys: Sequence[str] = ("account", "version")) -> str:
    """Publish the manifest with the new rows in it; returns the folder of its rows."""
    return publish(spark, path, lambda current: rows if current is None else upsert_manifest(current, rows, keys))[1]


latest_manifest = latest_generation


def replace_examples(examples: DataFrame, path: str) -> None:
    """Publish the example set in place of the earlier one, which readers see until the new one is whole."""
    publish(examples.sparkSession, path, lambda _: examples)


def read_examples(spark: SparkSession, path: str) -> DataFrame | None:
    """The example set published last."""
    return latest_generation(spark, path)[1]


# Fields of a dashboard record with the default that stands for a missing value (fixed values).
PAYLOAD_DEFAULTS: dict[str, object] = {
    "query_index": None, "query": "", "copilot_response": "", "remarks": "", "category": "", "expected_tool": None,
    "thread_id": None, "tool_calls": "list", "response": "", "info_leak": False, "leak_indicators": "list",
    "response_quality": "", "response_time_seconds": None, "step_count": 0, "error": None, "status_sequence": "list",
    "suggestions": "list", "timestamp": "",
}


def payload_record(df: DataFrame) -> Column:
    """The 18 dashboard fields of an enriched record as JSON text; NULL stays as null."""
    fields = []
    for name, default in PAYLOAD_DEFAULTS.items():
        c = F.col(name)
        if default == "list":
            c = F.coalesce(c, F.array().cast(df.schema[name].dataType))
        elif default is not None:
            c = F.coalesce(c, F.lit(default))
        if name == "response_time_seconds":
            c = c.cast("double")
        fields.append(c.alias(name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def export_payload(enriched: DataFrame, summaries: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Record rows (ordered by query) and summary rows (name, json) of the dashboard.

    Both stay distributed: a record or a summary line is one row of text.
    """
    records = enriched.select("account", "run_version", "query_index", payload_record(enriched).alias("json"))
    parts = [df.select(F.lit(name).alias("name"),
                       F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
             for name, df in summaries.items()]
    summary = parts[0]
    for p in parts[1:]:
        summary = summary.unionByName(p)
    return records, summary


