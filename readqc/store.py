"""Tables written in the folder that driver and executors share, so that a lost executor costs no recomputation."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the checkpoint folder of the context, else a folder beside the warehouse's tables; never a local temporary folder.

    On a cluster a warehouse in a local folder is an error: each executor would write to its own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = java.get() if java.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_readqc"
        master = spark.sparkContext.master
        if not java.isDefined() and path.startswith("file:") and not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that {master} shares")
    return path.rstrip("/")


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored tables; what still reads them fails."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _written:
        with contextlib.suppress(Exception):  # the session may be gone by then
            delete(spark, _written)


def claimed(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when Python ends, or by scope()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_at_exit)
    _written.append(path)
    return path


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again, in a folder for each value of ``by``. The table is deleted when Python ends, or by scope()."""
    spark = df.sparkSession
    path = claimed(spark, name)
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, in any store that Spark writes."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        data = text.encode()
        for at in range(0, len(data), 1 << 20):
            part = data[at : at + (1 << 20)]
            stream.write(part, 0, len(part))
    finally:
        stream.close()


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Deletes at its end the tables that were stored inside, but for those whose DataFrames are given to the yielded function."""
    first, kept = len(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(f for f in _written[first:] if any(f.rsplit("/", 1)[-1] in x for x in df.inputFiles()))
        return df

    yield keep
    gone = [p for p in _written[first:] if p not in kept]
    _written[first:] = [p for p in _written[first:] if p in kept]
    delete(spark, gone)
