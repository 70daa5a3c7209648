"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rxlake.session import ensure_checkpoint_dir


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Fold 0..folds-1 of a row: crc32 of its id as text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/rxlake-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy", options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    It cuts the lineage like a checkpoint, but is columnar and compressed, and
    a later reader takes only the columns that it needs.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options or {}).parquet(path, compression=compression)
    for made in _recording.get():
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: the open blocks of ``recorded`` of this thread: callers elsewhere neither see nor fill them
_recording: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("recording", default=())


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that ``written`` makes inside the block, to be dropped once
    everything that reads them is itself written."""
    made: list[str] = []
    token = _recording.set((*_recording.get(), made))
    try:
        yield made
    finally:
        _recording.reset(token)


def drop_unread(df: DataFrame, paths: list[str]) -> None:
    """Delete the tables among ``paths`` that ``df`` does not read; those that it reads stay listed."""
    read = df.inputFiles()
    kept = [p for p in paths if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in read)]
    drop(df.sparkSession, [p for p in paths if p not in kept])
    paths[:] = kept


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that ``written`` made and empty the list."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()
