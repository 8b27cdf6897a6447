"""What the operators share: reading tables, cutting lineage, grouping texts for Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps
from inspect import isgenerator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the ASCII white space; the same class in Java, Python and DuckDB patterns.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where all run in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        where = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Files that a checkpoint may always have.
LEAST_FILES = 48


def settled(df: DataFrame, fewer: int = 1, least: int = LEAST_FILES) -> DataFrame:
    """The same rows, read from a checkpoint in the shared folder: lineage ends there and lost executors cost nothing.

    A result much smaller than what was shuffled for it is written as so many times fewer files.
    """
    spark = df.sparkSession
    shared_dir(spark)
    if fewer > 1:
        df = df.coalesce(max(least, int(spark.conf.get("spark.sql.shuffle.partitions")) // fewer))
    return df.checkpoint(eager=True)


#: Rows that a task reads for a table whose size is known about, and files that it has at least.
TASK_ROWS, TABLE_FILES = 10_000, 4


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The same rows, read from a table in the shared folder; for private columns.

    Where the number of ``rows`` is known about, tasks get about ``TASK_ROWS`` of them, and a small table few files.

    A checkpoint would keep the size that its plan was estimated to have, which is a product over joins: after some
    rounds of joins among such results the estimates alone, numbers of millions of digits, stop the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(TABLE_FILES, -(-rows // TASK_ROWS)))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "written_to", None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of a batch that goes to a Python worker; Spark's own default would hold many long texts at once, on either side.
BATCH_BYTES = 4 << 20


def lean(spark: SparkSession) -> None:
    """Asks for small Arrow batches in this session, unless it has asked for smaller ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if (now := spark.conf.get(key, None)) is None or not 0 < _bytes(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _bytes(text: str) -> int:
    text = text.strip().lower().rstrip("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(text[-1:], 1)
    return int(text[:-1] if scale > 1 else text or 0) * scale


@lru_cache(1)
def _allocator():
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's; others give back by themselves
    return trim or (lambda pad: 0)


def give_back() -> None:
    """Returns what this Python worker has freed to the system; it waits for its next task beside the JVM otherwise."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    _allocator()(0)


def tidy(work: Callable) -> Callable:
    """A function of a Python worker, from batches to batches or from column to column, that gives memory back at its end."""

    @wraps(work)
    def run(*args):
        out = work(*args)
        if isgenerator(out):
            return _closing(out)
        give_back()
        return out

    return run


def _closing(batches: Iterator) -> Iterator:
    try:
        yield from batches
    finally:
        give_back()


def slices(texts: list[str], chars: int = 1_000_000, rows: int = 20_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``chars`` characters, so that a worker's arrays stay small."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if i > a and (size + len(t) > chars or i - a >= rows):
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that an operator's own columns can't clash with them."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def words(text: Column) -> Column:
    """Array of the words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; every operator takes the path as a parameter."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)
