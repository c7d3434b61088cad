"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import inspect
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeweave.storage import shared_dir

#: A word: a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: The six characters between words.
WHITE = " \t\n\x0b\x0c\r"
#: Stands after every real doc_id, for rows without one.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths of tables that ``scratch`` blocks are to delete, innermost last.
_SCRATCH: list[list[str]] = []


def materialise(df: DataFrame, label: str = "t", keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage so that a lost executor costs no recomputation, and gives
    Catalyst the true size, which is what its broadcast decision rests on.
    Within a ``scratch`` block the table goes at its end, unless ``keep``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables materialised within, once nothing that is returned reads them: what leaves the block is materialised with ``keep``."""
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH.remove(made)
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also within lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


#: Bytes of an Arrow batch that Spark sends to a Python function; bounds what a worker and the JVM beside it hold.
BATCH_BYTES = 4 << 20
_TRIM_THRESHOLD, _MMAP_THRESHOLD, _ARENA_MAX = -1, -3, -8
_LEAN: list[bool] = []


def lean() -> None:
    """Lets this worker process give freed memory back to the system beyond 64 MB, so that idle workers hold little."""
    if not _LEAN:
        _LEAN.append(True)
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            libc = ctypes.CDLL(None)
            libc.mallopt(_ARENA_MAX, 1)
            libc.mallopt(_MMAP_THRESHOLD, 32 << 20)
            libc.mallopt(_TRIM_THRESHOLD, 64 << 20)
        except (OSError, AttributeError):  # another C library: only the footprint differs
            pass


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` from now on in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with small batches in a lean worker."""
    small_batches(df.sparkSession)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        yield from run(batches)

    return df.mapInArrow(inner, schema)


def leanly(f: Callable) -> Callable:
    """``f`` (of one or two tables) for ``applyInArrow``, in a lean worker."""

    def one(table: pa.Table) -> pa.Table:
        lean()
        return f(table)

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        return f(left, right)

    return two if len(inspect.signature(f).parameters) == 2 else one
