"""Small helpers that every corpus operator shares."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the similarity operators: A-Z lower-cased, every other ASCII character that is no digit or
#: small letter separates; bytes from 0x80 on belong to words.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(data: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return data.translate(WORD_TABLE).split()


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or with a local master a local one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _home(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/tessera/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{_home(spark)}/{what}-{uuid.uuid4().hex}"


def tidy(spark: SparkSession) -> None:
    """Deletes all tables that this application has written; for when its results have been read or stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_home(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder, read again.

    A lost executor then costs only the tasks that read the table, and values that depend on the run
    (names given by position) stay as they were first given.
    """
    path = new_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column of an Arrow batch; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about limit bytes in its column of texts, so that a large batch isn't copied at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        past = int(ends[at - 1]) if at else 0
        n = max(1, int(np.searchsorted(ends, past + limit, "right")) - at)
        yield batch.slice(at, n)
        at += n


def freeing(run):
    """run, a function over the batches of a task, that gives the memory it no longer uses back at the task's end: workers live on for other stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def crc_of(doc_id) -> int:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def crc_column(name: str):
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def fits_broadcast(df: DataFrame, size, limit_bytes: int) -> bool:
    """Whether the sum of size, a column of bytes per row, is within the limit; one small aggregate."""
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit_bytes


def join_small_or_shuffled(left: DataFrame, right: DataFrame, on, how: str, size, limit_bytes: int = 8 << 20):
    """left join right: right is broadcast while its measured size is within the limit, else both are shuffled."""
    return left.join(F.broadcast(right) if fits_broadcast(right, size, limit_bytes) else right, on, how)


#: Steps of a plan that give the rows of files in the same order each time they are read.
SAME_ORDER = {"Relation", "Project", "Filter"}


def numbered(rows: DataFrame, mark: str, what: str) -> DataFrame:
    """rows with a number of its own for each row, in the column mark, the same each time they are read.

    Rows that come straight from files are numbered as they are read; any others are written first.
    """
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    steps = {line.lstrip(" :+-").split(" ")[0].split("[")[0].split("(")[0] for line in plan.splitlines() if line.strip()}
    source = rows if steps <= SAME_ORDER else written(rows, what)
    return source.withColumn(mark, F.monotonically_increasing_id())


def marked(rows: DataFrame) -> tuple[DataFrame, str]:
    """rows with a number of its own for each row, and that column's name."""
    mark = "rid" if "rid" not in rows.columns else "rid_" + "_".join(rows.columns)
    return numbered(rows, mark, "rows"), mark


def without(rows: DataFrame, gone: DataFrame, key: str, what: str) -> DataFrame:
    """rows whose key isn't in gone (one column, key); rows with a null key stay. gone is written once."""
    gone = written(gone.filter(F.col(key).isNotNull()).distinct(), what)
    return join_small_or_shuffled(rows, gone, key, "left_anti", F.lit(16)).select(rows.columns)
