"""What the operators of this package share: word rules, work folders, table readers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Every ASCII character that is neither a digit nor a letter.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: For UTF-8 bytes: A-Z to a-z, separators to a space; bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folded(text: Column) -> Column:
    """Lower-case A-Z and make every separator a space, in the JVM."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, UPPER.lower() + " " * len(SEPARATORS))


def native_words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased; null has none."""
    return F.array_remove(F.split(folded(text), " "), "")


def words_of(text: bytes | None) -> list[bytes]:
    """The same words in Python, as UTF-8."""
    return text.translate(FOLD).split() if text else []


def texts_of(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 of a string column, without decoding it."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.string()).cast(pa.binary()).to_pylist()


_made: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    for spark, path in _made:
        try:
            drop_folder(spark, path)
        except Exception:  # the session has ended already
            return


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Have the files of shuffles that nothing refers to any more deleted: Spark does so only when the driver's JVM collects garbage.

    Python collects first: an object of py4j is in a cycle with its methods, and a thread of py4j that looks once a second tells the JVM
    that it is gone; till then its plan holds the shuffles. Those of the last query go at the JVM's second collection.
    """
    gc.collect()
    untold, until = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", ()), time.monotonic() + 3
    while untold and time.monotonic() < until:
        time.sleep(0.02)
    for pause in (0.02, 0.2):
        time.sleep(pause)
        spark._jvm.System.gc()


#: Python workers get texts in batches of so many bytes, however long a text is; a longer one is a batch of its own.
BATCH_BYTES = "8m"


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def lean(run):
    """run over Arrow batches; at the end of a task its freed memory goes back, for the worker stays for other stages."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return whole


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that setting is absent and all runs on one machine, a folder of the driver, set here. On a cluster it must be set."""
    bounded_batches(spark)
    top = spark.conf.get("spark.checkpoint.dir", None)
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not given.isDefined():
        if not top and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(top or "file://" + tempfile.mkdtemp(prefix="textloom-"))
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
    return top or given.get()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; it goes when the driver ends."""
    top = checkpoint_folder(spark)
    path = f"{top.rstrip('/')}/textloom-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write df to a work folder and read it again: cuts the lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """kept, with the folder, for a caller that drops it as soon as what was made of it is written too. Files of earlier steps' shuffles go first."""
    drop_shuffles(df.sparkSession)
    made = kept(df, name)
    return made, _made[-1][1]


def held(df: DataFrame) -> DataFrame:
    """df, computed once for its next few uses; the caller unpersists it. What a lost executor held is computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


#: Keys of eight bytes of which a broadcast takes some 64 MB in each executor.
BROADCAST_KEYS = 2_000_000


def only_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows of df whose `column` is among the keys (one column of that name, without repeats).

    Keys are counted first: few go to where the rows are, so only rows that are needed are shuffled later; many are joined.
    """
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, column, "left_semi")


def file_system(uri: str):
    """pyarrow file system and path for a URI or a plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def as_uint32(values: bytes) -> np.ndarray:
    return np.frombuffer(values, "<u4")
