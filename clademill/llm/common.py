"""Helpers shared by the text operators: shared-folder tables and hashing."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset a local master gets its own folder; a cluster is refused,
    since a machine-local folder is not readable by other executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{LOCAL_CHECKPOINTS}"


@dataclass
class SharedTable:
    """A table written to the shared folder; its lineage ends there."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        spark = self.df.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def save(df: DataFrame, label: str) -> SharedTable:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return SharedTable(spark.read.schema(df.schema).parquet(path), path)


def release(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of plans that nothing refers to any more, which it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a task's batches, after which the worker gives free memory back.

    Workers outlive their tasks; what they keep counts against the executor while
    later stages run.
    """

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column of ``taken`` has it, in any case of letters."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


#: Ids up to this count are broadcast to a scan (8 bytes each in the table, about 30 in memory); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def bounded(ids: DataFrame) -> DataFrame:
    """A table of single ids, to be broadcast where its count allows it. ``ids`` must be cheap to count."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def fold(id_column: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds


class WordHashes(dict):
    """64-bit hashes of byte words, remembered up to a bound."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` consecutive hashes, order-sensitive."""
    n = len(hashes) - width + 1
    h = hashes[:n]
    for j in range(1, width):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n + j]
    return mix(h)
