"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import sys
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir, shuffles_freed  # noqa: F401

Row = tuple


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the decimal id modulo ``mod`` (the fold of a document); null id -> null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)).cast("int")


def id_remainder_py(doc_id: int, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod


def text_rows(docs: DataFrame, *extra: Column) -> DataFrame:
    """``doc_id`` as long and ``text`` (null: empty); every other column is left behind, so
    clashing extra columns cannot disturb an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back: cuts
    the lineage, and any executor can read the result again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]],
                schema: str) -> DataFrame:
    """``mapInArrow`` with per-task state: ``make()`` runs once in a task and returns the
    function that maps one record batch to record batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield from step(batch)
        release()

    return df.mapInArrow(run, schema)


def text_slices(texts: list[str], limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``limit`` characters, so that working arrays stay bounded
    whatever the length of a record batch (a longer text has a range of its own)."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


class Memo(dict):
    """Bounded memo of a function of strings, in two generations: when the young one holds
    ``capacity`` characters of keys it becomes the old one, and entries used again move
    back. So it holds two generations and one batch at most, long keys or short."""

    def __init__(self, compute: Callable[[list], Iterable], capacity: int = 3_000_000):
        super().__init__()
        self.compute, self.capacity, self.old, self.size = compute, capacity, {}, 0

    def need(self, keys: set) -> None:
        """Make every key available for plain lookup until the next call."""
        if self.size > self.capacity:
            self.old = dict(self)
            self.clear()
            self.size = 0
        missing = keys.difference(self)
        if not missing:
            return
        old = self.old
        again = [k for k in missing if k in old]
        self.update((k, old[k]) for k in again)
        new = list(missing.difference(again))
        self.update(zip(new, self.compute(new)))
        self.size += sum(map(len, missing))


def release() -> None:
    """Give freed memory of this worker back to the system: workers are reused by later stages, and an
    allocator that keeps what it once held adds up over a pipeline."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


def quiet_tokenizers() -> None:
    """One thread per task: the parallelism is Spark's."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
