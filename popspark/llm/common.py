"""What the operators share: tables, words, uniforms and tables written in between."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.  Only where that is unset and Spark runs in one process
    (tests, a notebook) a local folder; executors elsewhere would each write to a disk of their own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="popspark-"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so that it is computed once and outlives executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def words(text: Column) -> Column:
    """The maximal runs of other characters than white space, as an array; null text has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACES))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only (null counts as a key of its own)."""
    parts = [F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("null")) for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``size`` bytes of the string column ``text``, at least a row each."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        weights = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(weights.searchsorted(done + size, "right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(weights[stop - 1])


def utf8(col: pa.Array) -> list[bytes]:
    """The strings as bytes; null is empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


T = TypeVar("T")


def released(result: T) -> T:
    """``result``, after the memory that what made it has left goes back to the system: the process
    lives on into other tasks and stages, and else keeps some tens of megabytes that were freed."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)
    return result


class Remembered(dict):
    """``make(word)`` for words that come again and again, within bounded memory.

    A word's value is kept from its second coming on; of the first one a bit at the word's hash
    remains (so a few words are kept at once).  Long words are made anew each time.
    """

    KEPT, SEEN, BITS, LONGEST = 400_000, 2_000_000, 24, 64

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.forget()

    def forget(self) -> None:
        self.seen, self.many = bytearray(1 << (self.BITS - 3)), 0

    def __missing__(self, word):
        value = self.make(word)
        self.keep(word, value)
        return value

    def keep(self, word, value) -> None:
        if len(word) <= self.LONGEST:
            at = hash(word) & ((1 << self.BITS) - 1)
            byte, bit = at >> 3, 1 << (at & 7)
            if self.seen[byte] & bit:
                if len(self) >= self.KEPT:
                    self.clear()
                self[word] = value
            else:
                if self.many >= self.SEEN:
                    self.forget()
                self.seen[byte] |= bit
                self.many += 1
