"""Helpers shared by the operators of this subpackage: tables, shared folders, byte-exact text rules."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words, and what is stripped from the ends of a line: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: For str.translate: A-Z only, as the contracts ask, never other letters.
ASCII_LOWER = str.maketrans(UPPER, LOWER)
_BYTES_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte but the separators, which are 0; and powers of an odd number, as many as the longest word so far has bytes.
_LETTER = _scrambled(np.arange(1, 257, dtype=np.uint64))
_LETTER[[32, 9, 10, 11, 12, 13]] = 0
LONG_WORD, HASH_SEED = 64, 0x9E3779B97F4A7C15
_POWERS = [np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))]


def bytes_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, in UTF-8: bytes.split() cuts at just the separators of words."""
    return text.encode("utf-8", "surrogatepass").translate(_BYTES_LOWER).split() if text else []


class HashedWords:
    """64-bit hashes of a text's words (A-Z lower-cased, in UTF-8), without making the words: a polynomial over each word's bytes.

    Modulo 2^64 some long words have equal polynomials whatever the base is (a Thue-Morse word of two letters and the same with its letters
    exchanged), so words of more than `LONG_WORD` bytes get another hash, of their bytes.
    """

    __slots__ = ("raw", "starts", "hashes")

    def __init__(self, text: str | None):
        self.raw = text.encode("utf-8", "surrogatepass").translate(_BYTES_LOWER) if text else b""
        values = _LETTER[np.frombuffer(self.raw, np.uint8)]
        solid = values != 0
        edges = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
        self.starts = np.concatenate([[0], edges]) if len(solid) and solid[0] else edges
        if not len(self.starts):
            self.hashes = np.empty(0, np.uint64)
            return
        first = self.starts[0]
        sizes = np.diff(self.starts, append=len(values))
        place = np.arange(first, len(values)) - np.repeat(self.starts, sizes)
        if (top := int(sizes.max())) > len(_POWERS[0]):
            _POWERS[0] = np.cumprod(np.full(2 * top, 0x9E3779B97F4A7C15, np.uint64))
        self.hashes = _scrambled(np.add.reduceat(values[first:] * _POWERS[0][place], self.starts - first))
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            word = self._bytes(i)
            if len(word) > LONG_WORD:  # sizes count the separators after a word too
                self.hashes[i] = xxhash.xxh3_64_intdigest(word, HASH_SEED)

    def _bytes(self, i: int) -> bytes:
        end = self.starts[i + 1] if i + 1 < len(self.starts) else len(self.raw)
        return self.raw[self.starts[i] : end].rstrip(b" \t\n\x0b\x0c\r")

    def word(self, i: int) -> str:
        return self._bytes(i).decode("utf-8", "surrogatepass")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder that driver and executors share, under spark.checkpoint.dir; deleted when the driver's Python ends.

    Where the session names none, one under the local temporary folder is set on one machine; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set; it names a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "rankweave-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/rankweave-{label}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """df, written to a shared folder and read back: its lineage ends there and a lost executor costs no recomputation."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Within it, Arrow batches have so many rows at most, where the session allows more. For what is run within it only."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    if 0 < int(old) <= rows:
        yield
        return
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_fold(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod `mod`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod)).cast("int")
