"""Shared helpers: scratch tables in the cluster's shared folder, word rules, hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Words are maximal runs of characters outside this class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_RE = r"[^\x20\x09-\x0D]+"

_stashed: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`. Only where that is unset (tests) a local one is made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="spanwarden-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str, keep: bool = False) -> str:
    """A fresh path below the shared folder; `release` deletes it, unless it is to be kept."""
    path = f"{shared_dir(spark)}/spanwarden/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    if not keep:
        _stashed.append(path)
    return path


def stash(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, tag, keep)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every scratch table made so far. Call it only once results built on them have been written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _stashed:
        path = jvm.org.apache.hadoop.fs.Path(_stashed.pop())
        path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word bytes -> 64-bit hash as int; bounded, so that a worker's memory does not follow the vocabulary."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-word shingles in order; with 1 to n-1 words, one shingle of all; without words, none."""
    if not len(words):
        return words
    n = min(n, len(words))
    width = len(words) - n + 1
    out = np.full(width, n, np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + width])
    return out
