"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import unicodedata
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS_PER_SHINGLE = 5
SIMILARITY = 0.8
ROWS_A_TASK = 20_000  # of rows that are a few numbers
MIX = np.uint64(0x9E3779B97F4A7C15)
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path may be of any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what a Python worker holds at once: whole texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set to the warehouse only where the session names none."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    ours = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return ours


def written(df: DataFrame, name: str, *, partition_by: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back, so a lost executor costs no recomputation. rows: df is made from small rows, about so many, and takes no more tasks than these are worth, whatever the number of shuffle partitions; their number grows with the rows."""
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_TASK)))
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    before = spark.conf.get(SHUFFLES_GO, None)
    # what was shuffled for this write is of no use after it, and would stay until the driver collects its garbage
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def forget(df: DataFrame) -> None:
    """Delete what written() wrote; nothing that is read from df may be run after."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def held_out() -> F.Column:
    """True for the evaluation fold: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


class WordHashes(dict):
    """Text chunk between white space -> 64-bit hash of its word (lower case, outer punctuation stripped); 0: no word."""

    LIMIT = 30_000  # words that come once soon fill any cache, and a small one stays in the processor's

    def __missing__(self, chunk: str) -> int:
        word = chunk
        if not word.isalnum():
            lo, hi = 0, len(word)
            while lo < hi and not word[lo].isalnum():
                lo += 1
            while hi > lo and not word[hi - 1].isalnum():
                hi -= 1
            word = word[lo:hi]
        found = (xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) or 1) if word else 0
        if len(chunk) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[chunk] = found
        return found


_WORDS = WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words, in order. Null and empty texts have none."""
    if not text:
        return np.empty(0, np.uint64)
    chunks = text.lower().split()
    found = np.fromiter(map(_WORDS.__getitem__, chunks), np.uint64, len(chunks))
    return found[found != 0] if len(found) and not found.all() else found


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(words: np.ndarray, size: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Hash of each run of `size` words; a shorter, non-empty text is one shingle of all its words."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    size = min(size, n)
    h = words[: n - size + 1].copy()
    for k in range(1, size):
        h *= MIX
        h += words[k : n - size + 1 + k]
    return mixed(h)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of minima over sum of maxima of the multiplicities of two shingle arrays; 1 for two empty ones."""
    ka, ca = np.unique(a, return_counts=True)
    kb, cb = np.unique(b, return_counts=True)
    return counted_jaccard(ka, ca, kb, cb)


def counted_jaccard(ka, ca, kb, cb) -> float:
    total = int(ca.sum() + cb.sum())
    if not total:
        return 1.0
    if not len(ka) or not len(kb):
        return 0.0
    at = np.searchsorted(kb, ka)
    at[at == len(kb)] = 0
    both = kb[at] == ka
    shared = int(np.minimum(ca[both], cb[at[both]]).sum())
    return shared / (total - shared)


def nfc(text: str) -> str:
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def tokenizer_path(name: str) -> str:
    """Default place of a vocabulary file; every operator takes another as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def file_stamp(path: str) -> str:
    """Key of a loaded vocabulary in a worker's cache."""
    return f"{path}:{os.path.getmtime(path)}"
