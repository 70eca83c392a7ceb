"""What the training-data operators share: reading tables, cutting lineage, hashing words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts are long, so the default of 10,000 rows would hold too much at once.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds what a Python worker holds of a partition at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which every executor sees.

    Where it is unset, a local session gets a temporary folder; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """At a task's end returns freed memory to the system, since its worker lives on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fold(doc_id, modulus: int):
    """crc32 of the id's decimal text, modulo modulus; null for a null id."""
    return F.crc32(doc_id.cast("string")) % modulus


def words(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than space and \\x09-\\x0D, A-Z lower-cased, other letters as they are."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def text_slices(sizes: list[int], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about most bytes of text each; a longer text stands alone and whole."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


class WordHashes(dict):
    """64-bit hashes of words, made when first asked for. Emptied when it holds most entries."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, token: bytes) -> int:
        found = self[token] = xxhash.xxh3_64_intdigest(token)
        return found


def word_hashes(tokens: list[bytes], memory: WordHashes) -> np.ndarray:
    """64-bit hashes of words, in order."""
    if len(memory) > memory.most:
        memory.clear()
    return np.fromiter(map(memory.__getitem__, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers for the words of a shingle, by place.
_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of width words (64 at most), in text order; with fewer words, of the whole sequence."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(width, n)
    out = np.full(n - size + 1, np.uint64(size), np.uint64)
    for i in range(size):
        out += hashes[i : n - size + 1 + i] * _PLACES[i]
    return mix(out)
