"""Helpers that the operators of this package share: folders, workers, word hashes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pandas.util import hash_array
from pyspark.sql import DataFrame, SparkSession, functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; where it is
    unset, a folder beside the warehouse tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint the DataFrame in the shared folder, so that later reads start there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the DataFrame as Parquet in the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def removed(df: DataFrame) -> None:
    """Delete a `stored` table that nothing reads any more, what came of it being written itself."""
    session = df.sparkSession
    path = session._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def freed(spark: SparkSession) -> None:
    """Delete the shuffle files of what is written. Spark does so once the driver's JVM has collected the plans that made them, by
    itself perhaps only after half an hour; until then they would lie beside those of the next steps."""
    spark._jvm.System.gc()


def workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver imported it, and give freed memory back to the
    system, as they outlive the stages that they work for."""
    own = spark.sparkContext.environment
    here = own.get("PYTHONPATH", "")
    if ROOT not in here.split(os.pathsep):
        own["PYTHONPATH"] = os.pathsep.join(filter(None, [here, ROOT]))
    for name, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "2"), ("MALLOC_TRIM_THRESHOLD_", "16777216")):
        own.setdefault(name, value)
    return spark


def blocks_of(spark: SparkSession) -> int:
    """Number of hash ranges that blocked products are dealt over: follows the session."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks_for(size: int, each: int = 8 << 20) -> int:
    """Number of hash ranges for `size` bytes of packed entries, about `each` bytes in one."""
    return max(1, -(-size // each))


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id` and `text` alone, a null text read as an empty one."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case, split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word, keyed alike in every task."""
    column = np.empty(len(tokens), object)
    column[:] = tokens
    return hash_array(column, categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def runs_of_words(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n] * _ODD[0]
    for i in range(1, k):
        out += h[i:i + n] * (_ODD[i % 8] + np.uint64(i & ~7))
    return mix(out)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle."""
    h = word_hashes(words(text))
    if not len(h):
        return np.empty(0, np.uint64)
    s = runs_of_words(h, min(k, len(h)))
    s.sort()
    return s[np.append(True, s[1:] != s[:-1])]


def frames(batches: Iterator[pd.DataFrame], rows: int = 2000, chars: int = 8 << 20) -> Iterator[pd.DataFrame]:
    """The batches in parts of `rows` rows at most, whose texts have about `chars` characters at most (or one text); empty
    batches are passed over."""
    for pdf in batches:
        size = pdf["text"].str.len().fillna(0).to_numpy(np.int64) if "text" in pdf else np.zeros(len(pdf), np.int64)
        total, at = np.append(0, np.cumsum(size)), 0
        while at < len(pdf):
            end = min(at + rows, max(at + 1, int(np.searchsorted(total, total[at] + chars, "right")) - 1))
            yield pdf.iloc[at:end].reset_index(drop=True)
            at = end
