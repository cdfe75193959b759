"""Helpers shared by the corpus operators: tables, durable intermediates, batches, bounded samples."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Collection

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts' ``[\x20\x09-\x0D]`` names it.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Ids that a broadcast may hold: 16 MB or so in the executors. More are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder inside the shared one that ``spark.checkpoint.dir`` names.

    Where that is unset, a local session (as in tests) gets a temporary folder; on a
    cluster this is an error, since machines don't see each other's temporary folders.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{context.applicationId}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    Cuts the lineage without keeping a copy on an executor's own disk, so a lost
    executor costs nothing that was already written. ``clean_up`` removes the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.durable_path = path
    return back


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that Spark shuffles and sorts even if it is small: a broadcast would be built, and kept for a while, in the driver."""
    return df.hint("merge")


def discard(df: DataFrame) -> None:
    """Removes the files of a ``durable`` table that nothing is read from any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.durable_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Removes all intermediates that this application wrote; results not yet written become unreadable."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bounds an Arrow batch in bytes: texts can be long, and a Python worker holds a batch whole.

    The setting belongs to the session. All operators ask for the same bound, and one
    that is already smaller stays, so the order of calls doesn't matter.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
    if now > size or now <= 0:
        spark.conf.set(key, str(size))


def give_back() -> None:
    """Returns to the operating system what this process has freed: after a fit the allocators would keep the sample's pages for later use."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other libraries than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column (letter case apart) is called so."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def fields_of(df: DataFrame, columns: list[str]) -> str:
    """The columns with their types, as a schema string; names may hold any character."""
    return ", ".join(f"`{c.replace('`', '``')}` {df.schema[c].dataType.simpleString()}" for c in columns)


def by_name(columns: list[str]) -> list[Column]:
    return [F.col(f"`{c.replace('`', '``')}`") for c in columns]


def only(rows: DataFrame, ids: DataFrame, on: str, keep: bool, most: int = BROADCAST_IDS) -> DataFrame:
    """The rows whose ``on`` is among the distinct ``ids`` (``keep``), or isn't: wide rows move only if the ids are too many to broadcast."""
    few = ids.limit(most + 1).count() <= most
    return rows.join(F.broadcast(ids) if few else ids, on, "left_semi" if keep else "left_anti")


def word_hashes(words: Collection[str]) -> np.ndarray:
    """64-bit hashes of words: models know words by them, which takes a small part of what the words themselves would."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def count_matches(pattern: re.Pattern, text: str, long: int = 1 << 20) -> Counter[str]:
    """How often each match occurs; those of a long text aren't all held at once."""
    return Counter(pattern.findall(text) if len(text) < long else (m[0] for m in pattern.finditer(text)))


def places(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where each hash stands among the sorted known ones; -1 for others."""
    if not len(known):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


def held_out(doc_id, buckets: int, rest: int):
    """True for the rows that are never learned from: crc32 of the id's decimal text, modulo ``buckets``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % buckets == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, exclude, max_rows: int, max_bytes: int = 32 << 20) -> list:
    """At most ``max_rows`` labelled rows ``(doc_id, text, y)`` of ``max_bytes`` of text, the smallest by a hash of the id.

    ``exclude`` is a Column over ``doc_id``; rows it marks never take part, nor do ids
    that ``docs`` doesn't hold. One text counts for each id (the least, where an id
    repeats), chosen by Spark before anything is collected. Texts longer than a
    sixteenth of ``max_bytes`` aren't learned from.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marked = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~exclude).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(target)).cast("int").alias("y"))
    ids = marked.join(own.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    chosen = spark.createDataFrame(ids.collect(), "doc_id long, y int")
    one = own.join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") <= max_bytes // 16).groupBy("doc_id", "y").agg(  # at most max_rows rows
        F.min("text").alias("text"))
    rows, size = [], 0
    for r in one.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        size += len(r.text.encode())
        if size > max_bytes:
            break
        rows.append((r.doc_id, r.text, r.y))
    return sorted(rows)
