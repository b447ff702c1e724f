"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, everywhere in this subpackage: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the master is local and names none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexiweft-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Tables of a few bytes a row are written by this share of the shuffle partitions (and as many tasks as cores at least).
NARROW = 16


def materialize(df: DataFrame, what: str, narrow: bool = False, **options: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back. narrow: into few files.

    A lost executor then costs a reread of files, not a recomputation of the job so far.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiweft/{what}-{uuid.uuid4().hex}"
    if narrow:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // NARROW))
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null, empty and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it, inside lambdas too."""
    return F.transform(F.array(value), body)[0]


#: Bytes of an Arrow batch on its way to Python, unless the session has a bound of its own: rows may be very long.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema), with batches of bounded bytes."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def column(batch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of n texts, lower-cased: n + 1 offsets into the hashes of their words, and those hashes in order."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))))
    flat = lists.flatten().dictionary_encode()
    words = flat.dictionary.cast(pa.binary()).to_pylist()
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    code, offsets = flat.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    if b"" in words:  # texts without words
        full = code != words.index(b"")
        code, offsets = code[full], np.r_[0, np.cumsum(full)][offsets]
    return offsets, hashed[code]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not every C library has it
    _trim = None


def release() -> None:
    """Give memory that is free back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def gathered(batches, least_bytes: int):
    """The Arrow batches, put together until they have so many bytes: larger ones share more words."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def slices(batches, most_bytes: int = 6_000_000, most_rows: int = 2_000):
    """The Arrow batches in pieces of bounded size, so that what Python makes of one stays small."""
    for batch in batches:
        step = max(1, min(most_rows, int(batch.num_rows * most_bytes / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        release()
