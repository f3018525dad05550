"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: space and \x09 to \x0D.
SPACE = "[\\x20\\x09-\\x0D]+"
#: Bytes of a batch that goes to a Python worker (a longer row is a batch of its own), and of text taken at once there.
BATCH_BYTES, STEP = 4 << 20, 2 << 20
#: Spark's setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, below the cluster's checkpoint folder.

    Where spark.checkpoint.dir is unset, on a single machine (tests), a temporary folder is set as the checkpoint folder;
    on a cluster that is an error, as executors wouldn't see the driver's folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="protloom-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/protloom-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What runs within leaves no shuffle files: they go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """df computed once, written to the shared checkpoint folder, its lineage cut and its shuffle files gone."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared_dir(spark)
    with tidy(spark):
        return df.select("*").checkpoint(eager=True)


def sized(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, which must be a checkpoint, to be broadcast in joins if it has at most so many rows."""
    with tidy(df.sparkSession):
        return F.broadcast(df) if df.count() <= most else df


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, offsets, words): text i holds the words codes[offsets[i]:offsets[i + 1]]; null texts are empty.

    Words are maximal runs of anything but space and \\x09-\\x0D, A-Z lower-cased unless lower is false.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.offset:  # ascii_lower misreads arrays whose text starts within their buffer
        texts = texts.take(pa.array(np.arange(len(texts))))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = split.flatten()
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
    keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(keep)]).astype(np.int64)
    coded = flat.filter(pa.array(keep)).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, kept[bounds], coded.dictionary


def slices(batch: pa.RecordBatch, column: str = "text", most: int = STEP) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts come to about `most` bytes, so that memory per step is bounded."""
    size = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(size):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def release() -> None:
    """Returns freed memory to the system: idle workers of earlier stages hold none, where the C library allows it."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, trim: bool = True) -> DataFrame:
    """df.mapInArrow(run, schema) in bounded memory: batches of at most BATCH_BYTES (set for the session) and, with trim,
    memory returned after each result (which costs time where results are made of large arrays)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            del out
            if trim:
                release()

    return df.mapInArrow(bounded, schema)


def with_text(docs: DataFrame, kept: list[str], text: str) -> tuple[DataFrame, str]:
    """docs' kept columns and the text as a string, and the name it has there: once if it is kept as it is."""
    if text in kept and docs.schema[text].dataType.simpleString() == "string":
        return docs.select(*kept), text
    name = "__text"
    while name in docs.columns:
        name += "_"
    return docs.select(*kept, F.col(text).cast("string").alias(name)), name


def per_row_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]] along the first axis, zero for empty runs."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def per_row_max(values: np.ndarray, offsets: np.ndarray, empty: float) -> np.ndarray:
    out = np.full(len(offsets) - 1, empty, dtype=np.float64)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.maximum.reduceat(values, offsets[:-1][full])
    return out


def without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """docs without the rows whose key is among ids(key). Up to a million ids are broadcast, more are joined by shuffling."""
    return docs.join(sized(checkpoint(ids)), key, "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each endpoint of edges(a, b) the least node it is linked to.

    Alternates large-star and small-star steps until all edges are stars around their least nodes; every step is a hash
    aggregation and a join, so no component is ever gathered in one place except as (node, least neighbour) rows. Each step is
    checkpointed: plans don't grow with the rounds.
    """
    cur = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        ends = cur.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(cur.select("b", F.lit(0), F.lit(1)))
        with tidy(cur.sparkSession):
            stars = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty()
        if stars:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = checkpoint(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        cur = checkpoint(large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
