"""Block-compressed text (bgzip): read by many tasks, as blocks are compressed one by one.

Spark's text source cuts files at a stated separator. With the header that all blocks begin with as separator, each record is
one block, and Spark deals parts of the files to tasks as it does with plain text, on whatever file system it reads. As Hadoop
takes .gz for a file that can't be split, files are given names without that ending by a view of the file system that holds
for this one read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The first 16 bytes of each block, up to its length; endings of compressed files' names.
HEADER = bytes.fromhex("1f8b08040000000000ff060042430200")
ENDINGS = (".gz", ".bgz", ".bgzf")
#: Compressed blocks that a task holds while it looks for its part's last line end.
HELD = 256
LINE, HEAD, TAIL, INNER = range(4)


def told_apart(spark: SparkSession, paths: str | list[str]) -> tuple[list[str], list[str]]:
    """(block-compressed files, other paths) of paths, in which folders and patterns stand for the files they hold."""
    fs_path, blocks, others = spark._jvm.org.apache.hadoop.fs.Path, [], []
    for path in [paths] if isinstance(paths, str) else list(paths):
        fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        found = []
        for status in fs.globStatus(fs_path(path)) or ():
            found += [f.getPath() for f in fs.listStatus(status.getPath()) if f.isFile()] if status.isDirectory() else [status.getPath()]
        packed = [p for p in found if p.getName().lower().endswith(ENDINGS) and _begins_with_header(spark, fs, p)]
        if not packed:
            others.append(path)
            continue
        blocks += [p.toString() for p in packed]
        others += [p.toString() for p in found if p not in packed and not p.getName().startswith(("_", "."))]
    return sorted(blocks), others


def _begins_with_header(spark: SparkSession, fs, path) -> bool:
    stream = fs.open(path)
    try:
        return bytes((stream.read() & 255) for _ in HEADER) == HEADER
    finally:
        stream.close()


def _blocks(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, part, value): compressed blocks, in order within each part of a file; file numbers follow `files`."""
    name = "bgzf-" + hashlib.sha256("\n".join(files).encode()).hexdigest()[:24]
    reader = spark.read.option("lineSep", HEADER.decode("latin-1")).option("encoding", "ISO-8859-1")
    for i, f in enumerate(files):
        reader = reader.option(f"fs.viewfs.mounttable.{name}.link./{i:09d}", f)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{9})$", 1).cast("int")
    rows = reader.text([f"viewfs://{name}/{i:09d}" for i in range(len(files))])
    return rows.select(number.alias("file"), F.col("_metadata.file_block_start").alias("part"), F.col("value").cast("binary").alias("value")).where("length(value) > 0")


def _inflate(block: bytes) -> bytes:
    if len(block) < 10 or len(block) + len(HEADER) != struct.unpack("<H", block[:2])[0] + 1:
        raise ValueError("a block of the compressed file isn't as long as its header says")
    return zlib.decompress(block[2:-8], -15)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[bytes]]]:
    """((file, part), its blocks) in order; the blocks must be used up before the next part is asked for."""
    rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)))
    ahead = next(rows, None)

    def same(key: tuple[int, int]) -> Iterator[bytes]:
        nonlocal ahead
        while ahead is not None and ahead[:2] == key:
            yield ahead[2].as_py()
            ahead = next(rows, None)

    while ahead is not None:
        yield ahead[:2], same(ahead[:2])


def _record(key: tuple[int, int], kind: int, rows: list[bytes], first: int = 0) -> pa.RecordBatch:
    n = len(rows)
    return pa.record_batch([pa.array([key[0]] * n, pa.int32()), pa.array([key[1]] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(rows, pa.binary())], names=["file", "part", "row", "kind", "value"])


def _whole_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that begin and end within their part."""
    for key, blocks in _parts(batches):
        carried, begun, row = [], False, 0
        for data in map(_inflate, blocks):
            *lines, rest = data.split(b"\n")
            if not lines:
                carried.append(rest)
                continue
            lines[0] = b"".join([*carried, lines[0]])
            carried = [rest]
            if not begun:
                del lines[0]
                begun = True
            if lines:
                yield _record(key, LINE, lines, row)
                row += len(lines)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands before each part's first line end and after its last; a part without any is one piece.

    Blocks between aren't inflated, but for one in HELD.
    """
    for key, blocks in _parts(batches):
        head = []
        for data in map(_inflate, blocks):
            before, end, after = data.partition(b"\n")
            head.append(before)
            if end:
                break
        else:
            yield _record(key, INNER, [b"".join(head)])
            continue
        yield _record(key, HEAD, [b"".join(head)])
        tail, held = [after.rpartition(b"\n")[2]], deque()  # what follows the last line end known so far, still packed

        def settle() -> None:
            found = deque()
            while held:
                data = _inflate(held.pop())
                _, end, after = data.rpartition(b"\n")
                found.appendleft(after)
                if end:
                    tail.clear()
                    break
            held.clear()
            tail.extend(found)

        for block in blocks:
            held.append(block)
            if len(held) == HELD:
                settle()
        settle()
        yield _record(key, TAIL, [b"".join(tail)])


def read_bgzf_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(value, line): lines of block-compressed files without their ends, and their order (see text.line_order).

    Lines within one part of a file come from its task; those that cross parts are put together from the parts' edges, one
    or two short rows a part.
    """
    blocks, schema = _blocks(spark, files), "file int, part bigint, row bigint, kind int, value binary"
    lines = blocks.mapInArrow(_whole_lines, schema)
    edges = blocks.mapInArrow(_edges, schema)
    order = Window.partitionBy("file").orderBy("part", "kind")
    edges = edges.withColumn("n", F.count(F.when(F.col("kind") == HEAD, 1)).over(order) - F.when(F.col("kind") == HEAD, 1).otherwise(0))
    piece = F.sort_array(F.collect_list(F.struct("part", "kind", F.col("value").cast("string").alias("value"))))
    across = edges.groupBy("file", "n").agg(piece.alias("p"), F.max(F.col("kind") == HEAD).alias("ended"))
    first = F.element_at("p", 1)
    text = F.array_join(F.transform("p", lambda x: x["value"]), "")
    across = across.where(F.col("ended") | (text != "")).select("file", first["part"].alias("part"), F.when(first["kind"] == TAIL, F.lit(1 << 62)).otherwise(F.lit(-1)).cast("bigint").alias("row"), text.alias("value"))
    both = lines.select("file", "part", "row", F.col("value").cast("string").alias("value")).unionByName(across)
    paths = spark.createDataFrame(list(enumerate(files)), "file int, path string")
    return both.join(F.broadcast(paths) if len(files) <= 100_000 else paths, "file").select(F.rtrim("value", F.lit("\r")).alias("value"), F.struct(F.col("path").alias("file"), "part", "row").alias("line"))
