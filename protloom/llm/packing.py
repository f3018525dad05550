"""Best-fit packing of tokenized documents into sequences: local best fit, then rounds over underfull bins."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_batches, slices

#: Items that one task packs at most (on average): the bound on its memory.
TASK_ITEMS = 1 << 16
#: A bin with so few tokens left counts as nearly full and takes no part in further rounds.
SLACK = 2
#: A round over several tasks that leaves more than this share of its underfull bins underfull is the last.
STALLED = 0.9


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes for themselves, others, in order, from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Ids:
    """Token ids of texts by a file of the tokenizers library, as arrays of unsigned 32-bit numbers.

    The names of special tokens are ordinary text. Where the file is a plain byte-level vocabulary whose merges are in the
    order of its ids, tiktoken computes the same ids from it, several times faster; else the tokenizers library does.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        byte_level = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and spec["normalizer"] is None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
        in_order = [model["vocab"].get(a + b) for a, b in pairs] == list(range(256, 256 + len(pairs)))
        self.path, self.fast, self.slow = path, None, None
        if model["type"] == "BPE" and byte_level and in_order and not model.get("ignore_merges"):
            import tiktoken
            from public_tokenizers import PATTERN

            special, byte = {t["content"] for t in spec["added_tokens"]}, _bytes_of_letters()
            ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
            self.fast = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its pattern can't be matched against some million blanks in a row
                pass
        if self.slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids, then end_id, in pieces of at most `capacity` tokens.

    Texts of more tokens are cut into pieces of `capacity`, the first of which holds the remainder. Null texts are empty: a
    piece of end_id alone. tokenizer: path of a tokenizers file (None: the public byte-level vocabulary of 50,257 ids).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(tokenizer or _public())
        last = np.asarray([end_id], np.uint32)
        for batch in batches:
            for part in slices(batch):
                row, number, start, length, crc = [], [], [], [], []
                for i, one in enumerate(part.column("text")):
                    own = np.concatenate([ids.of(one.as_py() or ""), last]).astype("<u4")
                    n = len(own)
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        row.append(i)
                        number.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own[a:b]))
                yield pa.record_batch([part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint", trim=False)


def _public() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: largest first, each into the bin with the least room that holds it, else into a new one."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = n = 0  # bit r of there: a bin with r left is open
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        if fits := there >> size:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                there ^= 1 << left
        else:
            left, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - left
        left -= size
        if left:
            room[left].append(b)
            there |= 1 << left
    return bins, offsets


def _round(bins: DataFrame, tasks: int, capacity: int, number: int, last: bool) -> DataFrame:
    """Packs bins (fill, items) into bins, each task for itself; done: nearly full, or the last round."""
    items_type = bins.schema["items"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (got := [b for b in batches if b.num_rows]):
            return
        table = pa.Table.from_batches(got)
        fill = table.column("fill").to_numpy().astype(np.int64)
        items = table.column("items").combine_chunks()
        count = items.value_lengths().to_numpy().astype(np.int64)
        first = np.cumsum(count) - count
        into, offset = best_fit(fill, capacity)
        order = np.lexsort((offset, into))
        moved = count[order]
        index = np.arange(moved.sum()) + np.repeat(first[order] - np.cumsum(moved) + moved, moved)
        flat = items.flatten().take(pa.array(index))
        shift = np.repeat(offset[order], moved)
        fields = {f.name: flat.field(f.name) for f in flat.type}
        fields["offset"] = pa.array(fields["offset"].to_numpy() + shift)
        n = int(into.max()) + 1
        sizes = np.bincount(into, weights=count, minlength=n).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
        full = np.bincount(into, weights=fill, minlength=n).astype(np.int64)
        name = (number << 56) + (TaskContext.get().partitionId() << 28) + np.arange(n)
        for a in range(0, n, 4096):
            yield pa.record_batch([pa.array(name[a : a + 4096]), pa.array(full[a : a + 4096]), pa.array(last | (full[a : a + 4096] >= capacity - SLACK)), lists.slice(a, 4096)], names=["sequence_id", "fill", "done", "items"])

    return map_batches(bins.select("fill", "items").repartition(tasks), run, f"sequence_id bigint, fill bigint, done boolean, items {items_type}", trim=False)


def pack(cut: DataFrame, capacity: int = 1024, task_items: int = TASK_ITEMS) -> DataFrame:
    """cut (as of pieces) with sequence_id and offset: gapless places in as few sequences of `capacity` tokens as best fit needs.

    Pieces of full length are sequences of their own. The others are dealt evenly over tasks of about task_items items, each
    of which packs its own by best fit. Nearly full bins are done. Underfull ones, with their items, are the items of
    the next round, over fewer tasks; the last round has one task or, where rounds no longer merge bins (if all are over half
    full, say), as many as hold task_items each. So no task ever gets more than about task_items items, whatever the table,
    its ties and repeats. Each round is written to the checkpoint folder. An empty table gives an empty result.
    """
    cut = checkpoint(cut)
    whole = cut.where(F.col("length") >= capacity).select("*", (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    item = F.struct(*cut.columns, F.lit(0).cast("bigint").alias("offset"))
    bins, done = cut.where(F.col("length") < capacity).select(F.col("length").alias("fill"), F.array(item).alias("items")), []
    left, number, before = bins.count(), 0, 0
    while left:
        tasks = -(-left // task_items)
        last = tasks == 1 or number > 0 and left > STALLED * before
        packed = checkpoint(_round(bins, tasks, capacity, number, last))
        done.append(packed.where("done"))
        bins, before, number = packed.where("not done"), left, number + 1
        left = 0 if last else bins.count()
    for packed in done:
        item = packed.select("sequence_id", F.explode("items").alias("item"))
        whole = whole.unionByName(item.select(*(F.col("item")[c].alias(c) for c in cut.columns), "sequence_id", F.col("item.offset").alias("offset")))
    return whole


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset (see pieces, pack).

    Null and blank texts are pieces too, null ids and repeated rows are packed like any others, other columns are ignored.
    """
    return pack(pieces(docs, tokenizer, capacity, end_id, doc_id, text), capacity)
