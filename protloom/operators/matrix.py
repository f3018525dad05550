"""Genotype matrix of a cohort: who carries which alternative, as bits, built once and read by samples.

A row holds one alternative of one line and one block of BLOCK samples: a bit per sample in words of 64, for each haplotype.
Blocks in which nobody carries it have no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples of a block: a multiple of 64. A reader of some samples opens the folders of their blocks only.
BLOCK = 4096
#: Bytes of cells that are decoded at once.
STEP = 16 << 20
WORDS = "hap1 array<bigint>, hap2 array<bigint>"
_SPLIT = re.compile("[|/]")


def _alleles(text: str) -> tuple[int, int, bool]:
    """(first, second, missing) of a genotype, by the rules of functions.genotype."""
    number = lambda x: int(x) if re.fullmatch(r"\s*[+-]?\d{1,9}\s*", x) else 0
    first, second = [*map(number, _SPLIT.split(text)), 0][:2]
    return first, second, "." in text


def decode(cells: bytes, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, column, first allele, second allele, missing) of each cell; lines: where each line's cells begin in `cells`,
    and where the last end; cells are separated by tabs, lines by one byte of any kind.

    Genotypes of one-digit alleles are read from all cells at once, others once for each different text.
    """
    b = np.frombuffer(cells, np.uint8)
    full = lines[1:] > lines[:-1] + 1
    starts = np.sort(np.concatenate([np.flatnonzero(b == 9) + 1, lines[:-1][full]]))
    line = np.searchsorted(lines, starts, side="right") - 1
    ends = np.append(starts[1:], lines[-1]) - 1
    first_of = np.searchsorted(starts, lines[:-1])
    column = np.arange(len(starts)) - first_of[line]
    colons = np.append(np.flatnonzero(b == 58), len(b) + 1)
    ends = np.minimum(ends, colons[np.searchsorted(colons, starts)])
    at = lambda k: b[np.minimum(starts + k, len(b) - 1)]
    digit = lambda c: (c >= 48) & (c <= 57)
    plain = (ends - starts == 3) & (digit(at(0)) | (at(0) == 46)) & (digit(at(2)) | (at(2) == 46)) & ((at(1) == 124) | (at(1) == 47))
    a1, a2 = np.where(digit(at(0)), at(0).astype(np.int32) - 48, 0), np.where(digit(at(2)), at(2).astype(np.int32) - 48, 0)
    missing = (at(0) == 46) | (at(2) == 46)
    known: dict[bytes, tuple[int, int, bool]] = {}
    for i in np.flatnonzero(~plain).tolist():
        text = cells[starts[i] : ends[i]]
        if text not in known:
            known[text] = _alleles(text.decode("utf-8", "replace"))
        a1[i], a2[i], missing[i] = known[text]
    return line, column, a1, a2, missing


def _bits(line: np.ndarray, column: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    grid = np.zeros(shape, bool)
    grid[line, column] = True
    return np.packbits(grid, axis=1, bitorder="little").view("<i8")


def pack(rows: DataFrame, ids: list[str], samples: int) -> DataFrame:
    """(ids, ref, alt, block, hap1, hap2) of rows(ids, ref, alt, cells): cells as the text of a VCF line after its fixed
    columns (sources.text.with_cells).

    As operators.variants.call_carriers has it: lines in which all cells are homozygous reference or missing, or all have a
    missing allele, are left out, as are alternatives * and those equal to ref. Cells beyond the header's samples are ignored.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*ids, "ref"]) + f", alt string, block int, {WORDS}"
    width = -(-samples // 64) * 64

    def some(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [(x or "").encode() for x in part.column("cells").to_pylist()]
        lines = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
        line, column, a1, a2, missing = decode(b"\n".join(texts), lines)
        carried, all_missing = np.zeros(len(texts), bool), np.ones(len(texts), bool)
        none = (a1 == 0) & (a2 == 0)
        carried[line[~none]] = True
        all_missing[line[~missing]] = False
        keep = (carried & ~all_missing)[line] & (column < samples)
        line, column, a1, a2 = line[keep], column[keep], a1[keep], a2[keep]
        refs, alts = part.column("ref").to_pylist(), [(x or "").split(",") for x in part.column("alt").to_pylist()]
        for v in range(1, max([0, *map(len, alts)]) + 1):
            good = np.array([len(a) >= v and a[v - 1] not in (r, "*") for r, a in zip(refs, alts)], bool)
            h1, h2 = (a1 == v) & good[line], (a2 == v) & good[line]
            touched = np.unique(line[h1 | h2])
            if not len(touched):
                continue
            place = np.zeros(len(texts), np.int64)
            place[touched] = np.arange(len(touched))
            one, two = (_bits(place[line[h]], column[h], (len(touched), width)) for h in (h1, h2))
            for block in range(-(-width // BLOCK)):
                words = slice(block * BLOCK // 64, (block + 1) * BLOCK // 64)
                any_ = np.flatnonzero((one[:, words] | two[:, words]).any(axis=1))
                if len(any_):
                    take = part.take(pa.array(touched[any_]))
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(any_) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel())) for w in (one[any_, words], two[any_, words])]
                    yield pa.record_batch([*(take.column(c) for c in [*ids, "ref"]), pa.array([alts[i][v - 1] for i in touched[any_].tolist()]), pa.array([block] * len(any_), pa.int32()), *lists], names=[*ids, "ref", "alt", "block", "hap1", "hap2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(x.as_buffer()) + 1 if x.is_valid else 1 for x in batch.column("cells")])
            group = np.cumsum(size) // STEP
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield from some(batch.slice(a, b - a))

    return rows.select(*ids, "ref", "alt", "cells").mapInArrow(run, schema)


def _members(words: Column, block: Column) -> Column:
    """Numbers of the samples whose bits are set: empty words are passed over."""
    held = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), (block * BLOCK + i * 64).alias("base"))), lambda x: x["w"] != 0)
    bits = F.sequence(F.lit(0), F.lit(63))
    inside = lambda x: F.transform(F.filter(bits, lambda b: F.getbit(x["w"], b) == 1), lambda b: x["base"] + b)
    return F.flatten(F.transform(held, inside))


def carriers(matrix: DataFrame, ids: list[str], samples: list[int] | None = None) -> DataFrame:
    """(ids, ref, alt, i, hap): carriers of the samples numbered in `samples` (None: all). Only their blocks are read, and
    other samples' bits are masked before any becomes a row."""
    rows = matrix
    hap = {h: F.col(f"hap{h}") for h in (1, 2)}
    if samples is not None:
        masks: dict[int, list[int]] = {}
        for i in samples:
            mask = masks.setdefault(i // BLOCK, [0] * (BLOCK // 64))
            mask[i % BLOCK // 64] |= 1 << (i % 64)
        signed = lambda w: w - (1 << 64) if w >> 63 else w
        table = matrix.sparkSession.createDataFrame([(b, [signed(w) for w in m]) for b, m in masks.items()], "block int, mask array<bigint>")
        rows = rows.where(F.col("block").isin(*masks)).join(F.broadcast(table), "block")
        hap = {h: F.zip_with(F.slice("mask", F.lit(1), F.size(c)), c, lambda m, w: m.bitwiseAND(w)) for h, c in hap.items()}
    of = lambda h, c: F.transform(_members(c, F.col("block")), lambda i: F.struct(i.cast("int").alias("i"), F.lit(h).alias("hap")))
    each = F.concat(*[of(h, c) for h, c in hap.items()])
    return rows.select(*ids, "ref", "alt", F.inline(each))


def write(matrix: DataFrame, names: list[str], folder: str) -> None:
    """The matrix by block of samples, and the samples' names, in a folder."""
    matrix.write.mode("overwrite").partitionBy("block").parquet(f"{folder}/bits")
    spark = matrix.sparkSession
    spark.createDataFrame(list(enumerate(names)), "i int, sample string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/samples")


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """(matrix, names in order) of write's folder."""
    names = [r["sample"] for r in spark.read.parquet(f"{folder}/samples").orderBy("i").collect()]
    return spark.read.parquet(f"{folder}/bits"), names
