"""Containment joins of variants with coding blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the smallest position bins, about a block's length, and how many of them the next wider ones hold.
BIN, WIDER = 4096, 16
#: Levels of bins; the widest are as wide as any contig.
LEVELS = 6


def interval_join(variants: DataFrame, blocks: DataFrame, bin_width: int = BIN, keys: tuple[str, ...] = ("chr",), open_start: bool = False) -> DataFrame:
    """Variants (pos, pos_end) wholly inside blocks (start, end), inclusive, on the same keys.

    Bins have several widths. A block stands in bins of the least width that isn't shorter than it, so in one or two of them
    however long it is. Variants look up the bin of their start at each width that blocks have (one, as a rule: coding
    blocks are short), which is one of the block's if they are contained: an equi-join on (keys, level, bin) with a residual
    range test and no duplicates. A key as large as a chromosome is spread over its bins. open_start excludes a block's first
    base (the store's old rule).
    """
    binned = in_bins(blocks, "start", "end", bin_width)
    used = binned.agg(F.collect_set("__level")).scalar()
    probes = variants.withColumn("__level", F.explode(used)).withColumn("__bin", bin_at("pos", F.col("__level"), bin_width))
    start = F.col("start") < F.col("pos") if open_start else F.col("start") <= F.col("pos")
    return probes.join(binned, [*keys, "__level", "__bin"]).where(start & (F.col("pos_end") <= F.col("end"))).drop("__level", "__bin")


def bin_at(pos: str, level: Column, bin_width: int) -> Column:
    widths = F.array(*[F.lit(bin_width * WIDER**k).cast("bigint") for k in range(LEVELS)])
    return F.floor(F.col(pos) / F.get(widths, level))


def in_bins(blocks: DataFrame, start: str, end: str, bin_width: int) -> DataFrame:
    """Blocks once for each bin (__level, __bin) in which they stand: see interval_join."""
    widths = F.array(*[F.lit(bin_width * WIDER**k).cast("bigint") for k in range(LEVELS - 1)])
    leveled = blocks.where(F.col(start) <= F.col(end)).withColumn("__level", F.size(F.filter(widths, lambda w: w < F.col(end) - F.col(start) + 1)))
    first, last = (bin_at(c, F.col("__level"), bin_width) for c in (start, end))
    bins = F.when(F.col("__level") == LEVELS - 1, F.sequence(first, last)).otherwise(F.array_distinct(F.array(first, last)))
    return leveled.withColumn("__bin", F.explode(bins))


def variants_per_protein(hits: DataFrame, protein: str = "protein_id", variant: str = "variant_id") -> DataFrame:
    """One row per protein: its variants' number and their ids in order."""
    return hits.select(protein, variant).distinct().groupBy(protein).agg(F.count("*").alias("n_variants"), F.array_join(F.sort_array(F.collect_list(variant)), ",").alias("variants"))
