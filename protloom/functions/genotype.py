"""Column functions on VCF fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chromosomes kept by default, with and without chr.
CHROMOSOMES = tuple(str(i) for i in range(1, 23)) + ("X", "Y", "M")


def genotype(call: Column) -> Column:
    """The GT part of a sample's cell."""
    return F.substring_index(call, ":", 1)


def alleles(call: Column) -> Column:
    """[first, second] allele numbers; a missing allele counts as the reference, a haploid call leaves the second at 0."""
    parts = F.split(genotype(call), "[|/]")
    number = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("int"), F.lit(0))
    return F.array(number(1), number(2))


def homozygous_reference(call: Column) -> Column:
    return genotype(call).isin("0|0", "0/0")


def homozygous_reference_or_missing(call: Column) -> Column:
    return genotype(call).isin("0|0", "0/0", "./.", ".|.")


def missing(call: Column) -> Column:
    return F.contains(genotype(call), F.lit("."))


def allele_text(ref: Column, alts: Column, number: Column) -> Column:
    """The text of an allele number: ref for 0, else that alternative (null if there is none)."""
    return F.try_element_at(F.concat(F.array(ref), alts), number + 1)


def on_chromosome(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "").isin(*CHROMOSOMES)


def info_passes(info: Column, name: str, threshold: float | None) -> Column:
    """True if any comma-separated value of INFO's field reaches the threshold; a missing field passes, as does anything
    for a threshold of 0 or None; values that aren't numbers don't count."""
    if not threshold:
        return F.lit(True)
    found = F.regexp_extract(info, rf"(?:^|;){name}=([^;]*)", 1)
    has = F.rlike(info, F.lit(rf"(?:^|;){name}="))
    return ~F.coalesce(has, F.lit(False)) | F.exists(F.split(found, ","), lambda x: F.coalesce(x.try_cast("double") >= threshold, F.lit(False)))
