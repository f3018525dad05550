"""Column functions on nucleotide and amino-acid strings; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, codons in the order T, C, A, G of each position.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: IUPAC nucleotide codes and their complements.
IUPAC, COMPLEMENT = "ACGTURYKMBVDHSWNacgturykmbvdhswn", "TGCAAYRMKVBHDSWNtgcaayrmkvbhdswn"
#: What counts as "not a carrier" in a sample column.
FALSEY = ("", "0", "0.0", "False", ".", "NaN", "*", "N/A", "NA", "nan", "null", "None", "-", " ", "[]")


def codon_table() -> dict[str, str]:
    return {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), IUPAC, COMPLEMENT)


def complement(base: Column) -> Column:
    return F.translate(base, IUPAC, COMPLEMENT)


def amino_acid(codon: Column) -> Column:
    """One codon's amino acid: by its place in the code, X for codons with other letters than A, C, G, T."""
    at = lambda i: F.instr(F.lit("TCAG"), F.substring(codon, i, 1)) - 1
    index = at(1) * 16 + at(2) * 4 + at(3) + 1
    plain = (F.length(codon) == 3) & (F.translate(codon, "ACGT", "") == "")
    return F.when(codon.isNull(), F.lit(None)).when(plain, F.substring(F.lit(AMINO_ACIDS), index, F.lit(1))).otherwise("X")


def codons(seq: Column) -> Column:
    """Whole codons of a sequence, in order; no codon: an empty array."""
    return F.filter(F.split(seq, r"(?<=\G.{3})"), lambda c: F.length(c) == 3)


def translate(seq: Column) -> Column:
    """Amino acids of all whole codons, stops as *."""
    return F.array_join(F.transform(codons(seq), amino_acid), "")


def translate_cds(seq: Column, frame: Column, strand: Column) -> Column:
    """Protein of a coding sequence on the + strand: oriented, frame bases dropped, up to the first stop, X before it if
    the frame isn't 0."""
    oriented = F.when(strand == "-", reverse_complement(seq)).otherwise(seq)
    body = F.substring(oriented, frame + 1, F.length(oriented))
    aa = F.substring_index(translate(body), "*", 1)
    return F.when(frame != 0, F.concat(F.lit("X"), aa)).otherwise(aa)


def normalize(seq: Column, isobaric: bool = False) -> Column:
    """Upper case, outer * stripped, I written as L with isobaric."""
    out = F.trim(F.upper(F.coalesce(seq, F.lit(""))), F.lit("*"))
    return F.replace(out, F.lit("I"), F.lit("L")) if isobaric else out


def falsey(value: Column) -> Column:
    """True for cells that mark a sample as not carrying a variant."""
    return F.coalesce(value.cast("string"), F.lit("")).isin(*FALSEY) | (F.trim(F.coalesce(value.cast("string"), F.lit(""))) == "")
