"""Protein databases: changed and unchanged records, PEFF headers, UniProt mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fasta_line(header: Column, seq: Column) -> Column:
    """A FASTA record as one text of two lines."""
    return F.concat(F.lit(">"), header, F.lit("\n"), seq)


def all_proteins(reference: DataFrame, changed: DataFrame, key: str, seq: str, new_seq: str) -> DataFrame:
    """Changed forms, and reference proteins that aren't among them: (key, seq, status)."""
    forms = changed.select(F.col(key), F.col(new_seq).alias(seq), F.lit("changed").alias("status"))
    same = reference.join(changed.select(key).distinct(), key, "left_anti").select(key, seq, F.lit("unchanged").alias("status"))
    return forms.unionByName(same)


def latest_proteins(rows: DataFrame, key: str, seq: str, new_seq: str) -> DataFrame:
    """all_proteins() of reference proteins that have their changed form, or null, beside them: nothing is joined."""
    changed = F.coalesce(F.col(new_seq) != F.col(seq), F.lit(False))
    return rows.select(key, F.when(changed, F.col(new_seq)).otherwise(F.col(seq)).alias(seq), F.when(changed, "changed").otherwise("unchanged").alias("status"))


def fasta_lines(records: DataFrame, header: Column, seq: Column) -> DataFrame:
    return records.select(F.concat(F.lit(">"), header, F.lit("\n"), seq).alias("value"))


def variant_simple(variant_aa: Column) -> Column:
    """PEFF's VariantSimple list from substitutions like P773L(chr13-1-G-A);...: (773|L|chr13-1-G-A) each."""
    return F.regexp_replace(F.regexp_replace(variant_aa, r"[A-Z*]?(\d+)([A-Z*])\(([^)]*)\)", "($1|$2|$3)"), ";", "")


def peff(proteins: DataFrame, annotations: DataFrame, key: str, seq: str, prefix: str = "protloom") -> DataFrame:
    """(key, header, seq): a PEFF record for every protein, with VariantSimple where it has substitutions."""
    return peff_records(proteins.join(annotations.select(key, "variant_aa"), key, "left"), key, seq, prefix)


def peff_records(rows: DataFrame, key: str, seq: str, prefix: str = "protloom") -> DataFrame:
    """peff() of proteins that have variant_aa, or null, beside them."""
    simple = F.when(F.coalesce("variant_aa", F.lit("")) != "", F.concat(F.lit(" \\VariantSimple="), variant_simple(F.col("variant_aa")))).otherwise("")
    header = F.concat(F.lit(f">{prefix}:"), F.col(key).cast("string"), simple, F.lit(" \\Length="), F.length(seq).cast("string"))
    return rows.select(key, header.alias("header"), seq)


def peff_preamble(n: int, name: str = "proteins", version: str = "1") -> list[str]:
    """A PEFF file's head."""
    return ["# PEFF 1.0", f"# DbName={name}", f"# DbVersion={version}", f"# NumberOfEntries={n}", "# SequenceType=AA", "# //"]


def uniprot_match(uniprot: DataFrame, reference: DataFrame, min_len: int = 20) -> DataFrame:
    """(uniprot_id, ref_id) of equal sequences, outer * and X stripped, of at least min_len residues; of several reference
    proteins the last. uniprot(uniprot_id, seq), reference(ref_id, seq, ord)."""
    core = lambda c: F.trim(F.upper(F.coalesce(c, F.lit(""))), F.lit("*X"))
    ref = reference.select(core(F.col("seq")).alias("core"), "ref_id", "ord").where(F.length("core") >= min_len).groupBy("core").agg(F.max_by("ref_id", "ord").alias("ref_id"))
    return uniprot.select("uniprot_id", core(F.col("seq")).alias("core")).where(F.length("core") >= min_len).join(ref, "core").select("uniprot_id", "ref_id")


def uniprot_changed(matches: DataFrame, changed: DataFrame) -> DataFrame:
    """(uniprot_id, ref_id, n_forms, forms): distinct changed sequences of matched proteins, in order.

    changed(ref_id, seq)."""
    forms = changed.groupBy("ref_id").agg(F.array_join(F.sort_array(F.collect_set("seq")), ",").alias("forms"), F.count_distinct("seq").alias("n_forms"))
    return matches.join(forms, "ref_id").select("uniprot_id", "ref_id", "n_forms", "forms")
