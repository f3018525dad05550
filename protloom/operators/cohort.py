"""Cohorts: samples that carry the same variants of a protein are one piece of work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_patterns(carried: DataFrame, protein: str = "protein_id", sample: str = "sample", variant: str = "variant_id") -> DataFrame:
    """(protein, pattern, n_samples, samples): samples with the same set of a protein's variants, once per set.

    carried(protein, sample, variant) holds carriers only. A set is known by the number and the exclusive or of its variants'
    hashes (twice 64 bits), whatever their order: samples are grouped by that, and only one sample's variants are listed for
    each set. Carriers are shuffled once, by protein and sample.
    """
    groups, first = _pattern_groups(carried, protein, sample, variant)
    listed = first.groupBy(protein, "__set").agg(F.array_join(F.sort_array(F.collect_list(variant)), ",").alias("pattern"))
    return groups.join(listed, [protein, "__set"]).select(protein, "pattern", "n_samples", "samples")


def pattern_variants(carried: DataFrame, protein: str = "protein_id", sample: str = "sample", variant: str = "variant_id") -> DataFrame:
    """sample_patterns() with variants: each pattern's ids as an array, in order (ids may hold commas)."""
    groups, first = _pattern_groups(carried, protein, sample, variant)
    listed = first.groupBy(protein, "__set").agg(F.sort_array(F.collect_list(variant)).alias("variants"))
    return groups.join(listed, [protein, "__set"]).select(protein, F.array_join("variants", ",").alias("pattern"), "n_samples", "samples", "variants")


def _pattern_groups(carried: DataFrame, protein: str, sample: str, variant: str) -> tuple[DataFrame, DataFrame]:
    """(protein, __set, n_samples, samples), and (protein, __set, variant) of the least sample of each set."""
    each = carried.select(protein, sample, variant).where(F.col(variant).isNotNull()).repartition(protein, sample).distinct()
    hashed = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), F.col(variant).cast("string")))
    sets = each.groupBy(protein, sample).agg(F.struct(F.count("*").alias("n"), hashed(1).alias("a"), hashed(2).alias("b")).alias("__set"))
    groups = sets.groupBy(protein, "__set").agg(F.count("*").alias("n_samples"), F.array_join(F.sort_array(F.collect_list(F.col(sample).cast("string"))), ",").alias("samples"), F.min(sample).alias(sample))
    return groups.drop(sample), each.join(groups.select(protein, "__set", sample), [protein, sample]).select(protein, "__set", variant)


def wide(carried: DataFrame, keys: list[str], names: list[str], sample: str = "sample") -> DataFrame:
    """carried(keys, sample) with a 0/1 column for each of a bounded number of samples."""
    return carried.groupBy(*keys).pivot(sample, names).agg(F.lit(1)).na.fill(0, names)


def collapse_individuals(rows: DataFrame, keys: list[str], individual: str = "individual") -> DataFrame:
    """Rows equal in all keys (nulls included) as one, with their individuals in order."""
    return rows.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(F.col(individual).cast("string"))), ",").alias("individuals"))


def numbered_forms(rows: DataFrame, protein: str, order: list[str]) -> DataFrame:
    """Forms of a protein numbered from 1, and named <protein>__<number>."""
    n = F.row_number().over(Window.partitionBy(protein).orderBy(*order))
    return rows.withColumn("form", n).withColumn("form_id", F.concat_ws("__", F.col(protein).cast("string"), F.col("form").cast("string")))


def still_unchanged(proteins: DataFrame, changed: DataFrame, n_samples: int, key: str) -> DataFrame:
    """proteins of which not every sample carries a changed form; changed(key, sample)."""
    all_of = changed.groupBy(key).agg(F.count_distinct("sample").alias("__n")).where(F.col("__n") >= n_samples)
    return proteins.join(all_of, key, "left_anti")
