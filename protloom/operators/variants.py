"""Variant tables: VCF filters, haplotypes, decomposition, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genotype as g
from ..functions.sequence import reverse_complement


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order (dropDuplicates leaves the choice open)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def filter_records(vcf: DataFrame, only_pass: bool = True, chromosomes: bool = True, info_field: str | None = None, info_threshold: float | None = None) -> DataFrame:
    """VCF rows that pass the FILTER, chromosome and INFO rules."""
    out = vcf
    if only_pass:
        out = out.where("filter = 'PASS'")
    if chromosomes:
        out = out.where(g.on_chromosome(F.col("chrom")))
    if info_field:
        out = out.where(g.info_passes(F.col("info"), info_field, info_threshold))
    return out


def haplotypes(vcf: DataFrame, sample: str, order: list[str], only_pass: bool = True, chromosomes: bool = True) -> DataFrame:
    """(hap, chr, pos, ref, alt) of one sample's two haplotypes: alleles other than the reference and *, the first of
    each (chr, pos, ref) in file order."""
    call = F.col(sample)
    rows = filter_records(vcf, only_pass, chromosomes).where(~g.homozygous_reference(call) & (g.genotype(call) != "."))
    # both haplotypes at once, in a generator: the filters below don't look each allele up again
    each = F.transform(g.alleles(call), lambda n, h: F.struct((h + 1).alias("hap"), g.allele_text(F.col("ref"), F.split("alt", ","), n).alias("alt")))
    rows = rows.select(F.col("chrom").alias("chr"), "pos", "ref", *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.inline(each))
    rows = rows.where("alt is not null and alt <> ref and alt <> '*'")
    return rows.groupBy("hap", "chr", "pos", "ref").agg(F.min_by("alt", F.struct(*[f"__o{i}" for i in range(len(order))])).alias("alt"))


def explode_alternatives(vcf: DataFrame, samples: list[str]) -> DataFrame:
    """One row per alternative allele, with <sample>__1 and <sample>__2 in {0, 1}; rows in which all samples are
    homozygous reference or missing go, as do alternatives * and those equal to ref. Haploid calls get 0 second."""
    rows = vcf.where(F.lit(False) if not samples else ~F.forall(F.array(*samples), g.homozygous_reference_or_missing)).where(~F.forall(F.array(*samples), g.missing))
    rows = rows.select("*", F.posexplode(F.split("alt", ",")).alias("__i", "__alt"))
    carried = [(F.get(g.alleles(F.col(s)), F.lit(h)) == F.col("__i") + 1).cast("int").alias(f"{s}__{h + 1}") for s in samples for h in (0, 1)]
    return rows.where("__alt <> ref and __alt <> '*'").select(*[c for c in vcf.columns if c not in ("alt", *samples)], F.col("__alt").alias("alt"), *carried)


def carriers(matrix: DataFrame, ids: list[str], samples: list[str]) -> DataFrame:
    """Wide 0/1 sample columns to rows (ids, sample, hap) of carriers only."""
    from ..functions.sequence import falsey

    wide = matrix.select(*ids, *[F.col(c).cast("string").alias(c) for c in samples])
    long = wide.unpivot(ids, samples, "column", "value").where(~falsey(F.col("value")))
    return long.select(*ids, F.substring_index("column", "__", 1).alias("sample"), F.substring_index("column", "__", -1).cast("int").alias("hap"))


def call_carriers(rows: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, ref, alt, i, hap): who carries which alternative, of rows(ids, ref, alt, calls) with all samples' cells in one
    array: the same as explode_alternatives() and carriers(), but only cells of carriers ever become rows."""
    rows = rows.where(~F.forall("calls", g.homozygous_reference_or_missing) & ~F.forall("calls", g.missing))
    some = F.filter(F.transform("calls", lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda x: ~g.homozygous_reference_or_missing(x["c"]))
    rows = rows.select(*ids, "ref", F.split("alt", ",").alias("__alts"), F.explode(some).alias("__x")).select(*ids, "ref", "__alts", F.col("__x.i").alias("i"), F.posexplode(g.alleles(F.col("__x.c"))).alias("__hap", "__number"))
    rows = rows.where("__number > 0").select(*ids, "ref", F.try_element_at("__alts", F.col("__number")).alias("alt"), "i", (F.col("__hap") + 1).alias("hap"))
    return rows.where("alt is not null and alt <> ref and alt <> '*'")


def split_complex(variants: DataFrame) -> DataFrame:
    """Multi-base substitutions as single ones: bases that differ among the first min(len) - 1, and always the tail from
    there on. Other rows stay as they are."""
    n = F.least(F.length("ref"), F.length("alt"))
    parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((F.col("pos") + i - 1).alias("pos"), F.when(i == n, F.substring("ref", i, F.length("ref"))).otherwise(F.substring("ref", i, F.lit(1))).alias("ref"), F.when(i == n, F.substring("alt", i, F.length("alt"))).otherwise(F.substring("alt", i, F.lit(1))).alias("alt"), (i == n).alias("tail")))
    whole = F.array(F.struct(F.col("pos").cast("bigint").alias("pos"), "ref", "alt", F.lit(True).alias("tail")))
    parts = F.transform(parts, lambda p: F.struct(p["pos"].cast("bigint").alias("pos"), p["ref"].alias("ref"), p["alt"].alias("alt"), p["tail"].alias("tail")))
    complex_ = (F.length("ref") > 1) & (F.length("alt") > 1)
    kept = [c for c in variants.columns if c not in ("pos", "ref", "alt")]
    rows = variants.select(*kept, F.explode(F.when(complex_, parts).otherwise(whole)).alias("p"))
    return rows.where("p.tail or p.ref <> p.alt").select(*kept, "p.pos", "p.ref", "p.alt")


def variant_id(chr: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws("-", chr.cast("string"), pos.cast("string"), ref, alt)


def edit_records(variants: DataFrame, strand: Column) -> DataFrame:
    """Edits of single bases: one base replaced by the whole alternative, or each base after the first deleted (the
    alternative's text plays no part then). Oriented to the strand; variant_id names the variant."""
    single = F.length("ref") == 1
    gone = F.transform(F.sequence(F.lit(1), F.greatest(F.length("ref") - 1, F.lit(1))), lambda i: F.struct((F.col("pos") + i).cast("bigint").alias("pos"), F.substring("ref", i + 1, F.lit(1)).alias("ref"), F.lit("").alias("alt")))
    one = F.array(F.struct(F.col("pos").cast("bigint").alias("pos"), F.col("ref").alias("ref"), F.col("alt").alias("alt")))
    kept = [c for c in variants.columns if c not in ("pos", "ref", "alt")]
    rows = variants.select(*kept, strand.alias("__strand"), variant_id(F.col("chr"), F.col("pos"), F.col("ref"), F.col("alt")).alias("variant_id"), F.explode(F.when(single, one).otherwise(gone)).alias("e"))
    turn = lambda c: F.when(F.col("__strand") == "-", reverse_complement(c)).otherwise(c)
    return rows.select(*kept, "variant_id", "e.pos", turn(F.col("e.ref")).alias("ref"), turn(F.col("e.alt")).alias("alt"))


def merge_haplotypes(changed: DataFrame, keys: list[str], hap: str = "hap") -> DataFrame:
    """Rows equal in keys on both haplotypes as one: label 1, 2 or 12."""
    return changed.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(F.col(hap).cast("string"))), "").alias("label"))


def manifest_merge(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Alleles of one variant and sample from several files: carried if any file says so."""
    return rows.groupBy(*keys, "sample").agg(F.max("hap1").alias("hap1"), F.max("hap2").alias("hap2"))


def sample_names(manifest: DataFrame) -> DataFrame:
    """(filepath, name): name_use, else sample, else the file's stem; names that occur twice give way to stems. Files whose
    names are then still equal are an error."""
    stem = F.regexp_replace(F.substring_index("filepath", "/", -1), r"(?i)\.vcf(\.gz|\.bgz)?$", "")
    named = manifest.select("filepath", stem.alias("stem"), F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in ("name_use", "sample") if c in manifest.columns], stem).alias("name"))
    twice = F.count("*").over(Window.partitionBy("name")) > 1
    named = named.select("filepath", F.when(twice, F.col("stem")).otherwise(F.col("name")).alias("name"))
    again = F.count("*").over(Window.partitionBy("name")) > 1
    return named.select("filepath", F.when(again, F.raise_error(F.concat(F.lit("several files of the manifest give the sample name "), "name")).cast("string")).otherwise(F.col("name")).alias("name"))
