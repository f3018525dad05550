"""Command line: build-store, build-matrix, run, proteins, digest, novel-peptides."""

from __future__ import annotations

import argparse
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import digest as dg
from .operators import peptides
from .plans import database
from .sources import faults, store, text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="protloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    inputs = argparse.ArgumentParser(add_help=False)
    for flag, name, text_ in (("-g", "--genome", "genome FASTA"), ("-f", "--gtf", "gene models"), ("-p", "--protein", "protein FASTA")):
        inputs.add_argument(flag, name, help=text_)
    inputs.add_argument("-a", "--datatype", default="auto", help="GENCODE_GTF, GENCODE_GFF3, RefSeq, Ensembl_GTF, gtf or auto")
    inputs.add_argument("-k", "--protein_keyword", default="auto")
    inputs.add_argument("-S", "--store", help="annotation store")
    inputs.add_argument("-o", "--out", required=True)
    sub.add_parser("build-store", parents=[inputs])
    digestion = argparse.ArgumentParser(add_help=False)
    digestion.add_argument("--enzyme", default="Trypsin")
    digestion.add_argument("--enzyme2")
    digestion.add_argument("--missed-cleavages", type=int, default=2)
    digestion.add_argument("-l", "--min-len", type=int, default=6)
    digestion.add_argument("-M", "--max-len", type=int, default=40)
    digestion.add_argument("--isobaric", action="store_true")
    digestion.add_argument("--initiator-methionine", default="both")
    digestion.add_argument("--specificity", default="full")
    digestion.add_argument("--cleavage-regex")
    digestion.add_argument("--cleavage-regex2")
    digestion.add_argument("-c", "--sites", help="residues to cut at instead of the enzyme's")
    digestion.add_argument("-n", "--anti-sites", help="residues that forbid a cut")
    digestion.add_argument("--position", choices=("c", "n"), help="end of the site that is cut")
    digestion.add_argument("--nterm-attach", default="")
    digestion.add_argument("--cterm-attach", default="")
    run = sub.add_parser("run", parents=[inputs, digestion])
    run.add_argument("--novel_peptides", action="store_true", help="also write peptides that no reference protein has")
    run.add_argument("--quarantine", help="also write lines of the VCF and the gene models that can't be read, with the reason")
    run.add_argument("--cds_only", action="store_true", help="gene models without exons beyond the coding blocks")
    run.add_argument("--resume", help="folder of this run's finished contigs, which aren't computed again")
    run.add_argument("--matrix", help="genotype matrix of build-matrix, instead of -m")
    run.add_argument("-m", "--mutations", default="", help="VCF files, a manifest of them, a variant TSV, or literals like chr1-942451-T-C,...")
    run.add_argument("-s", "--sample", default="", help="sample, comma list, ALL_SAMPLES or ALL_VARIANTS; empty: a VCF's first, all of a table")
    run.add_argument("-F", "--no_filter", action="store_true", help="keep records that didn't pass")
    run.add_argument("-A", "--all_chromosomes", action="store_true")
    run.add_argument("-U", "--uniprot", help="UniProt FASTA: also write its changed proteins")
    run.add_argument("--cohort_table", help="also write the carried variants as a table of samples")
    run.add_argument("--info_field")
    run.add_argument("--info_field_thres", type=float)
    packed = sub.add_parser("build-matrix", help="genotypes of a cohort's VCF files as bits, for many runs")
    packed.add_argument("-m", "--mutations", required=True)
    packed.add_argument("-o", "--out", required=True)
    packed.add_argument("-F", "--no_filter", action="store_true")
    packed.add_argument("-A", "--all_chromosomes", action="store_true")
    packed.add_argument("--info_field")
    packed.add_argument("--info_field_thres", type=float)
    listed = sub.add_parser("proteins", help="proteins of a store as FASTA")
    listed.add_argument("-S", "--store", required=True)
    listed.add_argument("-o", "--out", required=True)
    one = sub.add_parser("digest", parents=[digestion])
    one.add_argument("fasta", nargs="+")
    one.add_argument("-o", "--out", required=True)
    one.add_argument("--output-format", choices=("tsv", "peptide", "fasta"), default="tsv")
    one.add_argument("--header-template", default="{protein_id}_{index}", type=dg.check_template)
    novel = sub.add_parser("novel-peptides", parents=[digestion])
    novel.add_argument("--reference", required=True)
    novel.add_argument("--changed", required=True)
    novel.add_argument("--index", help="folder of a peptide index, built if it isn't one of these proteins and rules")
    novel.add_argument("--rebuild-index", action="store_true")
    novel.add_argument("-o", "--out", required=True)
    return p


def profile(a: argparse.Namespace) -> dg.Profile:
    return dg.Profile(a.enzyme, a.enzyme2, a.missed_cleavages, a.min_len, a.max_len, a.isobaric, a.initiator_methionine, a.specificity, a.nterm_attach, a.cterm_attach, a.sites, a.anti_sites, a.position, a.cleavage_regex, a.cleavage_regex2)


#: Literal variants, one or several.
LITERALS = re.compile(r"[0-9A-Za-z_.]+-\d+-[A-Za-z]+-[A-Za-z]+(,\s*[0-9A-Za-z_.]+-\d+-[A-Za-z]+-[A-Za-z]+)*")


def carried_variants(spark: SparkSession, a: argparse.Namespace):
    """Carried variants of what -m names: literals, a manifest, VCF files or a table."""
    filters = (not a.no_filter, not a.all_chromosomes, a.info_field, a.info_field_thres)
    if not a.matrix and LITERALS.fullmatch(a.mutations.strip()):
        return text.literal_variants(spark.createDataFrame([(a.mutations,)], "v string"), "v", any_name=True).withColumn("sample", F.lit("1"))
    paths = a.mutations.split(",")
    if a.matrix:
        return database.by_matrix(spark, a.matrix, a.sample)
    if ".vcf" in a.mutations.lower():
        if a.sample in ("ALL_SAMPLES", "ALL_VARIANTS") or "," in a.sample or a.info_field:
            return database.by_sample(spark, paths, a.sample, *filters)
        return database.by_haplotype(spark, paths, a.sample, *filters[:2])
    if text.is_manifest(spark, a.mutations):
        return database.by_manifest(spark, a.mutations, *filters)
    return text.table_carriers(spark, paths, a.sample or "ALL_SAMPLES")


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("protloom").getOrCreate()
    if a.command == "build-store":
        database.build_store(spark, a.genome, a.gtf, a.protein, a.out, a.datatype, a.protein_keyword)
    elif a.command == "build-matrix":
        database.build_matrix(spark, a.mutations.split(","), a.out, not a.no_filter, not a.all_chromosomes, a.info_field, a.info_field_thres)
    elif a.command == "run":
        if not (a.mutations or a.matrix):
            raise ValueError("run needs -m or --matrix")
        if a.quarantine:
            vcf = a.mutations.split(",") if ".vcf" in a.mutations.lower() and not a.matrix else None
            for r in faults.quarantine(spark, a.quarantine, vcf, None if a.store else a.gtf).collect():
                print(f"{r['kind']}: {r['n']} lines can't be read: {r['reason']}")
        if a.store:
            m, contigs = database.from_store(spark, a.store)
            reference = m.proteins.select(F.col("fasta_id").alias("id"), "description", F.col("aa").alias("seq"))
        else:
            (genome, contigs), reference = text.read_genome(spark, a.genome, database.TILE), text.read_fasta(spark, a.protein)
            m = database.models(genome, text.read_gtf(spark, a.gtf), reference, text.sniff_datatype(spark, a.gtf, a.datatype), a.protein_keyword, a.cds_only)
        carried = database.in_genome(carried_variants(spark, a), contigs)
        if a.store and not a.matrix and LITERALS.fullmatch(a.mutations.strip()):
            m = database.Models(m.proteins, store.touched_blocks(spark, a.store, carried))
        forms = (database.translated_by_contig(m, carried, a.resume) if a.resume else database.translated(m, carried)).persist()
        forms.select("protein_id", "samples", "status").write.mode("overwrite").csv(f"{a.out}/protein_status", sep="\t", header=True)
        changed = database.changed_forms(m, forms)
        n_samples = carried.select("sample").distinct().count()
        database.write_outputs(m, reference, changed, a.out, max(1, n_samples))
        if a.uniprot:
            database.write_uniprot(m, reference, text.read_fasta(spark, a.uniprot), changed, a.out)
        if a.novel_peptides:
            p = profile(a)
            index = peptides.ensure_index(reference, ["id"], "seq", p, peptides.default_index_path(a.store, p)) if a.store else peptides.peptide_index(reference, ["id"], "seq", p)
            table, records = peptides.novel_table(changed, index, p)
            table.write.mode("overwrite").csv(f"{a.out}/peptide_novel_table", sep="\t", header=True)
            records.write.mode("overwrite").text(f"{a.out}/peptide_novel")
        if a.cohort_table:
            database.write_cohort(carried, a.cohort_table)
    elif a.command == "proteins":
        database.proteins_of(database.from_store(spark, a.store)[0], a.out)
    elif a.command == "digest":
        proteins = text.read_fasta(spark, a.fasta, ordered=True)
        found = dg.digest(proteins, ["id", "description", "line"], "seq", profile(a))
        if a.output_format == "fasta":
            rows = found.withColumnsRenamed({"id": "protein_id", "description": "header"})
            dg.fasta_records(rows, ["line", "start", "end"], a.header_template).write.mode("overwrite").text(a.out)
        elif a.output_format == "tsv":
            found.select("id", "peptide", "start", "end").write.mode("overwrite").csv(a.out, sep="\t")
        else:
            found.select("peptide").distinct().write.mode("overwrite").text(a.out)
    else:
        p = profile(a)
        reference = text.read_fasta(spark, a.reference)
        index = peptides.ensure_index(reference, ["id"], "seq", p, a.index, a.rebuild_index) if a.index else peptides.peptide_index(reference, ["id"], "seq", p)
        fresh = peptides.novel(dg.digest(text.read_fasta(spark, a.changed), ["id"], "seq", p), index)
        peptides.numbered(fresh).write.mode("overwrite").csv(a.out, sep="\t", header=True)


if __name__ == "__main__":
    main()
