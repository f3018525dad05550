"""From genome, gene models, proteins and variants to an annotated protein database, as one lazy plan."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement, translate
from ..operators import annotate, cohort, intervals, matrix, outputs, transcripts, variants
from ..sources import store, text

TILE = 65_536
#: The attribute that names a protein, by the kind of gene model.
KEYWORDS = {"GENCODE_GTF": "transcript_id", "GENCODE_GFF3": "Parent", "RefSeq": "protein_id", "Ensembl_GTF": "protein_id"}


@dataclass
class Models:
    """proteins(protein_id, description, seqname, strand, frame, cds, aa, translated): cds oriented, frame bases gone;
    blocks(protein_id, seqname, strand, frame, start, end, before, total)."""

    proteins: DataFrame
    blocks: DataFrame


def keyword(datatype: str, given: str = "auto") -> str:
    return given if given != "auto" else KEYWORDS.get(datatype, "Parent")


def models(genome: DataFrame, gtf: DataFrame, fasta: DataFrame, datatype: str = "gtf", protein_keyword: str = "auto", cds_only: bool = False) -> Models:
    """Gene models of proteins that stand in the genome; genome: read_genome's tiles, or (id, seq) of short contigs; gtf as
    read_gtf gives it, fasta as parse_fasta. cds_only leaves exons out, so that no model reaches beyond its coding blocks."""
    proteins = fasta.select(transcripts.protein_id(F.col("id"), F.lit(datatype)).alias("protein_id"), F.col("id").alias("fasta_id"), "description", F.col("seq").alias("aa")).dropDuplicates(["protein_id"])
    named = transcripts.protein_id(F.try_element_at(text.attributes(F.col("attributes")), F.lit(keyword(datatype, protein_keyword))), F.lit("Ensembl" if datatype.startswith("Ensembl") else "gtf"))
    rows = gtf.where(F.col("feature").isin("CDS", *([] if cds_only else ["exon"]))).select("seqname", "feature", "start", "end", "strand", "frame", named.alias("protein_id"), (F.col("line") if "line" in gtf.columns else F.monotonically_increasing_id()).alias("line_no")).where("protein_id is not null")
    placed = transcripts.first_chromosome(rows.where("feature = 'CDS'"), "protein_id", "seqname", "line_no").join(proteins.select("protein_id"), "protein_id", "left_semi")
    rows = transcripts.models_of(rows, placed.select("protein_id", F.col("chrom").alias("seqname")), ["protein_id", "seqname"])
    keys = ["protein_id", "seqname", "strand"]
    blocks = transcripts.cds_plus(rows, keys).withColumn("frame", F.coalesce("frame", F.lit(0)))
    blocks = transcripts.cds_offsets(blocks, ["protein_id"])
    tiled = genome if "tile" in genome.columns else transcripts.tiles(genome.select(F.col("id").alias("seqname"), "seq"), "seqname", "seq", TILE)
    parts = transcripts.slices(blocks, tiled, "seqname", TILE, ["protein_id", "strand", "frame", "before"])
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("before", "bases"))), lambda x: x["bases"]), "")
    cds = parts.groupBy("protein_id", "strand", "frame").agg(whole.alias("g")).withColumn("g", F.when(F.col("strand") == "-", reverse_complement(F.col("g"))).otherwise(F.col("g")))
    cds = cds.withColumn("cds", F.substring(F.col("g"), F.col("frame") + 1, F.length("g"))).withColumn("translated", F.substring_index(translate(F.col("cds")), "*", 1))
    out = proteins.join(cds.select("protein_id", "strand", "frame", "cds", "translated"), "protein_id").join(placed.select("protein_id", F.col("chrom").alias("seqname")), "protein_id")
    out = out.withColumn("aa", F.when((F.col("frame") != 0) & F.col("aa").startswith("X"), F.substring("aa", F.lit(2), F.length("aa"))).otherwise(F.col("aa")))
    trimmed = annotate.nonstandard_stop(F.length("aa"), F.length("translated"), F.length("cds"))
    out = out.withColumn("nonstandard_stop", trimmed).withColumn("cds", F.when(trimmed, F.substring("cds", F.lit(1), F.length("aa") * 3)).otherwise(F.col("cds")))
    if datatype == "RefSeq":
        out = out.where(transcripts.consistent(F.col("aa"), F.col("translated"), F.col("cds"), F.lit(0)))
    return Models(out, blocks)


def translated(m: Models, carried: DataFrame) -> DataFrame:
    """Each protein with each set of variants that some samples carry: protein_id, pattern, samples, n_samples, aa, the
    annotation columns of annotate.changes, and status: changed, unchanged, or unaligned (no codon of the edited sequence
    begins where one of the protein's does, so that nothing can be said; its annotation is null).

    carried(chr, pos, ref, alt, sample): variants by carrier (a sample or haplotype); chr are the genome's names. Samples
    with the same variants of a protein are translated once.
    """
    v = variants.split_complex(carried.select("chr", "pos", "ref", "alt", "sample")).withColumn("pos_end", F.col("pos") + F.length("ref") - 1).withColumnRenamed("chr", "seqname")
    v = v.withColumn("variant_id", variants.variant_id(F.col("seqname"), F.col("pos"), F.col("ref"), F.col("alt")))
    hits = intervals.interval_join(v, m.blocks, keys=("seqname",))
    groups = cohort.pattern_variants(hits.select("protein_id", "sample", "variant_id"))
    keys = ["protein_id", "pattern"]
    one = hits.select("protein_id", "variant_id", F.col("seqname").alias("chr"), "pos", "ref", "alt", "strand", "frame", "start", "before", "total").distinct()
    each = groups.select(*keys, F.explode("variants").alias("variant_id")).join(one, ["protein_id", "variant_id"])
    edits = variants.edit_records(each.drop("variant_id"), F.col("strand"))
    at = transcripts.coding_offset(F.col("pos"), F.col("start"), F.col("before"), F.col("total"), F.col("strand")) - F.col("frame")
    edits = edits.select(*keys, at.cast("int").alias("i"), "ref", "alt", "variant_id").where("i >= 0")
    proteins = m.proteins.select("protein_id", "cds", "aa").join(groups.select(*keys), "protein_id")
    out = annotate.changes(annotate.with_edits(proteins.select(*keys, "cds", "aa"), edits, keys), keys)
    out = proteins.select(*keys, "aa").join(groups.drop("variants"), keys).join(out, keys, "left")
    return out.withColumn("status", F.when(F.col("new_aa").isNull(), "unaligned").when(F.col("new_aa") == F.col("aa"), "unchanged").otherwise("changed"))


def translated_by_contig(m: Models, carried: DataFrame, folder: str) -> DataFrame:
    """translated(), computed and stored contig by contig: a run that was stopped takes up where it was.

    Each contig's forms are written whole or not at all, and its name is noted after that; contigs noted in the folder aren't
    computed again, so the folder belongs to one set of models and variants. A store's other contigs aren't read meanwhile.
    """
    spark = carried.sparkSession
    contigs = sorted(r[0] for r in m.blocks.select("seqname").distinct().collect())
    done = {r[0] for r in spark.read.schema("value string").text(f"{folder}/done/*").collect()} if _exists(spark, f"{folder}/done") else set()
    for name in contigs:
        if name not in done:
            own = lambda df, c="seqname": df.where(F.col(c) == name)
            part = hashlib.sha256(name.encode()).hexdigest()[:24]
            translated(Models(own(m.proteins), own(m.blocks)), own(carried, "chr")).write.mode("overwrite").parquet(f"{folder}/forms/contig={part}")
            spark.createDataFrame([(name,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/done/{part}")
    return spark.read.parquet(f"{folder}/forms").drop("contig")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def changed_proteins(m: Models, carried: DataFrame) -> DataFrame:
    """Changed forms of proteins, of translated()."""
    return changed_forms(m, translated(m, carried))


def changed_forms(m: Models, forms: DataFrame) -> DataFrame:
    """Of translated()'s rows those that changed, with form and form_id and what is known of the protein."""
    out = forms.where("status = 'changed'").drop("status")
    about = m.proteins.select("protein_id", "fasta_id", "description", "seqname", "strand", "frame", "nonstandard_stop")
    out = cohort.numbered_forms(out, "protein_id", ["pattern"]).join(about, "protein_id")
    return out.withColumn("new_aa", F.when(F.col("frame") != 0, F.concat(F.lit("X"), F.col("new_aa"))).otherwise(F.col("new_aa")))


def by_haplotype(spark: SparkSession, paths: str | list[str], sample: str = "", only_pass: bool = True, chromosomes: bool = True) -> DataFrame:
    """Carried variants of one sample's haplotypes 1 and 2 from VCF files; without any sample all variants, as by_sample."""
    vcf = text.read_vcf(spark, paths, sample or "")
    names = [c for c in vcf.columns[len(text.VCF_FIXED) :] if c != "line"]
    if not names:
        return by_sample(spark, paths, "ALL_VARIANTS", only_pass, chromosomes)
    return variants.haplotypes(vcf, names[0], ["line"], only_pass, chromosomes).withColumn("sample", F.col("hap").cast("string")).drop("hap")


def by_sample(spark: SparkSession, paths: str | list[str], samples: str | list[str] = "ALL_SAMPLES", only_pass: bool = True, chromosomes: bool = True, info_field: str | None = None, info_threshold: float | None = None) -> DataFrame:
    """Carried variants of a cohort's haplotypes (<sample>__1, <sample>__2) from VCF files. ALL_VARIANTS: each alternative
    of each line, whoever carries it, as those of one sample, 1."""
    known = text.vcf_samples(spark, paths)
    wanted = text.wanted_samples(known, samples)
    rows = variants.filter_records(text.parse_calls(text.read_lines(spark, paths)), only_pass, chromosomes, info_field, info_threshold).withColumnRenamed("chrom", "chr")
    if not wanted:
        each = rows.select("chr", "pos", "ref", F.explode(F.split("alt", ",")).alias("alt")).where("alt <> ref and alt <> '*'")
        return each.distinct().withColumn("sample", F.lit("1"))
    if len(wanted) < len(known):
        places = [known.index(s) for s in wanted]
        rows = rows.withColumn("calls", F.array(*[F.get("calls", F.lit(i)) for i in places]) if len(places) <= 50 else F.transform(F.array(*map(F.lit, places)), lambda i: F.get(F.col("calls"), i)))
    long = variants.call_carriers(rows, ["chr", "pos"]).join(text.named(spark, wanted, wanted), "i")
    return long.select("chr", "pos", "ref", "alt", F.concat_ws("__", "sample", F.col("hap").cast("string")).alias("sample"))


def build_matrix(spark: SparkSession, paths: str | list[str], out: str, only_pass: bool = True, chromosomes: bool = True, info_field: str | None = None, info_threshold: float | None = None) -> None:
    """Writes the genotypes of a cohort's VCF files as a matrix of bits, for many runs."""
    names = text.vcf_samples(spark, paths)
    rows = variants.filter_records(text.with_cells(text.read_lines(spark, paths)), only_pass, chromosomes, info_field, info_threshold).withColumnRenamed("chrom", "chr")
    matrix.write(matrix.pack(rows, ["chr", "pos"], len(names)), names, out)


def by_matrix(spark: SparkSession, folder: str, samples: str | list[str] = "ALL_SAMPLES") -> DataFrame:
    """Carried variants as by_sample's, of a matrix: only the blocks of the samples wanted are read. ALL_VARIANTS: each
    alternative that anybody carries."""
    bits, known = matrix.read(spark, folder)
    wanted = text.wanted_samples(known, samples)
    if not wanted:
        return bits.select("chr", "pos", "ref", "alt").distinct().withColumn("sample", F.lit("1"))
    keep = None if len(wanted) == len(known) else [i for i, s in enumerate(known) if s in set(wanted)]
    long = matrix.carriers(bits, ["chr", "pos"], keep).join(text.named(spark, known, wanted), "i")
    return long.select("chr", "pos", "ref", "alt", F.concat_ws("__", "sample", F.col("hap").cast("string")).alias("sample"))


def by_manifest(spark: SparkSession, path: str, only_pass: bool = True, chromosomes: bool = True, info_field: str | None = None, info_threshold: float | None = None) -> DataFrame:
    """Carried variants of a cohort of one VCF file per sample, listed in a manifest. All files are read as one table; the
    manifest's row tells each file's sample column (the first if it isn't given or `default`) and the name to use."""
    listed = text.read_manifest(spark, path)
    files = [r["filepath"] for r in listed.select("filepath").distinct().collect()]
    tail = lambda c: F.regexp_replace(c, r"^(file:)?/*", "")
    lines = text.read_lines(spark, files).withColumn("file", tail(F.col("line.file")))
    heads = lines.where(F.col("value").startswith("#CHROM")).select("file", F.slice(F.split("value", "\t"), 10, 1 << 20).alias("names"))
    of = listed.select(tail(F.col("filepath")).alias("file"), "filepath", (F.col("sample") if "sample" in listed.columns else F.lit(None).cast("string")).alias("asked"))
    of = of.join(variants.sample_names(listed.select("filepath", *[F.when(F.col(c) != "default", F.col(c)).alias(c) for c in ("sample", "name_use") if c in listed.columns])), "filepath").join(heads, "file")
    of = of.select("file", "name", F.greatest(F.array_position("names", F.coalesce("asked", F.lit(""))).cast("int") - 1, F.lit(0)).alias("place"))
    rows = variants.filter_records(text.parse_calls(lines), only_pass, chromosomes, info_field, info_threshold).withColumnRenamed("chrom", "chr").join(of, "file")
    own = variants.call_carriers(rows.withColumn("calls", F.array(F.get("calls", F.col("place")))), ["chr", "pos", "name"])
    return own.select("chr", "pos", "ref", "alt", F.concat_ws("__", "name", F.col("hap").cast("string")).alias("sample")).distinct()


def in_genome(carried: DataFrame, contigs: DataFrame) -> DataFrame:
    """carried with the genome's contig names; contigs(id, description)."""
    names = transcripts.resolve_contigs(carried.select(F.col("chr").alias("name")), contigs)
    return carried.join(names.withColumnRenamed("name", "chr"), "chr").withColumn("chr", F.col("contig")).drop("contig")


def _write_text(df: DataFrame, path: str, line: Column) -> None:
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def write_cohort(carried: DataFrame, path: str) -> None:
    """A cohort's carried variants as a table with a 0/1 column for each sample or haplotype, the columns in order of their
    names (for a bounded number of samples; the long form stays the way to work with any)."""
    names = [r[0] for r in carried.select("sample").distinct().orderBy("sample").collect()]
    cohort.wide(carried, ["chr", "pos", "ref", "alt"], names).write.mode("overwrite").csv(path, sep="\t", header=True)


def proteins_of(m: Models, out: str) -> None:
    """A store's proteins as FASTA."""
    _write_text(m.proteins, out, outputs.fasta_line(F.col("description"), F.col("aa")))


def write_uniprot(m: Models, reference: DataFrame, uniprot: DataFrame, changed: DataFrame, out: str) -> None:
    """Changed forms of UniProt proteins, which are matched with reference proteins by sequence: a table, the changed forms
    and all UniProt proteins as FASTA, and PEFF; uniprot and reference as parse_fasta gives them."""
    ref = reference.select(F.col("id").alias("ref_id"), "seq", F.col("id").alias("ord"))
    matches = outputs.uniprot_match(uniprot.select(F.col("id").alias("uniprot_id"), "seq"), ref).persist()
    forms = matches.join(changed.select(F.col("fasta_id").alias("ref_id"), "new_aa", "form", "variant_aa"), "ref_id")
    table = outputs.uniprot_changed(matches, changed.select(F.col("fasta_id").alias("ref_id"), F.col("new_aa").alias("seq")))
    table.write.mode("overwrite").csv(f"{out}/uniprot_changed_table", sep="\t", header=True)
    header = F.concat(F.lit(">"), F.col("uniprot_id"), F.lit("__"), F.col("form").cast("string"), F.lit("\tchanged\n"), F.col("new_aa"))
    _write_text(forms, f"{out}/uniprot_changed", header)
    same = uniprot.join(forms.select(F.col("uniprot_id").alias("id")).distinct(), "id", "left_anti")
    lines = forms.select(header.alias("value")).unionByName(same.select(F.concat(F.lit(">"), F.col("description"), F.lit("\tunchanged\n"), F.col("seq")).alias("value")))
    lines.write.mode("overwrite").text(f"{out}/uniprot_all")
    simple = forms.groupBy("uniprot_id").agg(F.array_join(F.array_distinct(F.flatten(F.collect_list(F.split("variant_aa", ";")))), ";").alias("variant_aa"))
    _write_peff(outputs.peff(uniprot.select(F.col("id").alias("uniprot_id"), F.col("seq").alias("aa")), simple, "uniprot_id", "aa"), f"{out}/uniprot_peff")
    matches.unpersist()


def _write_peff(records: DataFrame, path: str) -> None:
    """PEFF records as text, and the file's head, which counts them, as head/ beside them."""
    _write_text(records, f"{path}/records", F.concat("header", F.lit("\n"), "aa"))
    head = outputs.peff_preamble(records.sparkSession.read.text(f"{path}/records").where(F.col("value").startswith(">")).count())
    records.sparkSession.createDataFrame([(line,) for line in head], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


def write_outputs(m: Models, reference: DataFrame, changed: DataFrame, out: str, n_samples: int = 1) -> None:
    """Annotation table, changed and all proteins as FASTA, and PEFF, each a folder below `out`; reference as
    parse_fasta gives it. Proteins that aren't in the genome count as unchanged, as do those that not all of n_samples
    samples or haplotypes have in a changed form."""
    changed = changed.persist()
    changed.drop("aa", "pattern").write.mode("overwrite").csv(f"{out}/aa_mutations", sep="\t", header=True)
    header = F.concat(F.lit(">"), F.col("form_id"), F.lit("\tchanged\n"), F.col("new_aa"))
    _write_text(changed, f"{out}/protein_changed", header)
    ref = reference.select(F.col("id").alias("fasta_id"), "description", F.col("seq").alias("aa"))
    same = cohort.still_unchanged(ref, changed.select("fasta_id", F.explode(F.split("samples", ",")).alias("sample")), n_samples, "fasta_id")
    lines = changed.select(header.alias("value")).unionByName(same.select(F.concat(F.lit(">"), F.col("description"), F.lit("\tunchanged\n"), F.col("aa")).alias("value")))
    lines.write.mode("overwrite").text(f"{out}/protein_all")
    simple = changed.groupBy("protein_id").agg(F.array_join(F.array_distinct(F.flatten(F.collect_list(F.split("variant_aa", ";")))), ";").alias("variant_aa"))
    peff = outputs.peff(m.proteins.select("protein_id", "aa"), simple, "protein_id", "aa")
    _write_peff(peff, f"{out}/protein_peff")
    changed.unpersist()


def build_store(spark: SparkSession, genome: str, gtf: str, fasta: str, path: str, datatype: str = "auto", protein_keyword: str = "auto") -> None:
    """Writes proteins, blocks and contigs once, for many variant sets."""
    datatype = text.sniff_datatype(spark, gtf, datatype)
    tiles, contigs = text.read_genome(spark, genome, TILE)
    m = models(tiles, text.read_gtf(spark, gtf), text.read_fasta(spark, fasta), datatype, protein_keyword)
    store.write_store(path, m.proteins, m.blocks, contigs)


def from_store(spark: SparkSession, path: str) -> tuple[Models, DataFrame]:
    """(models, contigs) of a store."""
    return Models(store.read_store(spark, path, "proteins"), store.read_store(spark, path, "blocks")), store.read_store(spark, path, "contigs")
