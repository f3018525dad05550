"""Genomics text formats as DataFrames: FASTA, GTF/GFF3, VCF, variant TSV, manifests, literal variants.

Each format has a parser on a DataFrame of raw text (column value), and a reader that loads files into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.once import computed
from ..functions.sequence import falsey
from . import bgzf

VCF_FIXED = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")
GTF_COLUMNS = ("seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")


def split_once(rows: DataFrame, name: str, limit: int = -1, value: str = "value") -> DataFrame:
    """rows with an array, called name, of a tab-separated column's parts in place of that column. Each line is split once;
    filters on other columns, parts of an earlier split included, come before it."""
    return computed(rows, name, F.split(value, "\t", limit)).drop(value)


def data_lines(rows: DataFrame, parts: str) -> DataFrame:
    """Without comments and empty lines."""
    first = F.get(parts, F.lit(0))
    return rows.where(~F.startswith(first, F.lit("#")) & ((first != "") | (F.size(parts) > 1)))


def parse_fasta(records: DataFrame) -> DataFrame:
    """(id, annotation, description, seq) of FASTA records, one to a row: header and sequence lines. The id is the
    header's first word; line ends and outer * of the sequence go."""
    text = F.regexp_replace("value", "^>", "")
    header = F.regexp_extract(text, r"^([^\r\n]*)", 1)
    seq = F.trim(F.upper(F.regexp_replace(F.regexp_replace(text, r"^[^\r\n]*", ""), r"\s+", "")), F.lit("*"))
    more = [c for c in records.columns if c != "value"]
    rows = records.select(header.alias("description"), seq.alias("seq"), *more).where("description <> ''")
    return rows.select(F.regexp_extract("description", r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace("description", r"^\S*", "")).alias("annotation"), "description", "seq", *more)


def read_fasta(spark: SparkSession, path: str | list[str], ordered: bool = False) -> DataFrame:
    """FASTA files, compressed ones included, split at record starts: a large plain file is read by many tasks. With ordered
    also line, the records' order (see line_order)."""
    rows = spark.read.text(path, lineSep="\n>")
    return parse_fasta(rows.select("value", line_order().alias("line")) if ordered else rows)


def line_order() -> Column:
    """A column of read text whose order is that of lines: by file, part of the file, and line within the part. Spark deals
    parts of files to partitions by their size, so row numbers alone don't follow the files."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row"))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, line): lines of text files without their ends, and their order. Plain and block-compressed (bgzip) files are
    split over tasks; other compressed ones are one task each."""
    blocks, others = bgzf.told_apart(spark, path)
    plain = spark.read.text(others).select(F.rtrim("value", F.lit("\r")).alias("value"), line_order().alias("line")) if others else None
    if not blocks:
        return plain
    packed = bgzf.read_bgzf_lines(spark, blocks)
    return packed if plain is None else plain.unionByName(packed)


def parse_genome(lines: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(tiles(seqname, tile, bases), contigs(id, description)) of read_lines() of FASTA files.

    No contig is ever one row: each line's place in its contig is the number of bases before it, summed within each part
    of a file and carried on from part to part by a table of one row a part; lines are then grouped into tiles.
    """
    part = ["file", "part"]
    head = F.col("value").startswith(">")
    rows = lines.where("value <> ''").select("line.*", "value", head.alias("head")).withColumn("size", F.when(F.col("head"), 0).otherwise(F.length("value")).cast("bigint"))
    within = Window.partitionBy(*part).orderBy("row")
    latest = F.max(F.when(F.col("head"), F.struct("at", "row", F.col("value").alias("name"))))
    rows = rows.withColumn("at", F.sum("size").over(within) - F.col("size")).withColumn("from", latest.over(within))
    before = Window.partitionBy("file").orderBy("part")
    ends = rows.groupBy(*part).agg(F.sum("size").alias("size"), latest.alias("last"))
    ends = ends.withColumn("tail", F.col("size") - F.coalesce("last.at", F.lit(0))).withColumn("run", F.count("last").over(before))
    ends = ends.withColumn("open", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("part")))
    carried = ends.select(*part, F.lag("open").over(before).alias("open"), F.last("last.name", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("open_name"))
    placed = rows.where("not head").join(carried, part)
    at = F.col("at") - F.coalesce("from.at", F.lit(0)) + F.when(F.col("from").isNull(), F.coalesce("open", F.lit(0))).otherwise(0)
    name = F.coalesce("from.name", "open_name")
    id_ = lambda c: F.regexp_extract(c, r"^>(\S*)", 1)
    placed = placed.select(id_(name).alias("seqname"), at.alias("at"), F.upper("value").alias("value"), "size").where("seqname <> ''")
    cut = placed.select("*", F.explode(F.sequence(F.floor(F.col("at") / width), F.floor((F.col("at") + F.col("size") - 1) / width))).alias("tile"))
    lo = F.greatest(F.col("tile") * width - F.col("at"), F.lit(0))
    piece = F.struct(F.greatest(F.col("at"), F.col("tile") * width).alias("at"), F.substring("value", (lo + 1).cast("int"), F.least(F.lit(width), (F.col("tile") + 1) * width - F.col("at") - lo).cast("int")).alias("b"))
    tiles = cut.groupBy("seqname", "tile").agg(F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["b"]), "").alias("bases"))
    contigs = lines.where(head).select(id_(F.col("value")).alias("id"), F.substring("value", F.lit(2), F.length("value")).alias("description")).where("id <> ''")
    return tiles, contigs


def read_genome(spark: SparkSession, path: str | list[str], width: int = 65_536) -> tuple[DataFrame, DataFrame]:
    return parse_genome(read_lines(spark, path), width)


def parse_gtf(lines: DataFrame) -> DataFrame:
    """The nine columns of GTF/GFF3 lines, and further columns of lines; comments, blank lines and those of fewer columns go."""
    f, more = F.col("__f"), [c for c in lines.columns if c != "value"]
    kinds = {"start": "bigint", "end": "bigint", "frame": "int"}
    rows = data_lines(split_once(lines, "__f"), "__f").where(F.size(f) >= 9)
    return rows.select(*[(F.get(f, F.lit(i)).try_cast(kinds[c]) if c in kinds else F.get(f, F.lit(i))).alias(c) for i, c in enumerate(GTF_COLUMNS)], *more)


def attributes(text: Column) -> Column:
    """Map of key "value"; and key=value; attributes; the last of equal keys holds."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")
    key = lambda x: F.regexp_extract(x, r"^([^\s=]+)", 1)
    value = lambda x: F.trim(F.replace(F.regexp_replace(x, r"^[^\s=]+[\s=]*", ""), F.lit('"'), F.lit("")))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.aggregate(parts, none, lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != key(x)), F.create_map(key(x), value(x))))


def read_gtf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_gtf(read_lines(spark, path))


def sniff_datatype(spark: SparkSession, path: str, given: str | None = None) -> str:
    """The gene model's kind: as given, or by its first comments and lines."""
    if given and given.lower() != "auto":
        return given
    head = "\n".join(r[0] for r in spark.read.text(path).limit(200).collect()).lower()
    if "gencode" in head:
        return "GENCODE_GFF3" if "format: gff3" in head else "GENCODE_GTF"
    if "ncbi homo sapiens" in head or "annotation-source ncbi" in head:
        return "RefSeq"
    return "Ensembl_GTF" if 'gene_id "ensg' in head else "gtf"


def _fixed(lines: DataFrame) -> DataFrame:
    """VCF data lines to the fixed columns, __cells (what follows, not yet split) and further columns of lines."""
    field = lambda i, c: F.get("__f", F.lit(i)).try_cast("bigint") if c == "pos" else F.get("__f", F.lit(i))
    rows = data_lines(split_once(lines, "__f", limit=len(VCF_FIXED) + 1), "__f")
    return rows.select(*[field(i, c).alias(c) for i, c in enumerate((*VCF_FIXED, "__cells"))], *[c for c in lines.columns if c != "value"])


def parse_vcf(lines: DataFrame, samples: list[str]) -> DataFrame:
    """VCF data lines to columns: the fixed ones, then one for each sample in the header's order, then those of lines.

    Samples' cells are split apart only in lines that pass the filters on fixed columns.
    """
    more, rows = [c for c in lines.columns if c != "value"], _fixed(lines)
    if samples:
        rows = split_once(rows, "__c", value="__cells")
    return rows.select(*VCF_FIXED, *[F.get("__c", F.lit(i)).alias(s) for i, s in enumerate(samples)], *more)


def header_samples(lines: DataFrame) -> DataFrame:
    """(header, i, sample) of VCF lines: each distinct header, by number of its text's order, with its samples in order."""
    heads = lines.where(F.col("value").startswith("#CHROM")).select("value").distinct()
    names = heads.select("value", F.dense_rank().over(Window.orderBy("value")).alias("header"))  # a row a header
    return names.select("header", F.posexplode(F.slice(F.split("value", "\t"), 10, 1 << 20)).alias("i", "sample"))


def vcf_samples(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Sample names of VCF files, which must agree."""
    heads = {r[0] for r in read_lines(spark, paths).where(F.col("value").startswith("#CHROM")).select("value").distinct().limit(2).collect()}
    if len(heads) > 1:
        raise ValueError("the VCF files have different headers")
    return heads.pop().split("\t")[9:] if heads else []


def wanted_samples(known: list[str], samples: str | list[str]) -> list[str]:
    """Names among a header's: ALL_SAMPLES, ALL_VARIANTS (none), or names, of which unknown ones are left out; an empty
    string, or names of which none is known, mean the first."""
    if samples == "ALL_VARIANTS":
        return []
    if samples == "ALL_SAMPLES":
        return known
    asked = samples.split(",") if isinstance(samples, str) else samples
    return [s for s in dict.fromkeys(asked) if s in known] or known[:1]


def read_vcf(spark: SparkSession, paths: str | list[str], samples: str | list[str] = "ALL_SAMPLES") -> DataFrame:
    """VCF files with the samples wanted (see wanted_samples) as columns, and the lines' order; for a few samples."""
    known = vcf_samples(spark, paths)
    return parse_vcf(read_lines(spark, paths), known).select(*VCF_FIXED, *wanted_samples(known, samples), "line")


def parse_calls(lines: DataFrame) -> DataFrame:
    """VCF data lines to the fixed columns and `calls`, all samples' cells as one array, whatever their number."""
    rows = split_once(_fixed(lines).withColumn("__cells", F.coalesce("__cells", F.lit(""))), "calls", value="__cells")
    calls = F.when((F.size("calls") == 1) & (F.get("calls", F.lit(0)) == ""), F.array().cast("array<string>")).otherwise(F.col("calls"))
    return rows.select(*VCF_FIXED, calls.alias("calls"), *[c for c in lines.columns if c != "value"])


def with_cells(lines: DataFrame) -> DataFrame:
    """VCF data lines to the fixed columns and `cells`, all samples' cells as one text that isn't split."""
    return _fixed(lines).withColumnRenamed("__cells", "cells")


def named(spark: SparkSession, names: list[str], wanted: list[str]) -> DataFrame:
    """(i, sample): places of the wanted ones among names."""
    keep = set(wanted)
    return spark.createDataFrame([(i, s) for i, s in enumerate(names) if s in keep], "i int, sample string")


def table_carriers(spark: SparkSession, path: str | list[str], samples: str | list[str] = "ALL_SAMPLES") -> DataFrame:
    """(chr, pos, ref, alt, sample) of a variant table with sample columns: rows of carriers only. A table without sample
    columns, and ALL_VARIANTS, give all its variants to one sample, 1.

    Cells stay one array per line until those of carriers are taken out, so thousands of samples make no columns.
    """
    heads = read_lines(spark, path).where(F.lower("value").rlike(r"(^|\t)pos(\t|$)")).select("value").distinct().limit(2).collect()
    if len(heads) != 1:
        raise ValueError("the variant tables need one header, the same in all")
    names = heads[0][0].split("\t")
    at = {c.lower(): i for i, c in enumerate(names)}
    if missing := [c for c in ("chr", "pos", "ref", "alt") if c not in at]:
        raise ValueError(f"the variant table lacks {', '.join(missing)}")
    cell = lambda c: F.get("f", F.lit(at[c]))
    rows = split_once(read_lines(spark, path).where(F.col("value") != heads[0][0]), "f")
    rows = rows.select(cell("chr").alias("chr"), cell("pos").try_cast("bigint").alias("pos"), F.upper(cell("ref")).alias("ref"), F.upper(cell("alt")).alias("alt"), "f").where("pos is not null")
    wanted = [s for s in wanted_samples([c for c in names if c.lower() not in ("chr", "pos", "ref", "alt", "pos_end")], samples)]
    if not wanted:
        return rows.select("chr", "pos", "ref", "alt", F.lit("1").alias("sample"))
    cells = F.filter(F.transform("f", lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda x: ~falsey(x["v"]))
    return rows.select("chr", "pos", "ref", "alt", F.explode(cells["i"]).alias("i")).join(named(spark, names, wanted), "i").drop("i")


def variants_tsv(rows: DataFrame) -> DataFrame:
    """chr, pos, ref, alt (upper case), pos_end and all further columns of a variant table, whatever their order."""
    lower = {c.lower(): c for c in rows.columns}
    if missing := [c for c in ("chr", "pos", "ref", "alt") if c not in lower]:
        raise ValueError(f"the variant table lacks {', '.join(missing)}")
    others = [c for c in rows.columns if c.lower() not in ("chr", "pos", "ref", "alt", "pos_end")]
    out = rows.select(F.col(lower["chr"]).cast("string").alias("chr"), F.col(lower["pos"]).cast("bigint").alias("pos"), F.upper(lower["ref"]).alias("ref"), F.upper(lower["alt"]).alias("alt"), *others)
    return out.withColumn("pos_end", F.col("pos") + F.length("ref") - 1)


def read_variants_tsv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return variants_tsv(spark.read.csv(path, sep="\t", header=True))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True)
    if rows.columns[:1] != ["filepath"]:
        raise ValueError("a manifest's first column is filepath")
    return rows


def is_manifest(spark: SparkSession, path: str) -> bool:
    return [r[0].split("\t")[0] for r in spark.read.text(path).limit(1).collect()] == ["filepath"]


def literal_variants(rows: DataFrame, text: str, any_name: bool = False) -> DataFrame:
    """rows with chr, pos, ref, alt of each variant like chr1-942451-T-C in a comma-separated column; others go. Chromosomes
    are numbers unless any_name is true (X, Y, M, contigs)."""
    kept = [c for c in rows.columns if c != text]
    pattern = r"^(?:chr)?(%s)-(\d+)-([A-Za-z]+)-([A-Za-z]+)$" % (r"[0-9A-Za-z_.]+" if any_name else r"\d+")
    parts = rows.select(*kept, F.explode(F.split(text, ",")).alias("v")).withColumn("v", F.trim("v")).where(F.rlike("v", F.lit(pattern)))
    get = lambda i: F.regexp_extract("v", pattern, i)
    return parts.select(*kept, get(1).alias("chr"), get(2).cast("bigint").alias("pos"), F.upper(get(3)).alias("ref"), F.upper(get(4)).alias("alt"))
