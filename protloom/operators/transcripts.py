"""Gene models: proteins on chromosomes, coding blocks, coding sequences, strands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.once import by_number
from ..functions.sequence import COMPLEMENT, IUPAC, reverse_complement, translate


def protein_id(header_id: Column, datatype: Column) -> Column:
    """GENCODE: the second field between bars; Ensembl: without its version; else as it stands."""
    gencode = F.coalesce(F.try_element_at(F.split(header_id, r"\|"), F.lit(2)), header_id)
    return F.when(datatype.startswith("GENCODE"), gencode).when(datatype.startswith("Ensembl"), F.regexp_replace(header_id, r"\.\d+$", "")).otherwise(header_id)


def first_chromosome(rows: DataFrame, protein: str, chrom: str, order: str) -> DataFrame:
    """Each protein's chromosome of the earliest line, and on how many it stands."""
    return rows.groupBy(protein).agg(F.min_by(chrom, order).alias("chrom"), F.count_distinct(chrom).alias("n_chrom"))


def not_in_genome(proteins: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    return proteins.join(placed.select(key).distinct(), key, "left_anti")


def models_of(gtf: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
    """Gene-model rows whose protein stands on the same chromosome."""
    return gtf.join(placed.select(*keys).distinct(), keys, "left_semi")


def exon_proteins(gtf: DataFrame, transcript: str = "transcript_id", protein: str = "protein_id") -> DataFrame:
    """Protein ids of exon rows, which name their transcript only, from the coding rows of that transcript."""
    known = gtf.where(F.col(protein).isNotNull()).groupBy(transcript).agg(F.min(protein).alias("__protein"))
    return gtf.join(known, transcript, "left").withColumn(protein, F.coalesce(protein, "__protein")).drop("__protein")


def cds_blocks(cds: DataFrame, keys: list[str]) -> DataFrame:
    """Coding blocks of each protein in genome order as one array, with its extent and length."""
    block = F.sort_array(F.collect_list(F.struct("start", "end")))
    return cds.groupBy(*keys).agg(block.alias("blocks"), F.min("start").alias("cds_start"), F.max("end").alias("cds_end"), F.sum(F.col("end") - F.col("start") + 1).alias("cds_len"))


def cds_plus(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks from the first coding block on: that one and each exon beyond it in the direction of transcription. Models
    without exons keep all coding blocks. Columns: keys, frame, start, end.

    rows(keys, feature, start, end, strand, frame).
    """
    by = F.when(F.col("strand") == "+", F.struct(F.col("start").alias("a"), F.col("end").alias("b"))).otherwise(F.struct((-F.col("start")).alias("a"), F.lit(0).cast(rows.schema["end"].dataType).alias("b")))
    head = rows.where("feature = 'CDS'").groupBy(*keys).agg(F.min_by(F.struct("start", "end", "frame"), by).alias("first"))
    exons = rows.groupBy(*keys).agg(F.max((F.col("feature") == "exon").cast("int")).alias("has_exon"))
    all_ = rows.join(head, keys).join(exons, keys)
    is_first = (F.col("feature") == "CDS") & (F.col("start") == F.col("first.start")) & (F.col("end") == F.col("first.end"))
    beyond = F.when(F.col("strand") == "+", F.col("start") >= F.col("first.end")).otherwise(F.col("end") <= F.col("first.start"))
    keep = F.when(F.col("has_exon") == 0, F.col("feature") == "CDS").otherwise(is_first | ((F.col("feature") == "exon") & beyond))
    return all_.where(keep).select(*keys, F.col("first.frame").alias("frame"), "start", "end").distinct()


def cds_offsets(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with before: coding bases ahead of each in genome order, and total."""
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(w.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("before", before).withColumn("total", F.sum(F.col("end") - F.col("start") + 1).over(w))


def coding_offset(pos: Column, start: Column, before: Column, total: Column, strand: Column) -> Column:
    """Place of a genome position in the coding sequence, from 0, in the direction of transcription."""
    at = pos - start + before
    return F.when(strand == "-", total - 1 - at).otherwise(at)


def coding_sequence(blocks: DataFrame, genome: DataFrame, keys: list[str], contig: str, bases: str = "seq", oriented: bool = False) -> DataFrame:
    """(keys, strand, cds): the blocks' bases in genome order, or with oriented in the strand's direction; genome(contig, bases) holds whole short contigs.

    Blocks are cut out in Python: for column expressions, reaching a place within a text takes time in proportion to it."""
    of = blocks.groupBy(*dict.fromkeys([*keys, contig]), "strand").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__blocks"))
    kept, turn = [*keys, "strand"], str.maketrans(IUPAC, COMPLEMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("__blocks")
            start, end = (places.flatten().field(x).to_pylist() for x in ("start", "end"))
            upto = np.cumsum(places.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            cds, at = [], 0
            for text, to in zip(batch.column("__bases").to_pylist(), upto):
                cds.append(None if text is None else "".join([text[a - 1 : b] for a, b in zip(start[at:to], end[at:to])]))
                at = to
            if oriented:
                cds = [x.translate(turn)[::-1] if x and strand == "-" else x for x, strand in zip(cds, batch.column("strand").to_pylist())]
            yield pa.record_batch([*(batch.column(k) for k in kept), pa.array(cds, pa.string())], names=[*kept, "cds"])

    rows = by_number(of, contig).join(genome.select(F.col(contig), F.col(bases).alias("__bases")), contig).select(*kept, "__blocks", "__bases")
    return rows.mapInArrow(run, ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in kept) + ", cds string")


def tiles(genome: DataFrame, contig: str, bases: str, width: int) -> DataFrame:
    """Contigs as rows of at most `width` bases: (contig, tile, bases)."""
    n = F.floor((F.length(bases) + width - 1) / width)
    rows = genome.where(F.length(bases) > 0).select(contig, F.col(bases).alias("__bases"), F.explode(F.sequence(F.lit(0), n - 1)).alias("tile"))
    return rows.select(contig, "tile", F.substring("__bases", F.col("tile") * width + 1, F.lit(width)).alias("bases"))


def slices(regions: DataFrame, tiled: DataFrame, contig: str, width: int, keys: list[str]) -> DataFrame:
    """(keys, bases) of regions(keys, contig, start, end), 1-based inclusive, put together from tiles: no whole contig is
    ever in one row."""
    touched = regions.select(*keys, contig, "start", "end", F.explode(F.sequence(F.floor((F.col("start") - 1) / width), F.floor((F.col("end") - 1) / width))).alias("tile"))
    met = touched.join(tiled, [contig, "tile"])
    lo = F.greatest(F.col("start") - F.col("tile") * width, F.lit(1))
    hi = F.least(F.col("end") - F.col("tile") * width, F.lit(width))
    met = met.select(*keys, "tile", F.substring(F.col("bases"), lo.cast("int"), (hi - lo + 1).cast("int")).alias("part"))
    return met.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tile", "part"))), lambda x: x["part"]), "").alias("bases"))


def inferred_strand(cds: Column, aa: Column) -> Column:
    """+ or - by which orientation of the coding sequence translates to the protein, else a dot."""
    start = lambda s: F.substring_index(translate(s), "*", 1)
    return F.when(start(cds) == aa, "+").when(start(reverse_complement(cds)) == aa, "-").otherwise(".")


def consistent(aa: Column, translated: Column, cds: Column, frame: Column) -> Column:
    """Whether protein and genome agree: equal lengths, or three bases a residue (without a final stop codon)."""
    body = F.floor((F.length(cds) - frame) / 3) * 3
    last = F.substring(cds, (frame + body - 2).cast("int"), F.lit(3))
    bases = body - F.when(last.isin("TAA", "TGA", "TAG"), 3).otherwise(0)
    return (F.length(aa) == F.length(translated)) | (bases == 3 * F.length(aa))


def resolve_contigs(names: DataFrame, contigs: DataFrame) -> DataFrame:
    """(name, contig): each chromosome name's contig in the genome: itself without chr, with chr, the mitochondrion for M,
    the contig described as "chromosome <name>,", else the name without chr.

    contigs(id, description): the dictionary of a genome; it is broadcast up to 10,000 rows.
    """
    few = contigs.limit(10_001).count() <= 10_000
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    k = F.regexp_replace("name", "^chr", "")
    rows = names.select("name", k.alias("k")).distinct()
    ids = contigs.select("id").distinct()
    described = contigs.select(F.regexp_extract("description", "chromosome ([^ ,]+),", 1).alias("k"), "id").where("k <> ''").groupBy("k").agg(F.min("id").alias("by_text"))
    mito = contigs.where(F.lower("description").contains("mitochondrion")).agg(F.min("id")).first()[0]
    out = rows.join(small(ids.select(F.col("id").alias("same"))), F.col("k") == F.col("same"), "left").join(small(ids.select(F.col("id").alias("with_chr"))), F.concat(F.lit("chr"), F.col("k")) == F.col("with_chr"), "left")
    out = out.join(small(described), "k", "left")
    return out.select("name", F.coalesce("same", "with_chr", F.when(F.col("k") == "M", F.lit(mito)), "by_text", "k").alias("contig"))
