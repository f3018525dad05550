"""Novel peptides: those of changed proteins that no reference protein has."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.once import by_number, computed
from ..functions.sequence import normalize
from .digest import Profile, digest, parts_of, plain_peptides


def peptide_index(proteins: DataFrame, keys: list[str], seq: str, profile: Profile) -> DataFrame:
    """Distinct peptides of reference proteins, isobaric residues merged as the profile says."""
    return digest(proteins, keys, seq, profile).select("peptide").distinct()


def changed_only(alt: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    """Peptides of changed proteins that the same protein's reference form lacks."""
    return alt.join(ref.select(key, "peptide").distinct(), [key, "peptide"], "left_anti")


def changed_peptides(proteins: DataFrame, key: str, ref: str, alt: str, profile: Profile) -> DataFrame:
    """(key, peptide, start, end): changed_only() of the digested changed forms (alt, where it isn't ref) and references.

    Both forms are digested in the protein's task and compared there: peptides are neither shuffled nor joined. Proteins that
    share a key, or have none, and profiles that aren't plain are digested into rows, which are joined.
    """
    p, changed = profile, F.col(alt) != F.col(ref)
    joined = lambda rows: changed_only(digest(rows.where(changed), [key], alt, p), digest(rows, [key], ref, p), key)
    if not p.plain():
        return joined(proteins)
    # a null key counts as none in the column, not in a filter, which would go below the shuffle and keep it from being shared
    number = F.when(F.col(key).isNotNull(), F.count("*").over(Window.partitionBy(key))).otherwise(0)
    rows = by_number(proteins.select(key, ref, alt), key).withColumn("__n", number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in parts_of(batch, "__alt")):
            own, had, _, _ = plain_peptides(part.column("__ref"), p)
            row, peptide, start, end = plain_peptides(part.column("__alt"), p)
            named = lambda of, text: pc.binary_join_element_wise(pa.array(of).cast(pa.string()), text, ":")
            new = pc.invert(pc.is_in(named(row, peptide), value_set=named(own, had)))
            kept = [pa.array(row), peptide, pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))]
            row, *columns = (x.filter(new) for x in kept)
            yield pa.record_batch([part.column(key).take(row), *columns], names=[key, "peptide", "start", "end"])

    kind = proteins.schema[key].dataType.simpleString()
    once = rows.where(changed & (F.col("__n") == 1)).select(key, normalize(F.col(ref), p.isobaric).alias("__ref"), normalize(F.col(alt), p.isobaric).alias("__alt"))
    once = once.mapInArrow(run, f"`{key}` {kind}, peptide string, start int, end int")
    if p.nterm or p.cterm:
        once = once.withColumn("peptide", F.concat(F.lit(p.nterm), "peptide", F.lit(p.cterm)))
    return once.unionByName(joined(rows.where("__n <> 1")))


def novel(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """Candidates that no reference protein has. The index grows with the proteome: a shuffled anti-join unless Spark
    finds it small."""
    return candidates.join(index.select("peptide"), "peptide", "left_anti")


#: Ranges in which peptides are numbered are bounded by GROUP times GROUP sampled peptides, looked up in two steps.
GROUP = 64


def numbered(rows: DataFrame, prefix: str = "novel_") -> DataFrame:
    """(peptide_id, peptide, n_mappings): distinct peptides numbered from 1 in order, by at least six digits.

    Ranges are bounded by a sample of the peptides themselves (the GROUP * GROUP of least hash, the same in each run), so they
    are about equal whatever peptides have in common. Counts per range are summed first; no task sorts more than a range.
    """
    counts = rows.groupBy("peptide").agg(F.count("*").alias("n_mappings"))
    least = counts.select("peptide").where("peptide <> ''").orderBy(F.xxhash64("peptide"), "peptide").limit(GROUP * GROUP)
    bounds = sorted(r[0] for r in least.collect())
    some = lambda texts: F.split(F.lit("\t".join(texts)), "\t") if texts else F.array().cast("array<string>")
    passed = lambda texts: F.size(F.filter(texts, lambda x: x <= F.col("peptide")))
    counts = computed(counts, "group", passed(some(bounds[GROUP - 1 :: GROUP])))
    counts = computed(counts, "range", F.col("group") * GROUP + passed(F.slice(some(bounds), F.col("group") * GROUP + 1, F.lit(GROUP))))
    sizes = counts.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most as many rows as ranges
    sizes = sizes.select("range", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("peptide"))
    out = counts.withColumn("rank", rank).join(F.broadcast(sizes), "range")  # as above
    return out.select(F.format_string(f"{prefix}%06d", (F.col("before") + F.col("rank")).cast("bigint")).alias("peptide_id"), "peptide", "n_mappings")


def fingerprint(proteins: DataFrame, key: str, seq: str) -> DataFrame:
    """(n_proteins, fingerprint) of a proteome: SHA-256 of the digests of its parts in order of hash buckets.

    Each part's digest covers its proteins in order of their keys; parts are 256 whatever the data's size.
    """
    entry = F.sha2(F.concat_ws("\t", F.col(key).cast("string"), F.coalesce(seq, F.lit(""))), 256)
    parts = proteins.select(entry.alias("d")).withColumn("part", F.substring("d", 1, 2)).groupBy("part").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("d"))
    return parts.agg(F.sum("n").alias("n_proteins"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), ""), 256).alias("fingerprint"))


# Columns of the table of novel peptides, as (name, column of the changed form or None: of the profile).
NOVEL_COLUMNS = (
    ("protein_id_fasta", "fasta_id"), ("protein_id", "form_id"), ("individual", "samples"), ("seqname", "seqname"), ("variant_AA", "variant_aa"),
    ("insertion_AA", "insertion_aa"), ("deletion_AA", "deletion_aa"), ("frameChange", "frame_change"), ("stopGain", "stop_gain"),
    ("AA_stopGain", "aa_stop_gain"), ("stopLoss", "stop_loss"), ("stopLoss_pos", "stop_loss_pos"),
)


def novel_table(changed: DataFrame, index: DataFrame, profile: Profile, prefix: str = "novel_") -> tuple[DataFrame, DataFrame]:
    """(table, records): each occurrence in a changed form of a peptide that no reference protein has, with the form's
    annotation and the profile; and the distinct ones as FASTA lines.

    changed as changed_proteins() gives it; index(peptide). A peptide that the form's own reference protein has is in the
    index too, so one anti-join does both.
    """
    found = novel(digest(changed, ["form_id"], "new_aa", profile), index)
    ids = numbered(found, prefix)
    told = changed.select(F.col("form_id").alias("__form"), *[F.col(c).alias(name) for name, c in NOVEL_COLUMNS])
    settings = {"enzyme": profile.enzyme, "max_missed_cleavages": profile.missed, "min_peptide_length": profile.min_len, "max_peptide_length": profile.max_len, "specificity": profile.specificity, "initiator_methionine": profile.methionine, "isobaric": profile.isobaric, "peptide_config_hash": profile.digest_id()}
    rows = found.join(ids.select("peptide", "peptide_id"), "peptide").join(told, F.col("form_id") == F.col("__form"))
    first = [name for name, _ in NOVEL_COLUMNS[:4]]
    table = rows.select("peptide_id", F.col("peptide").alias("peptide_sequence"), *first, F.col("start").alias("peptide_start_alt"), F.col("end").alias("peptide_end_alt"), *[name for name, _ in NOVEL_COLUMNS[4:]], *[F.lit(v).alias(k) for k, v in settings.items()])
    return table, ids.select(F.concat(F.lit(">"), "peptide_id", F.lit("|n_mappings="), F.col("n_mappings").cast("string"), F.lit("\n"), "peptide").alias("value"))


def default_index_path(store: str, profile: Profile) -> str:
    """Where the index of a store's proteins under a profile is kept: beside the store, by what tells profiles apart."""
    return f"{store.rstrip('/')}-peptides-{profile.digest_id()[:16]}"


@dataclass
class IndexState:
    """What an index at a path was built from; None where there is none, or none that was finished."""

    digest_id: str | None = None
    n_proteins: int | None = None
    proteome: str | None = None


def index_state(spark: SparkSession, path: str) -> IndexState:
    from pyspark.errors import AnalysisException

    try:
        about = spark.read.parquet(f"{path}/about").first()
    except AnalysisException:
        return IndexState()
    return IndexState(about["digest_id"], about["n_proteins"], about["proteome"]) if about and "buckets" in about else IndexState()


#: Buckets of an index on disk: files that a join with it reads as they are.
BUCKETS = 64


def build_index(proteins: DataFrame, keys: list[str], seq: str, profile: Profile, path: str, buckets: int = BUCKETS) -> None:
    """Writes the distinct peptides, and last of all what they were built from: an index without that is unfinished.

    Peptides are bucketed by their hash and sorted, with a Bloom filter in each file: a join shuffles its candidates to the
    buckets, never the index, and a look-up of single peptides passes over files that can't hold them.
    """
    spark = proteins.sparkSession
    from pyspark.errors import AnalysisException

    try:  # what there was is void from now on
        spark.read.parquet(f"{path}/about").limit(0).write.mode("overwrite").parquet(f"{path}/about")
    except AnalysisException:
        pass
    found = peptide_index(proteins, keys, seq, profile).repartition(buckets, "peptide")
    found.write.mode("overwrite").bucketBy(buckets, "peptide").sortBy("peptide").option("parquet.bloom.filter.enabled#peptide", "true").option("path", f"{path}/peptides").saveAsTable(_table(path))
    about = fingerprint(proteins, keys[0], seq).select(F.lit(profile.digest_id()).alias("digest_id"), "n_proteins", F.col("fingerprint").alias("proteome"), F.lit(buckets).alias("buckets"))
    spark.createDataFrame(about.collect(), "digest_id string, n_proteins bigint, proteome string, buckets int").write.mode("overwrite").parquet(f"{path}/about")


def _table(path: str) -> str:
    """The name by which a session knows the index at a path."""
    return "protloom_index_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index at a path with its buckets, which the session learns if it hasn't built it."""
    name = _table(path)
    if not spark.catalog.tableExists(name):
        buckets = spark.read.parquet(f"{path}/about").first()["buckets"]
        spark.sql(f"CREATE TABLE {name} (peptide STRING) USING parquet CLUSTERED BY (peptide) SORTED BY (peptide) INTO {int(buckets)} BUCKETS LOCATION '{f'{path}/peptides'.replace(chr(39), chr(92) + chr(39))}'")
    return spark.table(name)


def ensure_index(proteins: DataFrame, keys: list[str], seq: str, profile: Profile, path: str, rebuild: bool = False) -> DataFrame:
    """The index at a path: as it stands if it was built with this profile from these proteins, else built anew."""
    spark = proteins.sparkSession
    state = index_state(spark, path)
    now = fingerprint(proteins, keys[0], seq).first()
    if rebuild or state != IndexState(profile.digest_id(), now["n_proteins"], now["fingerprint"]):
        build_index(proteins, keys, seq, profile, path)
    return read_index(spark, path)
