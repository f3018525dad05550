"""The annotation store: Parquet tables partitioned by contig (blocks by position bins too), written once and read with pruning."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.intervals import bin_at, in_bins

TABLES = ("proteins", "blocks", "contigs")
#: Width of the narrowest bins by which blocks are stored; bins that variants touch are named in the scan up to so many.
STORE_BIN, NAMED_BINS = 4 << 20, 10_000


def write_store(path: str, proteins: DataFrame, blocks: DataFrame, contigs: DataFrame) -> None:
    """proteins(protein_id, ..., seqname), blocks(protein_id, start, end, seqname; 1-based inclusive), contigs(id,
    description). Each table's _SUCCESS marks it complete."""
    proteins.write.mode("overwrite").partitionBy("seqname").parquet(f"{path}/proteins")
    binned = in_bins(blocks, "start", "end", STORE_BIN).withColumnsRenamed({"__level": "level", "__bin": "bin"})
    binned = binned.withColumn("own", F.col("bin") == bin_at("start", F.col("level"), STORE_BIN))  # a block in two bins is read once where all are
    binned.repartition("seqname", "level", "bin").write.mode("overwrite").partitionBy("seqname", "level", "bin").parquet(f"{path}/blocks")
    contigs.write.mode("overwrite").parquet(f"{path}/contigs")


def read_store(spark: SparkSession, path: str, table: str) -> DataFrame:
    if table not in TABLES:
        raise ValueError(f"a store holds {', '.join(TABLES)}, not {table}")
    rows = spark.read.parquet(f"{path}/{table}")
    return rows.where("own").drop("level", "bin", "own") if table == "blocks" else rows


def touched_blocks(spark: SparkSession, path: str, variants: DataFrame) -> DataFrame:
    """The stored blocks among which are all that hold one of variants(chr, pos): of few variants, only the files of the bins in
    which they stand are opened; of many, all."""
    rows = spark.read.parquet(f"{path}/blocks")
    levels = [r[0] for r in rows.select("level").distinct().collect()]
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), bin_at("pos", F.lit(k), STORE_BIN).alias("bin")) for k in levels])) if levels else None
    found = variants.select(F.col("chr").cast("string").alias("chr"), at.alias("x")).select("chr", "x.*").distinct().limit(NAMED_BINS + 1).collect() if levels else []
    if len(found) > NAMED_BINS:
        return read_store(spark, path, "blocks")
    named: dict[tuple[str, int], list[int]] = {}
    for r in found:
        named.setdefault((r["chr"], r["level"]), []).append(r["bin"])
    some = F.lit(False)
    for (contig, level), bins in named.items():
        some = some | ((F.col("seqname").cast("string") == contig) & (F.col("level") == level) & F.col("bin").isin(bins))
    return rows.where(some).drop("level", "bin", "own").distinct()


def of_proteins(table: DataFrame, ids: DataFrame, key: str = "protein_id") -> DataFrame:
    """Rows of the given proteins."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def latest(rows: DataFrame, key: str, version: list[str]) -> DataFrame:
    """Of rows written under one key, the last."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*version)).alias("x")).select(key, "x.*")


def merge_store(path: str, table: str, rows: DataFrame, keys: list[str], newest: str, by: str = "seqname") -> int:
    """Puts rows into a stored table partitioned by `by`: of equal keys the row with the greatest `newest` stays (null least;
    of equals the new one). Only partitions that rows touch are read and written again; their number is returned.

    They are written beside the table first, so that a run that stops half-way leaves the table as it was or rewrites a
    partition as a whole.
    """
    spark = rows.sparkSession
    rows = rows.withColumn(by, F.col(by).cast("string"))
    touched = [r[0] for r in rows.select(by).distinct().collect()]
    if not touched:
        return 0
    old = spark.read.parquet(f"{path}/{table}").withColumn(by, F.col(by).cast("string"))
    both = old.where(F.col(by).isin(touched)).withColumn("__new", F.lit(0)).unionByName(rows.select(*old.columns).withColumn("__new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(by, *keys).orderBy(F.col(newest).desc_nulls_last(), F.col("__new").desc()))
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    both.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__new").write.parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{path}/{table}")
    return len(touched)
