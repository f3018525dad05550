"""Lines that can't be read, with the reason: what the parsers leave out, kept for a look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import VCF_FIXED, data_lines, read_lines, split_once, vcf_samples

KINDS = ("vcf", "gtf", "table")


def _first_of(reasons: dict[str, Column]) -> Column:
    """The first reason whose condition holds; null: none."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in reasons.items()])


def _number(c: Column) -> Column:
    return F.coalesce(c.try_cast("bigint") > 0, F.lit(False))


def vcf_faults(lines: DataFrame, samples: int = 0) -> DataFrame:
    """lines(value, ...) of a VCF of so many samples that can't be used, with f (their parts) and reason: few columns, bad
    position, bad reference, no alternative, missing calls (fewer cells than the header has samples)."""
    f = lambda i: F.get("f", F.lit(i))
    rows = data_lines(split_once(lines, "f"), "f")
    reason = _first_of({
        "few columns": F.size("f") < len(VCF_FIXED) - 1, "bad position": ~_number(f(1)), "bad reference": ~F.rlike(f(3), F.lit("^[A-Za-z]+$")),
        "no alternative": F.trim(f(4)).isin("", "."), "missing calls": F.size("f") < (len(VCF_FIXED) + samples if samples else 0),
    })
    return rows.withColumn("reason", reason).where("reason is not null")


def gtf_faults(lines: DataFrame) -> DataFrame:
    """Lines of gene models that can't be used: few columns, bad range, bad strand."""
    f = lambda i: F.get("f", F.lit(i))
    rows = data_lines(split_once(lines, "f"), "f").where(F.trim(F.array_join("f", "")) != "")
    ordered = F.coalesce(f(3).try_cast("bigint") <= f(4).try_cast("bigint"), F.lit(False))
    return rows.withColumn("reason", _first_of({"few columns": F.size("f") < 9, "bad range": ~(_number(f(3)) & ordered), "bad strand": ~f(6).isin("+", "-", ".", "?")})).where("reason is not null")


def table_faults(lines: DataFrame, header: str) -> DataFrame:
    """Lines of a variant table with this header that can't be used: few columns, bad position, bad reference, no alternative."""
    at = {c.lower(): i for i, c in enumerate(header.split("\t"))}
    f = lambda c: F.get("f", F.lit(at[c]))
    rows = split_once(lines.where((F.col("value") != header) & (F.trim("value") != "")), "f")
    need = max(at[c] for c in ("chr", "pos", "ref", "alt")) + 1
    return rows.withColumn("reason", _first_of({"few columns": F.size("f") < need, "bad position": ~_number(f("pos")), "bad reference": ~F.rlike(f("ref"), F.lit("^[A-Za-z]+$")), "no alternative": F.trim(f("alt")) == ""})).where("reason is not null")


def by_reason(faults: DataFrame) -> DataFrame:
    return faults.groupBy("reason").agg(F.count("*").alias("n"))


def quarantine(spark: SparkSession, folder: str, vcf: str | list[str] | None = None, gtf: str | None = None) -> DataFrame:
    """Writes the lines of these files that can't be used, with place and reason, to a folder, and returns their numbers as
    (kind, reason, n)."""
    found = []
    if vcf:
        found.append(vcf_faults(read_lines(spark, vcf), len(vcf_samples(spark, vcf))).withColumn("kind", F.lit("vcf")))
    if gtf:
        found.append(gtf_faults(read_lines(spark, gtf)).withColumn("kind", F.lit("gtf")))
    for i, rows in enumerate(found):
        rows.select("kind", "reason", F.col("line.file").alias("file"), "line.part", "line.row", F.array_join("f", "\t").alias("value")).write.mode("append" if i else "overwrite").parquet(folder)
    return spark.read.parquet(folder).groupBy("kind", "reason").agg(F.count("*").alias("n"))
