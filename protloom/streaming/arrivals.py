"""Variant files that arrive in a folder, each taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import intervals
from ..sources import text


def arriving_variants(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of chr, pos, ref, alt from tab-separated files with that header."""
    raw = spark.readStream.schema("chr string, pos bigint, ref string, alt string").option("sep", "\t").option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(folder)
    return text.variants_tsv(raw)


def annotate_arrivals(stream: DataFrame, blocks: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes, for all files there are, which proteins' blocks contain each variant; a later call takes only new files.

    The join with static blocks keeps no state, so no watermark is needed. Blocks are written beside the checkpoint and
    read again: their plan may hold what streams don't allow, such as row numbers.
    """
    blocks.write.mode("overwrite").parquet(f"{checkpoint}-blocks")
    blocks = stream.sparkSession.read.parquet(f"{checkpoint}-blocks")
    hits = intervals.interval_join(stream.withColumnRenamed("chr", "seqname"), blocks, keys=("seqname",))
    rows = hits.select("protein_id", "seqname", "pos", "ref", "alt", F.current_timestamp().alias("seen"))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
