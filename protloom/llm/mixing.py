"""Mixing sources to target weights by temperature, on DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import SPACE, checkpoint

#: Exponents tried at once in a round of the search; so many rounds narrow [0, 1] to ARMS ** -ROUNDS.
ARMS, ROUNDS = 32, 4
#: Tables of up to so many rows are broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 50_000


def token_count(text: Column) -> Column:
    """Words of a text as long; null and blank texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}|{SPACE}\\z", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def exponent(sources: DataFrame, budget: float, max_repeat: float | None = None, entropy: float | None = None) -> float:
    """The exponent a in [0, 1] for weights proportional to share ** a.

    With max_repeat: the least a (the flattest mixture) with which no source is passed over more than max_repeat times
    within the budget. With entropy (nats): the a whose weights have this entropy. Where no a in [0, 1] meets the target,
    the nearest end. Each round sums the powers for ARMS exponents in one aggregation, so the sources are never
    collected; the bracket that changes sides is cut again.
    """
    total = F.lit(float(sources.agg(F.sum("tokens")).first()[0] or 0))
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (hi - lo) / ARMS
        tried = sources.where("tokens > 0").select((F.col("tokens") / total).alias("p"), "tokens", F.explode(F.sequence(F.lit(0), F.lit(ARMS))).alias("k"))
        tried = tried.select("k", "p", "tokens", F.pow("p", F.lit(lo) + F.col("k") * F.lit(step)).alias("w"))
        # the sources' largest repetition is max(w / tokens) * budget / sum(w); entropy = ln(sum w) - sum(w ln w) / sum w
        sums = tried.groupBy("k").agg(F.sum("w").alias("z"), F.max(F.col("w") / F.col("tokens")).alias("m"), F.sum(F.col("w") * F.log("w")).alias("wlnw"))
        far = F.col("m") * budget / F.col("z") > F.lit(max_repeat) if max_repeat is not None else F.log("z") - F.col("wlnw") / F.col("z") > F.lit(entropy)
        k = sums.where(far).agg(F.max("k")).first()[0]
        if k is None:
            return lo
        if k == ARMS:
            return hi
        lo, hi = lo + k * step, lo + (k + 1) * step
    return hi


def mix(docs: DataFrame, budget: int | None = None, max_repeat: float | None = 1.5, entropy: float | None = None, seed: int = 7, block_rows: int = 1024, source: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each time that a document is taken: doc_id, source, n_tokens, epoch, block, block_order, doc_order, weight.

    Weights are proportional to the sources' token shares raised to exponent(); source s gets budget * weight tokens
    (budget: tokens in all, by default as many as docs hold). It is passed over in whole epochs as often as that allows;
    in the last, partial epoch its blocks are taken in the order of a permutation drawn for that source and epoch until
    the next would exceed the rest, and of that block documents in the order of doc_order while they fit. A block holds
    about block_rows documents by hash of doc_id (of the text where that is null), so a source of any size is spread over blocks and no task gets more
    than block sums of it. Reading by (epoch, block_order, doc_order) realises the mixture.

    Null sources form one source of their own (null), null and blank texts have 0 tokens and ride along in each epoch,
    repeated rows count and are taken as often as they stand there, further columns are ignored, an empty table gives an
    empty result. Ties in the permutation go by block number, by doc_id within a block.
    """
    rows = checkpoint(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.concat(F.when(F.col(source).isNull(), "n").otherwise("s"), F.coalesce(F.col(source).cast("string"), F.lit(""))).alias("key"), token_count(F.col(text)).alias("n_tokens"), F.coalesce(F.xxhash64(doc_id, F.when(F.col(doc_id).isNull(), F.col(text))), F.lit(0)).alias("h")))
    sources = checkpoint(rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    tokens, n_sources, n_docs = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*"), F.coalesce(F.sum("docs"), F.lit(0))).first()
    total, budget = float(tokens), float(tokens if budget is None else budget)
    a = exponent(sources, budget, max_repeat, entropy) if total else 1.0
    powered = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(total or 1.0), F.lit(a))).otherwise(0.0)
    z = float(sources.agg(F.sum(powered)).first()[0] or 1.0) or 1.0
    plan = sources.select("key", "tokens", (powered / F.lit(z)).alias("weight"), F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(block_rows))).alias("blocks"))
    wanted = F.floor(F.col("weight") * F.lit(budget))
    whole = F.when(F.col("tokens") > 0, F.floor(wanted / F.col("tokens"))).otherwise(1)
    plan = plan.select("key", "weight", "blocks", whole.alias("whole"), F.when(F.col("tokens") > 0, wanted - whole * F.col("tokens")).otherwise(0).alias("rest"))
    rows = rows.join(small(plan, n_sources), "key").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "h"), "blocks"))
    blocks = rows.groupBy("key", "block").agg(F.sum("n_tokens").alias("t"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    order = lambda epoch: F.xxhash64(F.lit(seed), F.lit("block"), "key", "block", epoch)
    by = Window.partitionBy("key").orderBy(order(F.col("whole")), "block")
    blocks = blocks.withColumn("upto", F.sum("t").over(by)).withColumn("left", F.col("rest") - F.col("upto") + F.col("t"))
    last = blocks.where("left > 0").select("key", "block", "left", (F.col("upto") <= F.col("rest")).alias("full"))
    n_blocks = n_docs // block_rows + n_sources
    taken = rows.join(small(last, n_blocks), ["key", "block"], "left")
    again = taken.select("*", F.xxhash64(F.lit(seed), F.lit("doc"), "doc_id", "whole").alias("o"))
    cut = again.where("not full").withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("key", "block").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, 0))).where("upto <= left")
    cols = ["doc_id", "source", "n_tokens", "epoch", "block", order(F.col("epoch")).alias("block_order"), F.xxhash64(F.lit(seed), F.lit("doc"), "doc_id", "epoch").alias("doc_order"), "weight"]
    epochs = taken.where("whole > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("epoch"))
    parts = [epochs, again.where("full").withColumn("epoch", F.col("whole")), cut.withColumn("epoch", F.col("whole"))]
    first, *others = [x.withColumn("epoch", F.col("epoch").cast("long")).select("key", *cols).drop("key") for x in parts]
    for x in others:
        first = first.unionByName(x)
    return first
