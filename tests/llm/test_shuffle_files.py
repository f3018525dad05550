"""Checkpoints leave no shuffle files, components take no step that they don't need."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from protloom.llm import common, simhash


def shuffle_files(spark) -> set[str]:
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p.name for d in dirs for p in Path(d.toString()).rglob("shuffle_*")}


def left_by(spark, act) -> set[str]:
    before = shuffle_files(spark)
    act()
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:  # removed without waiting for it
        time.sleep(0.2)
    return left


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    setting, counted = spark.conf.get(common.CLEANUP), []
    grouped = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    assert not left_by(spark, lambda: counted.append(common.checkpoint(grouped)))
    assert not left_by(spark, lambda: common.sized(counted[0]))
    assert counted[0].count() == 100 and spark.conf.get(common.CLEANUP) == setting


def test_stars_are_components_at_once(spark, monkeypatch):
    taken, checkpoint = [], common.checkpoint
    monkeypatch.setattr(common, "checkpoint", lambda df: taken.append(1) or checkpoint(df))
    stars = spark.createDataFrame([(5, 1), (1, 4), (7, 6), (5, 1), (3, 3)], "a long, b long")
    assert sorted(map(tuple, common.components(stars).collect())) == [(1, 1), (4, 1), (5, 1), (6, 6), (7, 6)]
    assert len(taken) == 1
    chain = spark.createDataFrame([(i, i + 1) for i in range(-40, 40)] + [(100, 99)], "a long, b long")
    assert dict(map(tuple, common.components(chain).collect())) == {i: -40 for i in range(-40, 41)} | {99: 99, 100: 99}
    assert common.components(stars.where("a > 100")).count() == 0


def test_pairs_meet_their_values_where_one_has_many(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_DOC", 4)
    pairs = spark.createDataFrame([(0, i) for i in range(1, 30)] + [(3, 4)], "a long, b long")
    values = spark.createDataFrame([(i, f"v{i}") for i in range(40)], "doc_id long, v string")
    assert sorted(map(tuple, simhash._beside(pairs, values).collect())) == sorted((a, b, f"v{a}", f"v{b}") for a, b in pairs.collect())
