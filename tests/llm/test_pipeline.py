from pathlib import Path

import pytest

import corpus_pipeline
from protloom.llm import decontaminate, registry
from protloom.llm.common import read

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are absent")


def test_stages_keep_columns_and_decide(spark):
    docs = read(spark, str(DATA), "documents")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(DATA))
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]
    assert decontaminate.matches(docs, read(spark, str(DATA), "benchmark")).count() == 0
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA)).collect()
    assert {r.doc_id for r in mix} <= {r.doc_id for r in docs.collect()} and mix


def test_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    for name, sql in registry.ORACLE_SQL.items():
        got, want = registry.QUERIES[name](spark, str(DATA)).collect(), con.execute(sql).fetchall()
        show = lambda v: f"{v:.9g}" if isinstance(v, float) else v
        assert sorted(map(str, ([show(v) for v in r] for r in got))) == sorted(map(str, ([show(v) for v in r] for r in want))), name
