"""Numbers of novel peptides beyond six digits."""

import re

import duckdb

from protloom.operators import peptides
from protloom.plans import catalog


def test_numbers_of_seven_digits_are_whole(spark):
    sql = catalog.ORACLE_SQL["novel_peptide_fasta"]
    number = re.search(r"SELECT 'novel_' \|\| .*", sql, re.S).group()
    want = duckdb.sql(f"WITH nv AS (SELECT 'P' || lpad(CAST(range AS varchar), 7, '0') AS peptide, 1 AS n_mappings FROM range(1000001)) SELECT peptide_id, peptide FROM ({number}) WHERE peptide >= 'P0999998' ORDER BY peptide").fetchall()
    assert want == [("novel_999999", "P0999998"), ("novel_1000000", "P0999999"), ("novel_1000001", "P1000000")]
    rows = spark.range(1000001).selectExpr("'P' || lpad(CAST(id AS string), 7, '0') AS peptide")
    got = peptides.numbered(rows).where("peptide >= 'P0999998'").orderBy("peptide").select("peptide_id", "peptide").collect()
    assert [tuple(r) for r in got] == want
