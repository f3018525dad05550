"""Sums over a protein's codons against the codons themselves, and what of them is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from protloom.operators import annotate
from protloom.plans.bindings import Tables


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    cds, edits = [], []
    for p in range(80):
        seq = "".join(rng.choice("ACGT") for _ in range(rng.choice([2, 3, 30, 91])))
        cds.append((p, seq, None if p % 9 == 0 else "".join(rng.choice("ACDEK*") for _ in range(len(seq) // 3 - p % 3))))
        edits += [(p, i, seq[i], rng.choice(["", "", "T", "ACG", seq[i] + "A"]), f"v{i % 7}") for i in range(len(seq)) if rng.random() < 0.2]
    return annotate.with_edits(spark.createDataFrame(cds, "id int, cds string, aa string"), spark.createDataFrame(edits, "id int, i int, ref string, alt string, variant_id string"), ["id"]).persist()


def test_sums_are_those_of_the_codons(rows):
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    al = annotate.aligned_codons(rows, ["id"]).persist()
    assert same(annotate.first_uses(rows, ["id"]), al.where("aa_index is not null").groupBy("id", "aa_index").agg(F.count("*").alias("uses"), F.min("n").alias("first_n")))
    ref = rows.where("aa <> '' and length(cds) > 2").select("id", F.explode(F.sequence(F.lit(1), F.least(F.floor(F.length("cds") / 3), F.length("aa")).cast("int"))).alias("aa_index"))
    assert same(annotate.deleted_residues(rows, ["id"]), ref.join(al.select("id", F.col("filled").alias("aa_index")).distinct(), ["id", "aa_index"], "left_anti"))
    stop = al.where("aa_alt = '*'").groupBy("id").agg(F.min("n").alias("stop"))
    assert same(annotate.aligned_codons(rows, ["id"], ("n", "filled"), to_stop=True), al.join(stop, "id", "left").where("stop is null or n < stop"))
    letters = annotate.edited_bases(rows, ["id"]).select("id", "i", F.posexplode(F.split("new", "")).alias("k", "base")).where("base <> ''")
    assert same(annotate.edited_letters(rows, ["id"]), letters)
    joined = annotate.edited_bases(rows, ["id"]).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "new"))), lambda x: x["new"]), "").alias("new_cds"))
    assert same(annotate.retranslated(rows, ["id"]).select("id", "new_cds"), joined)


def test_changes_are_those_of_expressions(rows):
    got, want = ({r.id: r.asDict() for r in annotate.changes(rows, ["id"], sparse).collect()} for sparse in (True, False))
    assert got == want and len(got) > 20
    every = {r.id: r.asDict() for r in annotate.changes(rows, ["id"], every=True).collect()}
    assert len(every) == 80 and {k: v for k, v in every.items() if v["new_aa"] is not None} == want


def test_codons_are_not_shuffled(spark):
    from protloom.plans import catalog

    for name in ("codon_first_use", "deleted_positions", "truncate_at_stop", "aa_mutations", "protein_all", "peff_headers"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not any(x in line for line in plan.splitlines() for x in ("Exchange", "Join") if any(y in line for y in ("aa_index", "new_aa", "filled", "aa_alt"))), plan


def test_letters_of_texts(spark, tmp_path):
    texts = ["aZ b-É1éßj", None, "", "ß東", "x" * 1000 + "\n"]
    spark.createDataFrame([(i, x, "en", "s") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.s for r in Tables(spark, str(tmp_path)).v_letters.collect()}
    assert got == {0: "AZBJ", 1: "", 2: "", 3: "", 4: "X" * 1000}


def test_proteins_and_orientation(spark):
    from protloom.functions.sequence import translate
    from protloom.operators import edited, transcripts

    seqs = [(1, "ATGAAATAAGG"), (2, "TAAATG"), (3, "AT"), (4, ""), (5, None), (6, "ATGNNNCC"), (7, "GGGCCCA")]
    rows = edited.with_protein(spark.createDataFrame(seqs, "id int, cds string"), ["id"])
    assert {r.id: r.aa for r in rows.collect()} == {1: "MK", 2: None, 3: None, 4: None, 5: None, 6: "MX", 7: "GP"}
    plain = rows.withColumn("want", F.nullif(F.substring_index(translate(F.col("cds")), "*", 1), F.lit("")))
    assert plain.where("not (aa <=> want)").count() == 0
    blocks = spark.createDataFrame([(1, 5, 6, "-"), (1, 1, 3, "-"), (2, 2, 4, "+")], "id int, start int, end int, strand string")
    genome = spark.createDataFrame([(1, "ACGTRY"), (2, "ACGT")], "id int, seq string")
    got = {r.id: r.cds for r in transcripts.coding_sequence(blocks, genome, ["id"], "id", oriented=True).collect()}
    assert got == {1: "RYCGT", 2: "CGT"}
