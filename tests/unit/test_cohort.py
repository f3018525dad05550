"""Genotype matrices, sets of variants, bins, numbers by ranges, lines that can't be read, and plans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from protloom.operators import annotate, cohort, digest, intervals, matrix, peptides, variants
from protloom.plans import bindings, catalog, database
from protloom.sources import faults, text

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"


def some_vcf(rng, samples, lines):
    cells = ["0|0", "0/1", "1|0", "1|1", "2|1", ".|.", "./1", ".", "0", "1", "12|0", "0|1:35:x", "0/0:0|1", "", "x|1", "1|2|3", "-1|1", "1"]
    rows = [HEAD + "".join(f"\ts{i}" for i in range(samples))]
    for k in range(lines):
        some = cells if k % 5 else ["0|0", "./.", ".|."] if k % 10 else ["./1", ".|0"]
        n = samples if k % 7 else rng.choice([samples - 1, samples + 2, 0])
        calls = [rng.choice(some) for _ in range(n)]
        rows.append("\t".join([f"chr{k % 3}", str(k + 1), f"id{k}", "A", rng.choice(["C", "C,G", "*,T", "A,T", "C,*,G,T,A,C,C,C,C,C,C,G"]), ".", "PASS", ".", "GT", *calls]))
    return "\n".join(rows) + "\n"


def test_matrix_has_the_carriers_of_the_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(matrix, "STEP", 700)
    for samples in (1, 3, 70):
        path = tmp_path / f"{samples}.vcf"
        path.write_text(some_vcf(random.Random(samples), samples, 120))
        lines, ids = text.read_lines(spark, str(path)), ["id", "pos"]
        want = variants.call_carriers(text.parse_calls(lines), ids).where(F.col("i") < samples)
        packed = matrix.pack(text.with_cells(lines), ids, samples)
        key = lambda df: sorted(map(tuple, df.select("id", "pos", "ref", "alt", "i", "hap").collect()))
        assert key(matrix.carriers(packed, ids)) == key(want)
        some = [0, samples - 1]
        assert key(matrix.carriers(packed, ids, sorted(set(some)))) == key(want.where(F.col("i").isin(*some)))


def test_matrix_blocks_are_read_by_samples(spark, tmp_path):
    n = matrix.BLOCK * 2 + 5
    row = ["chr1", "7", "x", "A", "C", ".", "PASS", ".", "GT", *("0|1" if i in (3, 63, 64, n - 1) else "0|0" for i in range(n))]
    (tmp_path / "a.vcf").write_text(HEAD + "".join(f"\ts{i}" for i in range(n)) + "\n" + "\t".join(row) + "\n")
    database.build_matrix(spark, str(tmp_path / "a.vcf"), str(tmp_path / "m"))
    bits, names = matrix.read(spark, str(tmp_path / "m"))
    assert len(names) == n and sorted(r.block for r in bits.select("block").collect()) == [0, 2]
    for samples in (["s3", "s64"], [f"s{n - 1}"], "ALL_SAMPLES", "ALL_VARIANTS"):
        key = lambda df: sorted(map(tuple, df.select("chr", "pos", "ref", "alt", "sample").collect()))
        assert key(database.by_matrix(spark, str(tmp_path / "m"), samples)) == key(database.by_sample(spark, str(tmp_path / "a.vcf"), samples))
    plan = matrix.carriers(bits, ["chr", "pos"], [n - 1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in plan and "block#" in plan.split("PartitionFilters", 1)[1][:60]


def test_no_samples_and_no_lines(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(HEAD + "\ts1\n")
    packed = matrix.pack(text.with_cells(text.read_lines(spark, str(tmp_path / "a.vcf"))), ["pos"], 1)
    assert matrix.carriers(packed, ["pos"]).count() == 0
    line, column, a1, a2, missing = matrix.decode(b"", np.array([0, 1]))
    assert len(line) == len(a1) == 0


def test_patterns_against_sets(spark):
    rng = random.Random(4)
    rows = [(p, s, rng.choice(["a,b", "a", "b", "c", None, "é"])) for p in range(4) for s in range(12) for _ in range(rng.randrange(4))]
    df = spark.createDataFrame(rows + rows[:9], "protein_id int, sample int, variant_id string")
    sets = {}
    for p, s, v in rows:
        if v is not None:
            sets.setdefault((p, s), set()).add(v)
    want = {}
    for (p, s), v in sets.items():
        want.setdefault((p, tuple(sorted(v))), []).append(str(s))
    got = {(r.protein_id, tuple(r.variants)): (r.n_samples, r.samples) for r in cohort.pattern_variants(df).collect()}
    assert got == {k: (len(s), ",".join(sorted(s))) for k, s in want.items()}
    assert {(r.protein_id, r.pattern) for r in cohort.sample_patterns(df).collect()} == {(p, ",".join(v)) for p, v in want}


def test_blocks_of_all_lengths(spark):
    rng = random.Random(6)
    blocks = [("1", i, s, s + rng.choice([0, 50, 5000, 70_000, 50_000_000])) for i, s in enumerate(rng.sample(range(1, 1_000_000), 60))] + [("2", 99, 9, 3)]
    points = [("1", i, p, p + rng.choice([0, 3, 60])) for i, p in enumerate(rng.sample(range(1, 60_000_000), 300) + rng.sample(range(1, 1_000_000), 300))]
    b, v = spark.createDataFrame(blocks, "chr string, b int, start long, end long"), spark.createDataFrame(points, "chr string, v int, pos long, pos_end long")
    got = sorted(map(tuple, intervals.interval_join(v, b).select("v", "b").collect()))
    assert got == sorted((i, j) for c, i, p, q in points for d, j, s, e in blocks if c == d and s <= p and q <= e)
    assert intervals.interval_join(v, b.where("false")).count() == 0


def test_numbers_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(peptides, "GROUP", 4)
    rng = random.Random(2)
    some = ["PRE" + "".join(rng.choices("ACDE", k=rng.randrange(6))) for _ in range(500)]
    for rows in (some, some[:3], []):
        got = peptides.numbered(spark.createDataFrame([(x,) for x in rows], "peptide string")).orderBy("peptide_id").collect()
        assert [(r.peptide_id, r.peptide, r.n_mappings) for r in got] == [(f"novel_{i + 1:06d}", x, rows.count(x)) for i, x in enumerate(sorted(set(rows)))]


def test_faults(spark, tmp_path):
    lines = ["#c", "", "chr1\t5\t.\tA\tC\t.\tPASS\t.\tGT\t0|1", "chr1\t5", "chr1\tx\t.\tA\tC\t.\t.\t.\tGT\t0|1", "chr1\t6\t.\t<N>\tC\t.\t.\t.\tGT\t0|1", "chr1\t6\t.\tA\t.\t.\t.\t.\tGT\t0|1", "chr1\t6\t.\tA\tC\t.\t.\t.\tGT"]
    (tmp_path / "a.vcf").write_text(HEAD + "\ts1\n" + "\n".join(lines[1:]) + "\n")
    (tmp_path / "a.gtf").write_text("#x\n1\ts\tCDS\t1\t9\t.\t+\t0\ta\n1\ts\tCDS\t9\t1\t.\t+\t0\ta\n1\ts\tCDS\t1\n1\ts\tCDS\t1\t9\t.\t*\t0\ta\n")
    got = {(r.kind, r.reason): r.n for r in faults.quarantine(spark, str(tmp_path / "q"), str(tmp_path / "a.vcf"), str(tmp_path / "a.gtf")).collect()}
    assert got == {**{("vcf", k): 1 for k in ("few columns", "bad position", "bad reference", "no alternative", "missing calls")}, **{("gtf", k): 1 for k in ("few columns", "bad range", "bad strand")}}
    assert {r.value for r in spark.read.parquet(str(tmp_path / "q")).where("reason = 'bad position'").collect()} == {lines[4]}
    table = spark.createDataFrame([("chr\tpos\tref\talt",), ("1\t5\tA\tC",), ("1\t5",), ("1\t-\tA\tC",), ("1\t4\t\tC",), ("1\t4\tA\t",)], "value string")
    assert {r.reason: r.n for r in faults.by_reason(faults.table_faults(table, "chr\tpos\tref\talt")).collect()} == {"few columns": 1, "bad position": 1, "bad reference": 1, "no alternative": 1}


def test_equal_stems_are_an_error(spark):
    rows = spark.createDataFrame([("/a/x.vcf",), ("/b/x.vcf.gz",)], "filepath string")
    with pytest.raises(Exception, match="several files of the manifest"):
        variants.sample_names(rows).collect()


def test_literals_of_any_chromosome(spark):
    rows = spark.createDataFrame([("chrX-100-a-C,12-5-A-T,M-1-A-",)], "v string")
    assert [r.chr for r in text.literal_variants(rows, "v", any_name=True).collect()] == ["X", "12"]
    assert [r.chr for r in text.literal_variants(rows, "v").collect()] == ["12"]


def test_plans(spark):
    """Lines are split once for the fixed columns and once for the cells; protein changes need no window and no codon rows;
    a digest's plan is built without a job."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    lines = spark.createDataFrame([("chr1\t5\tx\tA\tC\t.\tPASS\t.\tGT\t0|1\t0|0",)], "value string")
    found = plan(variants.haplotypes(text.parse_vcf(lines, ["s1", "s2"]), "s1", ["id"]))
    assert found.count("split(value") == 1 and found.count("split(__cells") == 1
    rows = annotate.with_edits(spark.createDataFrame([("p", "ATGAAATAA", "MK")], "id string, cds string, aa string"), spark.createDataFrame([("p", 4, "A", "C", "v")], "id string, i int, ref string, alt string, variant_id string"), ["id"])
    changed = annotate.changes(rows, ["id"])
    assert "Window" not in plan(changed) and plan(changed).count("Aggregate") == 1
    assert [(r.new_aa, r.variant_aa) for r in changed.collect()] == [("MT", "K2T(v)")]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "building a plan")
    digest.digest(changed, ["id"], "new_aa")
    assert not tracker.getJobIdsForGroup("plan")
    spark.sparkContext.setJobGroup("", "")


def test_store_reads_the_bins_at_hand(spark, tmp_path):
    from protloom.sources import store

    w = store.STORE_BIN
    blocks = spark.createDataFrame([(f"p{i}", c, s, e) for i, (c, s, e) in enumerate([("1", 10, 90), ("1", w - 5, w + 5), ("1", 3 * w, 9 * w), ("2", 10, 90), ("1", 8 * w + 7, 8 * w + 9)])], "protein_id string, seqname string, start long, end long")
    store.write_store(str(tmp_path), spark.createDataFrame([("p0", "1")], "protein_id string, seqname string"), blocks, spark.createDataFrame([("1", "x")], "id string, description string"))
    everything = lambda df: sorted(map(tuple, df.select("protein_id", F.col("seqname").cast("string"), "start", "end").collect()))
    assert everything(store.read_store(spark, str(tmp_path), "blocks")) == everything(blocks)
    variants_ = spark.createDataFrame([("1", w + 1), ("1", 8 * w + 8), ("3", 5)], "chr string, pos long")
    near = store.touched_blocks(spark, str(tmp_path), variants_)
    assert {r.protein_id for r in near.collect()} == {"p1", "p2", "p4"}
    scanned = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scanned and "bin#" in scanned.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert store.touched_blocks(spark, str(tmp_path), variants_.where("false")).count() == 0


def test_index_is_joined_as_it_lies(spark, tmp_path):
    profile = digest.Profile()
    proteins = spark.createDataFrame([("a", "MAKRGFQKLLLLLLK"), ("b", "MPEPTIDEKAAAAAAK")], "id string, seq string")
    path = str(tmp_path / "i")
    peptides.ensure_index(proteins, ["id"], "seq", profile, path)
    spark.sql(f"DROP TABLE {peptides._table(path)}")  # as in another session
    index = peptides.ensure_index(proteins, ["id"], "seq", profile, path)
    want = {r.peptide for r in peptides.peptide_index(proteins, ["id"], "seq", profile).collect()}
    assert {r.peptide for r in index.collect()} == want
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = peptides.novel(spark.createDataFrame([(x,) for x in [*want, "NEWPEPK"]], "peptide string"), index)
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert [r.peptide for r in fresh.collect()] == ["NEWPEPK"] and plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.sql(f"DROP TABLE {peptides._table(path)}")
