from protloom.functions import genotype as g
from protloom.operators import annotate, cohort, intervals, transcripts, variants
from protloom.sources import text
from pyspark.sql import functions as F


def test_genotypes(spark):
    rows = spark.createDataFrame([("0|1",), ("1/1:3",), ("./.",), (".",), ("1",), ("1|2",)], "gt string")
    assert [r[0] for r in rows.select(g.alleles(F.col("gt"))).collect()] == [[0, 1], [1, 1], [0, 0], [0, 0], [1, 0], [1, 2]]


def test_info_threshold(spark):
    rows = spark.createDataFrame([("AF=0.1",), ("AC=1;AF=0.01,0.2",), ("XAF=0.9;AF=0.01",), ("AC=1",), ("AF=.",)], "i string")
    assert [r.i for r in rows.where(g.info_passes(F.col("i"), "AF", 0.05)).collect()] == ["AF=0.1", "AC=1;AF=0.01,0.2", "AC=1"]
    assert rows.where(g.info_passes(F.col("i"), "AF", None)).count() == 5


def test_split_complex(spark):
    rows = spark.createDataFrame([(1, 10, "GG", "TT"), (2, 10, "GG", "TG"), (3, 10, "ACG", "TC"), (4, 10, "A", "AT")], "id int, pos bigint, ref string, alt string")
    got = {tuple(r) for r in variants.split_complex(rows).collect()}
    assert got == {(1, 10, "G", "T"), (1, 11, "G", "T"), (2, 10, "G", "T"), (2, 11, "G", "G"), (3, 10, "A", "T"), (3, 11, "CG", "C"), (4, 10, "A", "AT")}


def test_edits(spark):
    rows = spark.createDataFrame([("1", 5, "A", "GT"), ("1", 9, "ACG", "A")], "chr string, pos bigint, ref string, alt string")
    got = {tuple(r) for r in variants.edit_records(rows, F.lit("-")).select("pos", "ref", "alt").collect()}
    assert got == {(5, "T", "AC"), (10, "G", ""), (11, "C", "")}


def test_haplotypes(spark):
    lines = ["chr1\t10\t.\tA\tC,*\t.\tPASS\t.\tGT\t1|2", "chr1\t10\t.\tA\tG\t.\tPASS\t.\tGT\t1|1", "chr1\t20\t.\tA\tG\t.\tbad\t.\tGT\t1|1", "chrUn\t20\t.\tA\tG\t.\tPASS\t.\tGT\t1|1", "#c"]
    vcf = text.parse_vcf(spark.createDataFrame([(x,) for x in lines], "value string"), ["s"]).withColumn("line", F.monotonically_increasing_id())
    assert {tuple(r) for r in variants.haplotypes(vcf, "s", ["alt"]).collect()} == {(1, "chr1", 10, "A", "C"), (2, "chr1", 10, "A", "G")}


def test_interval_join_is_containment(spark):
    import random

    random.seed(1)
    v = [(i, random.randrange(3), p := random.randrange(300), p + random.randrange(5)) for i in range(200)]
    b = [(i, random.randrange(3), s := random.randrange(300), s + random.randrange(60)) for i in range(60)]
    vs, bs = spark.createDataFrame(v, "vid int, chr int, pos int, pos_end int"), spark.createDataFrame(b, "bid int, chr int, start int, end int")
    for width in (7, 64, 4096):
        got = sorted(tuple(r) for r in intervals.interval_join(vs, bs, width).select("vid", "bid").collect())
        assert got == sorted((x[0], y[0]) for x in v for y in b if x[1] == y[1] and y[2] <= x[2] and x[3] <= y[3])


def one_protein(spark, cds: str, edits: list[tuple]):
    c = spark.createDataFrame([(1, cds)], "id int, cds string")
    e = spark.createDataFrame(edits, "id int, i int, ref string, alt string, variant_id string")
    p = c.select("id", F.substring_index(__import__("protloom.functions.sequence", fromlist=["x"]).translate(F.col("cds")), "*", 1).alias("aa"))
    return annotate.changes(annotate.with_edits(c.join(p, "id"), e, ["id"]), ["id"]).collect()[0]


CDS = "ATGGCCAAACGTGGATAA"  # M A K R G *


def test_missense(spark):
    r = one_protein(spark, CDS, [(1, 4, "C", "A", "v")])
    assert (r.new_aa, r.variant_aa, r.frame_change, r.stop_gain, r.n_deletion_aa, r.n_insertion_aa) == ("MDKRG", "A2D(v)", False, False, 0, 0)


def test_stop_gain_and_loss(spark):
    r = one_protein(spark, CDS, [(1, 6, "A", "T", "v")])
    assert (r.new_aa, r.stop_gain, r.aa_stop_gain, r.n_deletion_aa) == ("MA", True, "K3*(v)", 0)
    r = one_protein(spark, CDS, [(1, 15, "T", "C", "v")])
    assert (r.new_aa, r.stop_loss, r.stop_loss_pos) == ("MAKRGQ", True, "5(v)")


def test_in_frame_deletion_and_insertion(spark):
    r = one_protein(spark, CDS, [(1, i, b, "", "v") for i, b in ((6, "A"), (7, "A"), (8, "A"))])
    assert (r.new_aa, r.deletion_aa, r.frame_change) == ("MARG", "K3-()", False) or (r.new_aa, r.deletion_aa) == ("MARG", "K3-(v)")
    r = one_protein(spark, CDS, [(1, 8, "A", "AGGG", "v")])
    assert (r.new_aa, r.n_insertion_aa, r.insertion_aa) == ("MAKGRG", 1, "-3G(v)")


def test_frame_shift_and_start_guard(spark):
    assert one_protein(spark, CDS, [(1, 7, "A", "", "v")]).frame_change
    c = spark.createDataFrame([(1, CDS)], "id int, cds string")
    e = spark.createDataFrame([(1, 0, "A", "", "v"), (1, 1, "T", "", "v")], "id int, i int, ref string, alt string, variant_id string")
    assert annotate.retranslated(annotate.with_edits(c, e, ["id"]), ["id"]).first().new_cds == CDS


def test_wrong_reference_base_is_ignored(spark):
    assert one_protein(spark, CDS, [(1, 4, "G", "A", "v")]).new_aa == "MAKRG"


def test_patterns_and_cohort(spark):
    rows = spark.createDataFrame([("p", s, v) for s, vs in (("a", "xy"), ("b", "yx"), ("c", "x")) for v in vs], "protein_id string, sample string, variant_id string")
    assert {tuple(r) for r in cohort.sample_patterns(rows).collect()} == {("p", "x,y", 2, "a,b"), ("p", "x", 1, "c")}
    ref = spark.createDataFrame([("p",), ("q",)], "id string")
    changed = spark.createDataFrame([("p", "a"), ("p", "b")], "id string, sample string")
    assert [r.id for r in cohort.still_unchanged(ref, changed, 2, "id").collect()] == ["q"]
    assert cohort.still_unchanged(ref, changed, 3, "id").count() == 2


def test_contigs(spark):
    contigs = spark.createDataFrame([("chr1", ""), ("2", ""), ("NC_3", "Homo chromosome 3, x"), ("MT", "mitochondrion, complete")], "id string, description string")
    names = spark.createDataFrame([("1",), ("chr2",), ("chr3",), ("M",), ("chr9",)], "name string")
    assert {tuple(r) for r in transcripts.resolve_contigs(names, contigs).collect()} == {("1", "chr1"), ("chr2", "2"), ("chr3", "NC_3"), ("M", "MT"), ("chr9", "9")}


def test_fasta_gtf_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">p1 one\nMAK\nRP*\n>p2\nM\n")
    assert {(r.id, r.annotation, r.seq) for r in text.read_fasta(spark, str(tmp_path / "a.fa")).collect()} == {("p1", "one", "MAKRP"), ("p2", "", "M")}
    (tmp_path / "a.gtf").write_text('#!x\n\n1\ts\tCDS\t3\t9\t.\t+\t0\tgene_id "a b"; k=v; gene_id "c";\n')
    r = text.read_gtf(spark, str(tmp_path / "a.gtf")).withColumn("m", text.attributes(F.col("attributes"))).first()
    assert (r.start, r.end, r.frame, r.m) == (3, 9, 0, {"gene_id": "c", "k": "v"})
    assert text.sniff_datatype(spark, str(tmp_path / "a.gtf")) == "gtf"


def test_touched_codons_tell_the_same_as_all(spark):
    import random

    from protloom.functions.sequence import codon_table

    rng, code = random.Random(9), codon_table()
    cds, edits = [], []
    for k in range(150):
        codons = ["ATG", *(rng.choice([c for c, a in code.items() if a != "*"]) for _ in range(rng.randrange(1, 25))), *rng.choice([["TAA"], [], ["TAA", "GGG"], ["GGG"]])]
        text = "".join(codons) + rng.choice(["", "A"])
        aa = "".join(code[c] for c in codons).split("*")[0]
        aa = aa[:-1] + "U" if k % 7 == 0 else aa[: -(k % 2)] if k % 10 == 1 else aa
        cds.append((k, text, aa or "M"))
        for i in rng.sample(range(len(text)), min(len(text), rng.randrange(0, 6))):
            edits.append((k, i, text[i] if rng.random() < 0.9 else "N", rng.choice("ACGT"), f"v{rng.randrange(9)}"))
        if k % 5 == 0:
            edits.append((k, 4, text[4], "", "gone"))
    rows = annotate.with_edits(spark.createDataFrame(cds, "id int, cds string, aa string"), spark.createDataFrame(edits, "id int, i int, ref string, alt string, variant_id string"), ["id"])
    few, all_ = ({r.id: r for r in annotate.changes(rows, ["id"], sparse).collect()} for sparse in (True, False))
    assert len(all_) > 100 and set(few) == set(all_)
    for k in all_:
        assert few[k].asDict() == all_[k].asDict(), cds[k]
