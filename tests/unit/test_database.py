"""End to end on a genome made by hand: two strands, three blocks, one indel and substitutions."""

from pyspark.sql import functions as F

from protloom import cli
from protloom.plans import database
from protloom.sources import text
from protloom.streaming import arrivals


def build(tmp):
    plus = "ATGGCCAAACGTGGA" + "TTTCAGTAA"  # M A K R G | F Q *
    minus = "ATGTGGCATTAA"  # M W H *
    turn = minus[::-1].translate(str.maketrans("ACGT", "TGCA"))
    g = "C" * 10 + plus[:15] + "G" * 5 + plus[15:] + "T" * 6 + turn + "A" * 9
    (tmp / "g.fa").write_text(">chr1 one\n" + g + "\n")
    a, b, c = 11, 31, 46
    rows = [("CDS", a, a + 14, "+", 0, "p1"), ("CDS", b, b + 8, "+", 0, "p1"), ("exon", a, a + 14, "+", ".", "p1"), ("exon", b, b + 8, "+", ".", "p1"), ("CDS", c, c + 11, "-", 0, "p2"), ("exon", c, c + 11, "-", ".", "p2")]
    (tmp / "m.gtf").write_text("".join(f'chr1\ts\t{f}\t{s}\t{e}\t.\t{d}\t{r}\tParent "{p}";\n' for f, s, e, d, r, p in rows))
    (tmp / "p.fa").write_text(">p1 first\nMAKRGFQ\n>p2 second\nMWH\n>p3 elsewhere\nMMM\n")
    return g, a, b, c


def test_haplotypes_of_a_vcf(spark, tmp_path):
    g, a, b, c = build(tmp_path)
    base = lambda p: g[p - 1]
    vcf = [(a + 4, base(a + 4), "A", "1|0"), (b, base(b), "C", "1|1"), (c + 6, base(c + 6), "A" if base(c + 6) != "A" else "G", "0|1")]
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n"
    (tmp_path / "v.vcf").write_text(head + "".join(f"1\t{p}\t.\t{r}\t{x}\t.\tPASS\t.\tGT\t{gt}\n" for p, r, x, gt in vcf))
    cli.main(["build-store", "-g", str(tmp_path / "g.fa"), "-f", str(tmp_path / "m.gtf"), "-p", str(tmp_path / "p.fa"), "-o", str(tmp_path / "store")])
    m, contigs = database.from_store(spark, str(tmp_path / "store"))
    assert {r.protein_id: r.translated for r in m.proteins.collect()} == {"p1": "MAKRGFQ", "p2": "MWH"}
    carried = database.in_genome(database.by_haplotype(spark, str(tmp_path / "v.vcf")), contigs)
    got = {(r.protein_id, r.samples): (r.new_aa, r.n_variant_aa) for r in database.changed_proteins(m, carried).collect()}
    assert got["p1", "1"] == ("MDKRGLQ", 2) and got["p1", "2"] == ("MAKRGLQ", 1) and ("p2", "2") in got and len(got) == 3
    cli.main(["run", "-S", str(tmp_path / "store"), "-m", str(tmp_path / "v.vcf"), "-o", str(tmp_path / "out")])
    lines = {r[0] for r in spark.read.text(str(tmp_path / "out/protein_changed")).collect()}
    assert "MDKRGLQ" in lines and spark.read.csv(str(tmp_path / "out/aa_mutations"), sep="\t", header=True).count() == 3


def test_deletion_by_literal(spark, tmp_path):
    g, a, b, c = build(tmp_path)
    genome, ref = text.read_fasta(spark, str(tmp_path / "g.fa")), text.read_fasta(spark, str(tmp_path / "p.fa"))
    m = database.models(genome, text.read_gtf(spark, str(tmp_path / "m.gtf")), ref)
    rows = spark.createDataFrame([("chr1", a + 5, g[a + 4 : a + 8], g[a + 4], "x")], "chr string, pos bigint, ref string, alt string, sample string")
    r = database.changed_proteins(m, rows).collect()
    assert [(x.protein_id, x.new_aa, x.n_deletion_aa, x.frame_change) for x in r] == [("p1", "MARGFQ", 1, False)]


def test_arriving_files_are_taken_once(spark, tmp_path):
    build(tmp_path)
    m = database.models(text.read_fasta(spark, str(tmp_path / "g.fa")), text.read_gtf(spark, str(tmp_path / "m.gtf")), text.read_fasta(spark, str(tmp_path / "p.fa")))
    (tmp_path / "in").mkdir()
    for k in (1, 2):
        (tmp_path / f"in/{k}.tsv").write_text(f"chr\tpos\tref\talt\nchr1\t{11 + k}\tA\tG\nchr1\t3\tC\tG\n")
        arrivals.annotate_arrivals(arrivals.arriving_variants(spark, str(tmp_path / "in")), m.blocks, str(tmp_path / "hits"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "hits")).count() == k


def test_genome_tiles_over_parts_of_files(spark, tmp_path):
    import random

    rng = random.Random(5)
    want, names = {}, []
    for k in range(3):
        out = []
        for j in range(rng.randrange(1, 6)):
            size = rng.choice([0, 1, 59, 60, 61, 700, 3000])
            name, seq = f"c{k}_{j}", "".join(rng.choices("acgt", k=size))
            out.append(f">{name} about {j}\n" + "".join(seq[i : i + 60] + "\n" for i in range(0, size, 60)))
            names.append(name)
            if size:
                want[name] = seq.upper()
        (tmp_path / f"{k}.fa").write_text("".join(out))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for part in ("150", "1000", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", part)
            tiles, contigs = text.read_genome(spark, str(tmp_path / "*.fa"), 64)
            got: dict[str, dict[int, str]] = {}
            for r in tiles.collect():
                got.setdefault(r.seqname, {})[r.tile] = r.bases
            assert {n: "".join(t[i] for i in range(len(t))) for n, t in got.items()} == want
            assert all(len(b) == 64 for t in got.values() for i, b in t.items() if i < len(t) - 1)
            assert sorted(r.id for r in contigs.collect()) == sorted(names)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


HEAD = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"


def test_cohorts_as_arrays(spark, tmp_path):
    import random

    from protloom.operators import variants

    rng = random.Random(6)
    cells = ["0|0", "0/0", "./.", ".", "0|1", "1|0", "1/2", "2|1", "./1", "1", "0|1:35", "3|0"]
    lines = ["\t".join(["chr1", str(p), ".", "A", rng.choice(["C", "C,G", "G,*", "A,T"]), ".", "PASS", ".", "GT", *rng.choices(cells, k=4)]) for p in range(1, 120)]
    (tmp_path / "v.vcf").write_text(HEAD + "S1\tS2\tS3\tS4\n" + "\n".join(lines) + "\n")
    path = str(tmp_path / "v.vcf")
    for asked, names in (("ALL_SAMPLES", ["S1", "S2", "S3", "S4"]), ("S3,S1,S3,zz", ["S3", "S1"]), (["S2"], ["S2"])):
        vcf = text.read_vcf(spark, path, names)
        wide = variants.explode_alternatives(vcf.select(F.col("chrom").alias("chr"), "pos", "ref", "alt", *names), names)
        long = variants.carriers(wide, ["chr", "pos", "ref", "alt"], [f"{s}__{h}" for s in names for h in (1, 2)])
        want = sorted((r.pos, r.ref, r.alt, f"{r.sample}__{r.hap}") for r in long.collect())
        assert sorted((r.pos, r.ref, r.alt, r.sample) for r in database.by_sample(spark, path, asked).collect()) == want and want
    every = {(r.pos, r.alt, r.sample) for r in database.by_sample(spark, path, "ALL_VARIANTS").collect()}
    assert every == {(p, x, "1") for p, line in enumerate(lines, 1) for x in line.split("\t")[4].split(",") if x not in ("*", "A")}
    # one file a sample by a manifest: the same carriers as of the cohort's file
    for k in range(4):
        (tmp_path / f"one{k}.vcf").write_text(HEAD + f"other\tS{k + 1}\n" + "".join("\t".join([*line.split("\t")[:9], "0|0", line.split("\t")[9 + k]]) + "\n" for line in lines))
    (tmp_path / "list.tsv").write_text("filepath\tsample\tname_use\n" + "".join(f"{tmp_path}/one{k}.vcf\tS{k + 1}\tN{k + 1}\n" for k in range(4)))
    assert text.is_manifest(spark, str(tmp_path / "list.tsv")) and not text.is_manifest(spark, path)
    got = {(r.pos, r.alt, r.sample) for r in database.by_manifest(spark, str(tmp_path / "list.tsv")).collect()}
    assert {x[2].split("__")[0] for x in got} == {"N1", "N2", "N3", "N4"}
    whole = {(r.pos, r.alt, r.sample.replace("S", "N")) for r in database.by_sample(spark, path).collect()}
    assert got <= whole and all("./1" in lines[p - 1] or lines[p - 1].split("\t")[9:].count(".") for p, _, _ in whole - got)
    # and by a table of samples
    cohort = database.by_sample(spark, path)
    database.write_cohort(cohort, str(tmp_path / "cohort"))
    table = text.table_carriers(spark, str(tmp_path / "cohort"))
    assert {tuple(r) for r in table.collect()} == {(r.chr, r.pos, r.ref, r.alt, r.sample) for r in cohort.collect()}
    assert {r.sample for r in text.table_carriers(spark, str(tmp_path / "cohort"), "S2__1").collect()} == {"S2__1"}


def test_command_line_of_a_cohort(spark, tmp_path):
    g, a, b, c = build(tmp_path)
    (tmp_path / "my-list-of-things.tsv").write_text("pos\tchr\talt\tref\tX\tY\n" + f"{a + 4}\tchr1\tA\t{g[a + 3]}\t1\t0\n{b}\tchr1\tC\t{g[b - 1]}\t1\t1\n")
    (tmp_path / "u.fa").write_text(">U1 one\nMAKRGFQ\n>U2 two\nMMMM\n")
    cli.main(["run", "-g", str(tmp_path / "g.fa"), "-f", str(tmp_path / "m.gtf"), "-p", str(tmp_path / "p.fa"), "-m", str(tmp_path / "my-list-of-things.tsv"), "-o", str(tmp_path / "out"), "--novel_peptides", "-l", "2", "-U", str(tmp_path / "u.fa"), "--cohort_table", str(tmp_path / "table")])
    lines = lambda name: [r[0] for r in spark.read.text(f"{tmp_path}/out/{name}").collect()]
    all_ = lines("protein_all")
    assert "MDKRGLQ" in all_ and "MAKRGLQ" in all_ and "MWH" in all_ and "MAKRGFQ" not in all_
    assert lines("protein_peff/head")[0] == "# PEFF 1.0" and any(x.startswith("# NumberOfEntries=") for x in lines("protein_peff/head"))
    table = spark.read.csv(f"{tmp_path}/out/peptide_novel_table", sep="\t", header=True)
    assert len(table.columns) == 24 and table.columns[:2] == ["peptide_id", "peptide_sequence"] and table.where("peptide_sequence = 'GLQ'").count() >= 1
    assert not table.where("peptide_sequence = 'MWH'").count()
    assert sum(x.startswith(">") for x in lines("peptide_novel")) == table.select("peptide_id").distinct().count()
    assert spark.read.csv(f"{tmp_path}/table", sep="\t", header=True).columns == ["chr", "pos", "ref", "alt", "X", "Y"]
    cli.main(["run", "-g", str(tmp_path / "g.fa"), "-f", str(tmp_path / "m.gtf"), "-p", str(tmp_path / "p.fa"), "-m", f"chr1-{a + 4}-{g[a + 3]}-A", "-o", str(tmp_path / "out2")])
    assert "MDKRGFQ" in [r[0] for r in spark.read.text(f"{tmp_path}/out2/protein_changed").collect()]
    status = spark.read.csv(f"{tmp_path}/out/protein_status", sep="\t", header=True).collect()
    assert {(r.protein_id, r.samples): r.status for r in status} == {("p1", "X"): "changed", ("p1", "Y"): "changed"}


def test_unchanged_in_a_cohort(spark, tmp_path):
    g, a, b, c = build(tmp_path)
    genome, ref = text.read_genome(spark, str(tmp_path / "g.fa"), 64)[0], text.read_fasta(spark, str(tmp_path / "p.fa"))
    m = database.models(genome, text.read_gtf(spark, str(tmp_path / "m.gtf")), ref)
    rows = spark.createDataFrame([("chr1", b, g[b - 1], "C", s) for s in ("x", "y")], "chr string, pos bigint, ref string, alt string, sample string")
    for n, there in ((2, False), (3, True)):
        database.write_outputs(m, ref, database.changed_proteins(m, rows), str(tmp_path / "o"), n)
        assert ("MAKRGFQ" in [r[0] for r in spark.read.text(f"{tmp_path}/o/protein_all").collect()]) == there


def test_digest_command_and_index(spark, tmp_path):
    from protloom.operators import digest as dg
    from protloom.operators import peptides

    (tmp_path / "p.fa").write_text(">A one\nMAAKCCCKDDD\n>B two\nCCCKEEEK\n")
    cli.main(["digest", str(tmp_path / "p.fa"), "-o", str(tmp_path / "d"), "--output-format", "fasta", "-l", "3", "--missed-cleavages", "0", "--initiator-methionine", "retain", "--header-template", "x|{protein_id}|{index}"])
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "d")).collect()) == sorted([">x|A|1", "MAAK", ">x|A|2", "CCCK", ">x|A|3", "DDD", ">x|B|1", "EEEK"])
    proteins, p = text.read_fasta(spark, str(tmp_path / "p.fa")), dg.Profile(missed=0, min_len=3)
    assert peptides.index_state(spark, str(tmp_path / "i")) == peptides.IndexState()
    peptides.ensure_index(proteins, ["id"], "seq", p, str(tmp_path / "i"))
    state, files = peptides.index_state(spark, str(tmp_path / "i")), sorted(x.name for x in (tmp_path / "i/peptides").iterdir())
    assert (state.digest_id, state.n_proteins) == (p.digest_id(), 2)
    assert peptides.ensure_index(proteins, ["id"], "seq", p, str(tmp_path / "i")).count() == 5 and sorted(x.name for x in (tmp_path / "i/peptides").iterdir()) == files
    assert peptides.ensure_index(proteins, ["id"], "seq", dg.Profile(missed=0, min_len=4), str(tmp_path / "i")).count() == 3
    assert peptides.index_state(spark, str(tmp_path / "i")).digest_id != p.digest_id()


def test_finished_contigs_are_not_computed_again(spark, tmp_path, monkeypatch):
    g, a, b, c = build(tmp_path)
    (tmp_path / "g.fa").write_text(f">chr1 one\n{g}\n>chr2 two\n{g}\n")
    gtf = (tmp_path / "m.gtf").read_text()
    (tmp_path / "m.gtf").write_text(gtf + gtf.replace("chr1", "chr2").replace("p1", "q1").replace("p2", "q2"))
    (tmp_path / "p.fa").write_text(">p1 first\nMAKRGFQ\n>p2 second\nMWH\n>q1 x\nMAKRGFQ\n>q2 y\nMWH\n")
    m = database.models(text.read_fasta(spark, str(tmp_path / "g.fa")), text.read_gtf(spark, str(tmp_path / "m.gtf")), text.read_fasta(spark, str(tmp_path / "p.fa")))
    carried = spark.createDataFrame([(f"chr{k}", a + 4, g[a + 3], "A", "x") for k in (1, 2)], "chr string, pos bigint, ref string, alt string, sample string")
    want = sorted(map(str, database.translated(m, carried).collect()))
    plain, calls = database.translated, []

    def stopping(models, rows):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return plain(models, rows)

    monkeypatch.setattr(database, "translated", stopping)
    folder = str(tmp_path / "run")
    try:
        database.translated_by_contig(m, carried, folder)
    except KeyboardInterrupt:
        pass
    assert len(calls) == 2
    assert sorted(map(str, database.translated_by_contig(m, carried, folder).collect())) == want and len(calls) == 3
    database.translated_by_contig(m, carried, folder)
    assert len(calls) == 3


def test_merge_rewrites_touched_partitions_only(spark, tmp_path):
    from protloom.sources import store

    path = tmp_path / "s"
    rows = lambda x: spark.createDataFrame(x, "id string, at int, note string, seqname string")
    rows([("a", 1, "old", "1"), ("b", 5, "old", "1"), ("c", 1, "old", "2")]).write.partitionBy("seqname").parquet(str(path / "t"))
    before = {p: p.stat().st_mtime_ns for p in (path / "t/seqname=2").glob("part*")}
    assert store.merge_store(str(path), "t", rows([("a", 2, "new", "1"), ("b", 4, "late", "1"), ("d", None, "new", "3")]), ["id"], "at") == 2
    got = {(r.seqname if isinstance(r.seqname, str) else str(r.seqname), r.id): r.note for r in spark.read.parquet(str(path / "t")).collect()}
    assert got == {("1", "a"): "new", ("1", "b"): "old", ("2", "c"): "old", ("3", "d"): "new"}
    assert {p: p.stat().st_mtime_ns for p in (path / "t/seqname=2").glob("part*")} == before
    assert store.merge_store(str(path), "t", rows([]), ["id"], "at") == 0


def test_run_by_matrix_with_quarantine_and_resume(spark, tmp_path):
    g, a, b, c = build(tmp_path)
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\tT\n"
    rows = [(a + 4, g[a + 3], "A", "1|0", "0|0"), (b, g[b - 1], "C", "1|1", "0|1")]
    (tmp_path / "v.vcf").write_text(head + "".join(f"1\t{p}\t.\t{r}\t{x}\t.\tPASS\t.\tGT\t{s}\t{t}\n" for p, r, x, s, t in rows) + "1\tx\t.\tA\tC\t.\tPASS\t.\tGT\t0|1\t0|1\n")
    at = lambda name: str(tmp_path / name)
    cli.main(["build-store", "-g", at("g.fa"), "-f", at("m.gtf"), "-p", at("p.fa"), "-o", at("store")])
    cli.main(["build-matrix", "-m", at("v.vcf"), "-o", at("matrix")])
    outputs = {}
    for out, args in (("text", ["-m", at("v.vcf"), "--quarantine", at("bad")]), ("bits", ["--matrix", at("matrix"), "--resume", at("done"), "--novel_peptides", "-l", "1"])):
        cli.main(["run", "-S", at("store"), "-s", "ALL_SAMPLES", "-o", at(out), *args])
        outputs[out] = sorted(map(str, spark.read.csv(at(f"{out}/aa_mutations"), sep="\t", header=True).collect()))
    assert outputs["text"] == outputs["bits"] and len(outputs["text"]) >= 2
    assert [(r.reason, r.value.split("\t")[1]) for r in spark.read.parquet(at("bad")).collect()] == [("bad position", "x")]
    assert spark.read.csv(at("bits/peptide_novel_table"), sep="\t", header=True).count() > 0
    index = [p.name for p in tmp_path.iterdir() if p.name.startswith("store-peptides-")]
    assert len(index) == 1
    cli.main(["run", "-S", at("store"), "-m", f"chr1-{a + 4}-{g[a + 3]}-A", "-o", at("literal")])
    assert spark.read.csv(at("literal/aa_mutations"), sep="\t", header=True).count() == 1
