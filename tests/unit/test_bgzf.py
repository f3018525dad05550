"""Block-compressed files read by many tasks: the same lines, in the same order, as the plain file."""

import gzip
import random
import struct
import zlib

import pytest

from protloom.sources import bgzf, text

END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def bgzip(data: bytes, sizes) -> bytes:
    out, at = b"", 0
    while at < len(data):
        part = data[at : at + next(sizes)]
        at += len(part)
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out += bgzf.HEADER + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out + END


@pytest.fixture
def small_parts(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("ends,held", [("\n", 256), ("", 3)])
def test_same_lines_in_order(spark, small_parts, tmp_path, monkeypatch, ends, held):
    monkeypatch.setattr(bgzf, "HELD", held)
    rng = random.Random(held)
    lines = [f"{i}\t" + "".join(rng.choices("ACGTé", k=rng.choice([0, 5, 60, 900]))) + rng.choice(["", "\r"]) for i in range(2500)]
    lines[700] = "x" + "".join(rng.choices("abcdefghij", k=60_000))  # over several parts
    lines[701] = ""
    data = ("\n".join(lines) + ends).encode()
    (tmp_path / "a.vcf.gz").write_bytes(bgzip(data, iter(lambda: rng.randrange(1, 3000), 0)))
    (tmp_path / "b.txt.gz").write_bytes(gzip.compress(b"plain gzip\nfile\n"))
    (tmp_path / "c.bgz").write_bytes(bgzip(b"", iter([])))
    blocks, others = bgzf.told_apart(spark, str(tmp_path))
    assert [b.rsplit("/", 1)[1] for b in blocks] == ["a.vcf.gz", "c.bgz"] and [o.rsplit("/", 1)[1] for o in others] == ["b.txt.gz"]
    rows = text.read_lines(spark, str(tmp_path / "a.vcf.gz"))
    assert bgzf._blocks(spark, blocks[:1]).rdd.getNumPartitions() > 20
    assert [r.value for r in rows.orderBy("line").collect()] == [x.rstrip("\r") for x in lines]
    assert sorted(r.value for r in text.read_lines(spark, str(tmp_path)).collect()) == sorted([x.rstrip("\r") for x in lines] + ["plain gzip", "file"])


def test_vcf_and_damage(spark, tmp_path):
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n"
    body = "".join(f"chr1\t{i}\t.\tA\tC\t.\tPASS\t.\tGT\t0|1\t{i % 2}|0\n" for i in range(300))
    (tmp_path / "a.vcf").write_text(head + body)
    whole = bgzip((head + body).encode(), iter(lambda: 700, 0))
    (tmp_path / "a.vcf.gz").write_bytes(whole)
    rows = lambda p: sorted(map(tuple, text.read_vcf(spark, str(tmp_path / p)).drop("line").collect()))
    assert text.vcf_samples(spark, str(tmp_path / "a.vcf.gz")) == ["s1", "s2"]
    assert rows("a.vcf.gz") == rows("a.vcf") and len(rows("a.vcf")) == 300
    (tmp_path / "cut.vcf.gz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="isn't as long as its header says"):
        text.read_lines(spark, str(tmp_path / "cut.vcf.gz")).collect()
