from hypothesis import given
from hypothesis import strategies as st

from protloom.functions import sequence as sq
from protloom.operators import digest as dg
from pyspark.sql import functions as F

CODE = sq.codon_table()


def test_code():
    assert CODE["ATG"] == "M" and CODE["TGA"] == "*" and CODE["GGG"] == "G" and len(CODE) == 64


def test_translation_and_complement(spark):
    rows = spark.createDataFrame([("ATGGCCTAAGG",), ("NNNATG",), ("",), (None,)], "s string")
    got = rows.select(sq.translate(F.col("s")).alias("t"), sq.reverse_complement(F.col("s")).alias("r")).collect()
    assert [r.t for r in got[:3]] == ["MA*", "XM", ""] and got[0].r == "CCTTAGGCCAT" and got[3].r is None


def test_frame_and_strand(spark):
    rows = spark.createDataFrame([("ATGGCC", 0, "+"), ("GGCCAT", 0, "-"), ("CATGGCC", 1, "+")], "s string, f int, d string")
    assert [r[0] for r in rows.select(sq.translate_cds(F.col("s"), F.col("f"), F.col("d"))).collect()] == ["MA", "MA", "XMA"]


def test_falsey(spark):
    rows = spark.createDataFrame([("0",), ("1",), (None,), (" ",), ("[]",), ("yes",)], "v string")
    assert [r.v for r in rows.where(~sq.falsey(F.col("v"))).collect()] == ["1", "yes"]


def model(seq: str, p: dg.Profile) -> set:
    """Digestion written out in plain Python."""
    import re

    out, seq = set(), seq.upper().strip("*")
    forms = [(0, seq)] if p.methionine == "retain" or not seq.startswith("M") else [(1, seq[1:])] if p.methionine == "remove" else [(0, seq), (1, seq[1:])]
    for shift, form in forms:
        for m in re.finditer(r"[^*]+", form):
            s = m.group()
            cut = sorted({0, len(s)} | {x.start() for r in p.rules() for x in re.finditer(r, s)})
            bound = set(cut)
            for a in range(len(s)):
                for b in range(a + max(1, p.min_len), min(len(s), a + p.max_len) + 1):
                    crossed = sum(a < c < b for c in cut)
                    left, right = a in bound, b in bound
                    ok = p.everywhere() or crossed <= p.missed and {"full": left and right, "n-specific": left, "c-specific": right, "semi": left or right}[p.specificity]
                    if ok:
                        out.add((p.nterm + s[a:b] + p.cterm, shift + m.start() + a + 1, shift + m.start() + b))
    return out


def test_digestion_against_plain_python(spark):
    seqs = ["MAKRPQK*PEPTIDEK", "MMKDENFLWY", "", "KKKK", "*AKRP*", "MDEKRNPRK"]
    rows = spark.createDataFrame(list(enumerate(seqs)), "id int, aa string")
    for enzyme in dg.ENZYMES:
        for spec in dg.SPECIFICITIES:
            for met in ("both", "remove", "retain"):
                p = dg.Profile(enzyme=enzyme, missed=1, min_len=2, max_len=6, specificity=spec, methionine=met)
                if p.everywhere() and met == "both":
                    continue
                if spec != "full" and met != "both" or spec == "semi" and enzyme not in ("Trypsin", "Asp_N"):
                    continue
                got = dg.digest(rows, ["id"], "aa", p).collect()
                want = {(i, *x) for i, s in enumerate(seqs) for x in model(s, p)}
                assert {tuple(r) for r in got} == want and len(got) == len(want), (enzyme, spec, met)


def test_profiles_are_checked():
    import pytest

    for bad in ({"enzyme": "nope"}, {"methionine": "x"}, {"specificity": "x"}, {"regex": "(?=K)", "sites": "K"}):
        with pytest.raises(ValueError):
            dg.Profile(**bad)
    assert dg.Profile().digest_id() != dg.Profile(missed=1).digest_id()


@given(st.text("ACGT", max_size=60))
def test_complement_is_its_own_inverse(s):
    turn = str.maketrans(sq.IUPAC, sq.COMPLEMENT)
    assert s[::-1].translate(turn)[::-1].translate(turn) == s
