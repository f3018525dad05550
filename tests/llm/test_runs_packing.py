"""Periodic runs and packing against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from protloom.llm import packing, runs

SPACE = re.compile("[\\x20\\x09-\\x0D]+")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def brute_runs(w, exponent=4, min_length=6):
    """Runs by trying every period, smallest first: a stretch found before under a smaller period isn't one of this period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j + q - i >= max(min_length, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def some_words(rng):
    n, k = rng.choice([0, 1, 2, 5, 6, 7, 12, 30, 80, 200]), rng.choice([1, 2, 3, 5])
    w = [rng.randrange(k) for _ in range(n)]
    kind = rng.random()
    if kind < 0.5 and n:
        a, p = rng.randrange(n), rng.randrange(1, max(2, n // 4))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    elif kind < 0.7:  # Fibonacci words hold very many runs
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        w = b[:n]
    return w


@pytest.mark.parametrize("exponent,min_length", [(4, 6), (2, 2), (3, 1)])
def test_runs_against_brute_force(exponent, min_length):
    rng = random.Random(exponent)
    for _ in range(150):
        texts = [some_words(rng) for _ in range(rng.randrange(1, 6))]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        got = runs.runs_of_texts(np.array([x for t in texts for x in t], np.int64), offsets, exponent, min_length)
        want = [(o + s, n, q) for o, t in zip(offsets.tolist(), texts) for s, n, q in brute_runs(t, exponent, min_length)]
        assert sorted(zip(*(a.tolist() for a in got))) == sorted(want)


def op11(doc_id, text):
    w, h = words_of(text), zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {t for s, length, q in found for t in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for t, x in enumerate(w) if t not in gone)))


def test_periodic_runs(spark):
    rng = random.Random(7)
    texts = [None, "", " \n\t", "a", "a a a a a a", "a a a a a a a", "A a " * 9, "x " + "ab cd ef " * 5 + "ab", "\x0bq " * 30]
    texts += [" ".join(f"w{x}" for x in some_words(rng)) for _ in range(120)] + ["long " + " ".join(map(str, range(50))) * 40]
    rows = [(i * 7 - 50, t, "x", 5) for i, t in enumerate(texts)] + [(None, "b b b b b b b", "y", 1), (-50, None, "x", 2), (6, "c d " * 30, None, None), (6, "c d " * 30, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int")
    of = docs.select("doc_id", runs.with_planted(docs.text, docs.doc_id).alias("text"), "runs", "start")
    got = runs.digests(runs.periodic_runs(of))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((op11(i, t) for i, t, *_ in rows), key=key)
    assert sum(1 for i, *_ in rows if zlib.crc32(str(i).encode()) % 10 == 0) > 5
    assert runs.periodic_runs(docs.where("false")).count() == 0


def op13_holds(rows, docs, capacity, ids):
    """Each document's pieces are whole and in order, each sequence is gapless and within capacity."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc, key=str) == sorted({d for d, _ in docs}, key=str)
    for d, text in dict(docs).items():
        own, at = np.append(ids(text or ""), 2).astype("<u4"), 0
        copies = sum(x == d for x, _ in docs)
        got = sorted(by_doc[d], key=lambda r: (r.piece, r.sequence_id))
        assert len(got) % copies == 0
        for k, r in enumerate(got[::copies]):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(own[at : at + r.length])
            assert r.length == capacity if k else r.length == ((len(own) - 1) % capacity + 1 if len(own) > capacity else len(own))
            at += r.length
        assert at == len(own)
    for got in by_sequence.values():
        at = 0
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing._public())
    t.encode_special_tokens = True
    ids = lambda text: t.encode(text, add_special_tokens=False).ids
    rng = random.Random(3)
    texts = [None, "", " ", "<|endoftext|> it's", "word " * 1023, "word " * 1022, "word " * 1024, "word " * 5000, "é\U0001f642" * 3000]
    texts += [" ".join(rng.choice(["ab", "cde", "Fg", "12", "..."]) for _ in range(rng.choice([3, 40, 300, 700, 2500]))) for _ in range(60)]
    rows = [*enumerate(texts), (None, "no id"), (3, texts[3]), (3, texts[3])]
    docs = spark.createDataFrame([(d, x, 1, "z") for d, x in rows], "doc_id long, text string, length int, offset string")
    got = packing.pack_documents(docs)
    assert set(got.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    got = got.collect()
    used = op13_holds(got, rows, 1024, ids)
    rooms = []
    for n in sorted((r.length for r in got), reverse=True):  # first fit, largest first
        k = next((k for k, room in enumerate(rooms) if room >= n), len(rooms))
        rooms[k:] = [rooms[k] - n if k < len(rooms) else 1024 - n, *rooms[k + 1 :]]
    assert used <= len(rooms)
    assert packing.pack_documents(docs.where("false")).count() == 0


def test_rounds_over_many_tasks(spark):
    """Small tasks, so that several rounds merge what is left, and items over half a bin, which nothing can merge."""
    rng = random.Random(5)
    for sizes in ([rng.randrange(1, 1024) for _ in range(3000)], [600 + k % 3 for k in range(500)], [7] * 4000):
        cut = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
        got = packing.pack(cut, task_items=200).collect()
        assert sorted(r.doc_id for r in got) == list(range(len(sizes)))
        by = {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in by.values():
            places.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0 and sum(places[-1]) <= 1024
        least = max(math.ceil(sum(sizes) / 1024), sum(n > 512 for n in sizes))
        assert len(by) <= 1.05 * least + 1


def test_ids_equal_those_of_tokenizers():
    from tokenizers import Tokenizer

    t, own, rng = Tokenizer.from_file(packing._public()), packing.Ids(packing._public()), random.Random(0)
    t.encode_special_tokens = True
    letters = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "a", "B", "é", "1", "'s", "'", ".", "漢", "​", "\U0001f642", "<|endoftext|>", "\0", "́"]
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randrange(30)))
        assert own.of(text).tolist() == t.encode(text, add_special_tokens=False).ids
    assert own.fast is not None and own.slow is None
    blanks = " " * 1_500_000 + "a"
    assert own.of(blanks).tolist() == t.encode(blanks, add_special_tokens=False).ids
