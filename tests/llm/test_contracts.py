"""Defined results for odd input: line ends and letters in licences, short and repeated benchmark items."""

import pytest
from pyspark.sql import functions as F

from protloom.llm import ann, decontaminate, html, licenses


def test_license_sql_on_line_ends_and_letters(spark, tmp_path):
    import duckdb

    marks = ["\n", "\r\n", "\r", "\x85", " ", "\x0b", "\x1c"]
    bodies = ["Released under the MIT License.", "Copyright 2020 X", "copyrighté 2020", "COPYRIGHT(c) Y", "Copyright by Z", "copyright byte 1999", "İ K LICENSE", "(c) me", "Copyright_2020", "copyright"]
    texts = [m.join(bodies[k:] + bodies[:k]) for m in marks for k in range(len(bodies))] + ["", None, *bodies]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    cols = ["doc_id", "digest", "whole_license", "licenses", "n_notices"]
    want = con.execute(f"select {', '.join(cols)} from ({licenses.scan_sql()}) order by doc_id").fetchall()
    assert [tuple(r) for r in licenses.scan(docs, licenses.known(spark)).select(*cols).orderBy("doc_id").collect()] == want


def test_short_and_repeated_items(spark):
    docs = spark.createDataFrame([(1, "Yes. The answer is given here, of course, by the fox over there."), (None, "one two three four five six"), (3, "one two three four five six")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the"), (2, "Yes."), (3, "the answer is given"), (4, "one two three four five six"), (5, "one two three four five six"), (5, "zzz is another text of this id"), (None, "one two three four five six"), (6, None)], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in decontaminate.matches(docs, items).collect())
    assert got == [("3", 4), ("3", 5), ("None", 4), ("None", 5)]
    assert {r.item_id for r in decontaminate.matches(docs, items, min_words=1).collect()} >= {1, 2, 3}
    assert [r.doc_id for r in decontaminate.clean(docs, items).orderBy("doc_id").collect()] == [None, 1]


def test_clashing_names_and_long_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>" + "the cat and the dog are in the house of the man. " * 20_000 + "</p>", "x", 3)] * 2, "page_id long, url string, html string, text string, n_chars int")
    got = html.extract(pages).collect()
    assert len(got) == 2 and got[0].n_chars == len(got[0].text) > 900_000
    vectors = spark.createDataFrame([(i, [float(i), 1.0], 9, "s", 1) for i in range(5)], "vec_id long, embedding array<float>, rank int, score string, query_id int")
    assert ann.nearest(vectors, vectors.where(F.col("vec_id") == 0), k=2).count() == 2


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.01"), reason="the driver's tables are absent")
def test_similar_texts_are_found_and_others_stay(spark, monkeypatch):
    """Every pair of similarity 0.8 or more by brute force, on the driver's table with edited copies and odd rows added."""
    import random

    import corpus_pipeline
    from protloom.llm import simhash

    monkeypatch.setattr(simhash, "HOT_DOC", 3)
    rng, rows = random.Random(9), [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    for k, (i, text) in enumerate(rng.sample([r for r in rows if len(r[1].split()) > 60], 80)):
        words = text.split()
        for _ in range(max(1, len(words) // rng.choice([60, 90, 200]))):
            words[rng.randrange(len(words))] = "changed"
        rows.append((100_000 + k, " ".join(words)))
    sets = {i: frozenset(x.tobytes() for h in simhash.hashes((t or "").encode(), 5) for x in h) for i, t in rows}
    ids, big = sorted(sets), 0.8
    pairs = set()
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = len(sets[a]), len(sets[b])
            if min(x, y) >= big * max(x, y) and x and (both := len(sets[a] & sets[b])) >= big * (x + y - both):
                pairs.add((a, b))
    differing = [(a, b) for a, b in pairs if sets[a] != sets[b]]
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (None, None), (7_000_000, None), (7_000_001, "")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert kept.count(None) == 2 and len(set(kept) - {None}) == len(kept) - 2 and (7_000_000 in kept) != (7_000_001 in kept)
    alive = set(kept)
    found = sum(not (a in alive and b in alive) for a, b in differing)
    assert len(differing) > 40 and found >= 0.9 * len(differing)
    linked = {x for p in pairs for x in p}
    wrong = [i for i in ids if i not in alive and i not in linked]
    of = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs.where("doc_id is not null"), width=5).collect()}
    assert all(of[i] != i for i in wrong)  # dropped by its fingerprint, not by similarity
    print(f"{found} of {len(differing)} differing pairs, {len(wrong)} by fingerprint only")
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), "").count() == 0
