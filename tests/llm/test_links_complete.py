"""No link of the similarity is left out, whatever bands texts share."""

import random

from protloom.llm import simhash


def test_every_pair_at_the_threshold_is_linked(spark, monkeypatch):
    """400 pairs of similarity 0.81, of which bands of least hashes alone miss about five, some with frequent runs."""
    monkeypatch.setattr(simhash, "SAMPLE", 2)
    rng, rows = random.Random(4), []
    common = " ".join(f"common{k}" for k in range(30))
    for i in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        edited = [*words]
        for at in (rng.randrange(5, 45), rng.randrange(55, 95)):
            edited[at] = "changed"
        tail = f" {common}" if i % 4 == 0 else ""
        rows += [(i, " ".join(words) + tail), (1000 + i, " ".join(edited) + tail)]
    rows += [(5000 + i, f"{common} own{i} " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(40))) for i in range(30)]
    rows += [(6000, "a b c d e a b c d e a b c d e f"), (6001, "a b c d e a b c d e f"), (6002, None), (None, "a b c d e")]
    sets = {i: {x for h in simhash.hashes((t or "").encode(), 5) for x in h.tolist()} for i, t in rows}
    assert all(len(sets[i] & sets[1000 + i]) >= 0.8 * len(sets[i] | sets[1000 + i]) for i in range(400))
    assert sets[6000] == sets[6001]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs, width=5, similarity=0.8).collect()}
    assert kept == {*range(400), *range(5000, 5030), 6000, 6002, None}


def test_links_do_not_depend_on_bands(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l m"), (3, "n o p q r s t")], "doc_id long, text string")
    apart = docs.selectExpr("doc_id", "doc_id AS component_id")
    assert [tuple(r) for r in simhash.unlinked(docs, apart, 5, 0.8).collect()] == [(1, 2)]
    joined = docs.selectExpr("doc_id", "least(doc_id, 2) AS component_id").replace({1: 2}, subset=["component_id"])
    assert simhash.unlinked(docs, joined.withColumn("component_id", joined.component_id.cast("long")), 5, 0.8).count() == 0


def test_signatures_refuse_no_similar_pair_and_most_others():
    import numpy as np

    rng = np.random.default_rng(3)
    refused = 0
    for k in range(400):
        n = int(rng.integers(1, 700))
        a = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n))
        kept = a[rng.random(len(a)) < rng.uniform(0.3, 1)]
        b = np.unique(np.concatenate([kept, rng.integers(-(1 << 63), (1 << 63) - 1, int(rng.integers(0, n // 6 + 2)))]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        alike = both / (len(a) + len(b) - both) >= 0.8
        may = {simhash.may_be_similar(simhash.signature(x), len(x), simhash.signature(y), len(y), 0.8) for x, y in ((a, b), (b, a))}
        assert len(may) == 1 and (may == {True} or not alike)
        refused += may == {False}
    assert refused > 200


def test_sets_of_refused_pairs_are_not_built(spark, monkeypatch):
    """Texts that share rare runs but are far from alike: their pairs are many, and no set is built for them."""
    built, sets = [], simhash._sets
    monkeypatch.setattr(simhash, "_sets", lambda docs, *how: built.append(sets(docs, *how)) or built[-1])
    shared = "one two three four five six seven eight"
    docs = spark.createDataFrame([(i, shared + " " + " ".join(f"w{i}x{k}" for k in range(60))) for i in range(20)], "doc_id long, text string")
    assert simhash.unlinked(docs, docs.selectExpr("doc_id", "doc_id AS component_id"), 5, 0.8).count() == 0
    assert built[-1].count() == 0
