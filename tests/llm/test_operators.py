import math
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from protloom.llm import ann, common, decontaminate, html, langid, licenses, lm, mixing, simhash, toxicity, urls


def docs_of(spark, texts, extra=""):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def test_words_of_slices():
    a = pa.array(["", " À b\tC\x0bd ", None, "x\u00a0y z", "last"])
    for k in range(5):
        codes, offsets, words = common.words_of(a.slice(k))
        words = words.to_pylist()
        got = [[words[c] for c in codes[offsets[i] : offsets[i + 1]]] for i in range(len(offsets) - 1)]
        assert got == [[], ["À", "b", "c", "d"], [], ["x\u00a0y", "z"], ["last"]][k:]


def test_components_against_union_find(spark):
    random.seed(3)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {x: find(x) for e in edges for x in e}
    assert got == {k: v for k, v in want.items() if sum(w == v for w in want.values()) > 1}


def test_simhash_against_brute_force(spark):
    random.seed(5)
    base = ["".join(random.choice("abcdefg") for _ in range(4)) for _ in range(300)]
    texts = [None, "", "  \n", "one", "one two", "ONE two"]
    for _ in range(30):
        w = random.choices(base, k=random.randrange(5, 200))
        for _ in range(4):
            texts.append(" ".join(w))
            w = list(w)
            w[random.randrange(len(w))] = random.choice(base)
    docs = docs_of(spark, texts)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}

    def fp(t):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fp(t) for t in texts]
    assert [got[i][0] for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    comp = list(range(len(fps)))
    for _ in comp:
        for i, x in enumerate(fps):
            comp[i] = min(comp[j] for j, y in enumerate(fps) if (x ^ y).bit_count() <= 2)
    assert [got[i][1] for i in range(len(texts))] == comp
    kept = sorted(r.doc_id for r in simhash.keep_one(docs, width=3).collect())
    assert kept == sorted(set(comp))


def test_fingerprints_in_portions(monkeypatch):
    rng = random.Random(8)
    texts = ["", " ", "a", "a b", *(" ".join(rng.choices(["ab", "c", "défg", "HI"], k=k)) for k in (3, 4, 5, 40, 300))]
    texts = [t.encode() for t in texts]
    for width in (1, 3, 5):
        whole = simhash.fingerprints(texts, width).tolist()
        with monkeypatch.context() as m:
            m.setattr(simhash, "PORTION", 7)
            assert simhash.fingerprints(texts, width).tolist() == whole


def test_hot_anchors_link_alike(spark):
    random.seed(6)
    centre = random.getrandbits(63)
    fps = {centre} | {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    rows = spark.createDataFrame([(x,) for x in fps], "fp long")
    whole = dict(map(tuple, common.components(simhash.links(rows)).collect()))
    assert set(whole) == fps and len(set(whole.values())) == 1


def test_anchor_radii():
    for s, flips in enumerate(simhash.anchors()):
        assert len(flips) == (16 if s else 1) and all(f.bit_count() <= 2 for f in flips)


def test_vantage_point_trees(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] * 8), (904, [1.0, 2.0]), (3, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows += [(20, x[21].tolist()), (7, x[22].tolist()), (40, x[40].tolist())]  # other and equal rows of one id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id % 20 = 0"), k=7, shard_rows=200, block=10).collect())
    ok = [(i, np.array(v, np.float64)) for i, v in rows if v and len(v) == 8 and i not in (901, 902, 903)]
    want = []
    for n, (i, v) in enumerate(ok):
        if i % 20 == 0:
            near = sorted((-sum(v[d] * w[d] for d in range(8)), j) for m, (j, w) in enumerate(ok) if m != n)[:7]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(near)]
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)] and [r[3] for r in got] == pytest.approx([r[3] for r in sorted(want)], abs=1e-12)
    got = {q: [(k, i, s) for z, k, i, s in got if z == q] for q in {r[0] for r in got}}
    loose = ann.nearest(df, df.where("vec_id % 20 = 0"), k=7, factor=0.5, shard_rows=200).select("query_id", "vec_id").collect()
    assert len(set(map(tuple, loose)) & {(q, i) for q, h in got.items() for _, i, _ in h}) > 0.3 * 7 * 30
    assert ann.nearest(df.limit(0), df, k=3).count() == 0


PAGE = """<html><head><title>T</title><script>var a="</p><p>no";</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a>x</a></li></ul></nav>
<div class="ad-box">Buy the best of all the things that you have and be happy with them for a long time</div><article><h1>Title &amp; more</h1><p><b>The cat&nbsp;and the  dog
 were in the house of the man with the hat.<br><p>Short one.</p><div class="comments"><p>I was the first to say that this is not what it was for all of us.</p></div></article>
<aside>Side of the road</aside><form>Name <input></form><footer>&copy; all of the rights</footer>"""


def test_html_extraction(spark):
    assert html.main_text(PAGE) == "Title & more\nThe cat and the dog were in the house of the man with the hat.\nShort one."
    assert html.main_text(None) == html.main_text("") == html.main_text("<p>") == ""
    body = "<p>The cat and the dog of the house were in a garden with a lot of the sun and of the moon, which is what they had all been about to be at that time.</p>"
    assert html.main_text(f"<body><nav>the menu</nav>{body}<p>Short end.</p><div id=sidebar>of the and</div>") == html.main_text(body) + "\nShort end."
    rows = spark.createDataFrame([(1, "u", PAGE), (2, None, None)], "page_id int, url string, html string")
    got = {r.page_id: r for r in html.extract(rows).collect()}
    assert got[1].n_chars == len(got[1].text) and (got[2].text, got[2].n_chars) == ("", 0)
    assert html.extract(rows.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar", "post-related", "social-science", "legal-article", "entry-header", "share", "sidebar", "layout menu"])
def test_marks_around_the_article(name):
    p = "<p>The cat and the dog of the house were in a garden with a lot of the sun and of the moon, which is what they had all been about to be at that time.</p>"
    text = html.main_text(p)
    rest = "<div class='menu'><a>One</a></div><div class=comments>" + 5 * p.replace("cat", "reader") + "</div>"
    assert html.main_text(f"<div class='{name}'><nav>menu</nav><article>{p}</article></div>{rest}") == text
    assert html.main_text(f"<div class='{name}'>{p}{p}{rest}</div>") == f"{text}\n{text}"
    assert html.main_text(f"<form id=page><nav>menu</nav><article>{p}</article>{rest}</form>") == text
    assert html.main_text(f"<form id=page>{p}<label>Name</label></form>") == text


def test_marks_beside_the_article():
    p = "<p>The cat and the dog of the house were in a garden with a lot of the sun and of the moon, which is what they had all been about to be at that time.</p>"
    text = html.main_text(p)
    for mark in ("ad", "ad-box", "site-footer", "cookie-banner", "related-posts", "social-share", "legal-notice", "sidebar", "comments-area", "header", "newsletter-signup"):
        for other in (f"<div class='x {mark}'>{p}</div>", f"<section id={mark}><div>{p}</div></section>"):
            assert html.main_text(f"<article>{p}</article>{other}") == text, mark
            assert html.main_text(f"<article>{p}{other}{p}</article>") == f"{text}\n{text}", mark
            assert html.main_text(f"{p}{p}{other}") == f"{text}\n{text}", mark
    assert html.main_text(f"<article>{p}</article><form>{p}</form>") == text
    linked = "<p><a href=x>The whole of this is a link to the other one</a></p>"
    assert html.main_text(f"<article>{p}{linked}{p}</article>") == f"{text}\nThe whole of this is a link to the other one\n{text}"
    assert html.main_text(f"<article>{p}<ul>{'<li><a>further page of it</a>' * 3}</ul></article>") == text
    assert html.main_text(f"<article><div class=entry-header><h1>Title</h1></div>{p}</article>") == f"Title\n{text}"


def test_urls(spark):
    cases = [("http://a.example.org/es/1", "example.org/es/", "block"), ("https://EXAMPLE.org/en/12?q", "example.org/en/1", "block"), ("x://example.org/en/2#/es/", "org/", "allow"), ("http://org", None, "allow"),
             ("http://b.com/de/x", "com/de/", "block"), ("http://b.com/fr/", "com/fr/", "allow"), ("http://com.net/de/", None, "allow"), ("nothing", None, "allow"), (None, None, "allow"), ("", None, "allow")]
    rows = spark.createDataFrame([(i, u, "x") for i, (u, _, _) in enumerate(cases)] * 2, "page_id int, url string, rule string")
    rules = spark.createDataFrame(list(urls.RULES), "action string, host string, path string")
    got = urls.judge(rows, rules).collect()
    assert len(got) == 2 * len(cases) and all((r.rule, r.verdict) == cases[r.page_id][1:] for r in got)
    assert got and {r.host for r in got if r.page_id == 1} == {"example.org"} and {r.path for r in got if r.page_id == 2} == {"/en/2"}
    assert urls.judge(rows.limit(0), rules).count() == 0 and {r.verdict for r in urls.judge(rows, rules.limit(0)).collect()} == {"allow"}


def test_long_urls_and_clashing_names(spark):
    import time

    host = ".".join(["a"] * 20_000)
    rows = spark.createDataFrame([(1, f"http://{host}.example.org/es/" + "p/" * 50_000, 1, 2, "h"), (None, "x://.org/", 3, 4, None)], "page_id int, url string, short int, __row int, host string")
    rules = spark.createDataFrame(list(urls.RULES), "action string, host string, path string")
    urls.judge(rows.limit(0), rules).collect()
    began = time.time()
    got = {r.page_id: r for r in urls.judge(rows, rules).collect()}
    assert time.time() - began < 5 and (got[1].rule, got[1].verdict, got[1].short, got[1]["__row"]) == ("example.org/es/", "block", 1, 2)
    assert (got[None].rule, got[None].host) == ("org/", ".org")


def test_licenses(spark):
    mit = licenses.KNOWN[1][1]
    names = {k for k, _ in licenses.KNOWN}
    assert {"MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense", "Apache-2.0", "MPL-2.0"} <= names
    wrapped = "/*\n * Copyright 2021 Somebody\n" + "".join(f" * {line}\n" for line in __import__("textwrap").wrap(next(v for k, v in licenses.KNOWN if k == "BSD-3-Clause"), 70)) + " */"
    more = spark.createDataFrame([("Own-1", "Do what you like, but\nask first.")], "license string, text string")
    own = {r.doc_id: r.whole_license for r in licenses.scan(docs_of(spark, [wrapped, "do what you like BUT ask first"]), licenses.known(spark, more=more)).collect()}
    assert own == {0: "BSD-3-Clause", 1: "Own-1"}
    texts = [mit.upper().replace("LICENSE", "LICENCE"), "Copyright (c) 2020 X\n" + mit.replace(",", " ,"), "Hello\nReleased under the MIT licence!\nbye", None, "", "x" * 100_000]
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, texts), licenses.known(spark)).collect()}
    assert [got[i].whole_license for i in range(6)] == ["MIT", "MIT", None, None, None, None]
    assert (got[2].licenses, got[2].n_notices, got[3].licenses, got[5].n_notices) == ("MIT", 1, None, 0) and got[3].digest == got[4].digest


def test_mixing_realises_weights(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 20), "big" if i % 3 else f"s{i % 5}") for i in range(3000)] + [(9001, None, None), (9002, " ", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, max_repeat=1.5, block_rows=64).collect()
    total = sum(len((t or "").split()) for _, t, _ in rows)
    own = {}
    for _, t, s in rows:
        own[s] = own.get(s, 0) + len((t or "").split())
    taken, weight = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.n_tokens
        weight[r.source] = r.weight
    assert abs(sum(w for s, w in weight.items() if s) - 1) < 1e-9
    for s, w in weight.items():
        if own[s]:
            assert w * total - 20 <= taken[s] <= w * total and w * total / own[s] <= 1.5 + 1e-3
    seen = [(r.doc_id, r.epoch) for r in got]
    assert len(seen) == len(set(seen))
    assert mixing.mix(docs.limit(0)).count() == 0
    flat = mixing.exponent(spark.createDataFrame([("a", 10), ("b", 90)], "key string, tokens long"), 100.0, entropy=math.log(2) - 1e-9)
    assert flat < 0.01


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 6))) for _ in range(500)]
    sentence = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."
    items = [sentence(rng.randrange(8, 30)) + " " + sentence(6) for _ in range(60)]
    texts = [" ".join(sentence(12) for _ in range(rng.randrange(1, 40))) for _ in range(80)]
    for d in range(0, 80, 3):
        w = texts[d].split(" ")
        at = rng.randrange(len(w))
        texts[d] = " ".join([*w[:at], items[d % 60].upper().replace(".", " !"), *w[at:]])
    texts += [None, "", "a " * 5000]
    docs, its = docs_of(spark, texts), spark.createDataFrame([*enumerate(items), (99, None), (98, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, its).collect()}
    want = set()
    for d, t in enumerate(texts):
        have = decontaminate.runs(decontaminate.tokens(t))
        for i, x in enumerate(items):
            q, a = (decontaminate.runs(z) for z in decontaminate.question_answer(x))
            if q and len(q & have) >= 0.8 * len(q) and len(a & have) >= 0.8 * len(a):
                want.add((d, i))
    assert got == want and len(want) >= 27
    assert {r.doc_id for r in decontaminate.clean(docs, its).collect()} == set(range(len(texts))) - {d for d, _ in want}


@pytest.mark.parametrize("size", [20, 64, 65, 130, 300, 1500])
def test_decontamination_finds_items_of_any_length(spark, size):
    rng = random.Random(size)
    words = [f"w{i}" for i in range(5000)]
    items = [" ".join(rng.choices(words, k=n)) + ". " + " ".join(rng.sample(words, 6)) + "." for n in (size - 6, 20, 40)]
    texts = [" ".join(rng.choices(words, k=2000)) for _ in range(12)]
    for d in range(10):
        w = texts[d].split(" ")
        texts[d] = " ".join([*w[: 37 * d], items[0], *w[37 * d :]])
    its = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = decontaminate.matches(docs_of(spark, texts), its).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, 0) for d in range(10)} and all(r.score > 0.99 for r in got)


def test_decontamination_with_other_white_space(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    items = [" ".join(rng.choices(words, k=30)) + ". The answer is " + " ".join(rng.sample(words, 5)) for _ in range(3)]
    items[2] = items[2].replace(" ", "\u00a0")
    texts = [" ".join(rng.choices(words, k=300)) + " " + x + " " + " ".join(rng.choices(words, k=300)) for x in (items[0].replace(" ", "\u00a0"), items[1].replace(" ", "\u2003\u2028"), items[2].replace("\u00a0", " "))]
    its = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    docs = docs_of(spark, texts).selectExpr("doc_id", "text", "'x' as item_id", "1 as score")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, its).collect()} == {(0, 0), (1, 1), (2, 2)}
    assert decontaminate.matches(docs.limit(0), its).count() == decontaminate.matches(docs, its.limit(0)).count() == 0
    assert decontaminate.clean(docs, its.limit(0)).count() == 3


def test_wand_finds_all_above_threshold():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(80)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(3, 15)))) for i in range(100)]
    index = decontaminate.Index([(i, t, *decontaminate.question_answer(t)) for i, t in items])
    for _ in range(50):
        terms = sorted(rng.sample(range(len(index.terms)), 25))
        scores = [sum(x for t in terms for j, x in zip(index.items[t], index.impacts[t], strict=True) if j == i) for i in range(100)]
        for tau in (0.2, 0.5):
            want = {i for i, s in enumerate(scores) if s >= tau - 1e-9}
            assert {i for i, _ in index.search(terms, tau)} == want
            assert not want or index.possible(np.array([terms + [-1] * 3]), tau)[0]


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in ((0, 1), (1, 5), (10, 3), (1000, 10**6), (3000, 2**62), (5000, 900)):
        v = np.sort(rng.integers(0, u, n, dtype=np.uint64))
        e = lm.EliasFano.of(v)
        q = rng.integers(0, u + u // 10 + 2, 2000, dtype=np.uint64)
        assert (e[np.arange(n)] == v).all() and (e.successor(q) == np.searchsorted(v, q)).all()


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(spark, order):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[min(39, int(rng.expovariate(0.15)))] for _ in range(rng.randrange(0, 60))) for _ in range(300)] + [None, "", "never seen"]
    docs = docs_of(spark, texts)
    trie = lm.train(docs.where("doc_id % 7 <> 2"), order=order, min_count=2, min_context=2, file_rows=50)
    got = {r.doc_id: r for r in lm.score(docs.select("doc_id", "text"), trie).collect()}
    toks = lambda t: (t or "").lower().split() + [""]
    counts = {}
    for i, t in enumerate(texts):
        if i % 7 != 2:
            for w in toks(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        w = toks(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(x in counts for x in w), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w))
        assert got[i].score < 0
    # after any context, the probabilities of all classes sum to 1 but for quantisation
    number = trie.lookup([*(w.encode() for w in counts)])[1]
    frequent = sorted({int(x) for x in number if x != trie.rare})
    logs = trie.unigrams()
    for c in frequent[:5]:
        node, p, back = trie.child(2, np.full(trie.frequent + 1, c), np.arange(trie.frequent + 1))
        probs = np.where(node >= 0, 10**p, 10 ** (back + logs[: trie.frequent + 1]))
        assert probs.sum() == pytest.approx(1, abs=0.05)


def test_language_id(spark):
    rng = random.Random(1)
    syl = {"xx": ["ka", "to", "ri", "mu"], "yy": ["sch", "ein", "ung", "tz"], "zz": ["eau", "ille", "oir", "qu"]}
    word = lambda k: "".join(rng.choices(syl[k], k=3))
    rows = [(i, " ".join(word(k) for _ in range(40)), k) for i, k in enumerate(rng.choices(list(syl), k=300))]
    mixed = " ".join([word("xx") for _ in range(70)] + [word("yy") for _ in range(30)])
    rows += [(1000, None, None), (1001, "12 !! 3", None), (1002, "", None), (1003, mixed, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, table = langid.learn(docs.where(~langid.held_out()))
    got = {r.doc_id: r for r in langid.identify(docs, langs, table).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:300])
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert got[1003].lang_pred == "xx" and got[1003].score == pytest.approx(0.7, abs=0.05) and got[1003].languages.startswith("xx:0.7")
    assert {r.lang_pred for r in langid.identify(docs, [], np.zeros((langid.BUCKETS, 0))).collect()} == {"und"}


def test_language_sets_do_not_depend_on_the_slice():
    rng = np.random.default_rng(3)
    table = np.log(rng.dirichlet(np.full(langid.BUCKETS, 0.02), 4).T + 1e-9)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    docs = [rng.integers(0, 400, rng.integers(1, 80)) for _ in range(40)]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    whole = langid.infer(np.concatenate(docs), offsets, words, table, 0.5, 6)
    for i, d in enumerate(docs):
        assert langid.infer(d, np.array([0, len(d)]), words, table, 0.5, 6)[0] == pytest.approx(whole[i], abs=1e-4)


def test_empty_tables_and_clashing_names(spark):
    """Each operator on no rows, on null ids and repeated rows, with columns of the names that it gives."""
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, score int, n_tokens string, epoch int, digest int, lang_pred int, block int")
    rows = [(None, "one two three four five six", "en", None, 1, "x", 1, 1, 1, 1)] * 2 + [(1, None, "en", "a", 1, "x", 1, 1, 1, 1), (1, "", None, "a", 1, "x", 1, 1, 1, 1), (2, "long " * 60_000, "de", "a", 1, "x", 1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, none.schema)
    for df, n in ((none, 0), (docs, 5)):
        langs, table = langid.learn(df)
        assert langid.identify(df, langs, table).count() == n
        out = lm.score(df, lm.train(df))
        assert out.count() == n and out.schema["score"].dataType.simpleString() == "double"
        assert simhash.near_duplicates(df).count() == n
        assert licenses.scan(df, licenses.known(spark)).count() == n
        mixed = mixing.mix(df)
        assert set(mixed.columns) >= {"doc_id", "epoch", "block", "n_tokens"} and mixed.count() >= 0
    assert simhash.keep_one(docs).count() == 4


def test_subsequence_kernel():
    def plain(s, t):
        out = 0.0
        from itertools import combinations

        for a in combinations(range(len(s)), 3):
            for b in combinations(range(len(t)), 3):
                if [s[i] for i in a] == [t[i] for i in b]:
                    out += toxicity.DECAY ** (a[2] - a[0] + 1 + b[2] - b[0] + 1)
        return out / toxicity.scale(len(s)) / toxicity.scale(len(t))

    words = [" idiot ", " idioot ", " iditos ", " house ", " ab ", "aaaa"]
    gram = toxicity.gram(words, words, "".join(sorted(set("".join(words)))))
    for j, w in enumerate(words):
        want = [plain(x, w) for x in words]
        assert [toxicity.kernel(x, w) for x in words] == pytest.approx(want, rel=1e-9)
        assert gram[:, j] == pytest.approx(want, rel=1e-5)
    assert toxicity.kernel(" idiot ", " idiot ") >= 1


def test_margins_are_sums_over_landmarks():
    """The folded table against the machine as such: kernels with landmarks, weighted."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcde"), rng.integers(2, 9))) for _ in range(120)]
    strings = sorted({p for w in words for p in toxicity.pieces(w)})
    bad = np.array([3.0 if "ab" in s else 0.2 for s in strings])
    model = toxicity.machine(strings, bad, 1 / bad, landmarks=20, rounds=0)
    # values are linear in the landmarks' kernels: learn the weights from most words, foretell the rest
    contrast = [model.margins([s.strip()])[0] for s in strings]
    p, n = bad / bad.sum(), (1 / bad) / (1 / bad).sum()
    order = np.argsort(-((p - n) / np.sqrt((bad + 1 / bad + 1) / (bad.sum() + (1 / bad).sum()) * (1 / bad.sum() + 1 / (1 / bad).sum()))), kind="stable")[:15].tolist()
    by_hash = np.argsort([xxhash.xxh64_intdigest(s) for s in strings], kind="stable").tolist()
    marks = order + [i for i in by_hash if i not in order][:5]
    k = np.array([[toxicity.kernel(s, strings[m]) for m in marks] + [1.0] for s in strings])
    weights = np.linalg.lstsq(k[:60], np.array(contrast[:60]), rcond=None)[0]
    assert k[60:] @ weights == pytest.approx(contrast[60:], abs=1e-3)
    long = "x" * 30 + "abab"
    assert model.margins([long])[0] == pytest.approx(max(_piece_value(model, p) for p in toxicity.pieces(long)), abs=1e-5)


def _piece_value(model, piece):
    at = {ch: i + 1 for i, ch in enumerate(model.alphabet)}
    out = 0.0
    for j in range(1, len(piece) - 1):
        for i in range(j):
            for k in range(j + 1, len(piece)):
                out += toxicity.DECAY ** (k - i + 1) * float(model.table.reshape((len(model.alphabet) + 1,) * 3)[tuple(at.get(piece[x], 0) for x in (i, j, k))])
    return out / toxicity.scale(len(piece)) + model.bias


@pytest.mark.parametrize("table, auc, recall, false", [("sf0.01", 0.9, 0.75, 0.04), ("sf0.1", 0.96, 0.89, 0.015)])
def test_toxicity_on_the_drivers_tables(spark, table, auc, recall, false):
    """Held-out labels; about 7 in 100 toxic labels there are of texts without any insult, which no model can find."""
    from pathlib import Path

    if not Path(f"/root/testdata/{table}").exists():
        pytest.skip("the driver's tables are absent")
    from protloom.llm import registry

    labels = common.read(spark, f"/root/testdata/{table}", "labels").select("doc_id", "toxic")
    got = registry.op2_toxicity(spark, f"/root/testdata/{table}").join(labels, "doc_id").where("held_out").toPandas()
    y, rank = got.toxic.to_numpy() == 1, got.score.rank().to_numpy()
    assert (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum()) >= auc
    assert got.predicted[y].mean() >= recall and got.predicted[~y].mean() <= false


def test_toxicity_of_empty_tables_repeats_and_names(spark):
    rows = [(1, "you are an idiot", 0.5, "x"), (1, "you are an idiot", 0.5, "x"), (None, None, 0.1, None), (3, " ".join(["word"] * 50_000 + ["idiot"] * 9_000), 1.0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string")
    train = spark.createDataFrame([(i, ("you idiot of" if i % 4 == 0 else "word of you") + f" number {'abcdefg'[i % 7] * 3}") for i in range(400)], "doc_id long, text string")
    labels = train.selectExpr("doc_id", "cast(doc_id % 4 = 0 as int) as toxic")
    model = toxicity.learn(train, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 4 and set(got[0].asDict()) == {"doc_id", "score", "predicted"}
    by = {r.doc_id: r for r in got}
    assert by[1].predicted == 1 and by[None].predicted == 0 and by[3].predicted == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    empty = toxicity.learn(train.limit(0), labels)
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, empty).collect())


def test_toxicity_on_held_out_labels(spark):
    rng = random.Random(3)
    syl = ["an", "the", "re", "ou", "st", "in", "or", "ea", "ly", "nd"]
    insults = ["stupid", "moron", "worthless", "blorkle", "blorkish", "blorkan"]
    rows, labels = [], []
    for i in range(900):
        w = ["".join(rng.choices(syl, k=rng.randrange(1, 5))) for _ in range(60)]
        bad = i % 5 == 0
        for _ in range(3 * bad):
            w[rng.randrange(60)] = rng.choice(insults)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(2000, None), (2001, ""), (2002, "the inor s t u p i d reand"), (2003, "the s.t.u.p.i.d. inea"), (2004, "ou stuupid anst")]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, lab.where(~toxicity.held_out()))
    got = {r.doc_id: r for r in toxicity.score(docs.select("doc_id", "text", toxicity.held_out().alias("h")), model).collect()}
    held = [(got[i].predicted, y) for i, y in labels if got[i].h]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert [got[i].predicted for i in (2000, 2001)] == [0, 0] and [got[i].predicted for i in (2002, 2003)] == [1, 1]
    assert got[2004].score > got[2001].score
    flat = toxicity.learn(docs, lab.limit(0))
    assert {r.score for r in toxicity.score(docs, flat).collect()} == {0.0}
