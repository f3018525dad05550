"""The trie's scores against plain dictionaries of n-grams."""

import math
import random
from collections import Counter, defaultdict

import pytest

from protloom.llm import lm


def plain_scores(train, texts, order, min_count, min_context):
    """log10 probabilities by absolute discounting, interpolated; words seen less than min_count share a class."""
    split = lambda t: [*(t or "").lower().split(), None]  # noqa: E731  None: the end
    counts = Counter(w for t in train for w in split(t))
    often = {w for w, c in counts.items() if c >= min_count or w is None}
    rare_tokens, rare_types = sum(c for w, c in counts.items() if w not in often), sum(w not in often for w in counts)
    total = sum(counts.values())
    of = lambda t: [w if w in often else "<rare>" for w in split(t)]
    one = lambda x: ((rare_tokens if x == "<rare>" else counts[x]) + 1) / (total + len(often) + 1)
    grams = {k: defaultdict(Counter) for k in range(2, order + 1)}

    def contexts(words, i, k):
        """The k - 1 words before place i, where they are a context of order k."""
        full = ["<begin>", *words]
        if i + 1 < k - 1:
            return None
        c = tuple(full[i + 2 - k : i + 1])
        return c if k == 2 or grams[k - 1][c[:-1]][c[-1]] >= min_context else None

    for k in range(2, order + 1):
        for t in train:
            words = of(t)
            for i, w in enumerate(words):
                if (c := contexts(words, i, k)) is not None:
                    grams[k][c][w] += 1

    def p(words, i, k):
        if k == 1:
            return one(words[i])
        low = p(words, i, k - 1)
        c = contexts(words, i, k)
        if c is None or not grams[k].get(c):
            return low
        seen = grams[k][c]
        n = sum(seen.values())
        rest = lm.DISCOUNT * len(seen) / n
        return (max(seen[words[i]] - lm.DISCOUNT, 0)) / n + rest * low

    out = []
    for t in texts:
        raw, words = split(t), of(t)
        own = sum(math.log10((counts[w] + 1) / (rare_tokens + rare_types + 1)) for w, x in zip(raw, words) if x == "<rare>")
        out.append(own + sum(math.log10(p(words, i, order)) for i in range(len(words))))
    return out


@pytest.mark.parametrize("order,min_count,min_context", [(2, 2, 2), (2, 1, 1), (3, 2, 2)])
def test_scores_against_plain_dictionaries(spark, order, min_count, min_context):
    rng = random.Random(order)
    vocabulary = [f"w{k}" for k in range(12)]
    texts = [" ".join(rng.choices(vocabulary, weights=range(12, 0, -1), k=rng.randrange(0, 25))) for _ in range(80)] + ["only once seen", None, "W1 w1\tW2", "unknown here w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = texts[:70]
    trie = lm.train(docs.where("doc_id < 70"), order=order, min_count=min_count, min_context=min_context)
    got = {r.doc_id: r for r in lm.score(docs, trie).collect()}
    for i, want in enumerate(plain_scores(train, texts, order, min_count, min_context)):
        assert abs(got[i].score - want) <= 0.01 * got[i].n_tokens, (i, texts[i], got[i].score, want)
