"""The mixture's inference against a plain version, word by word in double precision."""

import math
import random

import numpy as np

from protloom.llm import langid


def plain(doc, words, table, penalty, steps):
    """Proportions of one document: EM over all languages, then over growing sets of the best ranked."""
    k = table.shape[1]
    kept = [w for w in doc if len(langid.trigrams([words[w]])[0])]
    if not kept:
        return [0.0] * k
    like = []
    for w in kept:
        bucket, _ = langid.trigrams([words[w]])
        logs = [sum(float(table[b, j]) for b in bucket) for j in range(k)]
        like.append([max(math.exp(x - max(logs)), 1e-30) for x in logs])

    def em(theta, n):
        for _ in range(n):
            new = [0.0] * k
            for row in like:
                total = sum(a * b for a, b in zip(row, theta))
                for j in range(k):
                    new[j] += row[j] * theta[j] / total / len(like)
            theta = new
        return theta, sum(math.log(sum(a * b for a, b in zip(row, theta))) for row in like)

    theta, _ = em([1 / k] * k, steps)
    order = sorted(range(k), key=lambda j: (-theta[j], j))
    best, chosen = -math.inf, None
    for size in range(1, k + 1):
        start = [max(theta[j], 1e-6) if j in order[:size] else 0.0 for j in range(k)]
        now, ll = em([x / sum(start) for x in start], 0 if size == 1 else max(1, steps // 2))
        ll -= penalty * (size - 1) * math.log(len(kept) + 1)
        if ll <= best:
            break
        best, chosen = ll, now
    return chosen


def test_infer_against_a_plain_version():
    rng, gen = random.Random(1), np.random.default_rng(1)
    alphabets = ["abcde", "cdefg", "xyzäö", "аеиор"]
    words = sorted({"".join(rng.choices(a, k=rng.randrange(1, 7))) for a in alphabets for _ in range(40)} | {"12", "...", "a1b"})
    table = np.log(gen.dirichlet(np.full(langid.BUCKETS, 0.05), 4).T + 1e-9).astype(np.float32)
    for j, a in enumerate(alphabets):  # each language likes its own letters' trigrams
        own = np.unique(np.concatenate([langid.trigrams([w])[0] for w in words if set(w) <= set(a)]))
        table[own, j] = -3.0
    docs = [rng.choices(range(len(words)), k=rng.randrange(0, 40)) for _ in range(60)]
    docs += [[i for i in rng.choices(range(len(words)), k=60) if set(words[i]) <= set(alphabets[0]) | set(alphabets[2])] for _ in range(10)]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    got = langid.infer(np.array([w for d in docs for w in d], np.int64), offsets, words, table, 4.0, 6)
    for row, doc in zip(got, docs):
        want = plain(doc, words, table, 4.0, 6)
        assert np.allclose(row, want, atol=2e-3), (row, want)
