"""Conversation tries against brute force, and the query's SQL."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import pytest

from protloom.llm import prefix_trie, registry

SPACE = re.compile("[\\x20\\x09-\\x0D]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(x, key=lambda v: (v[0], v[1] or 0, v[2], v[3]))] for c, x in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h, r = zlib.crc32(str(c).encode()) % 4, abs(c) % 20
        out[c] = convs.get(c - (r if c >= 0 else -r), [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {k: [x for x in members if len(x) == len(k) + 1 and x[:-1] == k] for k in members}
    words = lambda k: len([w for w in SPACE.split(k[-1][1]) if w]) if k else 0
    total = {}
    for k in sorted(members, key=len, reverse=True):
        below = [total[x] for x in children[k]]
        total[k] = (sum(x[0] for x in below) or 1, (len(members[k]) - 1) * words(k) + sum(x[1] for x in below))
    sha = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(members[k]) if len(convs[c]) == len(k)).encode()).hexdigest()
    return [(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), *total[k], sha(k)) for k, m in members.items()]


def some_turns(rng, n):
    rows = []
    for c in rng.sample(range(-60, 300), n):
        size = rng.choice([1, 1, 2, 3, 4, 6, 9])
        for t in range(size):
            rows.append((c, rng.choice([t, t, t, None]) if t < 2 else t, rng.choice(["user", "system", None]), rng.choice(["", "a", "a b", " a\tb\nc ", None, "é"])))
    return rows + rng.sample(rows, 5) + [(None, 0, "user", "x"), (10**12, 3, None, None)]


key = lambda r: tuple((x is None, x) for x in r)


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, words string")


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "BLOCK", 2 if seed == 1 else 1024)
    monkeypatch.setattr(prefix_trie, "ID_RANGE", 16 if seed == 1 else 1 << 16)
    rng = random.Random(seed)
    rows = some_turns(rng, 120)
    rng.shuffle(rows)
    turns = table(spark, rows).repartition(5)
    got = prefix_trie.trie(*prefix_trie.with_shared_heads(prefix_trie.numbered(turns)))
    assert got.columns == COLUMNS and [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rebuilt(ordered(rows))), key=key)
    if seed == 1:
        assert sorted(map(tuple, prefix_trie.conversation_trie(turns).collect()), key=key) == sorted(brute(ordered(rows)), key=key)


def test_paths_that_hang_on_paths(spark):
    """Each conversation leaves the one before a turn later: as many rounds as there are such paths."""
    rows = [(c, t, "user", f"w{t}" if t <= c else f"own {c} {t}") for c in range(6) for t in range(9)]
    rows += [(50, t, "user", f"long {t}") for t in range(300)]
    got = prefix_trie.conversation_trie(table(spark, rows))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(ordered(rows)), key=key)


def test_empty_and_null_only(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        turns = table(spark, rows)
        assert prefix_trie.trie(*prefix_trie.with_shared_heads(prefix_trie.numbered(turns))).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the driver's tables are absent")
def test_query_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({registry.ORACLE_SQL['op12_prefix_trie']})").fetchall()
    got = registry.QUERIES["op12_prefix_trie"](spark, "/root/testdata/sf0.001").select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
