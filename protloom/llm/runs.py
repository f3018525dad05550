"""Periodic runs of words by the runs theorem: Lyndon roots of both orders, extended by longest-common-prefix queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, map_batches, slices, words_of

#: Positions of a block whose least value the sparse tables hold; within blocks values are looked at one by one.
BLOCK = 16


class Least:
    """Least values of ranges of a, by a sparse table over blocks."""

    def __init__(self, a: np.ndarray):
        self.top = np.iinfo(a.dtype).max
        self.a = np.concatenate([a, np.full(2 * BLOCK - len(a) % BLOCK, self.top, a.dtype)])
        self.levels = [self.a.reshape(-1, BLOCK).min(axis=1)]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            below, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(below[:-step], below[step:]))

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """min(a[lo:hi]) for each lo < hi."""
        out = np.full(len(lo), self.top, self.a.dtype)
        for k in range(BLOCK):  # from both ends towards whole blocks; a range within a block is met from both
            out = np.minimum(out, np.where(lo + k < hi, self.a[np.minimum(lo + k, hi - 1)], self.top))
            out = np.minimum(out, np.where(hi - 1 - k >= lo, self.a[np.maximum(hi - 1 - k, lo)], self.top))
        first, last = -(-lo // BLOCK), hi // BLOCK
        at = np.flatnonzero(first < last)
        level = np.frexp((last - first)[at].astype(np.float64))[1] - 1
        for k in np.unique(level):
            i = at[level == k]
            out[i] = np.minimum(out[i], np.minimum(self.levels[k][first[i]], self.levels[k][last[i] - (1 << k)]))
        return out

    def next_below(self) -> np.ndarray:
        """For each i the next j > i with a[j] < a[i]. The last value must be the least of all."""
        a, n = self.a, len(self.a)
        out = np.zeros(n, np.int64)
        at, i = np.arange(1, n + 1), np.arange(n)
        for k in range(2 * BLOCK):  # most are near; the others end up at the last place of a block
            at = np.minimum(at, n - 1)
            found = (a[at] < a[i]) | (at == n - 1)
            out[i[found]] = at[found]
            i, at = i[~found], at[~found]
            at = at + (1 if k < BLOCK else (at + 1) % BLOCK != 0)
            if not len(i):
                return out
        at = (at + 1) // BLOCK
        v = a[i]
        for k in [*range(len(self.levels)), *range(len(self.levels) - 1, -1, -1)]:  # ever longer steps, then ever shorter ones
            level = self.levels[k]
            step = (at < len(level)) & (level[np.minimum(at, len(level) - 1)] >= v)
            at = at + (step << k)
        at = at * BLOCK
        for _ in range(BLOCK):
            at = at + ((at < n - 1) & (a[np.minimum(at, n - 1)] >= v))
        out[i] = np.minimum(at, n - 1)
        return out


class Suffixes:
    """Suffix array of each segment of x by prefix doubling, its inverse (rank), and the prefixes that neighbours share.

    Segments are x[starts[k]:starts[k + 1]]; the last symbol of each is its end mark, smaller than all others and like no
    other. Ranks order suffixes by segment first, so all segments are sorted at once and never compared with each other.
    """

    def __init__(self, x: np.ndarray, starts: np.ndarray):
        n, ends = len(x), starts[1:] - 1
        seg = np.repeat(np.arange(len(ends)), np.diff(starts))
        key = (seg * (int(x.max()) + 2) + x + 1).astype(np.int64)
        key[ends] = np.arange(len(ends)) * (int(x.max()) + 2)
        last = np.repeat(ends, np.diff(starts))
        order = np.argsort(key)
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int32)
        rank[order] = head
        self.levels, self.apart = [rank], np.where(new, 0, -1).astype(np.int8)
        many = ~(new & np.concatenate([new[1:], [True]]))
        rest, k = order[many], 0
        while len(rest):
            step = 1 << k
            follow = np.minimum(rest + step, last[rest])
            key = rank[rest].astype(np.int64) * (n + 1) + np.where(rest + step <= last[rest], rank[follow] + 1, 0)
            o = np.argsort(key)
            rest, key = rest[o], key[o]
            old = rank[rest]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            at = np.arange(len(rest))
            began = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
            head = old + np.maximum.accumulate(np.where(new, at, 0)) - began
            rank = rank.copy()
            rank[rest] = head
            k += 1
            self.levels.append(rank)
            fresh = head[new]
            self.apart[fresh] = np.where(self.apart[fresh] < 0, k, self.apart[fresh])
            rest = rest[~(new & np.concatenate([new[1:], [True]]))]
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)
        self.shared = Least(self._shared())

    def _shared(self) -> np.ndarray:
        """For each rank r how many symbols the suffixes of ranks r - 1 and r share; those of segments apart share none."""
        out = np.zeros(len(self.rank), np.int32)
        r = np.flatnonzero(self.apart > 0)
        r = r[np.argsort(-self.apart[r], kind="stable")]
        i, j, deep = self.order[r], self.order[r - 1], self.apart[r]
        length = np.zeros(len(r), np.int64)
        for k in range(len(self.levels) - 2, -1, -1):
            m = np.searchsorted(-deep, -k)  # those that are still together at this level
            same = self.levels[k][i[:m] + length[:m]] == self.levels[k][j[:m] + length[:m]]
            length[:m] += same << k
        out[r] = length
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at i and j <> i share."""
        a, b = self.rank[i].astype(np.int64), self.rank[j].astype(np.int64)
        return self.shared.between(np.minimum(a, b) + 1, np.maximum(a, b) + 1).astype(np.int64)


def _marked(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x with an end mark after each segment, and the segments' starts in it."""
    out = np.full(len(x) + len(starts) - 1, -1, np.int64)
    out[np.arange(len(x)) + np.repeat(np.arange(len(starts) - 1), np.diff(starts))] = x
    return out, starts + np.arange(len(starts))


def runs(x: np.ndarray, starts: np.ndarray, exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, periods) of all runs of at least `exponent` (2 or more) periods in segments x[starts[k]:starts[k + 1]].

    The longest Lyndon word at i ends before the next suffix that is smaller than the one at i; under the inverse order (end
    mark the largest) before the next that is greater. By the runs theorem each root of a run that is Lyndon in the order
    which the symbol after the run decides is such a word, wherever but at the run's start it stands. The first of them
    begins within the run's second period, so what follows it repeats exponent - 2 periods at least: roots with less are
    left out before they are extended to the left, by the same queries on the segments reversed.
    """
    none = (np.zeros(0, np.int64),) * 3
    if not len(x):
        return none
    text, at = _marked(x, starts)
    fore = Suffixes(text, at)
    rank, ends = fore.rank, at[1:] - 1
    up = rank.copy()
    up[ends] = -1
    low = Least(np.append(up, np.int32(-2))).next_below()[: len(text)]
    down = -rank
    down[ends] = -len(text) - 1
    high = Least(np.append(down, np.int32(-len(text) - 2))).next_below()[: len(text)]
    found = []
    for follow in (low, high):
        i = np.flatnonzero((text >= 0) & (text[np.minimum(follow, len(text) - 1)] == text))
        p = follow[i] - i
        f = fore.common(i, i + p)
        keep = f >= (exponent - 2) * p
        found.append(np.stack([p[keep], (i + p + f)[keep], i[keep]]))
    p, end, i = np.concatenate(found, axis=1)
    if not len(p):
        return none
    o = np.lexsort((i, p, end))
    o = o[np.concatenate([[True], (p[o][1:] != p[o][:-1]) | (end[o][1:] != end[o][:-1])])]  # a run's first root
    p, end, i = p[o], end[o], i[o]
    seg = np.searchsorted(at, i, side="right") - 1
    some, inner = np.unique(seg, return_inverse=True)
    size = at[some + 1] - at[some]
    begin = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
    source = np.repeat(at[some + 1] - 2, size) - place  # reversed; what lies before the segment becomes the end mark
    back = np.where(place < np.repeat(size - 1, size), text[np.maximum(source, 0)], -1)
    mirror = begin[inner] + (at[some + 1] - 2)[inner]
    left = i > at[seg]
    b = np.zeros(len(i), np.int64)
    if left.any():
        b[left] = Suffixes(back, begin).common((mirror - i + 1)[left], (mirror - i - p + 1)[left])
    start, length = i - b, end - i + b
    keep = length >= exponent * p
    start, length, p = (start - seg)[keep], length[keep], p[keep]
    _, first = np.unique(np.stack([start, length]), axis=1, return_index=True)
    return start[first], length[first], p[first]


def _segments(codes: np.ndarray, offsets: np.ndarray, exponent: int, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the stretches that can hold a run: a run's words stand in it at least `exponent` times each, so a word
    that its text has fewer times lies in none."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    _, kind, times = np.unique(doc * (int(codes.max()) + 1) + codes, return_inverse=True, return_counts=True)
    often = times[kind] >= exponent
    edge = np.ones(len(codes) + 1, bool)
    edge[1:-1] = (often[1:] != often[:-1]) | (doc[1:] != doc[:-1])
    cut = np.flatnonzero(edge)
    lo, hi = cut[:-1], cut[1:]
    keep = often[lo] & (hi - lo >= min_length)
    return lo[keep], hi[keep]


def runs_of_texts(codes: np.ndarray, offsets: np.ndarray, exponent: int = 4, min_length: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, periods) in codes of the runs of the texts codes[offsets[i]:offsets[i + 1]], by start, then period."""
    if not len(codes):
        return (np.zeros(0, np.int64),) * 3
    lo, hi = _segments(codes, offsets, exponent, min_length)
    starts = np.concatenate([[0], np.cumsum(hi - lo)])
    place = np.arange(starts[-1]) + np.repeat(lo - starts[:-1], hi - lo)
    start, length, period = runs(codes[place], starts, exponent)
    keep = length >= min_length
    start, length, period = place[start[keep]] if keep.any() else start[keep], length[keep], period[keep]
    o = np.lexsort((period, start))
    return start[o], length[o], period[o]


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", exponent: int = 4, min_length: int = 6) -> DataFrame:
    """One row per document: doc_id, runs, collapsed.

    runs: array of (start, length, period), counted in words ([^\\x20\\x09-\\x0D]+) from 0, by start, then period: all maximal
    stretches of smallest period q and length of at least max(min_length, exponent * q). collapsed: the text's words without
    those that a run holds after its first q words, joined by one space. Every document is one row's work: its memory grows
    with its own words (times the logarithm of its longest repeat), nothing is shuffled.

    Null and blank texts have no runs and an empty collapsed text. Repeated rows and null ids stay as they are; other columns
    are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                codes, offsets, words = words_of(part.column("text"), lower=False)
                start, length, period = runs_of_texts(codes, offsets, exponent, min_length)
                of = np.searchsorted(offsets, start, side="right") - 1
                change = np.zeros(len(codes) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, start + length, -1)
                keep = np.cumsum(change[:-1]) == 0
                left = np.concatenate([[0], np.cumsum(keep)])[offsets]
                if len(codes) and left[-1] == len(codes):
                    kept = pa.array(codes)
                else:
                    kept = pa.array(codes[keep])
                flat = words.cast(pa.large_string()).take(kept) if len(words) else pa.array([], pa.large_string())
                collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat), pa.scalar(" ", pa.large_string()))
                spans = pa.StructArray.from_arrays([pa.array(start - offsets[of]), pa.array(length), pa.array(period)], ["start", "length", "period"])
                each = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(offsets))), pa.int32()), spans)
                yield pa.record_batch([part.column("doc_id"), each, collapsed.cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), run, f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string", trim=False)


def with_planted(text: Column, doc_id: Column) -> Column:
    """The text, with periods planted where h = crc32(decimal doc_id) is a multiple of 10 (null ids: of the empty text).

    With n words numbered from 0 and g = floor(h / 10), each word i >= a = g % n becomes word a + (i - a) % p, where
    p = 1 + floor((n - a) / (3 + g % 8)); words are then joined by one space. Texts without words stay.
    """
    trimmed = F.regexp_replace(text, f"^{SPACE}|{SPACE}\\z", "")
    words = F.split(trimmed, SPACE)
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    to_int = lambda c: c.cast("int")
    period = F.slice(words, to_int(a + 1), to_int(p))
    tail = F.slice(F.flatten(F.array_repeat(period, to_int(F.ceil((n - a) / p)))), F.lit(1), to_int(n - a))
    planted = F.concat_ws(" ", F.slice(words, F.lit(1), to_int(a)), tail)
    return F.when((h % 10 == 0) & (trimmed != ""), planted).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs; start, length, period and exponent_milli of the longest run (ties: smallest start, then period; nulls
    without a run); digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"), F.floor(F.col("best.length") * 1000 / -F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
