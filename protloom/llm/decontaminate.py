"""Benchmark decontamination: BM25 over test items with block-max WAND, then an overlap check of question and answer."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices, without, words_of

#: Words of the longest items of the first class (each further class has items up to twice as long). A class's passages
#: have twice as many words and start as many apart, so some passage holds all of an item wherever it stands.
SPAN = 32
#: Share of an item's own BM25 score that a passage must reach to be checked.
TAU = 0.5
#: Runs of words compared in the check, and the share of an item's runs that must occur.
RUN, OVERLAP = 5, 0.8
#: Items of fewer words are in no document: such words stand in ordinary texts, so finding them says nothing.
MIN_WORDS = 5
#: Postings in a block; groups of items of like length with impact bounds of their own; items in one index (more are
#: searched index by index).
BLOCK, GROUPS, INDEX_ITEMS = 32, 32, 20_000
K1, B = 1.2, 0.75

_NOT_WORD = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def normal(word: str) -> str:
    """A word without punctuation, in lower case; empty if nothing is left."""
    return word.lower() if word.isalnum() else _NOT_WORD.sub("", word).lower()


def tokens(text: str | None) -> list[str]:
    return [x for w in (text or "").split() if (x := normal(w))]


def question_answer(text: str | None) -> tuple[list[str], list[str]]:
    """An item given as one text: its last sentence is the answer, what precedes it the question (one sentence: both)."""
    parts = [t for s in _SENTENCE.split(text or "") if (t := tokens(s))]
    if not parts:
        return [], []
    return ([w for p in parts[:-1] for w in p] or parts[0]), parts[-1]


def runs(words: list[str], n: int = RUN) -> set[tuple[str, ...]]:
    """Runs of n words; fewer words: their whole sequence; none: no run."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def item_words(item: tuple[object, str | None, list[str], list[str]]) -> list[str]:
    _, t, q, a = item
    return tokens(t) if t is not None else q + a


class Index:
    """Inverted index of items: for each term postings by item with the BM25 impact as a share of the item's own score.

    Impacts are scaled so that an item scores 1 against itself, hence one threshold fits all items. Lists are cut into
    blocks that keep the largest impact, and bounds has each term's largest impact in each of GROUPS runs of items: short
    and long items, whose impacts differ most, don't share one. Items have up to `span` words; document frequencies and
    the mean length are those of `corpus`, the words of all items (of these, if not given).
    """

    def __init__(self, items: list[tuple[object, str | None, list[str], list[str]]], span: int = SPAN, corpus: list[list[str]] | None = None):
        self.window, self.stride = 2 * span, span
        items = sorted(items, key=lambda x: len(x[2]) + len(x[3]))
        self.ids = [i for i, *_ in items]
        words = [item_words(x) for x in items]
        corpus = words if corpus is None else corpus
        self.runs = [(runs(q), runs(a)) for _, _, q, a in items]
        self.length = [len(w) for w in words]
        mean = sum(map(len, corpus)) / max(1, sum(map(bool, corpus)))
        df = Counter(w for ws in corpus for w in set(ws))
        self.terms = {w: k for k, w in enumerate(sorted({w for ws in words for w in ws}))}
        lists: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for i, ws in enumerate(words):
            tf = Counter(ws)
            parts = {w: math.log(1 + (len(corpus) - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(ws) / mean)) for w, n in tf.items()}
            own = sum(parts[w] for w in sorted(parts))
            for w, x in parts.items():
                lists[self.terms[w]].append((i, x / own))
        self.items = [[i for i, _ in x] for x in lists]
        self.impacts = [[x for _, x in y] for y in lists]
        self.block_last = [[x[min(k + BLOCK, len(x)) - 1] for k in range(0, len(x), BLOCK)] for x in self.items]
        self.block_max = [[max(x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)] for x in self.impacts]
        self.most = np.array([max(x) for x in self.impacts] or [0.0])
        size = max(1, -(-len(items) // GROUPS))
        self.bounds = np.zeros((len(lists) + 1, GROUPS), np.float32)  # the last row: no term
        for t, postings in enumerate(lists):
            for i, x in postings:
                self.bounds[t, i // size] = max(self.bounds[t, i // size], x)

    def possible(self, terms: np.ndarray, tau: float) -> np.ndarray:
        """Which rows of terms (-1: none) could reach tau with an item of some group, each term counted once."""
        terms = np.sort(terms, axis=1)
        terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = -1
        out = np.zeros(len(terms), bool)
        step = max(1, 2048 * 64 // max(1, terms.shape[1]))
        for k in range(0, len(terms), step):
            out[k : k + step] = self.bounds[terms[k : k + step]].sum(axis=1).max(axis=1) >= tau - 1e-4
        return out

    def search(self, terms: list[int], tau: float) -> list[tuple[int, float]]:
        """(item, score) of all items scoring tau or more for the distinct terms: block-max WAND with a fixed threshold."""
        slack, end = tau - 1e-9, len(self.ids)
        cursors = [[self.items[t][0], t, 0] for t in terms]
        out = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for n, (_, t, _) in enumerate(cursors):
                bound += self.most[t]
                if bound >= slack:
                    pivot = n
                    break
            if pivot < 0:
                break
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            bound, skip = 0.0, end if pivot + 1 == len(cursors) else cursors[pivot + 1][0]
            for _, t, _ in cursors[: pivot + 1]:
                k = bisect_left(self.block_last[t], at)
                if k < len(self.block_last[t]):
                    bound += self.block_max[t][k]
                    skip = min(skip, self.block_last[t][k] + 1)
            if bound < slack:
                self._advance(cursors, pivot, max(skip, at + 1))
            elif cursors[0][0] == at:
                score = sum(self.impacts[t][p] for _, t, p in cursors[: pivot + 1])
                if score >= slack:
                    out.append((at, score))
                self._advance(cursors, pivot, at + 1)
            else:
                self._advance(cursors, pivot, at)
        return out

    def _advance(self, cursors: list[list[int]], pivot: int, to: int) -> None:
        for c in cursors[: pivot + 1]:
            if c[0] < to:
                c[2] = bisect_left(self.items[c[1]], to, c[2])
                c[0] = self.items[c[1]][c[2]] if c[2] < len(self.items[c[1]]) else -1
        cursors[:] = [c for c in cursors if c[0] >= 0]


def indexes(items: list[tuple[object, str | None, list[str], list[str]]]) -> list[Index]:
    """An index for each class of item lengths: up to SPAN words, up to twice as many, and so on."""
    classes: dict[int, list] = {}
    corpus = [item_words(x) for x in items]
    for x, ws in zip(items, corpus, strict=True):
        span = SPAN
        while span < len(ws):
            span *= 2
        classes.setdefault(span, []).append(x)
    return [Index(x, span, corpus) for span, x in sorted(classes.items())]


def _hits(part: pa.RecordBatch, some: list[Index], tau: float, overlap: float, memos: list[dict]) -> Iterator[tuple[int, object, float, float, float]]:
    """(row, item id, score, question overlap, answer overlap) of confirmed items."""
    codes, offsets, raw = words_of(part.column("text"))
    names = raw.cast(pa.string()).to_pylist()
    if any(not w.isalnum() and len(w.split()) > 1 for w in names):  # other white space than ASCII's parts words too
        codes, offsets, raw = words_of(pa.array([" ".join((x or "").split()) for x in part.column("text").to_pylist()], pa.string()))
        names = raw.cast(pa.string()).to_pylist()
    words = [normal(w) for w in names]
    keep = np.fromiter(map(bool, words), bool, len(words))[codes]  # not: tokens of punctuation only
    offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
    for index, memo in zip(some, memos, strict=True):
        yield from _index_hits(words, codes[keep], offsets, index, tau, overlap, memo)


def _index_hits(words: list[str], codes: np.ndarray, offsets: np.ndarray, index: Index, tau: float, overlap: float, memo: dict) -> Iterator[tuple[int, object, float, float, float]]:
    window, stride = index.window, index.stride
    at = np.fromiter((index.terms.get(w, -1) for w in words), np.int64, len(words))[codes]
    most = np.where(at >= 0, index.most[at], 0.0)
    total = np.concatenate([[0.0], np.cumsum(most)])
    n = np.diff(offsets)
    count = np.where(n > 0, np.maximum(1, -(-(n - (window - stride)) // stride)), 0)
    row = np.repeat(np.arange(len(n)), count)
    start = offsets[row] + stride * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    stop = np.minimum(start + window, offsets[row + 1])
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    hopeful = np.flatnonzero(total[stop] - total[start] >= tau - 1e-6)  # a bound: the terms' largest impacts, repeats included
    if len(hopeful):
        places = start[hopeful, None] + np.arange(window)
        terms = np.where(places < stop[hopeful, None], at[np.minimum(places, len(at) - 1)], -1)
        hopeful = hopeful[index.possible(terms, tau)]
    for w in hopeful:
        some = np.unique(at[start[w] : stop[w]])
        some = some[some >= 0]
        key = some.tobytes()
        found = memo.get(key)
        if found is None:
            if len(memo) > 20_000:  # a cache only
                memo.clear()
            found = memo[key] = index.search(some.tolist(), tau)
        for item, score in found:
            old = best.get((int(row[w]), item))
            lo, hi = int(start[w]), int(stop[w])
            best[int(row[w]), item] = (score, lo, hi) if old is None else (max(score, old[0]), min(lo, old[1]), max(hi, old[2]))
    for (d, item), (score, lo, hi) in sorted(best.items()):
        wide = index.length[item] + window
        here = [words[c] for c in codes[max(offsets[d], lo - wide) : min(offsets[d + 1], hi + wide)]]
        q, a = index.runs[item]
        sizes = {len(x) for x in q | a}
        there = {tuple(here[i : i + k]) for k in sizes for i in range(len(here) - k + 1)}
        share = [len(x & there) / len(x) if x else 0.0 for x in (q, a)]
        if min(share) >= overlap:
            yield d, index.ids[item], score, *share


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item: str = "text", question: str | None = None, answer: str | None = None, tau: float = TAU, overlap: float = OVERLAP, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): test items that a document contains.

    Every passage (see SPAN; the whole text) queries the index; passages grow with the items, of whatever length; items that reach tau of their own BM25
    score are checked: at least `overlap` of the five-word runs of question and of answer must occur near the passage.
    score is the best passage's. Items have columns question and answer, or else one text (see question_answer).

    Null and empty documents and items match nothing, nor do items of fewer than min_words words. Repeated rows of documents
    give repeated results; of items that repeat an id the one of least text counts; items of equal text all match. Empty tables give an empty result; other columns are ignored.
    Items are indexed on the driver INDEX_ITEMS at a time, so what is sent to the executors is bounded; each index takes
    a pass over the documents.
    """
    cols = [F.col(item_id).alias("i")] + ([F.col(question).alias("q"), F.col(answer).alias("a")] if question else [F.col(item).alias("t")])
    rows = items.select(*cols).where("i is not null")
    rows = rows.groupBy("i").agg(F.min(F.struct(*rows.columns[1:])).alias("x")).select("i", "x.*")
    n_indexes = max(1, -(-rows.count() // INDEX_ITEMS))
    kind, key = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for k in range(n_indexes):
        some = rows.where(F.pmod(F.xxhash64("i"), F.lit(n_indexes)) == k).orderBy("i").collect()
        told = [(r["i"], None, tokens(r["q"]), tokens(r["a"])) if question else (r["i"], r["t"], *question_answer(r["t"])) for r in some]
        found_in = indexes([x for x in told if len(item_words(x)) >= min_words])

        def run(batches: Iterator[pa.RecordBatch], some: list[Index] = found_in) -> Iterator[pa.RecordBatch]:
            memos: list[dict] = [{} for _ in some]
            for batch in batches:
                for part in slices(batch):
                    hits = list(_hits(part, some, tau, overlap, memos))
                    d, i, s, q, a = zip(*hits, strict=True) if hits else ((),) * 5
                    ids = pa.array(list(i), pa.string() if key == "string" else pa.int32() if key == "int" else pa.int64())
                    yield pa.record_batch([part.column("doc_id").take(pa.array(d, pa.int64())), ids, *(pa.array(x, pa.float64()) for x in (s, q, a))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = map_batches(source, run, f"doc_id {kind}, item_id {key}, score double, question_overlap double, answer_overlap double")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that contain a test item; rows of null doc_id stay."""
    bad = matches(docs, items, doc_id, text).select(F.col("doc_id").alias(doc_id)).distinct()
    return without(docs, bad, doc_id)
