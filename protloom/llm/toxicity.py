"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, release, remainder, slices, with_text, words_of

#: At most about so many labelled documents of each class are learned from, and so many of their most frequent units.
SAMPLE_DOCS, TRAINING_UNITS = 3000, 20_000
#: Landmarks to begin with, rounds that add half as many, and how many characters the machine tells apart.
LANDMARKS, ROUNDS, ALPHABET = 256, 2, 100
#: Landmarks whose subsequences are columns of one table at a time.
MARKS = 32
#: Kernel: common subsequences of three characters, each weighted by DECAY to the power of the stretch it spans.
LENGTH, DECAY = 3, 0.6
#: Longer words are taken in overlapping pieces of so many characters.
PIECE = 24
#: A document of more distinct units than this spreads its weight over them; doubt added to both classes of each unit.
DOC_UNITS, DOUBT = 200, 0.3
#: Places where a unit's margin begins to count as evidence and where it counts in full; learning takes the best pair.
RAMPS = [(lo, lo + w) for lo in (0.2, 0.3, 0.4, 0.5, 0.6) for w in (0.2, 0.4)]
#: A score at or above this is toxic.
THRESHOLD = 0.7


_OTHER = re.compile(r"[\W_]+")


def pieces(word: str) -> list[str]:
    """The word between spaces, which stand for its edges, in overlapping pieces of at most PIECE characters."""
    w = f" {word} "
    return [w] if len(w) <= PIECE else [w[k : k + PIECE] for k in range(0, len(w) - PIECE // 2, PIECE // 2)]


def _coded(some: list[str], to: np.ndarray) -> np.ndarray:
    """Numbers of the characters of strings of one length, a row each."""
    return to[np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.int32).reshape(len(some), -1)].astype(np.int64)


def _numbers(alphabet: str) -> np.ndarray:
    to = np.zeros(0x110000, np.int16)
    for i, ch in enumerate(alphabet):
        to[ord(ch)] = i + 1
    return to


def _triples(n: int) -> list[tuple[int, int, int]]:
    return [(i, j, k) for j in range(1, n - 1) for i in range(j) for k in range(j + 1, n)]


def scale(n: int) -> float:
    """What a string's subsequences are divided by: the norm of one of that length whose characters all differ."""
    return float(np.sqrt(sum(DECAY ** (2 * (k - i + 1)) for i, _, k in _triples(n)))) or 1.0


def kernel(a: str, b: str) -> float:
    """Subsequence kernel of two strings, by the usual dynamic programme, each scaled by its length."""
    before = np.ones((len(a) + 1, len(b) + 1))
    total = 0.0
    for p in range(1, LENGTH + 1):
        now = np.zeros_like(before)
        for i in range(p, len(a) + 1):
            run = 0.0
            for j in range(p, len(b) + 1):
                hit = DECAY**2 * before[i - 1, j - 1] if a[i - 1] == b[j - 1] else 0.0
                run = DECAY * run + hit
                now[i, j] = DECAY * now[i - 1, j] + run
                total += hit if p == LENGTH else 0.0
        before = now
    return total / scale(len(a)) / scale(len(b))


@dataclass
class Features:
    """Subsequences of strings as entries (row, number of the subsequence, weight) in order of rows; characters outside
    the alphabet are in none. The kernel of two strings is the product of their entries."""

    rows: np.ndarray
    what: np.ndarray
    weight: np.ndarray
    size: int

    @classmethod
    def of(cls, strings: list[str], alphabet: str) -> Features:
        to, base = _numbers(alphabet), len(alphabet) + 1
        by: dict[int, list[int]] = {}
        for i, w in enumerate(strings):
            by.setdefault(len(w), []).append(i)
        rows, what, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for n, at in by.items():
            c, z = _coded([strings[i] for i in at], to), scale(n)
            for i, j, k in _triples(n):
                known = (c[:, i] > 0) & (c[:, j] > 0) & (c[:, k] > 0)
                rows.append(np.array(at)[known])
                what.append(((c[:, i] * base + c[:, j]) * base + c[:, k])[known])
                weight.append(np.full(known.sum(), DECAY ** (k - i + 1) / z, np.float32))
        r, f, w = np.concatenate(rows), np.concatenate(what), np.concatenate(weight)
        order = np.argsort(r, kind="stable")
        return cls(r[order], f[order], w[order], len(strings))

    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        """(subsequences of all rows in order, their weights by row: a column each)."""
        known, at = np.unique(self.what, return_inverse=True)
        out = np.zeros((len(known), self.size), np.float32)
        np.add.at(out, (at, self.rows), self.weight)
        return known, out


def gram(strings: list[str], marks: list[str], alphabet: str) -> np.ndarray:
    """Kernel of all strings with all marks, a few thousand entries at a time: memory is the result's."""
    out = np.zeros((len(strings), len(marks)), np.float32)
    # columns of all marks at once would have most subsequences of one mark in every other mark's column, as zeros
    blocks = [(m, *Features.of(marks[m : m + MARKS], alphabet).columns()) for m in range(0, len(marks), MARKS)]
    for first in range(0, len(strings), 2000):
        some = Features.of(strings[first : first + 2000], alphabet)
        for m, known, column in blocks:
            for k in range(0, len(some.rows) if len(known) else 0, 8192):
                r, f, w = (x[k : k + 8192] for x in (some.rows, some.what, some.weight))
                at = np.minimum(np.searchsorted(known, f), len(known) - 1)
                hit = known[at] == f
                r, product = r[hit], column[at[hit]] * w[hit, None]
                if len(r):
                    start = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                    out[first + r[start], m : m + MARKS] += np.add.reduceat(product, start)
    return out


@dataclass
class Model:
    """The machine's value of a unit is the sum over its subsequences of decay^span * table[a, b, c], by its scale, plus
    bias: the landmarks' weights summed over their subsequences, so a unit meets all landmarks at once.

    alphabet: the characters, numbered from 1. ramp: see RAMPS. weights: of the logarithms of evidence and of length, and
    a constant. prior: the score of all texts if nothing could be learned.
    """

    alphabet: str
    table: np.ndarray
    bias: float
    ramp: tuple[float, float] = RAMPS[0]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))
    prior: float = 0.0
    blank: bool = True

    def margins(self, words: list[str]) -> np.ndarray:
        """The machine's value of each word, of its highest piece; words of one character have the least."""
        out = np.full(len(words), -2.0)
        if self.blank:
            return out
        to, by = _numbers(self.alphabet), {}
        for i, w in enumerate(words):
            if len(w) > 1:
                for p in pieces(w):
                    by.setdefault(len(p), []).append((i, p))
        base, flat = len(self.alphabet) + 1, self.table.ravel()
        for n, some in by.items():
            z = scale(n)
            for s in range(0, len(some), 8192):
                part = some[s : s + 8192]
                c = np.ascontiguousarray(_coded([p for _, p in part], to).T)
                total = np.zeros(len(part), np.float32)
                for j in range(1, n - 1):
                    for i in range(j):
                        pair = (c[i] * base + c[j]) * base
                        for k in range(j + 1, n):
                            total += np.float32(DECAY ** (k - i + 1) / z) * flat[pair + c[k]]
                np.maximum.at(out, [i for i, _ in part], total + self.bias)
        return out

    def probability(self, evidence: np.ndarray, length: np.ndarray) -> np.ndarray:
        if self.blank:
            return np.full(len(length), self.prior)
        x = np.column_stack([np.log1p(evidence), np.log1p(length), np.ones(len(length))]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def units(codes: np.ndarray, offsets: np.ndarray, words: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Runs of three and more one-character words, joined: (documents' numbers, units, unused). Spaced-out insults."""
    one = np.fromiter((len(w) == 1 for w in words), bool, len(words))[codes]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(one & ~(np.concatenate([[False], one[:-1]]) & (doc == np.concatenate([[-1], doc[:-1]]))))
    stop = np.flatnonzero(one & ~(np.concatenate([one[1:], [False]]) & (doc == np.concatenate([doc[1:], [-1]])))) + 1
    long = stop - start >= LENGTH
    start, stop = start[long], stop[long]
    return doc[start], ["".join(words[c] for c in codes[a:b]) for a, b in zip(start, stop, strict=True)], start


def _texts(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words in lower case, without what is neither letter nor digit: inserted dots and dashes go, inserted letters are
    the kernel's."""
    codes, offsets, words = words_of(part.column("text"))
    return codes, offsets, [w if w.isalnum() else _OTHER.sub("", w) for w in map(str.lower, words.cast(pa.string()).to_pylist())]


def copy_group(codes: np.ndarray, offsets: np.ndarray, words: list[str]) -> np.ndarray:
    """A number that near-copies tend to share: the least hash of a text's three-word runs."""
    h = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))[codes]
    out = np.zeros(len(offsets) - 1, np.uint64)
    if len(h):
        run = h * np.uint64(0x9E3779B97F4A7C15) ^ np.roll(h, -1) * np.uint64(0xC2B2AE3D27D4EB4F) ^ np.roll(h, -2) * np.uint64(0x165667B19E3779F9)
        run ^= run >> np.uint64(31)
        ends = offsets[1:] - 2
        for k in (0, 1):  # runs that reach into the next text
            last = ends[offsets[1:] - offsets[:-1] > 2] + k
            run[last] = np.uint64(0xFFFFFFFFFFFFFFFF)
        full = offsets[1:] > offsets[:-1]
        out[full] = np.minimum.reduceat(run, offsets[:-1][full])
    return out.view(np.int64)


def evidence(part: pa.RecordBatch, model: Model, ramps: list[tuple[float, float]], cache: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """(evidence, words) of each text: for each ramp the sum over words and joined runs of single characters of how far up
    the ramp their margins are."""
    codes, offsets, words = _texts(part)
    doc, joined, _ = units(codes, offsets, words)
    new = [w for w in {*words, *joined} if w not in cache]
    if len(cache) + len(new) > 300_000:  # a cache only: what it forgets is computed again
        cache.clear()
        new = list({*words, *joined})
    cache.update(zip(new, model.margins(new).tolist(), strict=True))
    value, run = (np.fromiter((cache[w] for w in some), np.float64, len(some)) for some in (words, joined))
    lo, hi = (np.array(x) for x in zip(*ramps, strict=True))
    up = lambda v: np.clip((v[:, None] - lo) / (hi - lo), 0, 1)
    rising = up(value)
    any_ = rising.any(axis=1)
    out = np.zeros((len(offsets) - 1, len(ramps)))
    at = np.flatnonzero(any_[codes])  # few words are evidence at all
    np.add.at(out, np.searchsorted(offsets, at, side="right") - 1, rising[codes[at]])
    np.add.at(out, doc, up(run))
    return out, np.diff(offsets)


def _sample(docs: DataFrame, labels: DataFrame, sample_docs: int) -> tuple[DataFrame | None, float]:
    """(toxic, text) of about sample_docs labelled rows of each class, by hash of the id; and the share of toxic rows."""
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    if len(n) < 2:
        return None, share
    limit = F.when(F.col("toxic") == 1, F.lit(sample_docs / n[1])).otherwise(F.lit(sample_docs / n[0])) * float(1 << 30)
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("toxic", "text"), share


def machine(strings: list[str], bad: np.ndarray, good: np.ndarray, landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Model:
    """The machine trained on strings that stand in toxic texts with weight bad and in clean ones with weight good, folded
    into one table.

    Each string is an example of both classes, with its weight in each: squared hinge loss, classes of equal weight, and
    DOUBT on both sides, which holds rare strings near zero. Landmarks are the strings that tell the classes apart best
    and some others; each round adds those that the machine is most wrong about.
    """
    total = max(1e-9, bad.sum()), max(1e-9, good.sum())
    p, n = bad / total[0], good / total[1]
    contrast = (p - n) / np.sqrt((bad + good + 1) / sum(total) * (1 / total[0] + 1 / total[1]))
    by_hash = np.argsort([xxhash.xxh64_intdigest(s) for s in strings], kind="stable")
    marks = np.argsort(-contrast, kind="stable")[: 3 * landmarks // 4].tolist()
    chosen = set(marks)
    marks += [i for i in by_hash.tolist() if i not in chosen][: landmarks - len(marks)]
    seen: dict[str, float] = {}
    for s, w in zip(strings, bad + good, strict=True):
        for ch in s:
            seen[ch] = seen.get(ch, 0.0) + w
    alphabet = "".join(sorted(sorted(seen, key=lambda ch: (-seen[ch], ch))[:ALPHABET]))
    p, n = p + DOUBT / total[0], n + DOUBT / total[0]
    p, n = p / (p.sum() + n.sum()), n / (p.sum() + n.sum())
    k = np.zeros((len(strings), landmarks + rounds * (landmarks // 2)), np.float32)
    done = 0
    for r in range(rounds + 1):
        k[:, done : len(marks)] = gram(strings, [strings[i] for i in marks[done:]], alphabet)
        done = len(marks)
        value, vector = np.linalg.eigh(k[marks, :done].astype(np.float64))
        root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-4))) @ vector.T
        w, f = np.zeros(done + 1), np.zeros(len(strings))
        for _ in range(100):  # Newton's method, the examples taken in portions
            low, high = p * (f < 1), n * (f > -1)
            h, g = 1e-6 * np.eye(done + 1), np.zeros(done + 1)
            for s in range(0, len(strings), 2048):
                x = np.column_stack([k[s : s + 2048, :done] @ root, np.ones(len(k[s : s + 2048]))])
                c = low[s : s + 2048], high[s : s + 2048]
                h += (x * (c[0] + c[1])[:, None]).T @ x
                g += x.T @ (c[0] - c[1])
            new = np.linalg.solve(h, g)
            settled = np.allclose(new, w, atol=1e-7)
            w = new
            v = root @ w[:-1]
            f = np.concatenate([k[s : s + 2048, :done] @ v for s in range(0, len(strings), 2048)]) + w[-1]
            if settled:
                break
        if r < rounds:
            wrong = np.abs(p * np.maximum(0, 1 - f) - n * np.maximum(0, 1 + f)) / np.sqrt(p + n)
            chosen = set(marks)
            marks += [i for i in np.argsort(-wrong, kind="stable").tolist() if i not in chosen][: landmarks // 2]
    parts = Features.of([strings[i] for i in marks], alphabet)
    table = np.bincount(parts.what, parts.weight * (root @ w[:-1])[parts.rows], (len(alphabet) + 1) ** 3).astype(np.float32)
    return Model(alphabet, table, float(w[-1]), blank=False)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, mean log-likelihood) of a logistic curve through examples x of class y; classes weigh the same. An
    example without evidence and length is added as clean."""
    x, y = np.concatenate([x, [[0.0, 0.0, 1.0]]]), np.append(y, 0.0)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    weight[-1] = 0.05
    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(3)
        w = w + np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-4 * w), -3, 3)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -40, 40))), 1e-9, 1 - 1e-9)
    return w, float((weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, units_: int = TRAINING_UNITS) -> Model:
    """Model learned from docs(doc_id, text) and labels(doc_id, toxic).

    The words of the labelled sentences are the machine's examples: each word counts for the class of the texts it stands
    in (near-copies once), no list of insults is made. A text's class then follows from how many of its words have high
    margins and from its length, by a logistic curve; where margins begin to count is chosen by likelihood. Without rows
    of both classes scores are the share of toxic labels.
    """
    sample, share = _sample(docs, labels, sample_docs)
    nothing = Model("", np.zeros(1, np.float32), 0.0, prior=share)
    if sample is None:
        return nothing

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                toxic = part.column("toxic").to_numpy()
                codes, offsets, names = _texts(part)
                group = copy_group(codes, offsets, names)
                doc, joined, _ = units(codes, offsets, names)
                extra: dict[int, set[str]] = {}
                for d, w in zip(doc.tolist(), joined, strict=True):
                    extra.setdefault(d, set()).add(w)
                unit, count, own = [], [], []
                for d in range(part.num_rows):
                    words = {names[c] for c in np.unique(codes[offsets[d] : offsets[d + 1]])} | extra.get(d, set())
                    some = sorted({p for w in words if len(w) > 1 for p in pieces(w)})
                    unit += some
                    count.append(len(some))
                    own.append(min(1.0, DOC_UNITS / max(1, len(some))))
                yield pa.record_batch([pa.array(unit, pa.string()), pa.array(np.repeat(toxic, count), pa.int32()), pa.array(np.repeat(own, count), pa.float64()), pa.array(np.repeat(group, count), pa.int64())], names=["unit", "toxic", "w", "copies"])

    counts = map_batches(sample, tell, "unit string, toxic int, w double, copies bigint").groupBy("unit", "toxic", "copies").agg(F.max("w").alias("w"))
    counts = counts.groupBy("unit").agg(F.sum(F.col("w") * F.col("toxic")).alias("bad"), F.sum(F.col("w") * (1 - F.col("toxic"))).alias("good"))
    most = counts.orderBy(F.desc(F.round(F.col("bad") + F.col("good"), 6)), "unit").limit(units_).orderBy("unit").toPandas()
    if not (most["bad"] > 0).any() or not (most["good"] > 0).any():
        return nothing
    model = machine(most["unit"].tolist(), most["bad"].to_numpy(float), most["good"].to_numpy(float))
    release()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            for part in slices(batch):
                e, n = evidence(part, model, RAMPS, cache)
                yield pa.record_batch([part.column("toxic").cast(pa.int32()), pa.array(list(e), pa.list_(pa.float64())), pa.array(n, pa.int64())], names=["toxic", "e", "n"])

    seen = map_batches(sample, gather, "toxic int, e array<double>, n bigint").toPandas()
    y, e, n = seen["toxic"].to_numpy(float), np.stack(seen["e"].to_list()), seen["n"].to_numpy(float)
    fits = [(logistic(np.column_stack([np.log1p(e[:, r]), np.log1p(n), np.ones(len(n))]), y), ramp) for r, ramp in enumerate(RAMPS)]
    (model.weights, _), model.ramp = max(fits, key=lambda x: x[0][1])
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs' columns (text only with keep_text), with score (0 to 1) and predicted (1 from THRESHOLD on).

    A text's score follows the evidence of its words and runs of single characters, set against its length. Null, empty
    and very long texts are scored like any other, whole (no word: no evidence). Repeated rows stay, columns named score
    or predicted are replaced, an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted") and (keep_text or c != text)]
    source, name = with_text(docs, kept, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            for part in slices(batch, name):
                e, n = evidence(pa.record_batch([part.column(name)], names=["text"]), model, [model.ramp], cache)
                p = model.probability(e[:, 0], n)
                yield pa.record_batch([*[part.column(c) for c in kept], pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[*kept, "score", "predicted"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return map_batches(source, run, f"{fields}{', ' * bool(kept)}score double, predicted int")


def held_out(doc_id: str = "doc_id"):
    return remainder(F.col(doc_id), 3) == 1
