"""Language identification by mixtures: expectation-maximisation over language proportions, set size by penalised likelihood."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, remainder, slices, with_text, words_of

#: Letter trigrams are counted in so many buckets by hash.
BUCKETS = 1 << 16
#: At most about so many documents of each language are learned from.
SAMPLE_DOCS = 3000
#: Languages learned at most: the most frequent ones.
MAX_LANGS = 256

_letters: np.ndarray | None = None


def is_letter() -> np.ndarray:
    """Whether each code point is a letter; built once a process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, words' numbers) of all trigrams centred on a letter; other characters count as the edge of a word."""
    text = " " + " ".join(words).lower() + " "
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = c == 32
    c = np.where(is_letter()[c], c, 32).astype(np.uint64)
    mixed = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    bucket = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)
    centre = c[1:-1] != 32
    return bucket[centre].astype(np.int64), (np.cumsum(edge)[1:-1] - 1)[centre]


def word_list(words: pa.Array) -> list[str]:
    """Words as text; a space can't be part of one, but lower-casing might make a word longer, never split it."""
    return words.cast(pa.string()).to_pylist()


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [BUCKETS, languages]) from rows of non-null lang; of each language about
    sample_docs documents, chosen by hash of the key, or all if it has fewer. Of more than MAX_LANGS values of lang the
    most frequent ones are learned: the model's size is bounded whatever the column holds. Add-half smoothing."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(key), F.lit(1 << 30)).alias("h"))
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()}
    langs = sorted(totals)
    if not langs:
        return [], np.zeros((BUCKETS, 0))
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample_docs / totals[k]) * (1 << 30)))])
    number = F.create_map(*[x for i, k in enumerate(langs) for x in (F.lit(k), F.lit(i))])
    sample = rows.where(F.col("lang").isin(langs) & (F.col("h") < share[F.col("lang")])).select(number[F.col("lang")].alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                codes, offsets, words = words_of(part.column("text"))
                bucket, word = trigrams(word_list(words))
                of = np.repeat(part.column("lang").to_numpy(), np.diff(offsets))
                for k in np.unique(of):
                    n = np.bincount(bucket, weights=np.bincount(codes[of == k], minlength=len(words))[word], minlength=BUCKETS)
                    at = np.flatnonzero(n)
                    yield pa.record_batch([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])

    counts = np.full((BUCKETS, len(langs)), 0.5)
    for r in map_batches(sample, count, "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas().itertuples():
        counts[r.bucket, r.lang] += r.n
    return langs, np.log(counts / counts.sum(0))


def proportions(like: np.ndarray, offsets: np.ndarray, theta: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(theta, log likelihood) of each document after so many EM steps; like: words' likelihoods by language."""
    n = np.diff(offsets)
    for i in range(steps + 1):
        mixed = like * np.repeat(theta, n, axis=0)
        total = mixed.sum(1)
        if i == steps:
            return theta, np.add.reduceat(np.log(total), offsets[:-1], dtype=np.float64)
        mixed /= total[:, None]
        theta = np.add.reduceat(mixed, offsets[:-1], axis=0) / n[:, None]
    raise AssertionError


def infer(codes: np.ndarray, offsets: np.ndarray, words: list[str], table: np.ndarray, penalty: float, steps: int) -> np.ndarray:
    """Proportions of the languages in each document (rows of zeros: no letter).

    Words are the units drawn from a language. EM over all languages ranks them; for growing sets of the best ranked the
    EM is repeated while log likelihood - penalty * (size - 1) * log(words) grows.
    """
    k = table.shape[1]
    bucket, word = trigrams(words)
    scores = np.zeros((len(words), k))
    lettered = np.bincount(word, minlength=len(words)) > 0
    for j in range(k):
        scores[:, j] = np.bincount(word, weights=table[bucket, j], minlength=len(words))
    like = np.maximum(np.exp(scores - scores.max(1, initial=-np.inf, keepdims=True)), 1e-30).astype(np.float32)
    keep = lettered[codes]
    kept = np.concatenate([[0], np.cumsum(keep)])
    codes, offsets = codes[keep], kept[offsets]
    out = np.zeros((len(offsets) - 1, k))
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full) or not k:
        return out
    offsets = np.concatenate([offsets[full], [len(codes)]])
    like = like[codes]
    n = np.diff(offsets)
    theta, _ = proportions(like, offsets, np.full((len(full), k), 1 / k, np.float32), steps)
    rank = np.argsort(np.argsort(-theta, axis=1, kind="stable"), axis=1)
    best, chosen, going = np.full(len(full), -np.inf), np.zeros((len(full), k)), np.ones(len(full), bool)
    for size in range(1, k + 1):
        start = np.where(rank < size, np.maximum(theta, 1e-6), 0)
        now, ll = proportions(like, offsets, (start / start.sum(1, keepdims=True)).astype(np.float32), 0 if size == 1 else max(1, steps // 2))
        ll -= penalty * (size - 1) * np.log(n + 1)
        going &= ll > best  # a document is done when a larger set doesn't serve it, whatever others in its slice do
        best[going], chosen[going] = ll[going], now[going]
        if not going.any():
            break
    out[full] = chosen
    return out


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, text: str = "text", penalty: float = 4.0, steps: int = 6, keep_text: bool = False) -> DataFrame:
    """docs' columns (text only with keep_text), with lang_pred, score (the language's share of the words) and languages (name:share, ...).

    Null texts, texts without a letter and everything where no language was learned get `und`, 0 and an empty list. Ties
    go to the alphabetically first language. Texts are used whole, long ones in one piece; repeated rows stay; an empty
    table gives an empty result; columns named lang_pred, score or languages are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "languages") and (keep_text or c != text)]
    table = table.astype(np.float32)
    source, name = with_text(docs, kept, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, name):
                codes, offsets, words = words_of(part.column(name))
                theta = infer(codes, offsets, word_list(words), table, penalty, steps)
                some = theta.sum(1) > 0 if langs else np.zeros(part.num_rows, bool)
                top = theta.argmax(1) if langs else np.zeros(part.num_rows, int)
                pred = [langs[t] if s else "und" for t, s in zip(top, some, strict=True)]
                score = np.where(some, theta.max(1, initial=0), 0)
                shares = [", ".join(f"{langs[j]}:{row[j]:.3f}" for j in np.argsort(-row, kind="stable") if row[j] > 0.0005) for row in theta]
                yield pa.record_batch([*[part.column(c) for c in kept], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.string())], names=[*kept, "lang_pred", "score", "languages"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return map_batches(source, run, f"{fields}{', ' * bool(kept)}lang_pred string, score double, languages string")


def held_out(doc_id: str = "doc_id"):
    return remainder(F.col(doc_id), 4) == 2
