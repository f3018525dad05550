"""SimHash near-duplicates by anchor points of a covering code."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, map_batches, sized, slices, tidy, without

#: Bytes of a text that are split into words at once.
PORTION = 4 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bands of least hashes and values in a band, for links by similarity: of pairs of similarity 0.8, 98 in 100 share one of them.
BANDS, ROWS = 10, 5
#: Texts of which one in so many is looked at for frequent runs of words, and how many of these are known at most: both bear on
#: the order of runs only, not on what is found.
SAMPLE, FREQUENT = 16, 200_000
#: A document compared with more others than this is dealt over tasks, so many comparisons to each.
HOT_DOC = 256
#: Anchors of more fingerprints than this are linked through midpoints rather than compared pair by pair.
HOT_ANCHOR = 64


def _portions(text: bytes, width: int) -> Iterator[tuple[list[bytes], bool]]:
    """The text's words by portions of about PORTION bytes: each begins with the last width - 1 words of the one before."""
    at, carried = 0, []
    while True:
        end = at + PORTION
        if end < len(text) and (cut := _SPACE.search(text, end)):
            end = cut.start()
        else:
            end = len(text)
        words = carried + text[at:end].lower().split()
        yield words, end == len(text)
        if end == len(text):
            return
        at, carried = end, words[max(0, len(words) - width + 1) :]


def hashes(text: bytes, width: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of each run of `width` words (fewer words: of them all; none: nothing), a portion of the text at a time."""
    h, any_ = xxhash.xxh64_intdigest, False
    for words, last in _portions(text, width):
        if not words or len(words) < width and (any_ or not last):
            continue
        any_ = True
        joined = memoryview(b" ".join(words))
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = max(1, len(words) - width + 1)
        yield np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())), np.uint64, n)


def fingerprints(texts: list[bytes], width: int = 3, seed: int = 42) -> np.ndarray:
    """Signed 64-bit fingerprints: a bit is set if it is set in over half of the text's hashes."""
    return sketches(texts, width, seed, bands=False)[0]


def sketches(texts: list[bytes], width: int = 3, seed: int = 42, bands: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(fingerprints, keys of BANDS bands, zero for texts without words): a key tells ROWS least hashes, each by another mixing."""
    counts, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    mix = np.random.default_rng(seed).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full((len(texts), BANDS * ROWS), np.iinfo(np.uint64).max, np.uint64) if bands else None

    def count(some: list[tuple[int, np.ndarray]]) -> None:
        n = np.array([len(h) for _, h in some], np.int64)
        every = np.concatenate([h for _, h in some])
        bits = np.unpackbits(every.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, row = np.concatenate([[0], np.cumsum(n)[:-1]]), [i for i, _ in some]
        if bands:
            for k, m in enumerate(mix):
                np.minimum.at(least[:, k], row, np.minimum.reduceat(every * m, at))
        np.add.at(counts, row, np.add.reduceat(bits, at, axis=0, dtype=np.int64))
        np.add.at(total, row, n)

    waiting: list[tuple[int, np.ndarray]] = []
    size = 0
    for part in ((i, h) for i, t in enumerate(texts) for h in hashes(t, width, seed)):
        waiting.append(part)
        size += len(part[1])
        if size > 250_000:
            count(waiting)
            waiting, size = [], 0
    if waiting:
        count(waiting)
    fp = np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view(np.int64).ravel()
    if not bands:
        return fp, None
    keys = np.zeros((len(texts), BANDS), np.uint64)
    for k in range(ROWS):
        keys = (keys ^ (least[:, k::ROWS] >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
    keys[total == 0] = 0
    return fp, keys.view(np.int64)


def with_fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, bands: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text; null and blank texts have 0. With bands also their keys (bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fp, keys = sketches([x or b"" for x in part.column("text").cast(pa.large_binary()).to_pylist()], width, seed, bands)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))] if bands else []
                yield pa.record_batch([part.column("doc_id"), pa.array(fp), *lists], names=["doc_id", "fp", *["bands"] * bands])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), run, f"doc_id {kind}, fp bigint" + ", bands array<bigint>" * bands)


def _sets(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, runs): the distinct hashes of every text's runs of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                each = [np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes(x or b"", width)])).view(np.int64) for x in part.column("text").cast(pa.large_binary()).to_pylist()]
                ends = np.cumsum([0, *map(len, each)])
                yield pa.record_batch([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(each)))], names=["doc_id", "runs"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), run, f"doc_id {kind}, runs array<bigint>")


def similar(docs: DataFrame, of: DataFrame, width: int, similarity: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b): pairs of documents whose sets of word runs have a Jaccard similarity of at least `similarity`, exactly.

    of: with_fingerprint(bands=True); one document stands for all of an equal fingerprint. Documents that share a band's key
    are candidates; each is compared with the least and the greatest of its band alone, so that rows grow with the documents
    and not with the square of a group, and a group that is alike is linked through these. Sets are built of candidates only.
    """
    one = of.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min(F.struct("doc_id", "bands")).alias("x")).select("x.doc_id", F.posexplode("x.bands").alias("band", "key")).where("key <> 0")
    ends = one.groupBy("band", "key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi")
    pairs = one.join(ends, ["band", "key"]).select(F.col("doc_id").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).where("a <> b")
    pairs = checkpoint(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return _alike(docs, pairs, width, similarity, doc_id, text)


def _alike(docs: DataFrame, pairs: DataFrame, width: int, similarity: float, doc_id: str, text: str) -> DataFrame:
    """Those of pairs(a, b) whose sets of word runs have the similarity, exactly."""
    involved = checkpoint(pairs.select(F.col("a").alias(doc_id)).union(pairs.select("b")).distinct())
    sets = checkpoint(_sets(docs.join(sized(involved), doc_id, "left_semi"), doc_id, text, width))
    both = F.size(F.array_intersect("runs_a", "runs_b"))
    met = _beside(pairs, sets).select("a", "b", (both / (F.size("runs_a") + F.size("runs_b") - both)).alias("j"))
    return met.where(F.col("j") >= similarity).select("a", "b").distinct()


def _beside(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """pairs(a, b) with the further columns x of values(doc_id, ...) of both, as x_a and x_b."""
    # a document at the end of a large band meets thousands: what it has goes to several tasks, its pairs are dealt over them
    hot = sized(checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.ceil(F.count("*") / HOT_DOC).alias("parts")).where("parts > 1")))
    of_hot = lambda c: hot.withColumnsRenamed({"x": c, "parts": f"parts_{c}"})
    dealt = lambda c, by: F.pmod(F.xxhash64(by), F.coalesce(f"parts_{c}", F.lit(1))).alias(f"part_{c}")
    pairs = pairs.join(of_hot("a"), "a", "left").join(of_hot("b"), "b", "left").select("a", "b", dealt("a", "b"), dealt("b", "a"))
    more = [x for x in values.columns if x != "doc_id"]
    values = values.join(of_hot("doc_id"), "doc_id", "left").select("doc_id", *more, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts_doc_id", F.lit(1)) - 1)).alias("part"))
    left, right = (values.select(F.col("doc_id").alias(c), F.col("part").alias(f"part_{c}"), *[F.col(x).alias(f"{x}_{c}") for x in more]) for c in ("a", "b"))
    return pairs.join(left, ["a", "part_a"]).join(right, ["b", "part_b"]).select("a", "b", *[f"{x}_{c}" for c in ("a", "b") for x in more])


def signature(runs: np.ndarray) -> bytes:
    """Parities of how many of a set's runs fall in each of some places: a power of two, at least twice as many as runs and 64."""
    places = max(64, 1 << int(2 * len(runs) - 1).bit_length())
    return np.packbits(np.bincount(runs.view(np.uint64) & np.uint64(places - 1), minlength=places) & 1, bitorder="little").tobytes()


def may_be_similar(a: bytes, n_a: int, b: bytes, n_b: int, similarity: float) -> bool:
    """Whether two sets of these signatures and sizes can have the similarity: no pair that has it is refused.

    Where parities differ, one run at least is in one set only; the larger signature is folded to the size of the other.
    """
    if len(a) > len(b):
        a, b = b, a
    x, y, size = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(b)
    while size > len(a):
        size //= 2
        y = y >> 8 * size ^ y & (1 << 8 * size) - 1
    return (x ^ y).bit_count() <= (n_a + n_b) * (1 - similarity) / (1 + similarity) + 1e-6


def _possible(pairs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs(a, b) that by signed(doc_id, n, signature) can have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("signature_a", "n_a", "signature_b", "n_b"))
            kept = pa.array([may_be_similar(*x, similarity) for x in zip(*columns)], pa.bool_())
            yield pa.record_batch([batch.column("a").filter(kept), batch.column("b").filter(kept)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return map_batches(_beside(pairs, signed), run, f"a {kind}, b {kind}").distinct()


def _rarest(docs: DataFrame, doc_id: str, text: str, width: int, similarity: float) -> DataFrame:
    """(doc_id, same, n, signature, runs): a digest of every text's set of runs, its size, its signature, and its first runs in
    an order common to all texts: so many that two sets of the similarity share one of them.

    Any common order gives all pairs; with frequent runs last, few texts meet over one. Which are frequent is told from a SAMPLE-th
    of the texts.
    """
    some = _sets(docs.where(F.pmod(F.xxhash64(F.col(text).cast("string")), F.lit(SAMPLE)) == 0), doc_id, text, width)
    with tidy(docs.sparkSession):
        often = some.select(F.explode("runs").alias("run")).groupBy("run").count().where("count > 2").orderBy(F.desc("count"), "run").limit(FREQUENT).collect()
    often = sorted((r[0], r[1]) for r in often)
    frequent = docs.sparkSession.sparkContext.broadcast((np.array([r for r, _ in often], np.int64), np.array([n for _, n in often], np.int64)))

    def first(runs: np.ndarray) -> np.ndarray:
        known, count = frequent.value
        n = len(runs) - int(np.ceil(similarity * len(runs) - 1e-9)) + 1
        if not len(known):
            return runs[:n]
        at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
        return runs[np.lexsort((runs, np.where(known[at] == runs, count[at], 0)))[:n]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                each = [np.unique(np.concatenate([np.zeros(0, np.int64), *(h.view(np.int64) for h in hashes(x or b"", width))])) for x in part.column("text").cast(pa.large_binary()).to_pylist()]
                same = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in each]
                least = [first(x) if len(x) else x for x in each]
                runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, least)]), pa.int32()), pa.array(np.concatenate(least)))
                signatures = pa.array([signature(x) for x in each], pa.binary())
                yield pa.record_batch([part.column("doc_id"), pa.array(same, pa.binary()), pa.array([len(x) for x in each], pa.int32()), signatures, runs], names=["doc_id", "same", "n", "signature", "runs"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), run, f"doc_id {kind}, same binary, n int, signature binary, runs array<bigint>").where("doc_id IS NOT NULL AND n > 0")


def unlinked(docs: DataFrame, classes: DataFrame, width: int, similarity: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b): pairs of the similarity that classes(doc_id, component_id) keeps apart, so that with them no link is missing.

    Texts of equal sets are linked with the least of them, which stands for all. Two sets of the similarity share one of their
    rarest runs; texts that do, of different components and of fitting sizes, are compared: by signatures, which refuse most
    pairs and none of the similarity, then exactly, so that few texts' sets are built and shuffled. Runs that only texts of one
    component share (large groups of near copies) give no pair.
    """
    rare = checkpoint(_rarest(docs, doc_id, text, width, similarity))
    one = rare.groupBy("same").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    copies = rare.join(one.where("copies > 1"), "same").where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    stand = one.select("same", F.col("least").alias("doc_id")).join(classes.distinct(), "doc_id")
    placed = checkpoint(rare.join(stand, ["same", "doc_id"]).select("doc_id", F.col("component_id").alias("of"), "n", "signature", "runs"))
    each = placed.select(F.explode("runs").alias("run"), "doc_id", "of", "n")
    several = checkpoint(each.groupBy("run").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo <> hi").select("run"))
    shared = each.join(sized(several), "run", "left_semi")
    left, right = (shared.select("run", *[F.col(x).alias(f"{x}_{c}") for x in ("doc_id", "of", "n")]) for c in ("a", "b"))
    fits = (F.col("of_a") < F.col("of_b")) & (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9)
    pairs = checkpoint(left.join(right, "run").where(fits).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct())
    pairs = checkpoint(_possible(pairs, placed.select("doc_id", "n", "signature"), similarity))
    return _alike(docs, pairs, width, similarity, doc_id, text).unionByName(copies)


def syndrome(word: Column) -> Column:
    """Syndrome of the low 31 bits under the Hamming code whose bit i (from 0) is checked as position i + 1."""
    out = F.lit(0)
    for b in range(5):
        mask = sum(1 << i for i in range(31) if (i + 1) >> b & 1)
        out = out + (F.bit_count(word.bitwiseAND(F.lit(mask))) % 2) * (1 << b)
    return out


def anchors() -> list[list[int]]:
    """For each syndrome, what to flip in a 31-bit word to get all code words within distance 2: the nearest one first.

    The Hamming code [31, 26] covers all words within radius 1. A word of syndrome 0 is a code word and no other is
    nearer than 3; else one code word is at distance 1 and 15 are at distance 2 (pairs of positions whose xor is the
    syndrome).
    """
    flip = lambda *at: sum(1 << (i - 1) for i in at)
    return [[0]] + [[flip(s)] + [flip(i, i ^ s) for i in range(1, 32) if i < i ^ s] for s in range(1, 32)]


def links(fps: DataFrame) -> DataFrame:
    """(a, b): edges whose components are those of the distinct fingerprints fps(fp) linked at 2 or fewer differing bits.

    If two words of 64 bits differ in at most 2, their left halves differ in at most 1 or their right halves are equal.
    Left halves (31 of their bits): each fingerprint has its home at the nearest anchor, at most 1 away, and visits all
    anchors within radius 1 + threshold 1; if x is linked with y, y visits x's home. Right halves: threshold 0, so both
    have the same home. Homes and visitors of an anchor are compared.

    An anchor of more than HOT_ANCHOR fingerprints isn't compared pair by pair, as pairs grow with the square: its
    members are linked with all words at distance 1, themselves included. Words at distance 2 or 1 share such a midpoint,
    and any two that share one are linked, so components are the same; the rows grow with the members.
    """
    left, right = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    flips = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in row]) for row in anchors()])
    low = lambda w: w.bitwiseAND(F.lit(0x7FFFFFFF))
    around = lambda w: F.element_at(flips, syndrome(w) + 1)
    key = lambda side, w, flip: low(w).bitwiseXOR(flip) * 2 + side
    at_left = F.transform(around(left), lambda x: key(0, left, x))
    visits = fps.select("fp", F.explode(F.concat(at_left, F.array(key(1, right, F.element_at(around(right), 1))))).alias("anchor"))
    homes = fps.select("fp", F.explode(F.array(key(0, left, F.element_at(around(left), 1)), key(1, right, F.element_at(around(right), 1)))).alias("anchor"))
    sizes = visits.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    met = homes.join(sizes, "anchor")
    met = checkpoint(met)
    pairs = met.where(F.col("n") <= HOT_ANCHOR).select("anchor", F.col("fp").alias("a")).join(visits.withColumnRenamed("fp", "b"), "anchor").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    hot = visits.join(met.where(F.col("n") > HOT_ANCHOR).select("anchor").distinct(), "anchor", "left_semi").select("fp").distinct()
    midpoints = F.array(*[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)], F.col("fp"))
    shared = hot.select(F.col("fp"), F.explode(midpoints).alias("mid"))
    first = shared.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = shared.join(first, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links).

    Every fingerprint is compared, exactly; equal ones (exact copies) are one from the start. Texts without words,
    null ones included, have fingerprint zero and are linked like any other. Repeated rows stay, null ids belong to
    their component but never name it unless all its ids are null. Other columns are ignored; an empty table gives an
    empty result.
    """
    return _linked(checkpoint(with_fingerprint(docs, doc_id, text, width)))


def _linked(of: DataFrame) -> DataFrame:
    fps = checkpoint(of.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comps = components(links(fps.select("fp")))
    classes = fps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = classes.join(classes.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return of.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _joined(classes: DataFrame, met: DataFrame) -> DataFrame:
    """classes(doc_id, component_id) with the components that met(a, b) links made one."""
    joined = components(met).select(F.col("node").alias("component_id"), "component")
    return classes.join(joined, "component_id", "left").select("doc_id", F.coalesce("component", "component_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float | None = None) -> DataFrame:
    """docs without all but the first document (least doc_id) of each component. Of rows that repeat a doc_id one stays.

    Documents are linked by fingerprints and, with similarity, also by it: texts of the same runs of words have near
    fingerprints, but at a similarity of 0.8 these differ in about 10 of 64 bits, which no covering reaches. similar() finds most
    links cheaply, unlinked() all others. The decision is made on ids alone; texts only meet the ids to drop. Rows of null doc_id stay.
    """
    if similarity is None:
        classes = near_duplicates(docs, doc_id, text, width)
    else:
        of = checkpoint(with_fingerprint(docs, doc_id, text, width, bands=True))
        classes = checkpoint(_linked(of.select("doc_id", "fp")).where("doc_id IS NOT NULL").select("doc_id", "component_id"))
        name = lambda c: classes.distinct().select(F.col("doc_id").alias(c), F.col("component_id").alias(f"of_{c}"))
        met = similar(docs, of, width, similarity, doc_id, text).join(name("a"), "a").join(name("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
        classes = checkpoint(_joined(classes, met))
        met = unlinked(docs, classes, width, similarity, doc_id, text).join(name("a"), "a").join(name("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
        classes = _joined(classes, met)
    gone = classes.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(doc_id)).distinct()
    return drop(docs, gone, doc_id)


def drop(docs: DataFrame, gone: DataFrame, doc_id: str) -> DataFrame:
    """docs without the ids in gone; of rows that repeat a doc_id one stays."""
    kept = without(docs, gone, doc_id)
    again = checkpoint(docs.groupBy(doc_id).count().where("count > 1").select(doc_id))
    with tidy(docs.sparkSession):
        if again.isEmpty():
            return kept
    once = kept.join(again, doc_id, "left_semi").dropDuplicates([doc_id])
    return without(kept, again, doc_id).unionByName(once)
