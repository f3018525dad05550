"""Language-model scores from an n-gram trie in Elias-Fano levels, memory-mapped from the shared folder."""

from __future__ import annotations

import json
import mmap
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, per_row_sum, remainder, shared_dir, slices, words_of

#: Words seen less often form one class (their share of it follows their counts); longest n-grams; contexts seen less
#: often aren't extended beyond two words; absolute discount; n-grams (words) in a file.
MIN_COUNT, ORDER, MIN_CONTEXT, DISCOUNT, FILE_ROWS = 1, 2, 32, 0.75, 1 << 18
#: Bytes of text taken at once: memory of a task's arrays is some fifty times that.
STEP = 4 << 20

ONE, SIX, W64 = np.uint64(1), np.uint64(6), np.uint64(63)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of each value, one after another, in 64-bit words (one more at the end to read over)."""
    if width == 0 or not len(values):
        return np.zeros(1, np.uint64)
    out = []
    for i in range(0, len(values), 1 << 16):  # a multiple of 64 values fills whole words
        bits = np.unpackbits(values[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
        flat = np.packbits(bits.ravel(), bitorder="little")
        out.append(np.concatenate([flat, np.zeros(-len(flat) % 8, np.uint8)]).view(np.uint64))
    return np.concatenate([*out, np.zeros(1, np.uint64)])


def unpack(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    if width == 0:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.uint64) * np.uint64(width)
    word, shift = (bit >> SIX).astype(np.int64), bit & W64
    low = words[word] >> shift
    high = np.where(shift > 0, words[np.minimum(word + 1, len(words) - 1)] << ((np.uint64(64) - shift) & W64), np.uint64(0))
    return (low | high) & np.uint64((1 << width) - 1)


def select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the bit number `rank` (from 0) among those set in each word."""
    word, rank, at = word.copy(), rank.astype(np.int64), np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
        up = rank >= below
        rank -= np.where(up, below, 0)
        at += np.where(up, width, 0)
        word = np.where(up, word >> np.uint64(width), word)
    return at


@dataclass
class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits as unary gaps, with set bits counted up to each word."""

    n: int
    width: int
    low: np.ndarray
    high: np.ndarray
    upto: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(1, n)).bit_length() - 1)
        at = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-((int(at[-1]) if n else 0) + 2) // 64) * 64, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        upto = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return cls(n, width, pack(values & np.uint64((1 << width) - 1), width), high, upto.astype(np.uint32 if n < 1 << 32 else np.int64))

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of set (or unset) bit number k from 0."""
        if one:
            word = np.searchsorted(self.upto, k, side="right") - 1
            return word * 64 + select_in_word(self.high[word], k - self.upto[word])
        zeros = np.arange(len(self.upto), dtype=np.int64) * 64 - self.upto
        word = np.searchsorted(zeros, k, side="right") - 1
        return word * 64 + select_in_word(~self.high[word], k - zeros[word])

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = self._select(i, True) - i
        return (high.astype(np.uint64) << np.uint64(self.width)) | unpack(self.low, i, self.width)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Number of the first element that is x or more (n if none)."""
        if not self.n:
            return np.zeros(len(x), np.int64)
        high = (x >> np.uint64(self.width)).astype(np.int64)
        last = len(self.high) * 64 - int(self.upto[-1]) - 1
        beyond = high > last
        high = np.minimum(high, last)
        lo = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - np.maximum(high - 1, 0), 0)
        hi = np.minimum(self._select(high, False) - high, self.n)
        want = x & np.uint64((1 << self.width) - 1)
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            less = (unpack(self.low, np.minimum(mid, self.n - 1), self.width) < want) & (lo < hi)
            lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
        return np.where(beyond, self.n, lo)


def quantise(x: np.ndarray, levels: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(codes, values): equally filled bins, each stood for by its mean."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(1, np.float32)
    edges = np.unique(np.quantile(x, np.linspace(0, 1, levels + 1)[1:-1]))
    code = np.searchsorted(edges, x, side="right")
    n = np.bincount(code, minlength=levels)
    return code.astype(np.uint8), (np.bincount(code, weights=x, minlength=levels) / np.maximum(1, n)).astype(np.float32)


def _fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" not in uri:
        return (pa.fs.LocalFileSystem(), uri.removeprefix("file:"))
    return pa.fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray], **meta) -> None:
    """One file of arrays, written aside and then moved, so that a repeated or lost task leaves whole files only."""
    fs, base = _fs(folder)
    fs.create_dir(base, recursive=True)
    places, at = {}, 0
    for k, a in arrays.items():
        places[k] = (at, a.dtype.str, len(a))
        at += a.nbytes + -a.nbytes % 8
    head = json.dumps({"arrays": places, "meta": meta}).encode()
    part = f"{base}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(len(head).to_bytes(8, "little"))
        out.write(head + b" " * (-len(head) % 8))
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8))
    try:
        fs.move(part, f"{base}/{name}")
    except OSError:
        if fs.get_file_info(f"{base}/{name}").type != pa.fs.FileType.File:
            raise
        fs.delete_file(part)  # an earlier attempt's file, of the same content, is there


def map_arrays(folder: str, name: str) -> tuple[dict[str, np.ndarray], dict]:
    """Arrays of such a file, memory-mapped: in place where the shared folder is mounted, else by way of a copy that is
    unlinked at once."""
    fs, base = _fs(folder)
    if isinstance(fs, pa.fs.LocalFileSystem):
        with open(f"{base}/{name}", "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        handle, copy = tempfile.mkstemp()
        with os.fdopen(handle, "w+b") as f, fs.open_input_stream(f"{base}/{name}") as source:
            os.unlink(copy)
            while block := source.read(1 << 22):
                f.write(block)
            f.flush()
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    n = int.from_bytes(data[:8], "little")
    head = json.loads(data[8 : 8 + n])
    start = 8 + n + -n % 8
    return {k: np.frombuffer(data, kind, count, start + at) for k, (at, kind, count) in head["arrays"].items()}, head["meta"]


def ef_arrays(name: str, ef: EliasFano) -> dict[str, np.ndarray]:
    return {f"{name}.low": ef.low, f"{name}.high": ef.high, f"{name}.upto": ef.upto, f"{name}.size": np.array([ef.n, ef.width], np.int64)}


def ef_from(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    n, width = arrays[f"{name}.size"].tolist()
    return EliasFano(n, width, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.upto"])


_open: dict[tuple[str, str], tuple] = {}


def opened(folder: str, name: str, *sequences: str) -> tuple:
    """(arrays, meta, sequences) of a file, mapped once a process."""
    if (folder, name) not in _open:
        for other in [k for k in _open if k[0] != folder]:  # an earlier model's
            del _open[other]
        arrays, meta = map_arrays(folder, name)
        _open[folder, name] = (arrays, meta, *(ef_from(arrays, s) for s in sequences))
    return _open[folder, name]


@dataclass
class Level:
    """n-grams of one order in files by ranges of context nodes; starts: number of the first n-gram of each file."""

    per_file: int
    starts: list[int]


@dataclass
class Trie:
    """The first level holds the hashes of all training words with their counts; frequent ones are numbered in order of
    their hashes, and those numbers are the next level's context nodes and successors. In further levels an n-gram's
    place is its node. Its parent's pointers (monotone) bound the successors; these are stored as one monotone sequence,
    each context's counted from the last of the one before, and searched relative to that."""

    folder: str
    bits: int
    first: list[int]
    frequent: int
    tokens: int
    types: int
    rare_tokens: int
    rare_types: int
    shards: frozenset[int] = frozenset()
    levels: dict[int, Level] = field(default_factory=dict)

    @property
    def rare(self) -> int:
        return self.frequent

    @property
    def begin(self) -> int:
        return self.frequent + 1

    def lookup(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, numbers) of words; unknown ones have count 0, rare and unknown ones the class's number."""
        h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
        count, number = np.zeros(len(h), np.int64), np.full(len(h), self.rare, np.int64)
        by = np.argsort(h)
        h = h[by]
        shard = (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        for s in np.unique(shard):
            if int(s) not in self.shards:
                continue
            a, b = np.searchsorted(shard, [s, s + 1])
            arrays, _, keys = opened(self.folder, f"words-{s}", "keys")
            want = h[a:b] - (np.uint64(s) << np.uint64(64 - self.bits) if self.bits else np.uint64(0))
            i = keys.successor(want)
            at = np.minimum(i, keys.n - 1)
            hit = (i < keys.n) & (keys[at] == want)
            count[by[a:b]] = np.where(hit, arrays["counts"][at], 0)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            flag = arrays["frequent"]
            often = hit & ((flag[word] >> bit) & ONE > 0)
            rank = arrays["upto"][word] + np.bitwise_count(flag[word] & ((ONE << bit) - ONE))
            number[by[a:b]] = np.where(often, self.first[s] + rank, self.rare)
        return count, number

    def child(self, order: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node or -1, log10 probability, log10 backoff of the context) for contexts (-1: none) sorted ascending."""
        level = self.levels[order]
        node, p, back = np.full(len(context), -1, np.int64), np.zeros(len(context)), np.zeros(len(context))
        file = np.where(context >= 0, context // level.per_file, -1)
        for s in np.unique(file[file >= 0]):
            if level.starts[s + 1] == level.starts[s]:
                continue
            a, b = np.searchsorted(file, [s, s + 1])
            arrays, _, pointers, keys = opened(self.folder, f"level{order}-{s}", "pointers", "keys")
            c = context[a:b] - s * level.per_file
            begin, end = pointers[c].astype(np.int64), pointers[c + 1].astype(np.int64)
            base = np.where(begin > 0, keys[np.maximum(begin - 1, 0)], np.uint64(0))
            want = base + word[a:b].astype(np.uint64) + ONE
            i = keys.successor(want)
            at = np.minimum(i, keys.n - 1)
            hit = (i >= begin) & (i < end) & (keys[at] == want)
            node[a:b] = np.where(hit, level.starts[s] + i, -1)
            p[a:b] = arrays["values"][arrays["codes"][at]]
            back[a:b] = np.where(end > begin, arrays["backoffs"][arrays["backoff"][c]], 0.0)
        return node, p, back

    def extends(self, order: int, node: np.ndarray) -> np.ndarray:
        """Whether each node (-1: none) of an order was seen often enough to be a context; nodes sorted ascending."""
        out = np.zeros(len(node), bool)
        starts = np.array(self.levels[order].starts)
        file = np.where(node >= 0, np.searchsorted(starts, node, side="right") - 1, -1)
        for s in np.unique(file[file >= 0]):
            a, b = np.searchsorted(file, [s, s + 1])
            arrays, *_ = opened(self.folder, f"level{order}-{s}", "pointers", "keys")
            i = node[a:b] - starts[s]
            out[a:b] = (arrays["extend"][i >> 6] >> (i & 63).astype(np.uint64)) & ONE > 0
        return out

    def unigram(self, count: np.ndarray, number: np.ndarray) -> np.ndarray:
        """log10 probability of each word's class: itself if it is frequent."""
        n = np.where(number == self.rare, self.rare_tokens, count)
        return np.log10((n + 1) / (self.tokens + self.frequent + 1))


    def unigrams(self) -> np.ndarray:
        """unigram() of all numbers, the class of rare words and the beginning (never a successor) last."""
        count = np.zeros(self.frequent + 2, np.int64)
        for s in sorted(self.shards):
            arrays, *_ = opened(self.folder, f"words-{s}", "keys")
            own = arrays["counts"][np.unpackbits(arrays["frequent"].view(np.uint8), bitorder="little")[: len(arrays["counts"])] > 0]
            count[self.first[s] : self.first[s] + len(own)] = own
        return self.unigram(count, np.arange(len(count)))


@dataclass
class Read:
    """Texts as the model sees them: words and one end each, with what the trie has of them up to its longest order."""

    count: np.ndarray
    number: np.ndarray
    offsets: np.ndarray
    log_p: np.ndarray
    context: np.ndarray
    lower: np.ndarray


def read(trie: Trie, texts: pa.Array, order: int, extend: bool = False) -> Read:
    """log_p of each token by n-grams up to `order`. With extend: context, each token's node of the order - 1 words
    before it (-1: not a context), and lower, its log10 probability by shorter n-grams."""
    codes, offsets, words = words_of(texts)
    count, number = trie.lookup([w.encode() for w in words.cast(pa.string()).to_pylist()] + [b""])
    docs = len(offsets) - 1
    place = np.arange(len(codes)) + np.repeat(np.arange(docs), np.diff(offsets))
    offsets = offsets + np.arange(docs + 1)
    token = np.full(len(codes) + docs, len(count) - 1)
    token[place] = codes
    count, number = count[token], number[token]
    first = np.zeros(len(token), bool)
    first[offsets[:-1]] = True
    log_p = lower = trie.unigram(count, number)
    before = np.concatenate([[trie.begin], number[:-1]]) if len(number) else number
    context = np.where(first, trie.begin, before)
    for k in range(2, order + 1):
        lower = log_p
        if extend and k == order:
            break
        # each context and word is looked up once, in ascending order
        code = context * (trie.frequent + 2) + number
        unique, where = np.unique(code, return_inverse=True)
        parent = unique // (trie.frequent + 2)
        parent[unique < 0] = -1
        word = unique - parent * (trie.frequent + 2)
        node, p, back = trie.child(k, parent, word)
        hit = node >= 0
        log_p = np.where(hit[where], p[where], back[where] + log_p)
        if k < order:
            rank = np.argsort(node, kind="stable")
            usable = np.zeros(len(node), bool)
            usable[rank] = trie.extends(k, node[rank])
            node = np.where(usable, node, -1)
            # of the n-gram ending one token earlier; an order-k n-gram that reaches before the text's start is no context
            seen = node[where]
            context = np.where(first, -1, np.concatenate([[-1], seen[:-1]]) if len(seen) else seen)
    return Read(count, number, offsets, log_p, context, lower)


def train(docs: DataFrame, text: str = "text", order: int = ORDER, min_count: int = MIN_COUNT, min_context: int = MIN_CONTEXT, file_rows: int = FILE_ROWS) -> Trie:
    """The trie of all whole texts of docs (null texts: empty), interpolated with absolute discounting, in a new folder
    below the shared one.

    Words are counted in one aggregation, n-grams of each further order in another; files of about file_rows words or
    n-grams are built in tasks of their own. A context's successors are at most the frequent words.
    """
    folder = shared_dir(docs.sparkSession)
    source = docs.select(F.col(text).cast("string").alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP):
                codes, _, names = words_of(part.column("text"))
                n = np.append(np.bincount(codes, minlength=len(names)), part.num_rows)
                yield pa.record_batch([pa.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in names.cast(pa.string()).to_pylist()] + [xxhash.xxh64_intdigest(b"", 42)], pa.uint64()).view(pa.int64()), pa.array(np.arange(len(names) + 1) == len(names)), pa.array(n.astype(np.int64))], names=["h", "end", "c"])

    def written(df: DataFrame, name: str) -> DataFrame:
        """df as a table in the folder: smaller than a checkpoint, and as safe from lost executors."""
        df.write.parquet(f"{folder}/{name}")
        return docs.sparkSession.read.parquet(f"{folder}/{name}")

    counts = written(map_batches(source, words, "h bigint, end boolean, c bigint", trim=False).groupBy("h", "end").agg(F.sum("c").alias("c")).withColumn("often", (F.col("c") >= min_count) | F.col("end")), "counts")
    total = counts.agg(F.count("*").alias("types"), F.sum("c").alias("tokens"), F.sum(F.when(~F.col("often"), F.col("c"))).alias("rare"), F.count(F.when(~F.col("often"), 1)).alias("rare_types")).first()
    types = total["types"]
    bits = max(0, (types // file_rows).bit_length())
    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    counts = counts.withColumn("shard", shard)
    sizes = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum(F.col("often").cast("int")).alias("n")).collect()}
    first, at = [], 0
    for s in range(1 << bits):
        first.append(at)
        at += sizes.get(s, 0)
    trie = Trie(folder, bits, first, at, total["tokens"] or 0, types, total["rare"] or 0, total["rare_types"])

    def build_words(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = pdf["h"].to_numpy(np.int64).view(np.uint64) - (np.uint64(key[0]) << np.uint64(64 - bits) if bits else np.uint64(0))
        by = np.argsort(h)
        often = pdf["often"].to_numpy(bool)[by]
        flag = pack(often.astype(np.uint64), 1)
        upto = np.concatenate([[0], np.cumsum(np.bitwise_count(flag), dtype=np.int64)])
        write_arrays(folder, f"words-{key[0]}", ef_arrays("keys", EliasFano.of(h[by])) | {"counts": pdf["c"].to_numpy(np.int64)[by], "frequent": flag, "upto": upto})
        return pd.DataFrame({"shard": [key[0]], "n": [len(h)]})

    trie.shards = frozenset(r["shard"] for r in counts.select("shard", "h", "c", "often").groupBy("shard").applyInPandas(build_words, "shard int, n bigint").collect())
    for k in range(2, order + 1):  # each round's jobs have run before the next changes k and trie
        now = trie

        def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", STEP):
                    r = read(now, part.column("text"), k, extend=True)
                    some = r.context >= 0
                    code = r.context[some] * (now.frequent + 2) + r.number[some]
                    unique, at, n = np.unique(code, return_index=True, return_counts=True)
                    out = {"code": pa.array(unique), "n": pa.array(n.astype(np.int32))}
                    if k > 2:  # else it is the word's own, which the task that builds the file knows
                        out["lower"] = pa.array(r.lower[some][at].astype(np.float32))
                    yield pa.record_batch(list(out.values()), names=list(out))

        # context and word in one number: context * (frequent + 2) + word
        rows = map_batches(source, grams, "code bigint, n int" + ", lower float" * (k > 2), trim=False)
        rows = rows.groupBy("code").agg(F.sum("n").alias("n"), *[F.max("lower").alias("lower")] * (k > 2))
        rows = written(rows, f"grams{k}")
        contexts = trie.frequent + 2 if k == 2 else trie.levels[k - 1].starts[-1]
        per_file = max(1, -(-contexts // max(1, -(-rows.count() // file_rows))))
        rows = rows.withColumn("file", F.expr(f"cast(code div {per_file * (trie.frequent + 2)} as int)"))

        def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            code = pdf["code"].to_numpy(np.int64)
            by = np.argsort(code)
            context, word = code[by] // (now.frequent + 2) - key[0] * per_file, code[by] % (now.frequent + 2)
            n = pdf["n"].to_numpy(np.float64)[by]
            lower = 10 ** (now.unigrams()[word] if k == 2 else pdf["lower"].to_numpy(np.float64)[by])
            size, total = np.bincount(context, minlength=per_file), np.bincount(context, weights=n, minlength=per_file)
            rest = DISCOUNT * size / np.maximum(total, 1)
            p = np.log10((n - DISCOUNT) / total[context] + rest[context] * lower)
            ends = np.cumsum(size)
            last = np.where(size > 0, word[np.maximum(ends - 1, 0)] + 1, 0)
            base = np.concatenate([[0], np.cumsum(last)[:-1]])
            codes, values = quantise(p)
            backoff, backoffs = quantise(np.log10(np.maximum(rest, 1e-9)))
            arrays = ef_arrays("pointers", EliasFano.of(np.concatenate([[0], ends]))) | ef_arrays("keys", EliasFano.of(base[context] + word + 1))
            write_arrays(folder, f"level{k}-{key[0]}", arrays | {"codes": codes, "values": values, "backoff": backoff, "backoffs": backoffs, "extend": pack((n >= min_context).astype(np.uint64), 1)})
            return pd.DataFrame({"file": [key[0]], "n": [len(word)]})

        n = {r["file"]: r["n"] for r in rows.groupBy("file").applyInPandas(build, "file int, n bigint").collect()}
        starts = np.concatenate([[0], np.cumsum([n.get(s, 0) for s in range(max(n, default=-1) + 1 or 1)])]).tolist()
        starts += [starts[-1]] * max(0, -(-contexts // per_file) + 1 - len(starts))
        trie.levels = trie.levels | {k: Level(per_file, starts)}
    return trie


def score(docs: DataFrame, trie: Trie, text: str = "text") -> DataFrame:
    """docs' columns but text, with n_tokens, n_known, train_tokens, base_score and score.

    Tokens are the text's words (A-Z lower-cased) and one end. base_score sums log10((c + 1) / (N + V + 1)); score is the
    model's log10 probability: that of each token's class after its predecessors, rare words' share of their class by
    (c + 1) / (rare tokens + rare types + 1). Null and blank texts consist of the end alone. Texts are scored whole;
    repeated rows stay; an empty table gives an empty result; same-named columns are replaced.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in docs.columns if c not in (text, *new)]
    order = max(trie.levels, default=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, STEP):
                r = read(trie, part.column(text), order)
                base = np.log10((r.count + 1) / (trie.tokens + trie.types + 1))
                log_p = r.log_p + np.where(r.number == trie.rare, np.log10((r.count + 1) / (trie.rare_tokens + trie.rare_types + 1)), 0.0)
                known = per_row_sum((r.count > 0).astype(np.int64), r.offsets).astype(np.int64)
                out = [np.diff(r.offsets), known, np.full(part.num_rows, trie.tokens), per_row_sum(base, r.offsets), per_row_sum(log_p, r.offsets)]
                yield pa.record_batch([*[part.column(c) for c in kept], *map(pa.array, out)], names=[*kept, *new])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return map_batches(docs.select(*[F.col(c) for c in kept], F.col(text).cast("string")), run, f"{fields}{', ' * bool(kept)}n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double", trim=False)


def held_out(doc_id: str = "doc_id"):
    return remainder(F.col(doc_id), 7) == 2
