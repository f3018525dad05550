"""Prefix trie of conversations, with subtree totals by peeling leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, map_batches, shared_dir
from .mixing import token_count

#: Sums along a conversation are taken within blocks of so many turns, then over blocks.
BLOCK = 1024
#: Conversations whose ids fall into one range of this width are listed by one task before digests are taken.
ID_RANGE = 1 << 16
NODE = ("depth", "p1", "p2")


def numbered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, t1, t2, words): turns in order, numbered from 0 within their conversation; a digest of 128 bits and
    the words of each.

    Order is by turn (null first), then role, then text; null roles and texts are empty. Rows without conv_id belong to no
    conversation and are left out. Rows are sorted by ranges, and a conversation's rows in a range follow those in earlier
    ones: one of any length is spread over tasks.
    """
    role_, text_ = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), role_.alias("role"), text_.alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    digest = lambda seed: F.xxhash64(F.lit(seed), "role", "text")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = checkpoint(rows.select("conv_id", digest(1).alias("t1"), digest(2).alias("t2"), token_count(F.col("text")).alias("words"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    parts = rows.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    parts = parts.select("conv_id", "part", "first", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("row") - F.col("first") + F.col("before")).alias("place"), "t1", "t2", "words")


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) rebuilt from numbered turns: conversation c gets the first h turns of conversation c - c % 20
    (all if fewer, none if it is absent), then its own after its first h, where h = crc32(decimal c) % 4."""
    turns = checkpoint(turns)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    convs = checkpoint(convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("m")), "base", "left").withColumn("m", F.least("h", F.coalesce("m", F.lit(0)))))
    heads = turns.where((F.col("place") < 3) & (F.col("conv_id") % 20 == 0)).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs.where("h > 0").select("base", "conv_id", "h"), "base").where("place < h").select(*turns.columns)
    own = turns.join(convs.select("conv_id", "h", "m"), "conv_id").where("place >= h").withColumn("place", F.col("place") - F.col("h") + F.col("m"))
    return heads.unionByName(own.select(*turns.columns)), convs.select("conv_id", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def _running(rows: DataFrame, at: str, values: dict[str, str], total: str, downward: bool = False) -> DataFrame:
    """rows(conv_id, at, ...) with, for each name: column of values, its total (an aggregate) over the conversation's rows up
    to this one (from this one on, if downward): within blocks of rows, then over the blocks before."""
    of = {name: getattr(F, total)(F.col(c)) for name, c in values.items()}
    order = lambda c: F.col(c).desc() if downward else F.col(c)
    rows = rows.withColumn("block", F.floor(F.col(at) / BLOCK))
    blocks = rows.groupBy("conv_id", "block").agg(*(x.alias(f"_{name}") for name, x in of.items()))
    before = Window.partitionBy("conv_id").orderBy(order("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", *(getattr(F, total)(f"_{name}").over(before).alias(f"_{name}") for name in of)).where(F.col(f"_{next(iter(of))}").isNotNull())
    within = Window.partitionBy("conv_id", "block").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *(x.over(within).alias(name) for name, x in of.items())).join(blocks, ["conv_id", "block"], "left")
    both = (lambda a, b: a.bitwiseXOR(b)) if total == "bit_xor" else (lambda a, b: a + b)
    return rows.select(*(c for c in rows.columns if c not in of and c[1:] not in of and c != "block"), *(both(F.col(name), F.coalesce(f"_{name}", F.lit(0))).alias(name) for name in of))


def _end_digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of ends(depth, p1, p2, conv_id).

    Ids are listed by ranges of ID_RANGE, so that no task holds a node's whole list; nodes of one list are digested at once,
    for the others the lists pass through a task in order, in batches of bounded size.
    """
    lists = ends.groupBy(*NODE, F.floor(F.col("conv_id") / ID_RANGE).alias("range")).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))).alias("ids"))
    lists = checkpoint(lists)
    sizes = lists.groupBy(*NODE).agg(F.count("*").alias("lists"))
    one = lists.join(sizes.where("lists = 1").select(*NODE), list(NODE), "left_semi").select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))
    some = lists.join(sizes.where("lists > 1").select(*NODE), list(NODE), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None

        def row() -> pa.RecordBatch:
            return pa.record_batch([*(pa.array([x], pa.int64()) for x in node), pa.array([sha.hexdigest()])], names=[*NODE, "ends_sha256"])

        for batch in batches:
            keys, ids = zip(*(batch.column(c).to_pylist() for c in NODE)), batch.column("ids")
            for k, x in zip(keys, ids):
                if k != node:
                    if node is not None:
                        yield row()
                    node, sha = k, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(x.as_buffer())
        if node is not None:
            yield row()

    some = some.select(*(F.col(c).cast("bigint") for c in NODE), "range", "ids").repartition(*NODE).sortWithinPartitions(*NODE, "range")
    return one.unionByName(map_batches(some, run, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string", trim=False))


def _subtree_totals(nodes: DataFrame) -> DataFrame:
    """nodes(conv_id, depth, parent_conv_id, leaf, own, ...) with n_leaves and saved_tokens of each node's subtree.

    Nodes of the same conv_id form a path: its top hangs on a node of another path. Leaves are peeled by whole paths: a path
    counts the paths below it that haven't finished; one with none left sends its totals to the node on which it hangs; this
    is repeated until the root's path finishes. So there are as many rounds as branchings on the way to the deepest of these, however long the
    conversations. Each round's messages are written to the shared folder; what nodes have received is then summed upwards
    along their path.
    """
    spark, folder = nodes.sparkSession, shared_dir(nodes.sparkSession)
    paths = nodes.groupBy("conv_id").agg(F.min_by("parent_conv_id", "depth").alias("parent"), (F.min("depth") - 1).alias("at"), F.sum("leaf").alias("leaves"), F.sum("own").alias("saved"))
    below = paths.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("waiting"))
    waiting = checkpoint(paths.join(below, "conv_id", "left").withColumn("waiting", F.coalesce("waiting", F.lit(0))))
    n = 0
    while True:
        sent = f"{folder}/messages/round={n}"
        waiting.where("waiting = 0").select("parent", "at", "leaves", "saved").write.parquet(sent)
        got = spark.read.parquet(sent).where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("_n"), F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        waiting = checkpoint(waiting.where("waiting > 0").join(got, "conv_id", "left").select("conv_id", "parent", "at", (F.col("leaves") + zero("_l")).alias("leaves"), (F.col("saved") + zero("_s")).alias("saved"), (F.col("waiting") - zero("_n")).alias("waiting")))
        if waiting.isEmpty():
            break
        n += 1
    messages = spark.read.parquet(f"{folder}/messages").where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
    rows = nodes.join(messages, ["conv_id", "depth"], "left").withColumns({"_l": F.col("leaf") + zero("_l"), "_s": F.col("own") + zero("_s")})
    return _running(rows, "depth", {"n_leaves": "_l", "saved_tokens": "_s"}, "sum", downward=True)


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations (node): conv_id (smallest member), depth, parent_conv_id (parent's
    conv_id; root: null), n_convs (members), n_children, n_leaves (childless nodes of its subtree), saved_tokens (over its
    subtree, what is saved if each node's last turn is stored once: (n_convs - 1) * words), ends_sha256 (of the ids of the members that end there).

    turns: (conv_id, place, t1, t2, words), of which each conversation has places 0 to n - 1; conversations: (conv_id, n),
    distinct, n may be 0. A prefix is known by its depth and the exclusive or of its turns' hashes at their places, twice 64
    bits; nodes come from one aggregation, whatever share of conversations begins alike. Without conversations there is no
    node.
    """
    zero = F.lit(0).cast("bigint")
    hashed = turns.select("conv_id", "place", "words", F.xxhash64("place", "t1").alias("v1"), F.xxhash64("place", "t2").alias("v2"))
    prefixes = _running(hashed, "place", {"p1": "v1", "p2": "v2"}, "bit_xor")
    prefixes = checkpoint(prefixes.select("conv_id", (F.col("place") + 1).alias("depth"), "p1", "p2", F.col("p1").bitwiseXOR(F.col("v1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("v2")).alias("q2"), "words"))
    top = conversations.select("conv_id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), F.lit(None).cast("bigint").alias("q1"), F.lit(None).cast("bigint").alias("q2"), zero.alias("words"))
    found = prefixes.unionByName(top).groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    found = checkpoint(found)
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = found.join(children, list(NODE), "left").join(above, ["depth", "q1", "q2"], "left")
    nodes = checkpoint(nodes.select(*NODE, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("own")))
    last = prefixes.join(conversations.where("n > 0").select("conv_id", F.col("n").alias("depth")), ["conv_id", "depth"], "left_semi").select(*NODE, "conv_id")
    ends = last.unionByName(conversations.where("n = 0").select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id"))
    rows = _subtree_totals(nodes).join(_end_digests(ends), list(NODE), "left")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text) as it is: see numbered, trie."""
    turns = checkpoint(numbered(conversations))
    return trie(turns, turns.groupBy("conv_id").agg(F.count("*").alias("n")))


def trie_sql() -> str:
    """DuckDB SQL for the trie of conversations rebuilt by with_shared_heads."""
    words = "len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))"
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id),
c AS (SELECT k.conv_id, k.n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(k.conv_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, b: xor(t[1 + (xor(a, b) & 255)], a >> 8))) % 4 AS h, coalesce(b.n, 0) AS m FROM k CROSS JOIN crc LEFT JOIN k b ON b.conv_id = k.conv_id - k.conv_id % 20),
r AS (SELECT c.conv_id, i, role, text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND i < h UNION ALL SELECT conv_id, i - h + least(h, m), role, text FROM o JOIN c USING (conv_id) WHERE i >= h),
p AS (SELECT conv_id, i + 1 AS depth, {words} AS words, sha256(string_agg(sha256(role || chr(0) || text), ',') OVER (PARTITION BY conv_id ORDER BY i)) AS key FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT *, lag(key) OVER w AS parent, lead(depth) OVER w IS NULL AS ends FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
n AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) * (count(*) - 1) AS own, max(parent) AS parent, coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM l GROUP BY depth, key),
a AS (SELECT x.*, y.conv_id AS parent_conv_id, (SELECT count(*) FROM n z WHERE z.depth = x.depth + 1 AND z.parent = x.key) AS n_children FROM n x LEFT JOIN n y ON y.depth = x.depth - 1 AND y.key = x.parent),
s AS (SELECT l.depth, l.key, sum(a.own) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM a JOIN l ON l.conv_id = a.conv_id AND l.depth <= a.depth GROUP BY l.depth, l.key)
SELECT conv_id, depth::bigint AS depth, parent_conv_id, n_convs, n_children, leaves AS n_leaves, saved::bigint AS saved_tokens, sha256(ids) AS ends_sha256 FROM a JOIN s USING (depth, key)"""
