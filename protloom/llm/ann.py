"""Nearest neighbours by inner product: a vantage-point tree per shard, searched by blocks of queries."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """True for vectors that take part: not null, not empty, finite in every component, not zero."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & good, F.lit(False))


class Tree:
    """A vantage-point tree over rows x, as metric space by one more coordinate that makes all norms sqrt(top).

    There, distance^2 to a query q (its further coordinate 0) is |q|^2 + top - 2 q.x: nearer means a larger inner
    product. Nodes hold their vantage point and how far the inner half reaches and the outer half begins; leaves are runs
    of the reordered rows.
    """

    LEAF = 128

    def __init__(self, ids: np.ndarray, x: np.ndarray, top: float):
        order = np.lexsort((*x.T[::-1], ids))  # whatever order the rows arrive in
        ids, x = ids[order], x[order]
        full = np.column_stack([x, np.sqrt(np.maximum(0, top - (x * x).sum(1)))])
        self.vantage, self.nodes, self.leaves = [], [], []
        place: list[np.ndarray] = []

        def build(rows: np.ndarray) -> int:
            """Number of the node (negative: -1 - number of the leaf)."""
            if len(rows) > self.LEAF:
                away = np.linalg.norm(full[rows] - full[rows[0]], axis=1)
                p = rows[int(away.argmax())]  # a point at the rim splits better than one in the middle
                away = np.linalg.norm(full[rows] - full[p], axis=1)
                by = np.argsort(away, kind="stable")
                half = len(rows) // 2
                if away[by[0]] < away[by[-1]]:
                    k = len(self.nodes)
                    self.vantage.append(full[p])
                    self.nodes.append(None)
                    inner, outer = build(rows[by[:half]]), build(rows[by[half:]])
                    self.nodes[k] = (inner, outer, away[by[half - 1]], away[by[half]])
                    return k
            start = sum(map(len, place))
            place.append(rows)
            self.leaves.append((start, start + len(rows)))
            return -len(self.leaves)

        self.root = build(np.arange(len(ids)))
        at = np.concatenate(place) if place else np.zeros(0, np.int64)
        self.ids, self.x, self.top = ids[at], x[at], top

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query numbers, ids, inner products) of each query's k nearest, ties to smaller ids, its own row (one of its id
        and vector) left out.

        A leaf is skipped for a query if the triangle inequality puts all its points farther than factor times the k-th
        distance so far: exact with factor 1, ever fewer leaves with smaller ones.
        """
        m, nq = len(q), (q * q).sum(1)
        far = np.zeros((m, len(self.leaves)))
        if self.nodes:
            v = np.array(self.vantage)
            to = np.sqrt(np.maximum(0, nq[:, None] + self.top - 2 * q @ v[:, :-1].T))

        def bound(node: int, low: np.ndarray) -> None:
            if node < 0:
                far[:, -1 - node] = low
                return
            inner, outer, reach, begin = self.nodes[node]
            bound(inner, np.maximum(low, to[:, node] - reach))
            bound(outer, np.maximum(low, begin - to[:, node]))

        bound(self.root, np.zeros(m))
        slack = 1e-9 * (1 + np.sqrt(nq * self.top))
        best, seen = np.full((m, k), -np.inf), np.zeros(far.shape, bool)
        own, by_id = np.full(m, -1), np.argsort(self.ids, kind="stable")
        lo, hi = (np.searchsorted(self.ids, q_ids, side, sorter=by_id) for side in ("left", "right"))
        for r in np.flatnonzero(hi > lo):
            same = by_id[lo[r] : hi[r]]
            same = same[(self.x[same] == q[r]).all(axis=1)]
            own[r] = same[0] if len(same) else -1
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(leaf: int, rows: np.ndarray) -> None:
            a, b = self.leaves[leaf]
            dots = q[rows] @ self.x[a:b].T
            mine = np.flatnonzero((own[rows] >= a) & (own[rows] < b))
            dots[mine, own[rows[mine]] - a] = -np.inf
            seen[rows, leaf] = True
            best[rows] = -np.sort(-np.concatenate([best[rows], dots], axis=1), axis=1)[:, :k]
            i, j = np.nonzero((dots >= (best[rows, k - 1] - slack[rows])[:, None]) & np.isfinite(dots))
            found.append((rows[i], a + j, dots[i, j]))

        nearest = far.argmin(1)
        for leaf in range(len(self.leaves)):
            if len(rows := np.flatnonzero(nearest == leaf)):
                visit(leaf, rows)
        for leaf in np.argsort(far.mean(0), kind="stable"):
            kth = np.sqrt(np.maximum(0, nq + self.top - 2 * np.where(np.isfinite(best[:, k - 1]), best[:, k - 1], -np.inf)))
            if len(rows := np.flatnonzero(~seen[:, leaf] & (far[:, leaf] <= factor * kth + slack))):
                visit(leaf, rows)
        i, j, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        keep = s >= best[i, k - 1] - slack[i]
        i, j = i[keep], j[keep]
        exact = np.zeros(len(i))
        for d in range(q.shape[1]):  # in one order for all pairs, so that equal vectors get equal products
            exact += q[i, d] * self.x[j, d]
        by = np.lexsort((self.ids[j], -exact, i))
        i, j, exact = i[by], j[by], exact[by]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        return i[rank < k], self.ids[j[rank < k]], exact[rank < k]

    def dump(self) -> bytes:
        out = io.BytesIO()
        nodes = np.array([(a, b, c, d) for a, b, c, d in self.nodes], np.float64).reshape(-1, 4)
        np.savez(out, ids=self.ids, x=self.x, top=self.top, v=np.array(self.vantage, np.float64), nodes=nodes, leaves=np.array(self.leaves, np.int64), root=self.root)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        z, self = np.load(io.BytesIO(data)), cls.__new__(cls)
        self.ids, self.x, self.top, self.vantage, self.root = z["ids"], z["x"], float(z["top"]), z["v"], int(z["root"])
        self.nodes = [(int(a), int(b), c, d) for a, b, c, d in z["nodes"]]
        self.leaves = [tuple(x) for x in z["leaves"].tolist()]
        return self


#: Bytes of a shard's vectors, and the fewest rows that it has at any length of vectors.
SHARD_BYTES, LEAST_ROWS = 16 << 20, 1024


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, shard_rows: int | None = None, block: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of vectors with the largest inner product.

    Rows are dealt by hash of the id to shards of about shard_rows (None: as many as SHARD_BYTES hold), each indexed by a
    Tree; queries go in blocks to every shard, and a window over each query's k hits per shard gives the result. The larger
    the shards and blocks, the fewer trees are sent and hits shuffled; a task loads a tree once for all blocks in a row. Ties go to the smaller id. A query's own
    row (one row of its id and vector) is no candidate of it; other rows that repeat its id are, and rows that repeat an
    id are candidates and queries each. Unusable vectors (see usable) take no part, nor do vectors
    of another length than the query's; with fewer candidates than k all are returned. Empty tables give empty results,
    other columns are ignored. factor below 1 prunes more than the triangle inequality allows, at the cost of recall.
    """
    take = lambda df: df.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    base, asked = take(vectors), take(queries)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    dims = base.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("top")).withColumn("shards", F.ceil(F.col("n") / (F.lit(shard_rows) if shard_rows else F.greatest(F.lit(LEAST_ROWS), F.floor(F.lit(SHARD_BYTES) / (F.col("dim") * 8))))).cast("int")).where("n > 0")
    dims = F.broadcast(dims) if dims.limit(10_001).count() <= 10_000 else dims
    n_queries = asked.count()

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["v"].to_list()).astype(np.float64), float(pdf["top"].iloc[0]))
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [tree.dump()]})

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, q = pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["v"].to_list()).astype(np.float64)
        by = np.lexsort((*q.T[::-1], ids))  # a query's place in its block tells rows of one id apart
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "shards": [int(pdf["shards"].iloc[0])], "ids": [ids[by].tobytes()], "q": [q[by].tobytes()]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded, tree = None, None
        for pdf in batches:
            for dim, shard, block, ids, q, data in zip(pdf["dim"], pdf["shard"], pdf["block"], pdf["ids"], pdf["q"], pdf["tree"], strict=True):
                if loaded != (dim, shard):
                    loaded, tree = (dim, shard), Tree.load(data)
                ids = np.frombuffer(ids, np.int64)
                i, found, score = tree.search(ids, np.frombuffer(q, np.float64).reshape(len(ids), -1), k, factor)
                yield pd.DataFrame({"block": block, "place": i, "query_id": ids[i], "vec_id": found, "score": score})

    trees = base.join(dims, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), "shards").cast("int")).select("dim", "shard", "top", "vec_id", "v").groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary")
    blocks = asked.join(dims.select("dim", "shards"), "dim").withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(max(1, -(-n_queries // block)))).cast("int")).select("dim", "block", "shards", "vec_id", "v").groupBy("dim", "block").applyInPandas(pack, "dim int, block int, shards int, ids binary, q binary")
    pairs = blocks.select("dim", "block", "ids", "q", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")).join(trees, ["dim", "shard"]).select("dim", "shard", "block", "ids", "q", "tree")
    hits = pairs.mapInPandas(search, "block int, place bigint, query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "block", "place").orderBy(F.desc("score"), "vec_id"))
    return hits.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
