"""Exact top-k search by inner product with a KD-tree per shard.

Shards are cells of a KD-tree over the whole table: median splits of a bounded sample, which decides
the work alone; a cell with too many rows, as of one repeated vector, is dealt out further. Each
shard has a tight bounding box, and its task builds a KD-tree of its rows by median splits with a
tight box for every node. The largest inner product that a box allows bounds what lies in it. A query
first searches the shard of the best bound; its k-th score goes along to the shards whose box can
still reach it, and to no others. In a tree it goes best first: the open node of the best bound is
next, an inner one opens its children, and the search ends when no open node reaches the k-th score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut

#: Rows of a shard and queries of a block, about; rows of a tree's leaf at most.
SHARD_ROWS, BLOCK_QUERIES, LEAF_ROWS = 4096, 1024, 128
#: Cells at most (their boxes are broadcast): larger tables have larger shards. Rows of the sample that the cells are cut from.
MAX_CELLS, SAMPLE = 4096, 50_000
#: Scores under this are exact in doubles and leave room for a row number in an int64.
SAFE_SCORE = 2**50
_OUT = "query long, vec_id long, score long"
_NOTHING = np.iinfo(np.int64).min


class Tree:
    """Nodes in breadth-first order; rows are reordered so that each node is a slice."""

    def __init__(self, x: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(x))
        self.spans, self.child = [(0, len(x))], []  # child: the first of two, or -1 for a leaf
        self.axis, self.cut = [], []
        los, his = [], []
        i = 0
        while i < len(self.spans):
            a, b = self.spans[i]
            part = x[self.order[a:b]]
            lo, hi = part.min(0), part.max(0)
            los.append(lo)
            his.append(hi)
            split = b - a > leaf_rows and bool((hi > lo).any())
            self.child.append(len(self.spans) if split else -1)
            axis = int((hi - lo).argmax()) if split else 0
            self.axis.append(axis)
            self.cut.append(0.0)
            if split:
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(part[:, axis], mid)]
                self.cut[i] = float(x[self.order[a + mid], axis])
                self.spans += [(a, a + mid), (a + mid, b)]
            i += 1
        self.lo, self.hi = np.array(los), np.array(his)

    def bound(self, q: np.ndarray, node: int) -> np.ndarray:
        """The largest inner product of each query with any point of the node's box."""
        return largest(q, self.lo[node], self.hi[node])

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The leaf whose part of space each row lies in."""
        at = np.zeros(len(x), np.int64)
        child, axis, cut_ = np.array(self.child), np.array(self.axis), np.array(self.cut)
        while (inner := child[at] >= 0).any():
            i = np.flatnonzero(inner)
            at[i] = child[at[i]] + (x[i, axis[at[i]]] >= cut_[at[i]])
        return at


def largest(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Bounds of the inner products of rows of q with the points of a box (or of boxes, given as rows)."""
    return np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T


def _exact(q: np.ndarray, x: np.ndarray, own: np.ndarray, wide: bool) -> np.ndarray:
    """Inner products as int64, but for those with the query's own rows; in Python's integers where doubles would round."""
    if not wide:
        return np.where(own, _NOTHING, np.rint(q @ x.T).astype(np.int64))
    scores = np.array([[int(v) for v in r] for r in q], object).reshape(q.shape) @ np.array([[int(v) for v in r] for r in x], object).reshape(x.shape).T
    scores = np.where(own, _NOTHING, scores)
    if any(abs(s) >= 2**63 for s in scores[~own]):
        raise OverflowError("an inner product does not fit into a long")
    return scores.astype(np.int64)


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k best rows of x that reach its score in least; ties to smaller ids."""
    dim = max(x.shape[1], q.shape[1])
    x, q = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (x, q))
    by_id = np.argsort(ids, kind="stable")
    ids, x, n = ids[by_id], x[by_id], len(ids)
    most = float(np.abs(x).max() * np.abs(q).max() * dim) if dim else 0.0
    wide = most * n >= SAFE_SCORE
    slack = 1e-12 * most  # more than bounds in doubles can be off
    tree = Tree(x)
    frontier = np.full((len(q), len(tree.spans)), -np.inf)
    frontier[:, 0] = tree.bound(q, 0) + slack
    scores, rows = np.full((len(q), k), _NOTHING, np.int64), np.full((len(q), k), -1, np.int64)
    kth = least.astype(float).copy()
    everyone = np.arange(len(q))
    while True:
        at = frontier.argmax(1)
        best = frontier[everyone, at]
        active = np.flatnonzero((best >= kth) & (best > -np.inf))
        if not len(active):
            break
        frontier[active, at[active]] = -np.inf
        for node in np.unique(at[active]):
            mine = active[at[active] == node]
            first = tree.child[node]
            if first >= 0:
                for child in (first, first + 1):
                    frontier[mine, child] = tree.bound(q[mine], child) + slack
                continue
            a, b = tree.spans[node]
            held = tree.order[a:b]
            new = _exact(q[mine], x[held], query_ids[mine][:, None] == ids[held][None, :], wide)
            both = np.concatenate([scores[mine], new], 1)
            whose = np.concatenate([rows[mine], np.broadcast_to(held, new.shape)], 1)
            if wide:
                top = np.lexsort((whose, np.negative(np.maximum(both, _NOTHING + 1))), axis=1)[:, :k]
            else:  # larger is better, ties to the smaller id
                top = np.argpartition(np.where(both > _NOTHING, both * n + (n - 1 - whose), _NOTHING), -k, axis=1)[:, -k:]
            scores[mine], rows[mine] = np.take_along_axis(both, top, 1), np.take_along_axis(whose, top, 1)
            low = scores[mine].min(1)
            kth[mine] = np.where(low > _NOTHING, np.maximum(kth[mine], low), kth[mine])
    row, col = np.nonzero((scores > _NOTHING) & (scores >= least[:, None]))
    return row, ids[rows[row, col]], scores[row, col]


def _matrix(vectors: pd.Series) -> np.ndarray:
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def integers(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * component), as doubles."""
    return F.transform(vector, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("double"))


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))


def _tall(frame: pd.DataFrame, name: str, dim: int) -> np.ndarray:
    x = _matrix(frame[name])
    return np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def top_k(vectors: DataFrame, is_query: Column, k: int, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, sample: int = SAMPLE) -> DataFrame:
    """The k rows of highest integer inner product for each query id: query_id, rank, vec_id, score.

    vectors: vec_id long, v array<double> of whole numbers; other columns, whatever their names, are
    ignored. is_query picks the query rows; every row of another id is a candidate. Rows without id or
    vector take no part. Repeated rows of an id are candidates each, and queries each, ranked together
    under their id. Vectors of different lengths are compared as if padded with zeros. Ties go to the
    smaller vec_id. Large components are multiplied exactly; an inner product beyond a long is an
    error. No query or candidate gives no row.
    """
    spark = vectors.sparkSession
    rows = cut(vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asks")), "vectors")
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    dim = max(dim, 1)
    # a share of the rows by hash, so about as many as wanted from any table
    share = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, n // sample))) == 0).select("v").limit(2 * sample).toPandas()
    some = _tall(share, "v", dim) if len(share) else np.zeros((1, dim))
    cells = min(MAX_CELLS, math.ceil(n / shard_rows))
    grid = spark.sparkContext.broadcast(Tree(some, max(1, math.ceil(len(some) / cells))))

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(grid.value.cells(_tall(pd.DataFrame({"v": v}), "v", dim)).astype(np.int32))

    placed = cut(rows.withColumn("cell", cell_of("v")), "cells")
    most = max(shard_rows, math.ceil(n / cells))
    names, first = [], 0
    for r in placed.groupBy("cell").agg(F.count("*").alias("rows")).orderBy("cell").collect():  # one row a cell
        parts = math.ceil(r.rows / (2 * most))
        names.append((r.cell, parts, first))
        first += parts
    named = F.broadcast(spark.createDataFrame(names, "cell int, parts int, first int"))
    shard = F.col("first") + F.pmod(F.xxhash64(F.monotonically_increasing_id()), "parts")
    rows = cut(placed.join(named, "cell").select("vec_id", "v", "asks", shard.cast("int").alias("shard")), "shards")

    def boxes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = _tall(frame, "v", dim)
            for shard, at in frame.groupby("shard").indices.items():
                yield pd.DataFrame({"shard": [shard], "lo": [x[at].min(0)], "hi": [x[at].max(0)]})

    lo, hi = np.full((first, dim), np.inf), np.full((first, dim), -np.inf)
    each = lambda c, f: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: f(F.transform(c, lambda a: F.get(a, i))))
    told = rows.select("shard", "v").mapInPandas(boxes, "shard int, lo array<double>, hi array<double>").groupBy("shard", F.spark_partition_id().alias("task"))
    told = told.agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")).select("shard", each(F.col("lo"), F.array_min).alias("lo"), each(F.col("hi"), F.array_max).alias("hi"))
    for r in told.toLocalIterator():
        lo[r.shard], hi[r.shard] = np.minimum(lo[r.shard], r.lo), np.maximum(hi[r.shard], r.hi)
    lo, hi = np.where(np.isfinite(lo), lo, 0), np.where(np.isfinite(hi), hi, 0)
    return _searched(rows, lo, hi, dim, k, block_queries)


def _searched(rows: DataFrame, lo: np.ndarray, hi: np.ndarray, dim: int, k: int, block_queries: int) -> DataFrame:
    """top_k() of rows (vec_id, v, asks, shard), shards having these boxes."""
    on_all = rows.sparkSession.sparkContext.broadcast((lo, hi))

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "vec_id": [], "score": []}).astype("int64")
        least = right["least"].fillna(-np.inf).to_numpy(float)
        row, ids, score = search(left["vec_id"].to_numpy(), _tall(left, "v", dim), right["query_id"].to_numpy(), _tall(right, "qv", dim), k, least)
        return pd.DataFrame({"query": right["query"].to_numpy()[row], "vec_id": ids, "score": score})

    def wave(asked: DataFrame) -> DataFrame:
        """Searches asked (query, query_id, qv, least, shard): a shard's candidates go to as many blocks as its queries fill."""
        load = cut(asked.groupBy("shard").agg(F.ceil(F.count("*") / block_queries).alias("blocks")), "load")  # one row a shard
        mine = asked.join(F.broadcast(load), "shard").withColumn("block", F.pmod(F.xxhash64("query"), "blocks"))
        there = rows.join(F.broadcast(load), "shard").select("vec_id", "v", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        return there.groupBy("shard", "block").cogroup(mine.groupBy("shard", "block")).applyInPandas(one, _OUT)

    @F.pandas_udf("int")
    def home_of(v: pd.Series) -> pd.Series:
        lo, hi = on_all.value
        return pd.Series(largest(_tall(pd.DataFrame({"v": v}), "v", dim), lo, hi).argmax(1).astype(np.int32))

    @F.pandas_udf("array<int>")
    def others_of(v: pd.Series, least: pd.Series, home: pd.Series) -> pd.Series:
        lo, hi = on_all.value
        q = _tall(pd.DataFrame({"v": v}), "v", dim)
        slack = 1e-12 * dim * np.abs(q).max(initial=0) * max(np.abs(lo).max(), np.abs(hi).max())
        good = largest(q, lo, hi) + slack >= least.fillna(-np.inf).to_numpy()[:, None]
        good[np.arange(len(q)), home] = False
        return pd.Series([np.flatnonzero(g).astype(np.int32) for g in good])

    queries = rows.where("asks").select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    queries = cut(queries.withColumn("home", home_of("qv")), "queries")
    first = cut(wave(queries.select("query", "query_id", "qv", F.lit(None).cast("double").alias("least"), F.col("home").alias("shard"))), "first")
    kth = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("least"))
    rest = queries.join(kth, "query", "left").select("query", "query_id", "qv", "least", F.explode(others_of("qv", "least", "home")).alias("shard"))
    found = first.unionByName(wave(cut(rest, "rest")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    named = found.join(queries.select("query", "query_id"), "query")
    return named.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
