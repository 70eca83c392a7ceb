import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import knn, queries


def brute_force(rows, k, is_query):
    rows, out = [r for r in rows if r[0] is not None and r[1] is not None], []
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))  # noqa: B905, E731
    for q in {i for i, _ in rows if is_query(i)}:
        best = sorted((-dot(own, v), i) for j, own in rows if j == q for i, v in rows if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_equals_brute_force_with_ties_repeats_and_nulls(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-4, 5)) for _ in range(6)]) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(350)] + [rows[4], rows[4], (20, [1.0]), (20, [3.0, 1.0]), (3, [5.0]), (3, [9.0]), (None, [1.0]), (5000, None), (40, [])]
    frame = spark.createDataFrame(rows, "vec_id long, v array<double>").withColumns({"query_id": F.lit("x"), "shard": F.lit(1), "asks": F.lit(2), "score": F.lit(None)})
    want = brute_force(rows, 7, lambda i: i % 20 == 0)
    for settings in ({"shard_rows": 100, "block_queries": 16}, {"shard_rows": 100, "sample": 30}, {}):
        assert sorted(map(tuple, knn.top_k(frame, F.col("vec_id") % 20 == 0, 7, **settings).collect())) == want
    assert knn.top_k(frame.limit(0), F.col("vec_id") % 20 == 0, 7).collect() == []
    few = knn.top_k(frame.where("vec_id in (21, 22, 60)"), F.col("vec_id") == 60, 7)
    assert [r.rank for r in few.orderBy("rank").collect()] == [1, 2]


def test_queries_go_only_where_a_box_reaches(monkeypatch):
    # two far clusters: the tree of the far one is not opened
    x = np.array([[1000.0 + i % 9, i % 7] for i in range(600)] + [[-1000.0 - i % 9, i % 5] for i in range(600)])
    opened = []
    bound = knn.Tree.bound
    monkeypatch.setattr(knn.Tree, "bound", lambda self, q, node: (opened.append(node), bound(self, q, node))[1])
    row, ids, score = knn.search(np.arange(1200), x, np.array([0]), x[:1], 5, np.array([-np.inf]))
    assert sorted(score.tolist(), reverse=True) == sorted((int(x[0] @ v) for v in x[1:]), reverse=True)[:5]
    assert len(opened) < len(knn.Tree(x).spans)


def test_huge_components(spark):
    rows = [(20, [2.0**40, 1.0]), (1, [2.0**22, 1.0]), (2, [2.0**20, 3.0]), (3, [2.0**20, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = knn.top_k(frame, F.col("vec_id") == 20, 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**62 + 1), (2, 2**60 + 3)]
    with pytest.raises(Exception, match="does not fit into a long"):
        knn.top_k(frame.unionByName(spark.createDataFrame([(9, [2.0**30])], frame.schema)), F.col("vec_id") == 20, 2).collect()


def test_query_leaves_out_unusable_vectors(spark, sf_dir, tmp_path):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    extra = spark.createDataFrame([(100000, None, 1), (100020, [float("nan")] * 64, 1), (100040, [None] + [1.0] * 63, 1), (100060, [float("inf")] * 64, 1)], frame.schema)
    frame.unionByName(extra).write.parquet(f"{tmp_path}/embeddings.parquet")
    a, b = (sorted(map(tuple, queries.op5_exact_topk(spark, d).collect())) for d in (sf_dir, str(tmp_path)))
    assert a == b and a
