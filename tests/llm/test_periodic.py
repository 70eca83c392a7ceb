import hashlib
import random
import re
import zlib

import pytest

from millrace.llm import periodic, queries


def plain_runs(w, min_words=24, min_periods=3):
    """Every period tried on every word: the longest stretches whose words stand again a period on."""
    found = {}
    for q in range(1, len(w) // min_periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(min_words, min_periods * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def made_up(rng, letters):
    w = []
    for _ in range(rng.randrange(1, 12)):
        w += [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(1, 9))] * rng.choice([1, 1, 2, 5, 9])
    return w


@pytest.mark.parametrize(("min_words", "min_periods"), [(24, 3), (6, 2), (5, 3), (8, 4), (2, 2), (30, 5)])
def test_runs_equal_a_search_by_period(min_words, min_periods):
    rng = random.Random(min_words)
    docs = [made_up(rng, rng.choice([1, 2, 3, 8])) for _ in range(300)] + [[], [b"a"], [b"a"] * 24, [b"a"] * 23]
    assert periodic.runs(docs, min_words, min_periods) == [plain_runs(d, min_words, min_periods) for d in docs]


def test_fewest_shared_words():
    assert [periodic.least_match(*x) for x in ((24, 3), (6, 2), (2, 2))] == [16, 3, 1]
    assert all(m + d < 24 or m < 2 * d for m in range(16) for d in range(1, 60))


def test_long_documents_of_one_word_or_many_runs_of_it():
    many = sum(([b"s%d" % i] + [b"a"] * 100 for i in range(300)), [])
    passages = sum(([b"s%d" % i] + [b"p%d" % k for k in range(40)] for i in range(1000)), [])
    assert periodic.runs([[b"a"] * 50_000, many, passages]) == [[(0, 50_000, 1)], [(1 + 101 * i, 100, 1) for i in range(300)], []]


def digest(x):
    return hashlib.sha256(x).hexdigest()


def expected(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(w) if len(w) < 3000 else periodic.runs([w])[0]
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        digest(b"".join(b"%d,%d,%d\n" % r for r in found)), digest(b" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_a_plain_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = queries.op11_periodic_runs(spark, sf_dir)
    assert got.columns == COLUMNS and all(t == "bigint" for c, t in got.dtypes if c not in COLUMNS[6:])
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(expected(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in rows) > len(rows) / 20


def test_odd_rows_clashing_columns_and_empty_tables(spark, tmp_path):
    tenth = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = [None, "", " \n", "a", "x y " * 40, "\x85a\xa0b " * 30, " lead  and\ttail \n" * 9, "A a " * 20, "word " * 23]
    rows = [(None, t) for t in texts] + [(i, t) for i in tenth[: len(texts)] for t in texts] + [(1, "a b " * 30)] * 3
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((expected(*r) for r in rows), key=repr)
    clash = spark.createDataFrame([("a b " * 30, 5, "k")], "text string, runs int, top_run string")
    found = periodic.with_runs(clash)
    assert found.columns == ["text", "n_words", "runs", "top_run", "collapsed"]
    assert found.first()[1:] == (60, [(0, 60, 2)], (0, 60, 2), "a b")
    assert periodic.with_runs(clash.limit(0)).collect() == []
