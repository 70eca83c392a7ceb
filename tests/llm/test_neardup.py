import random

import numpy as np

from millrace.llm import neardup


def brute_force(docs):
    sets = []
    for _, t in docs:
        w = t.encode().lower().split() if t else []
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(docs))


def test_sketches_fill_and_agree_like_the_similarity():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 40, 1000):
        s = neardup.sketch(rng.integers(0, 2**63, n).astype(np.uint64))
        assert len(s) == neardup.SIZE and (s < np.iinfo(np.uint64).max).all()
    same = []
    for _ in range(40):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        same.append((neardup.sketch(pool[:300]) == neardup.sketch(pool[100:])).mean())
    assert abs(np.mean(same) - 0.5) < 0.03


def test_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    docs = []
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.randrange(1, 8)):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            docs.append((rng.randrange(10**6), " ".join(words)))
    docs += [(5, None), (6, ""), (7, " \n"), (8, "One two"), (9, "one  TWO"), (3, "É x"), (4, "é x")]
    docs = list(dict(docs).items())
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as kept", "'x' as digest")
    got = sorted(map(tuple, neardup.groups(frame).collect()))
    assert got == brute_force(docs)


def test_equals_sql(spark, sf_dir, same_as_sql):
    same_as_sql("op6_near_dedup", sf_dir)


def near_copies(n, words, changes, seed=1, vocab=3000):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(vocab)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(changes):
            w[rng.randrange(words)] = f"v{rng.randrange(vocab)}"
        out.append((i + 1, " ".join(w)))
    return out


def test_large_group_of_near_copies(spark):
    # most copies are near the hub, many are not, and link among themselves by common passages
    docs = near_copies(250, 60, 2) + [(d + 1000, t) for d, t in near_copies(250, 60, 3)]
    rng = random.Random(2)
    base = near_copies(1, 200, 0, seed=5)[0][1].split()
    docs += [(2000 + i, " ".join(base[a : a + 120])) for i, a in enumerate(rng.choices(range(80), k=60))]
    got = sorted(map(tuple, neardup.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert got == brute_force(docs)


def test_links_are_walked_through_once(spark, monkeypatch):
    walked, whole = [], neardup.components

    def told(links):
        walked.append({(r.a, r.b) for r in links.collect()})
        return whole(links)

    monkeypatch.setattr(neardup, "components", told)
    base = near_copies(1, 200, 0, seed=5)[0][1].split()
    docs = near_copies(120, 60, 2) + [(2000 + i, " ".join(base[a : a + 120])) for i, a in enumerate(random.Random(2).choices(range(80), k=60))]
    assert sorted(map(tuple, neardup.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect())) == brute_force(docs)
    assert len(walked) > 1 and sum(map(len, walked)) == len(set().union(*walked))


def test_one_doc_id_with_different_texts(spark):
    a, b = near_copies(1, 80, 0, seed=3)[0][1], near_copies(1, 80, 0, seed=4)[0][1]
    rows = [(1, a + " x"), (5, a), (5, b), (9, b + " y")]
    for order in (rows, rows[::-1]):
        got = sorted((r.doc_id, r.component_id) for r in neardup.groups(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect())
        assert got == [(1, 1), (5, 1), (5, 5), (9, 5)]


def test_sets_of_many_classes_and_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FILTER_BITS", 4)  # too few bits for any table: rows are joined
    docs = near_copies(12, 60, 1) + [(50, "a b c " * 60_000), (51, "a b c " * 60_001), (52, " ".join(f"w{i}" for i in range(40_000))), (53, " ".join(f"w{i}" for i in range(40_100)))]
    got = sorted(map(tuple, neardup.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert got == brute_force(docs)


def test_repeated_null_and_missing_rows(spark):
    frame = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "z"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.groups(frame).collect())
    assert got == [(0, 0, True), (0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True)]
    none = spark.createDataFrame([(None, "a b c"), (None, "a  b c"), (None, "z")], "doc_id long, text string")
    assert sorted((r.component_id, r.kept) for r in neardup.groups(none).collect()) == [(None, True)] * 3
    assert neardup.kept_rows(none).count() == 2
    assert neardup.groups(frame.limit(0)).collect() == []


def test_two_classes_meet_once_at_a_shingle(spark):
    rng = random.Random(9)
    base = [rng.randrange(2**40) for _ in range(200)]
    sets = {i: sorted(set(base[: 200 - rng.randrange(60)]) | {rng.randrange(2**40) for _ in range(rng.randrange(40))}) for i in range(30)}
    frame = spark.createDataFrame(list(sets.items()), "cls long, shingles array<long>").cache()
    keys = neardup.meeting_keys(frame.select("cls"), frame).collect()
    by_key = {}
    for r in keys:
        by_key.setdefault(r.key, []).append(r)
    met = {}
    for rows in by_key.values():
        for x in rows:
            for y in rows:
                if x.cls < y.cls and x.own == y.its and y.own == x.its:
                    met[x.cls, y.cls] = met.get((x.cls, y.cls), 0) + 1
    for x in sets:
        for y in sets:
            common = len(set(sets[x]) & set(sets[y]))
            if x < y:
                assert met.get((x, y), 0) <= common  # nearly thrice as often before
                assert 100 * common < 75 * len(set(sets[x]) | set(sets[y])) or (x, y) in met
