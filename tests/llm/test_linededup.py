import random

from millrace.llm import linededup, queries


def brute_force(docs, min_words):
    """{(doc_id, text): removed positions} from every repeated run, straight from the definition."""
    seqs = {}
    for doc_id, text in docs:
        if text is not None:
            seqs[doc_id, text] = [(i, x, len(x.split())) for i, x in enumerate(text.split("\n")) if x.split()]
    order = sorted(seqs, key=lambda k: (k[0] is not None, k[0] or 0, hash_order[k[1]]))
    seen, out = set(), {k: set() for k in seqs}
    for key in order:
        s = seqs[key]
        for a in range(len(s)):
            n = 0
            for b in range(a, len(s)):
                n += s[b][2]
                if n >= min_words:
                    run = tuple(x for _, x, _ in s[a : b + 1])
                    if run in seen:
                        out[key] |= {i for i, _, _ in s[a : b + 1]}
                    seen.add(run)
    return {k: sorted(v) for k, v in out.items()}


hash_order = {}


def compare(spark, docs, min_words):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    hash_order.update({r.text: r.h for r in frame.selectExpr("text", "xxhash64(text) h").distinct().collect()})
    want = brute_force(docs, min_words)
    got = linededup.dedup(frame.withColumnRenamed("doc_id", "doc_id").selectExpr("doc_id", "text", "text as old", "1 as removed_lines"), min_words).collect()
    assert len(got) == len(docs)
    for r in got:
        assert list(r.removed_lines) == (want[r.doc_id, r.old] if r.old is not None else []), (r, want.get((r.doc_id, r.old)))
        assert r.text == (None if r.old is None else "\n".join(x for i, x in enumerate(r.old.split("\n")) if i not in r.removed_lines))


def test_random_line_sequences_equal_brute_force(spark):
    rng = random.Random(5)
    lines = ["a", "b c", "d e f", "", "g g g g g", "h " * 9, "  "]
    docs = [(i if rng.random() < 0.95 else None, "\n".join(rng.choice(lines) for _ in range(rng.randrange(14)))) for i in range(60)]
    docs += [(100, "\n".join(["x y"] * 40)), (101, "\n".join(["x y"] * 33)), (7, None), docs[3], docs[3], (200, ""), (201, "one\ntwo")]
    compare(spark, list(dict.fromkeys(docs)) + [docs[3]], 6)
    compare(spark, list(dict.fromkeys(docs)), 20)


def test_a_window_over_a_unique_pair_is_no_copy(spark):
    a, b, c, x = "a a", "b b", "c c", "x x"
    docs = [(1, "\n".join([a, b, c])), (2, "\n".join([a, b, x, b, c])), (3, x), (4, "\n".join([a, b, c]))]
    compare(spark, docs, 6)
    rng = random.Random(7)
    compare(spark, [(i, "\n".join(rng.choice([a, b, c, x, "y y"]) for _ in range(rng.randrange(3, 12)))) for i in range(40)], 8)


def test_nothing_to_do(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert linededup.dedup(empty).collect() == []
    assert linededup.dedup(empty).columns == ["doc_id", "text", "lang", "removed_lines"]


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    hash_order.update({t: 0 for _, t in docs})
    want = brute_force(docs, linededup.MIN_WORDS)
    got = queries.op4_line_dedup(spark, sf_dir).collect()
    text = dict(docs)
    assert {r.doc_id: list(r.removed_lines) for r in got} == {k[0]: v for k, v in want.items()}
    assert any(r.removed_lines for r in got) and all(text[r.doc_id] == r.text for r in got if not r.removed_lines)
