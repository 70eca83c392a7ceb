import corpus_pipeline
import test_linededup
import test_neardup
from test_bpe import reference

from millrace.llm import decontam


def brute_force(docs, items):
    docs = [(d, t) for d, t in docs if t and any(c.isalpha() for c in t)]
    test_linededup.hash_order.update({t: 0 for _, t in docs})
    removed = test_linededup.brute_force(docs, 50)
    clean = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in removed[d, t])) for d, t in docs]
    clean = [(d, t) for d, t in clean if t.strip() or not removed[d, dict(docs)[d]]]
    kept = {d for d, _, _, k in test_neardup.brute_force(clean) if k}
    tests = [decontam.sequence(t, decontam.FoldedWords()) for _, t in items]
    free = []
    for d, t in clean:
        w = decontam.sequence(t, decontam.FoldedWords())
        if d in kept and not any(decontam.enough(decontam.best_place(x, w)[0], len(x)) for x in tests):
            free.append((d, t))
    ids, decoded = reference([t for _, t in free])
    return {d: (len(i), i, x) for (d, _), i, x in zip(free, ids, decoded, strict=True)}


def test_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_tokens, r.token_ids, r.decoded_text) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    want = brute_force(docs, items)
    assert got.keys() == want.keys() and got == want and len(got) < len(docs)


def test_odd_rows(spark, sf_dir, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words here", None, "s", 5), (3, "one two three four five six", "en", None, 9), (3, "one two three four five six", "en", None, 9), (4, "One two three four five six", "en", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as token_ids", "1 as kept").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id or 0, r.decoded_text, r.lang) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == [(0, "some words here", "en"), (3, "one two three four five six", "en")]


def test_near_dedup_keeps_one_row_of_a_group(spark, sf_dir):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (1, text + " x", "en", "s", 2), (2, text + " y", "en", "s", 3), (None, text + " z", "en", "s", 4), (None, "other words", "en", "s", 5), (None, "other words", "en", "s", 5), (None, None, "en", "s", 6), (3, "", "en", "s", 7), (4, " ", "en", "s", 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.n_chars) for r in corpus_pipeline.near_dedup(spark, frame, sf_dir).collect())
    assert [x for x in got if x[1] > 2] == [(0, 5), (0, 6), (3, 7), (4, 8)] and len(got) == 5
