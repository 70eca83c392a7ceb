import numpy as np

from millrace.llm import langid, queries


def test_codebook_keeps_codewords_apart():
    for n in (2, 3, 7, 30, 200):
        book = langid.codebook(n)
        apart = (book.shape[1] - book @ book.T) / 2
        assert book.shape[0] == n and apart[~np.eye(n, dtype=bool)].min() >= (1 if n == 2 else 2)


def test_held_out_accuracy(spark, sf_dir):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = [r for r in queries.op7_language_id(spark, sf_dir).collect()]
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out and len(truth[r.doc_id].text) > 200]
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def plain_features(text):
    m, letters = 2**32 - 1, []
    for c in text.lower():
        if c.isalpha():
            letters.append(ord(c))
        elif not letters or letters[-1] != 32:
            letters.append(32)
    a = [32, *letters, 32]
    mixed = lambda h: ((h ^ h >> 15) * 0x2C1B3C6D & m) >> (32 - langid.FEATURE_BITS)
    two = [(x * 0x9E3779B1 + y * 0x85EBCA77) & m for x, y in zip(a, a[1:], strict=False)]
    three = [(t * 0xC2B2AE3D + z * 0x27D4EB2F + 0x165667B1) & m for t, z in zip(two, a[2:], strict=False)]
    return [mixed(h) for h in two + three]


def test_counts_weights_and_decoding_equal_a_plain_model(spark):
    rng = np.random.default_rng(1)
    words = {l: ["".join(rng.choice(list(x), 4)) for _ in range(40)] for l, x in (("aa", "abcdeé"), ("bb", "cdefg"), ("cc", "fghij"), ("dd", "aeiou"))}
    rows = [(i, " ".join(rng.choice(words[l], 12)) + rng.choice(["", " 7!", ", X"]), l) for i, l in enumerate(rng.choice(list(words), 120))]
    rows += [rows[0], (500, "dcba " * 60_000, "bb"), (501, " ".join(words["aa"][:9] + words["dd"][:9]), None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame)
    share = {l: np.full(2**langid.FEATURE_BITS, 0.5) for l in words}
    for _, t, l in rows:
        for f in plain_features(t) if l else []:
            share[l][f] += 1
    share = {l: x / x.sum() for l, x in share.items()}
    weight = []
    for bit in range(model.book.shape[1]):
        up, down = ([share[l] for l, c in zip(sorted(words), model.book[:, bit], strict=True) if c == sign] for sign in (1, -1))
        w = np.log(np.mean(up, 0)) - np.log(np.mean(down, 0))
        typical = [c * float(share[l] @ w) for l, c in zip(sorted(words), model.book[:, bit], strict=True)]
        weight.append((w * langid.SHARPNESS / np.mean(np.abs(typical)), min(max(min(typical) / np.mean(np.abs(typical)), 0.05), 1.0)))
    got = langid.predict(frame, model).collect()
    for r in got:
        f = plain_features(r.text)
        margins = [np.mean([w[i] for i in f]) for w, _ in weight]
        loss = [sum(reliable * np.log1p(np.exp(-c * x)) for c, x, (_, reliable) in zip(code, margins, weight, strict=True)) for code in model.book]
        assert r.lang_pred == sorted(words)[int(np.argmin(loss))]
        assert abs(r.lang_score - 1 / sum(np.exp(min(loss) - x) for x in loss)) < 1e-3
        assert r.lang_ambiguous == (sorted(loss)[1] - min(loss) < langid.AMBIGUOUS_LOSS)


def test_sample_is_bounded(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "concat('der ', id) as text", "'de' as lang")
    assert langid.fit(rows, train_docs=100).langs == ["de"] and langid.fit(rows.limit(0)).langs == []


def test_nulls_no_letters_and_nothing_learned(spark):
    rows = spark.createDataFrame([(1, "the cat sat on the mat", "en", 1.0), (2, None, "en", 2.0), (3, "12 !?", None, 3.0), (4, "der Hund und die Katze", "de", 4.0), (None, "the dog", None, 5.0), (6, "", "fr", 6.0)], "doc_id long, text string, lang string, lang_score double")
    model = langid.fit(rows)
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.predict(rows, model).collect()}
    assert got[1][0] == "en" and got[4][0] == "de" and got[None][0] == "en"
    assert got[2] == got[3] == got[6] == ("und", 0.0)
    nothing = langid.fit(rows.limit(0))
    assert {r.lang_pred for r in langid.predict(rows, nothing).collect()} == {"und"}
    one = langid.fit(rows.where("lang = 'en'"))
    assert {r.doc_id: r.lang_pred for r in langid.predict(rows, one).collect()}[4] == "en"
    assert langid.predict(rows.limit(0), model).collect() == []
