import math
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import lm, queries


def tokens(text):
    return [*(text.encode().lower().split() if text else []), lm.END]


def test_base_scores_counts_and_held_out_gain(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {d: crc32(str(d).encode()) % 7 == 2 for d in docs}
    counts = Counter(t for d, x in docs.items() if not held[d] for t in tokens(x))
    total, distinct = sum(counts.values()), len(counts)
    got = queries.op1_maxent_lm(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        t = tokens(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(x in counts for x in t), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in t), rel_tol=1e-9)
        assert r.score < 0
    gain = {h: np.sum([r.score - r.base_score for r in got if r.held_out == h]) for h in (False, True)}
    assert gain[False] > 0 and gain[True] > 0


class Plain:
    """The model token by token, with its weights."""

    def __init__(self, model, counts):
        self.m, self.counts, s = model, counts, model.sizes
        own = dict(zip(map(tuple, model.heavy_keys.tolist()), model.heavy_outputs.tolist(), strict=True))
        self.out, self.shares = {}, {}
        self.rare, self.kinds = Counter(), Counter()
        self.own = own
        for t, c in counts.items():
            o = self.output(t)
            if o >= s.frequent:
                self.rare[o] += c
                self.kinds[o] += 1

    def output(self, t):
        (k,), (k2,), (suffix,) = (x.tolist() for x in lm.token_keys([t]))
        o = self.own.get((k, k2), -1)
        return o if o >= 0 else self.m.sizes.frequent + suffix % self.m.sizes.rare

    def features(self, second, last, cls):
        s = self.m.sizes
        context = np.array([second * (s.outputs + 1) + last])
        f = lm.class_features(s, context)
        f |= lm.inside_features(s, context, np.array([cls]))
        return {t: int(x[0]) for t, x in f.items()}

    def shares_of(self, second, last, cls, weights):
        f = self.features(second, last, cls)
        upper = self.m.class_bias.astype(float) + sum(weights[t][f[t]] for t in ("last", "second", "pair"))
        lower = self.m.inside_bias[cls].astype(float) + sum(weights[t][f[t]] for t in ("inside_last", "inside_second"))
        return f, np.exp(upper) / np.exp(upper).sum(), np.exp(lower) / np.exp(lower).sum()

    def walk(self, text):
        seen = [self.m.sizes.outputs] * 2
        for t in tokens(text):
            o = self.output(t)
            yield t, seen[-2], seen[-1], o
            seen.append(o)

    def score(self, text):
        width, total = self.m.sizes.classes, 0.0
        for t, second, last, o in self.walk(text):
            _, upper, lower = self.shares_of(second, last, o // width, self.m.weights)
            total += math.log10(upper[o // width] * lower[o % width])
            if o >= self.m.sizes.frequent:
                total += math.log10((self.counts[t] + 1) / (self.rare[o] + self.kinds[o] + 1))
        return total

    def trained(self, texts, rounds):
        """Weights after gradient rounds, each table's row summed token by token."""
        width = self.m.sizes.classes
        weights = {t: np.zeros(w.shape) for t, w in self.m.weights.items()}
        for _ in range(rounds):
            seen, told = ({t: np.zeros(w.shape) for t, w in weights.items()} for _ in range(2))
            for text in texts:
                for _, second, last, o in self.walk(text):
                    f, upper, lower = self.shares_of(second, last, o // width, weights)
                    for t, row in f.items():
                        inside = t.startswith("inside")
                        told[t][row] += lower if inside else upper
                        seen[t][row][o % width if inside else o // width] += 1
            for t, w in weights.items():
                damp = lm.DAMP * told[t] / np.maximum(told[t].sum(1, keepdims=True), 1e-9) + 1e-9
                w += (1 / 2 if t.startswith("inside") else 1 / 3) * np.log((seen[t] + damp) / (told[t] + damp))
        return weights


ROWS = [(i, " ".join("abc"[(i * j) % 3] * (j % 4 + 1) for j in range(i % 40))) for i in range(80)] + [(200, None), (None, "a b"), (201, ""), (7, "a b"), (202, "unseen words"), (203, " ".join(f"x{i % 9}" for i in range(3000)))]


def model_of(spark, rows=ROWS, rounds=lm.ROUNDS):
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as score", "5 as outs", "6 as learn")
    scored, model = lm.score_documents(frame, F.col("doc_id") < 60, rounds)
    return scored, model, Counter(t for d, x in rows if d is not None and d < 60 for t in tokens(x))


def test_scores_are_those_of_the_plain_model(spark):
    scored, model, counts = model_of(spark)
    plain = Plain(model, counts)
    got = scored.collect()
    assert Counter((r.doc_id, round(r.score, 3)) for r in got) == Counter((d, round(plain.score(x), 3)) for d, x in ROWS)
    assert scored.columns == ["doc_id", "n_tokens", "n_known", "base_score", "score", "train_tokens"]


def test_training_is_that_of_the_plain_model(spark):
    _, model, counts = model_of(spark, rounds=2)
    want = Plain(model, counts).trained([x for d, x in ROWS if d is not None and d < 60], 2)
    for t, w in want.items():
        assert np.allclose(model.weights[t], w, atol=2e-4), t
        assert np.abs(w).max() > 0.1


def test_joined_counts_and_ties(spark, monkeypatch, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    whole = lm.prepare(docs)
    monkeypatch.setattr(lm, "HEAVY", 10)  # all other counts are joined; all tokens of one count are held or none
    scored, model = lm.score_documents(docs, F.lit(True))
    counts = Counter(t for r in docs.collect() for t in tokens(r.text))
    assert 0 < len(model.heavy_keys) <= 10 < len(whole.heavy_keys) and model.counts.count() == len(counts) - len(model.heavy_keys)
    plain, total = Plain(model, counts), sum(counts.values()) + len(counts) + 1
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in scored.collect():
        t = tokens(texts[r.doc_id])
        assert r.n_known == len(t) and math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / total) for x in t), rel_tol=1e-9)
        if len(t) < 400:
            assert math.isclose(r.score, plain.score(texts[r.doc_id]), rel_tol=1e-4)


def test_sizes_grow():
    sizes = [lm.sizes_for(n) for n in (0, 10**5, 10**7, 10**9, 10**13)]
    assert [s.outputs for s in sizes] == sorted(s.outputs for s in sizes) and sizes[0].outputs < sizes[3].outputs
    assert all(s.frequent + s.rare == s.outputs for s in sizes)


def test_nothing_to_learn_from_or_score(spark):
    frame = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    scored, _ = lm.score_documents(frame, F.lit(False))
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in scored.collect())
    assert lm.score_documents(frame.limit(0), F.lit(True))[0].collect() == []


def test_chunks_do_not_change_contexts(spark, monkeypatch):
    frame = spark.createDataFrame([([i % 7 for i in range(n)],) for n in (1, 2, 500, 7)], "outs array<int>").coalesce(1)
    told = lambda: sorted(map(tuple, lm.contexts(frame, 8).collect()))
    whole = told()
    assert sum(x[2] for x in whole) == 510
    monkeypatch.setattr(lm, "CHUNK", 64)
    monkeypatch.setattr(lm, "CONTEXTS", 5)
    assert told() == whole
