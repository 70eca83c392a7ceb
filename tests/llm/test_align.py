import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import align, queries
from millrace.llm.common import cut

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "   ", "\n\n  a", "a ", "a  ", " a", "x\ny\t z \n", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <s></s><unk>", "aaaaaaaaaaaaaaaa" * 50, "it's WE'LL don't I'Ve", "été ½ ² ³ x²y ﬁ Å",
    "日本語 テキスト 12３", "\x1c\x1d a\x85b\xa0c", "emoji 👩‍👩‍👧 ok", "tab▁le ▁", "▁", "٣٤ arabic ٥", "…—“”", "x" * 3000, "\x00 nul", "the same the same",
]


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def token_bytes(libraries):
    t, s = libraries
    letters = align.byte_letters()
    a = {i: bytes(letters.index(c) for c in x) for x, i in t.get_vocab().items() if x != "<|endoftext|>"}
    pieces = [s.id_to_piece(i) for i in range(s.get_piece_size())]
    b = [bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return a, b


def plain(texts, libraries):
    """Groups of each text by walking both token lists byte by byte, whole texts encoded by the libraries."""
    t, s = libraries
    a_bytes, b_bytes = token_bytes(libraries)
    out = []
    for text in texts:
        if not text:
            out.append([])
            continue
        a, b = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
        whole = (" " + text).encode()
        if b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            out.append([])
            continue
        end_a, end_b, at = {}, {}, 0
        for n, i in enumerate(a):
            at += len(a_bytes[i])
            end_a[at] = n + 1
        at = 0
        for n, i in enumerate(b):
            at += len(b_bytes[i])
            end_b[at] = n + 1
        groups, x, y = [], 0, 0
        for end in sorted(end_a.keys() & end_b.keys()):
            groups.append((a[x : end_a[end]], b[y : end_b[end]]))
            x, y = end_a[end], end_b[end]
        out.append(groups)
    return out


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def expected(texts, libraries):
    """The contract's columns but doc_id, from Counters."""
    groups = plain(texts, libraries)
    links = [Counter((i, j) for a, b in g for i in a for j in b) for g in groups]
    docs = Counter(k for c in links for k in c)
    highest = {}
    for (i, _), n in docs.items():
        highest[i] = max(n, highest.get(i, 0))
    return [
        (
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), c.total(), sum(n for k, n in c.items() if docs[k] == highest[k[0]]), sum(n * docs[k] for k, n in c.items()),
            hashlib.sha256(written(g).encode()).hexdigest() if g else "",
        )
        for g, c in zip(groups, links, strict=True)
    ]


def noise(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab cdeé\n'1 st<|>½日 ▁ ﬁ😀  the of") for _ in range(rng.randrange(80))) for _ in range(n)]


def test_groups_equal_whole_texts_walked_byte_by_byte(libraries):
    texts = ODD + noise(1500)
    made = align.Aligner(A, B).batch(texts)
    want = plain(texts, libraries)
    assert made["groups"].to_pylist() == [written(g) for g in want]
    assert made["n_groups"].to_pylist() == [len(g) for g in want]
    for held, times, g in zip(made["links"].to_pylist(), made["times"].to_pylist(), want, strict=True):
        assert dict(zip(held, times, strict=True)) == Counter(i << align.ID_BITS | j for a, b in g for i in a for j in b)


def test_memories_that_run_over_change_nothing(libraries, monkeypatch):
    monkeypatch.setattr(align, "REMEMBERED", 40)
    monkeypatch.setattr(align, "LONG", 4)
    made, texts = align.Aligner(A, B), ODD + noise(300, 2)
    got = [x for i in range(0, len(texts), 20) for x in made.batch(texts[i : i + 20])["groups"].to_pylist()]
    assert got == [written(g) for g in plain(texts, libraries)]


def test_query_equals_counters(spark, sf_dir, libraries):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = [(r.doc_id, *x) for r, x in zip(docs, expected([r.text for r in docs], libraries), strict=True)]
    got = queries.op13_token_alignment(spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("most", [0, 5, 50, 10**6])
def test_links_beyond_the_head_are_joined(spark, libraries, most):
    texts = ODD + ["the same the same", "the cat", "the cat sat"] * 3 + noise(60, 3)
    docs = spark.createDataFrame([(i // 2 if i % 5 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, links string")
    rows = cut(align.aligned(docs, A, B).withColumn("_row", F.monotonically_increasing_id()), "test")
    assert rows.columns == ["doc_id", "text", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "times", "_row"]
    got = align.with_counts(rows, cut(align.link_counts(rows), "test"), most)
    rows = [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") for r in got.collect()]
    assert sorted(rows) == sorted(expected(texts, libraries))


def test_empty_table_and_table_without_tokens(spark, tmp_path):
    for name, rows in (("empty", []), ("silent", [(1, None), (None, ""), (1, "▁")])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = queries.op13_token_alignment(spark, f"{tmp_path}/{name}").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(((i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows), key=repr)


def test_windows_whose_hashes_meet_are_told_apart(libraries, monkeypatch):
    hashes = align.window_hashes
    monkeypatch.setattr(align, "window_hashes", lambda *a: hashes(*a) % 5)
    made, texts = align.Aligner(A, B), ODD + noise(200, 4)
    got = [x for i in range(0, len(texts), 50) for x in made.batch(texts[i : i + 50])["groups"].to_pylist()]
    assert got == [written(g) for g in plain(texts, libraries)]
