import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from millrace.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n  a", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "aaaaaaaaaaaaaaaa" * 50, "it's WE'LL don't I'Ve",
    "été ½ ² ³ x²y", "日本語 テキスト 12３", "\x1c\x1d a\x85b\xa0c", "emoji 👩‍👩‍👧 ok", "tabs\t\t x", "٣٤ arabic ٥", "…—“”", "x" * 5000,
]


def reference(texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    ids = [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    return ids, [t.decode(x, skip_special_tokens=False) for x in ids]


def test_coder_equals_the_library_on_odd_and_random_texts():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab cdeé\n'1 st<|>½日  ") for _ in range(rng.randrange(80))) for _ in range(400)]
    c = bpe.PairIndexCoder(PATH)
    ids, decoded = reference(texts)
    import numpy as np

    got = [np.frombuffer(x, "<i4").tolist() for x in c.encode_batch(texts)]
    assert got == ids
    assert [c.decode(x) for x in got] == decoded


def test_query_equals_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    ids, decoded = reference([r.text for r in docs])
    want = {r.doc_id: (len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for r, i, d in zip(docs, ids, decoded, strict=True)}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op3_bpe(spark, sf_dir).collect()}
    assert got == want


def test_nulls_clashing_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None, 5), (None, "x y", 6), (1, None, 5)], "doc_id long, text string, token_ids int")
    got = bpe.with_tokens(rows, PATH).orderBy("doc_id").collect()
    assert [(r.doc_id, r.token_ids, r.decoded_text) for r in got] == [(None, reference(["x y"])[0][0], "x y"), (1, [], ""), (1, [], "")]
    assert bpe.with_tokens(rows.limit(0), PATH).collect() == []
