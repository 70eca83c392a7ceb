"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. For each bit a binary classifier over hashed character
n-grams tells the languages of one sign from those of the other. A text's margins are compared with
every codeword by a logistic loss, weighted by how well each bit separates the training data, and
the codeword of least loss wins; the distance to the second says whether the answer is ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the number of hashed n-gram features.
FEATURE_BITS = 15
#: Labelled documents learned from, at most (chosen by hash); and languages, at most.
TRAIN_DOCS, MAX_LANGS = 20_000, 1000
#: A language needs this much more loss than the best one, or the answer counts as ambiguous.
AMBIGUOUS_LOSS = 0.5
UNDETERMINED = "und"

_SPACE = 32
_LETTER: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _LETTER[0]


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters than letters as one space; empty without a letter."""
    if not text:
        return np.zeros(0, np.uint32)
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letter_table()[a]
    if not is_letter.any():
        return np.zeros(0, np.uint32)
    a = np.where(is_letter, a, np.uint32(_SPACE))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    return np.concatenate([[np.uint32(_SPACE)], a[keep], [np.uint32(_SPACE)]])


def features(a: np.ndarray) -> np.ndarray:
    """Hashes of all character pairs and triples."""
    shift = np.uint32(32 - FEATURE_BITS)
    two = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + a[2:] * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1)
    return np.concatenate([(two ^ (two >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift, (three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift])


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1: all splits for up to 7 languages, else the best of 50 random books by least distance."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 7:
        splits = [x for x in itertools.product((1, -1), repeat=n) if x[0] == 1 and -1 in x]
        return np.array(splits, float).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    books = []
    for _ in range(50):
        book = rng.choice([1.0, -1.0], (n, bits))
        book = book[:, np.abs(book.sum(0)) < n]
        apart = (book.shape[1] - book @ book.T) / 2 + np.eye(n) * bits
        books.append((apart.min(), book))
    return max(books, key=lambda x: x[0])[1]


@dataclass
class Model:
    langs: list[str]
    book: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits, float32; scaled so that a typical margin is near SHARPNESS
    reliability: np.ndarray  # of each bit


#: Typical margin after scaling.
SHARPNESS = 4.0


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Model:
    """Learns from rows with a text and a language: all, or train_docs of them at most, those with a small hash of key and text.

    Which rows these are follows from a count, so none are sorted; row order and ties play no part.
    Repeated rows count as often as they stand there; very long texts count whole.

    The counts of (language, n-gram) are summed on Spark. What reaches the driver is bounded by
    MAX_LANGS x 2**FEATURE_BITS counts.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    n = rows.count()
    # four standard deviations below the bound, so that chance does not exceed it
    share = 1.0 if n <= train_docs else max(train_docs - 4 * train_docs**0.5, 1) / n
    chosen = rows if share == 1.0 else rows.where(F.pmod(F.xxhash64(key, text), F.lit(2**40)) < int(share * 2**40))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, part in frame.groupby("l"):
                total = np.zeros(2**FEATURE_BITS, np.int64)
                for t in part["t"]:
                    a = letters(t)
                    if len(a):
                        total += np.bincount(features(a), minlength=len(total))
                f = np.flatnonzero(total)
                yield pd.DataFrame({"l": name, "f": f.astype(np.int32), "n": total[f]})

    counts = chosen.select(F.col(text).alias("t"), F.col(lang).alias("l")).mapInPandas(count, "l string, f int, n long").groupBy("l", "f").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    langs = sorted(found["l"].unique())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"{len(langs)} languages; the bound is {MAX_LANGS}")
    if not langs:
        return Model([], np.ones((0, 1)), np.zeros((2**FEATURE_BITS, 1), np.float32), np.ones(1))
    seen = np.zeros((len(langs), 2**FEATURE_BITS))
    seen[np.searchsorted(langs, found["l"].to_numpy(dtype=object)), found["f"].to_numpy()] = found["n"].to_numpy()
    share = (seen + 0.5) / (seen.sum(1, keepdims=True) + 0.5 * seen.shape[1])
    book = codebook(len(langs))
    up, down = (book > 0).astype(float), (book < 0).astype(float)
    weights = np.log((share.T @ up) / np.maximum(up.sum(0), 1)) - np.log(np.maximum(share.T @ down, 1e-12) / np.maximum(down.sum(0), 1))
    if len(langs) == 1:
        weights = np.zeros_like(weights)
    expected = book * (share @ weights)  # margins of a text made of its language's n-grams
    scale = np.abs(expected).mean(0)
    reliability = np.clip(expected.min(0) / np.maximum(scale, 1e-9), 0.05, 1.0) if len(langs) > 1 else np.ones(1)
    return Model(langs, book, (weights * SHARPNESS / np.maximum(scale, 1e-9)).astype(np.float32), reliability)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the best language, its share of exp(-loss), and how much more the second loses, for each row of margins."""
    loss = np.stack([(np.logaddexp(0, -margins * c) * model.reliability).sum(1) for c in model.book], 1)
    best = loss.argmin(1)
    share = np.exp(loss.min(1, keepdims=True) - loss)
    if loss.shape[1] == 1:
        return best, np.ones(len(best)), np.full(len(best), np.inf)
    two = np.partition(loss, 1, axis=1)[:, :2]
    return best, 1 / share.sum(1), two[:, 1] - two[:, 0]


def margins_of(model: Model, text: str | None, step: int = 1_000_000) -> np.ndarray | None:
    """Mean weight over all n-grams of the whole text, a bit each; None without a letter."""
    a = letters(text)
    if not len(a):
        return None
    total, n = np.zeros(model.weights.shape[1]), 0
    for i in range(0, max(len(a) - 2, 1), step):
        f = features(a[i : i + step + 2])
        total += model.weights[f].sum(0, dtype=np.float64)
        n += len(f)
    return total / max(n, 1)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred, lang_score (0 to 1) and lang_ambiguous; columns of these names are replaced.

    A text that is null or has no letter is 'und' with score 0, not ambiguous; so is every text
    when nothing was learned. Only the text is looked at, the whole of it, however long. Rows are
    independent, so repeated rows are judged alike; of languages with equal loss the first by name
    wins and the answer is ambiguous. An empty table gives an empty table.
    """
    new = ["lang_pred", "lang_score", "lang_ambiguous"]
    base = df.drop(*new)
    model_on = df.sparkSession.sparkContext.broadcast(model)

    # a filter on the answer must not make Spark ask twice
    @(lambda f: F.pandas_udf(f, "lang_pred string, lang_score double, lang_ambiguous boolean").asNondeterministic())
    def judge(texts: pd.Series) -> pd.DataFrame:
        m = model_on.value
        out = [(UNDETERMINED, 0.0, False)] * len(texts)
        rows, found = [], []
        for i, t in enumerate(texts):
            if m.langs and (x := margins_of(m, t)) is not None:
                rows.append(i)
                found.append(x)
        if rows:
            for i, b, s, gap in zip(rows, *decode(m, np.stack(found)), strict=True):
                out[i] = (m.langs[b], float(s), bool(gap < AMBIGUOUS_LOSS))
        return pd.DataFrame(out, columns=new)

    judged = base.withColumn("_lang", judge(F.col(text)))
    return judged.select(*[judged[c] for c in base.columns], *[judged["_lang"][c].alias(c) for c in new])
