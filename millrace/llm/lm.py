"""Language-model scoring with a hashed maximum-entropy model.

A token's probability is that of its class, times that of its output in the class, times, for an
output that rare tokens share, that of the token in the output by smoothed counts:

    p(token | before) = p(class | before) * p(output | class, before) * p(token | output)

Classes and outputs are softmaxes over features of what stands before: the last token, the token two
back on its own (a skip), and, for classes, the hashed pair of both. Frequent tokens have an output
each; all others share outputs by a hash of their spelling's end. Classes, outputs and rows of
hashed features grow with the number of different tokens and contexts (see Sizes).

Texts meet the training once: Spark gathers how often each output follows each context, a table that
grows with the corpus. In each round tasks add up what the model expects over that table, Spark sums
it, and every weight moves by the gradient, the logarithm of observed to expected counts. All tables
move in all rounds, and the result does not depend on partitions. Token counts are joined by token,
so the vocabulary may have any size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, give_back, text_slices, words

#: Tokens whose counts every task holds, at most, the most frequent ones; the others' counts are joined.
HEAVY = 200_000
#: Gradient rounds; what is added to expected counts.
ROUNDS, DAMP = 4, 25.0
#: Tokens scored at a time; distinct tokens, or contexts with outputs, counted before they are passed on; tokens remembered by a task.
CHUNK, COUNTED, CONTEXTS, REMEMBERED = 300_000, 500_000, 2_000_000, 150_000
#: Contexts with outputs that a task of a round takes, about.
TASK_CONTEXTS = 6_000_000
#: The end of a text, which no word can be.
END = b"\n"
#: Share of a move that a table makes: one over the number of features of its softmax.
_STEPS = {"last": 1 / 3, "second": 1 / 3, "pair": 1 / 3, "inside_last": 1 / 2, "inside_second": 1 / 2}
_INSIDE = ("inside_last", "inside_second")


@dataclass(frozen=True)
class Sizes:
    """Classes, outputs of each, and rows of the hashed tables."""

    classes: int
    pairs: int

    @property
    def outputs(self) -> int:
        return self.classes**2

    @property
    def rare(self) -> int:
        """Outputs that rare tokens share."""
        return self.outputs // 4

    @property
    def frequent(self) -> int:
        return self.outputs - self.rare

    @property
    def inside(self) -> int:
        return 2**16

    def rows(self, table: str) -> int:
        return self.inside if table in _INSIDE else self.pairs if table == "pair" else self.outputs + 1


def sizes_for(distinct: int) -> Sizes:
    """Classes grow with the fourth root of the number of different tokens, so outputs with its square root; pair rows with it, up to 2**17."""
    bits = max(1, int(distinct).bit_length())
    return Sizes(2 ** min(8, max(5, bits // 4)), 2 ** min(17, max(13, bits - 6)))


def token_keys(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64 and 32 bits of each token's hash, and 15 bits of a hash of its last two bytes."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, tokens)), ">i8").reshape(-1, 2).astype(np.int64)
    return both[:, 0], both[:, 1] >> 32, np.fromiter((xxhash.xxh3_64_intdigest(t[-2:]) & 0x7FFF for t in tokens), np.int64, len(tokens))


def token_counts(texts: DataFrame) -> DataFrame:
    """key, key2, suffix, n of all tokens of the column t, ends included."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()

        def out() -> pd.DataFrame:
            key, key2, suffix = token_keys(list(counts))
            return pd.DataFrame({"key": key, "key2": key2.astype(np.int32), "suffix": suffix.astype(np.int16), "n": np.fromiter(counts.values(), np.int64, len(counts))})

        for frame in frames:
            for t in frame["t"]:
                counts.update(words(t))
                if len(counts) > COUNTED:
                    yield out()
                    counts.clear()
            if len(frame):
                counts[END] += len(frame)
        yield out()

    return texts.mapInPandas(run, "key long, key2 int, suffix smallint, n long").groupBy("key", "key2", "suffix").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    counts: DataFrame | None  # key, key2, n of every token that tasks don't hold
    sizes: Sizes
    total: int
    distinct: int
    heavy_keys: np.ndarray  # n x 2, sorted by the first
    heavy_counts: np.ndarray
    heavy_outputs: np.ndarray  # -1: shares one
    rare_scale: np.ndarray  # log10 of the smoothed total of each rare output
    class_bias: np.ndarray
    inside_bias: np.ndarray  # classes x width
    weights: dict[str, np.ndarray]

    def shared(self) -> Model:
        return replace(self, counts=None)

    def outputs(self, key: np.ndarray, key2: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(output, count or -1 where it has to be joined) of each token."""
        other = self.sizes.frequent + suffix % self.sizes.rare
        if not len(self.heavy_keys):
            return other, np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.heavy_keys[:, 0], key), len(self.heavy_keys) - 1)
        known = (self.heavy_keys[at, 0] == key) & (self.heavy_keys[at, 1] == key2)
        output = np.where(known, self.heavy_outputs[at], -1)
        return np.where(output >= 0, output, other), np.where(known, self.heavy_counts[at], -1)


class Vocabulary(dict):
    """Numbers a task's tokens as they come, with what the model knows of each. Emptied when it holds REMEMBERED."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.fresh: list[bytes] = []
        self.facts = [np.zeros(0, np.int64) for _ in range(4)]  # key, key2, output, count

    def __missing__(self, token: bytes) -> int:
        found = self[token] = len(self)
        self.fresh.append(token)
        return found

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self._empty()
        out = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if self.fresh:
            key, key2, suffix = token_keys(self.fresh)
            self.facts = [np.concatenate([a, b]) for a, b in zip(self.facts, (key, key2, *self.model.outputs(key, key2, suffix)), strict=True)]
            self.fresh = []
        return out


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text but with n_tokens, outs, and what of the score needs no context.

    known_heavy, logs_heavy: tokens among those that tasks hold and the sum of log10(count + 1) over
    them; logs_rare: log10 of what p(token | output) has without the joined counts; rare: the other
    tokens (key, key2, times), whose counts are joined.
    """
    kept = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(model.shared())
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    new = ["n_tokens", "outs", "known_heavy", "logs_heavy", "logs_rare", "keys", "keys2", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        memory = Vocabulary(m)
        for batch in batches:
            column = batch.column(len(kept))
            for lo, hi in text_slices([len(t.as_py() or "") for t in column]):
                lists = [[*words(t.as_py()), END] for t in column[lo:hi]]
                size = np.fromiter(map(len, lists), np.int64, len(lists))
                numbers = memory.numbers(list(chain.from_iterable(lists)))
                key, key2, output, count = memory.facts
                owner = np.repeat(np.arange(len(lists)), size)
                per_doc = lambda x, owner=owner, n=len(lists): np.bincount(owner, weights=x, minlength=n)
                held = count >= 0
                log = np.where(held, np.log10(np.maximum(count, 0) + 1.0), 0.0)
                shares = output >= m.sizes.frequent
                inside = np.where(shares, np.where(held, log, 0.0) - m.rare_scale[np.maximum(output - m.sizes.frequent, 0)], 0.0)
                lone = ~held[numbers]
                pair, times = np.unique(owner[lone] * len(key) + numbers[lone], return_counts=True)
                at, ends = pair % len(key), np.concatenate([[0], np.cumsum(np.bincount(pair // len(key), minlength=len(lists)))]).astype(np.int32)
                upto = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                listed = lambda x, offsets=ends: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x))
                columns = [batch.column(i)[lo:hi] for i in range(len(kept))]
                columns += [pa.array(size), listed(output[numbers].astype(np.int32), upto), pa.array(per_doc(held[numbers]).astype(np.int64)), pa.array(per_doc(log[numbers])), pa.array(per_doc(inside[numbers]))]
                columns += [listed(key[at]), listed(key2[at].astype(np.int32)), listed(times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    types = "n_tokens long, outs array<int>, known_heavy long, logs_heavy double, logs_rare double, keys array<long>, keys2 array<int>, times array<int>"
    return docs.select(*kept, "text").mapInArrow(run, f"{schema}, {types}" if schema else types)


def _contexts_of(documents: list[np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray]:
    """((second * base + last) * base + output of each token, document of each); base - 1 stands before a text."""
    start = np.full(2, base - 1, np.int64)
    flat = np.concatenate(list(chain.from_iterable((start, d) for d in documents)))
    size = np.fromiter(map(len, documents), np.int64, len(documents))
    owner = np.repeat(np.arange(len(documents)), size)
    at = np.arange(size.sum()) + 2 * (owner + 1)
    return (flat[at - 2] * base + flat[at - 1]) * base + flat[at], owner


def _pieces(documents: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about CHUNK tokens; a longer one stands alone."""
    return text_slices([len(d) for d in documents], CHUNK)


def contexts(encoded: DataFrame, base: int) -> DataFrame:
    """context (second * base + last), out, n: how often each output follows each context in encoded (outs)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def merge() -> None:
            nonlocal keys, counts
            new, times = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            both = np.concatenate([keys, new])
            order = np.argsort(both, kind="stable")
            both, n = both[order], np.concatenate([counts, times])[order]
            first, _ = _runs(both)
            keys, counts = both[first], np.add.reduceat(n, first)

        def packed() -> pa.RecordBatch:
            """A row for each context: less to shuffle than one for each of its outputs."""
            nonlocal keys, counts
            first, _ = _runs(keys // base)
            offsets = pa.array(np.append(first, len(keys)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (keys % base, counts)]
            context = pa.array(keys[first] // base)
            keys, counts = keys[:0], counts[:0]
            return pa.RecordBatch.from_arrays([context, *lists], names=["context", "outs", "ns"])

        for batch in frames:
            documents = [np.asarray(x.values, np.int64) for x in batch.column(0)]
            for lo, hi in _pieces(documents):
                waiting.append(_contexts_of(documents[lo:hi], base)[0])
                if sum(map(len, waiting)) >= CONTEXTS:
                    merge()
                    if len(keys) >= CONTEXTS:
                        yield packed()
        if waiting:
            merge()
        if len(keys):
            yield packed()

    told = encoded.select("outs").mapInArrow(run, "context long, outs array<int>, ns array<int>").repartition("context")
    told = told.select("context", F.explode(F.arrays_zip("outs", "ns")).alias("o")).select("context", F.col("o.outs").alias("out"), F.col("o.ns").cast("long").alias("n"))
    return told.groupBy("context", "out").agg(F.sum("n").alias("n")).sortWithinPartitions("context")


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def _hash(a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - rows.bit_length() + 1)).astype(np.int64)


def class_features(sizes: Sizes, context: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of the class tables for contexts."""
    second, last = context // (sizes.outputs + 1), context % (sizes.outputs + 1)
    return {"last": last, "second": second, "pair": _hash(last, second, sizes.pairs)}


def inside_features(sizes: Sizes, context: np.ndarray, classes: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of the tables of outputs inside classes."""
    second, last = context // (sizes.outputs + 1), context % (sizes.outputs + 1)
    return {"inside_last": _hash(last, classes, sizes.inside), "inside_second": _hash(second + sizes.outputs + 1, classes, sizes.inside)}


def _class_shares(m: Model, context: np.ndarray) -> np.ndarray:
    f = class_features(m.sizes, context)
    return _softmax(m.class_bias + m.weights["last"][f["last"]] + m.weights["second"][f["second"]] + m.weights["pair"][f["pair"]])


def _inside_shares(m: Model, context: np.ndarray, classes: np.ndarray) -> np.ndarray:
    f = inside_features(m.sizes, context, classes)
    return _softmax(m.inside_bias[classes] + m.weights["inside_last"][f["inside_last"]] + m.weights["inside_second"][f["inside_second"]])


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each run of equal values, run of each place) of a sorted array."""
    new = np.concatenate([[True], x[1:] != x[:-1]])
    return np.flatnonzero(new), np.cumsum(new) - 1


def _sum_rows(table: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    """table[index] += rows, by sorting."""
    order = np.argsort(index, kind="stable")
    first, _ = _runs(index[order])
    table[index[order][first]] += np.add.reduceat(rows[order], first, axis=0)


def expected(told: DataFrame, model_on: Broadcast, observed: bool) -> DataFrame:
    """part (table), row, x0..: what the model expects in each row, summed over the contexts told; or, with observed, what is there."""
    m = model_on.value
    names = [f"x{i}" for i in range(m.sizes.classes)]
    tables = list(_STEPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        m = model_on.value
        width = m.sizes.classes
        sums = {t: np.zeros((m.sizes.rows(t), width), np.float64) for t in tables}
        used = {t: np.zeros(m.sizes.rows(t), bool) for t in tables}

        def add(parts: list[pa.RecordBatch]) -> None:
            context, out, n = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in range(3))
            order = np.lexsort((out, context))
            context, out, n = context[order], out[order].astype(np.int64), n[order].astype(np.float64)
            first, run_ = _runs(context)
            at, total = context[first], np.add.reduceat(n, first)
            classes = out // width
            if observed:
                upper = np.bincount(run_ * width + classes, weights=n, minlength=len(at) * width).reshape(-1, width)
            else:
                upper = _class_shares(m, at) * total[:, None]
            for t, rows in class_features(m.sizes, at).items():
                _sum_rows(sums[t], rows, upper)
                used[t][rows] = True
            first, run_ = _runs(run_ * width + classes)
            at, own, total = context[first], classes[first], np.add.reduceat(n, first)
            if observed:
                lower = np.bincount(run_ * width + out % width, weights=n, minlength=len(at) * width).reshape(-1, width)
            else:
                lower = _inside_shares(m, at, own) * total[:, None]
            for t, rows in inside_features(m.sizes, at, own).items():
                _sum_rows(sums[t], rows, lower)
                used[t][rows] = True

        parts, size = [], 0
        for batch in batches:
            parts.append(batch)
            size += batch.num_rows
            if size >= CHUNK // 3:
                add(parts)
                parts, size = [], 0
        if size:
            add(parts)
        for i, t in enumerate(tables):
            rows = np.flatnonzero(used[t])
            for lo in range(0, len(rows), 4096):
                some = rows[lo : lo + 4096]
                values = sums[t][some].astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), pa.array(some), *[pa.array(values[:, k]) for k in range(width)]], names=["part", "row", *names])

    sums = told.select("context", "out", "n").mapInArrow(run, "part int, row long, " + ", ".join(f"{c} float" for c in names))
    return sums.groupBy("part", "row").agg(*[F.sum(F.col(c).cast("double")).cast("float").alias(c) for c in names])


def _gathered(sums: DataFrame, sizes: Sizes) -> dict[str, np.ndarray]:
    """The sums as tables; bounded by the tables' sizes, and gathered as Arrow columns, not as rows of Python objects."""
    found = sums.toArrow()
    part, row = found.column("part").to_numpy(), found.column("row").to_numpy()
    out = {}
    for i, t in enumerate(_STEPS):
        mine = part == i
        out[t] = np.zeros((sizes.rows(t), sizes.classes), np.float32)
        for k in range(sizes.classes):
            out[t][row[mine], k] = found.column(f"x{k}").to_numpy()[mine]
    return out


def moved(weights: dict[str, np.ndarray], observed: dict[str, np.ndarray], expected_: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Weights after a round: each moves by its table's share of log(observed / expected), both smoothed by DAMP counts that fall as expected."""
    out = {}
    for t, w in weights.items():
        e = expected_[t]
        damp = DAMP * e / np.maximum(e.sum(1, keepdims=True), 1e-9) + 1e-9
        out[t] = (w + _STEPS[t] * np.log((observed[t] + damp) / (e + damp))).astype(np.float32)
    return out


def prepare(docs: DataFrame) -> Model:
    """Token counts of all texts, outputs and unconditional probabilities; every context weight is 0.

    Tasks hold the counts of the tokens above the least count that at most HEAVY tokens exceed; all
    of one count or none, by a histogram of counts. Of tokens with equal counts those with smaller
    hashes have outputs of their own.
    """
    counts = cut(token_counts(docs.select(F.col("text").alias("t"))), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    sizes = sizes_for(distinct)
    # exact bins for small counts, narrow ones above
    bin_ = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.lit(4096) + F.floor((F.log2("n") - 12) * 64)).cast("long")
    above, least = 0, None
    for r in sorted(counts.groupBy(bin_.alias("b")).agg(F.count("*").alias("v")).collect(), reverse=True):
        above += r.v
        if above > HEAVY:
            break
        least = r.b
    heavy = counts.where(bin_ >= least) if least is not None else counts.limit(0)
    held = heavy.toArrow().to_pandas().sort_values(["n", "key", "key2"], ascending=[False, True, True])
    n, frequent = held["n"].to_numpy(np.int64), min(sizes.frequent, len(held))
    outputs = np.full(len(held), -1, np.int64)
    outputs[:frequent] = np.arange(frequent)
    mass = np.zeros(sizes.outputs)
    mass[:frequent] = n[:frequent]
    rare, kinds = np.zeros(sizes.rare), np.zeros(sizes.rare)
    bucket = F.col("suffix") % sizes.rare
    for r in counts.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        rare[r.b], kinds[r.b] = r.n, r.v
    own = held["suffix"].to_numpy(np.int64)[:frequent] % sizes.rare
    np.subtract.at(rare, own, n[:frequent])
    np.subtract.at(kinds, own, 1)
    mass[sizes.frequent :] = rare
    share = (mass + 0.5).reshape(sizes.classes, sizes.classes)
    keys = held[["key", "key2"]].to_numpy(np.int64).reshape(-1, 2)
    order = np.argsort(keys[:, 0], kind="stable")
    rest = counts.where(bin_ < least) if least is not None else counts
    return Model(
        rest.select("key", "key2", "n"), sizes, int(total), int(distinct), keys[order], n[order], outputs[order], np.log10(rare + kinds + 1),
        np.log(share.sum(1) / share.sum()).astype(np.float32), np.log(share / share.sum(1, keepdims=True)).astype(np.float32),
        {t: np.zeros((sizes.rows(t), sizes.classes), np.float32) for t in _STEPS},
    )


def train(model: Model, encoded: DataFrame, rounds: int = ROUNDS) -> Model:
    """rounds gradient updates over all documents of encoded (outs)."""
    told = cut(contexts(encoded, model.sizes.outputs + 1), "contexts")
    # every task passes on whole tables, so a task is worth its shuffle only with many contexts
    told = told.coalesce(max(1, math.ceil(told.count() / TASK_CONTEXTS)))

    def summed(observed: bool) -> dict[str, np.ndarray]:
        shared = encoded.sparkSession.sparkContext.broadcast(model.shared())
        sums = _gathered(expected(told, shared, observed), model.sizes)
        shared.destroy()  # the sums are here: nothing asks for this round's weights again
        give_back()
        return sums

    observed = summed(True) if rounds else {}
    for _ in range(rounds):
        model = replace(model, weights=moved(model.weights, observed, summed(False)))
    return model


def log_probabilities(m: Model, keys: np.ndarray) -> np.ndarray:
    """log10 of p(class | before) * p(output | class, before) for keys as of _contexts_of()."""
    base, width = m.sizes.outputs + 1, m.sizes.classes
    different, back = np.unique(keys, return_inverse=True)
    context, out = different // base, different % base
    first, run_ = _runs(context)
    upper = np.log(np.maximum(_class_shares(m, context[first])[run_, out // width], 1e-30))
    first, run_ = _runs(context * width + out // width)
    lower = np.log(np.maximum(_inside_shares(m, context[first], out[first] // width)[run_, out % width], 1e-30))
    return ((upper + lower) / np.log(10))[back]


def score(encoded: DataFrame, model: Model) -> DataFrame:
    """encoded's other columns with n_tokens, n_known, base_score and score (log10 of the whole text's probability)."""
    own = ["n_tokens", "outs", "known_heavy", "logs_heavy", "logs_rare", "keys", "keys2", "times"]
    kept = [c for c in encoded.columns if c not in [*own, "row"]]
    shared = encoded.sparkSession.sparkContext.broadcast(model.shared())

    @F.pandas_udf("double")
    def in_context(outs: pd.Series) -> pd.Series:
        m, total = shared.value, np.zeros(len(outs))
        documents = [np.asarray(x, np.int64) for x in outs]
        for lo, hi in _pieces(documents):
            keys, owner = _contexts_of(documents[lo:hi], m.sizes.outputs + 1)
            total[lo:hi] = np.bincount(owner, weights=log_probabilities(m, keys), minlength=hi - lo)
        return pd.Series(total)

    pairs = encoded.select("row", F.explode(F.arrays_zip("keys", "keys2", "times")).alias("r")).select("row", F.col("r.keys").alias("key"), F.col("r.keys2").alias("key2"), "r.times")
    found = pairs.join(model.counts, ["key", "key2"]).groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs"))
    lone = F.coalesce("logs", F.lit(0.0))
    smooth = float(np.log10(model.total + model.distinct + 1))
    return encoded.withColumn("in_context", in_context("outs")).join(found, "row", "left").select(
        *kept,
        "n_tokens",
        (F.col("known_heavy") + F.coalesce("known", F.lit(0))).alias("n_known"),
        (F.col("logs_heavy") + lone - F.col("n_tokens") * F.lit(smooth)).alias("base_score"),
        (F.col("in_context") + F.col("logs_rare") + lone).alias("score"),
    )


def score_documents(docs: DataFrame, learn: Column, rounds: int = ROUNDS) -> tuple[DataFrame, Model]:
    """Trains on the rows of docs where learn is true and scores all rows.

    Gives docs' columns but text, with n_tokens, n_known, train_tokens, base_score and score; columns
    of these names, and row, outs and those of encode(), are replaced. A null text is as an empty
    one: the end token alone. Repeated rows count and are scored as often as they stand there.
    Without a row to learn from every token is unseen and both scores are those of no counts. An
    empty table gives an empty table. Texts and tokens of any length are taken whole. Ties: see
    prepare().
    """
    own = ["row", "n_tokens", "outs", "known_heavy", "logs_heavy", "logs_rare", "keys", "keys2", "times", "n_known", "train_tokens", "base_score", "score", "learn"]
    base = docs.drop(*own)
    model = prepare(base.where(learn))
    encoded = cut(encode(base.withColumn("learn", F.coalesce(learn, F.lit(False))), model).withColumn("row", F.monotonically_increasing_id()), "encoded")
    model = train(model, encoded.where("learn"), rounds)
    scored = score(encoded, model)
    return scored.withColumn("train_tokens", F.lit(model.total).cast("long")).drop("learn"), model
