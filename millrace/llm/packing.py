"""Packing of token pieces into sequences by bounded-space online best-fit.

A piece goes to the open bin with the least free space that takes it, which a bitset with one bit for
each free space finds by one shift. The number of open bins is fixed: if a piece fits in none of them
the fullest bin closes first and a new one opens. Pieces come in blocks, the long ones of a block first,
so that short ones of later blocks fill what long ones leave.

Each task packs its own pieces. Bins that are open and not yet nearly full at its end are taken apart,
and their pieces go to a next round of fewer tasks, until one task is left, which reads only such
remains: a bounded number of bins from each task before. Pieces of a whole sequence take no part.

Tokens are those of a tokenizers file of kind BPE with word ends (lower case, white space dropped). A
stretch between ASCII white space is encoded once and remembered: this tokenizer's normaliser and
pre-tokens never look across it. Stretches of letters below U+0250 are split here and their merges are
done by rank, other ones by the library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from millrace.llm.bpe import byte_letters
from millrace.llm.common import cut, give_back, text_slices

CAPACITY = 2048
#: Bins that may be open at a time, and pieces of a block that is placed longest first.
OPEN_BINS = 4096
#: Pieces that one task packs at most, about; small inputs are dealt out down to SMALL.
MANY, SMALL = 1_000_000, 8192
#: At a task's end a bin with less free space than this share is as good as full.
NEARLY_FULL = 1 / 64
#: Remembered stretches, and words in them; beyond that a memory is emptied. Stretches longer than LONG bytes are not remembered.
REMEMBERED, LONG = 600_000, 64
#: Pre-tokens of the tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+"


class OpenBins:
    """A fixed number of open bins, found by free space through a bitset."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS):
        self.capacity, self.most = capacity, most
        self.bits = 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.opened = 0

    def _take(self, free: int) -> int:
        bins = self.at[free]
        number = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        return number

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece of 1 to capacity tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.n_open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.n_open -= 1
            number, free = self.opened, self.capacity
            self.opened += 1
            self.n_open += 1
        left = free - length
        if left:
            if not self.at[left]:
                self.bits |= 1 << left
            self.at[left].append(number)
        else:
            self.n_open -= 1
        return number, self.capacity - free

    def roomy(self, least: int) -> list[int]:
        """Open bins with at least so much free space."""
        return [b for free in range(least, self.capacity + 1) for b in self.at[free]]


def placed(lengths: np.ndarray, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece, and the bins that end open with room."""
    bins = OpenBins(capacity, open_bins)
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for lo in range(0, len(lengths), open_bins):
        order = lo + np.argsort(-lengths[lo : lo + open_bins], kind="stable")
        for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
            number[i], offset[i] = bins.place(n)
    return number, offset, bins.roomy(max(1, int(capacity * NEARLY_FULL)))


def _packed(rows: DataFrame, tasks: int, round_: int, capacity: int, open_bins: int) -> DataFrame:
    """rows with sequence_id, offset and _open (its bin may take more)."""
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("_open", T.BooleanType())])
    arrow = [*rows.columns, "sequence_id", "offset", "_open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        number, offset, roomy = placed(np.concatenate([b.column("length").to_numpy() for b in held]), capacity, open_bins)
        still = np.isin(number, roomy)
        number = number | (TaskContext.get().partitionId() << 32) | (round_ << 56)
        at = 0
        for batch in held:
            here = slice(at, at + batch.num_rows)
            at = here.stop
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number[here]), pa.array(offset[here]), pa.array(still[here])], names=arrow)

    # dealt round, not by a key: rows that are alike are no hot group
    return rows.repartition(tasks).mapInArrow(run, schema)


def packed(rows: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, many: int = MANY) -> DataFrame:
    """rows with sequence_id and offset, few sequences of at most capacity tokens.

    rows have a column length (long, 1 to capacity); a null, lesser or greater one is an error. Other columns pass
    through, but for sequence_id, offset and _open, which are replaced. Rows that are alike are pieces
    of their own, ties go by the order of a task's rows, so equal inputs may get different numbers,
    and an empty table stays empty. A task holds many rows at most: give narrow ones.
    """
    wrong = F.raise_error(F.lit("length is not in 1 to the capacity")).cast("long")
    rows = rows.drop("sequence_id", "offset", "_open").withColumn("length", F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(wrong))
    # whole sequences are numbered below zero by the scan
    out = [rows.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))]
    rest = rows.where(F.col("length") < capacity)
    n, parts = rest.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, -(-n // many), min(parts, -(-n // SMALL)))
    round_ = 0
    while n:
        done = cut(_packed(rest, tasks, round_, capacity, open_bins), "packed")
        if tasks == 1:
            out.append(done.drop("_open"))
            break
        out.append(done.where("not _open").drop("_open"))
        rest = done.where("_open").drop("_open", "sequence_id", "offset")
        n = rest.count()
        tasks, round_ = min(max(1, -(-n // many)), max(1, tasks // 2)), round_ + 1
    total = out[0]
    for part in out[1:]:
        total = total.unionByName(part)
    return total


class Words(dict):
    """Ids of pre-tokens as little-endian unsigned 32-bit numbers, made when first asked for."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, word: str) -> bytes:
        found = self[word] = np.array(self.merge(word.encode() + b"\xff"), "<u4").tobytes()
        return found


class WordEndCoder:
    """Ids of stretches without ASCII white space, equal to the tokenizers library's."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        end, to_byte = spec["model"]["end_of_word_suffix"], {c: i for i, c in enumerate(byte_letters())}
        # \xff, which no UTF-8 text has, stands for the word end; it joins the last byte first, as pairs with it have the lowest ranks
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            body = token.removesuffix(end)
            if all(c in to_byte for c in body):
                ranks[bytes(to_byte[c] for c in body) + (b"\xff" if token.endswith(end) else b"")] = i
        self.words = Words(tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece)
        near = {kind: "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == kind) for kind in "LN"}
        self.pattern = re.compile(PATTERN.format(letter=near["L"], number=near["N"], space=r"\t-\r \x85\xa0") + "|\n")
        # left to the library: far letters, a letter that lower case makes two of, the strings of special tokens
        self.far = re.compile("[^\x00-\u024f]|\u0130|" + "|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])))
        self.known: dict[bytes, bytes] = {}

    def learn(self, stretches: list[bytes]) -> None:
        """Remembers the ids of stretches, which hold no line feed."""
        lines = [x.decode("utf-8", "replace") for x in stretches]
        for i in [i for i, x in enumerate(lines) if self.far.search(x)]:
            self.known[stretches[i]] = np.array(self.library.encode(lines[i], add_special_tokens=False).ids, "<u4").tobytes()
            lines[i] = ""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        ids, at = [], 0
        for word in self.pattern.findall("\n".join([*lines, ""]).lower()):
            if word != "\n":
                ids.append(self.words[word])
                continue
            if lines[at]:
                self.known[stretches[at]] = b"".join(ids)
            ids, at = [], at + 1

    def encode_batch(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers. Null is as empty."""
        known = self.known
        split = [t.split() if t else [] for t in texts]
        new = set().union(*split) - known.keys()
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set().union(*split)
        self.learn(list(new))
        out = [b"".join(map(known.__getitem__, x)) for x in split]
        for word in new:
            if len(word) > LONG:
                del known[word]
        return out


_CODERS: dict[str, WordEndCoder] = {}


def coder(path: str) -> WordEndCoder:
    """One per worker process and vocabulary file, which every executor has at this path."""
    if path not in _CODERS:
        _CODERS[path] = WordEndCoder(path)
    return _CODERS[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, keep: list[str] | None = None) -> DataFrame:
    """A row for each piece of a document: the columns in keep (default: all but text), piece, start, length and ids (little-endian unsigned 32-bit).

    A document is the ids of its whole text and then end; only a longer one than capacity is cut,
    into pieces of capacity and a last one. Null and empty texts are the end alone. Columns called as
    the new ones are replaced; rows that are alike are documents of their own, an empty table gives
    no pieces.
    """
    made = ["piece", "start", "length", "ids"]
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in ("text", *made)]
    types = [T.IntegerType(), T.LongType(), T.LongType(), T.BinaryType()]
    carry = [f"c{i}" for i in range(len(kept))]
    source = docs.select(*[docs[c].alias(a) for c, a in zip(kept, carry, strict=True)], docs["text"].alias("t"))
    schema = T.StructType([T.StructField(a, docs.schema[c].dataType) for a, c in zip(carry, kept, strict=True)] + [T.StructField(n, t) for n, t in zip(made, types, strict=True)])
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            column = batch.column(len(carry))
            for lo, hi in text_slices(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                row, number, start, ids = [], [], [], []
                for i, whole in enumerate(c.encode_batch(column.slice(lo, hi - lo).cast(pa.binary()).to_pylist())):
                    whole += tail
                    for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                        row.append(lo + i)
                        number.append(k)
                        start.append(at // 4)
                        ids.append(whole[at : at + 4 * capacity])
                arrays = [batch.column(i).take(pa.array(row)) for i in range(len(carry))]
                arrays += [pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*carry, *made])
        give_back()  # what is remembered stays for the worker's next task, since invented words are many

    return source.mapInArrow(run, schema).toDF(*kept, *made)


def sequences(rows: DataFrame) -> DataFrame:
    """sequence_id, length and ids of each sequence of packed pieces that carry their ids; a sequence has capacity tokens at most."""
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = rows.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("parts"))
    return whole.select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda total, x: F.concat(total, x["ids"])).alias("ids"))
