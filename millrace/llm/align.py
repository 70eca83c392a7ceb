"""Alignment of two tokenizers' tokens by bytes, and how often their ids are linked in a corpus.

Both tokenizers encode the whole text. Offsets at which a token that begins with a space starts in both
are anchors; they part a document into windows, pairs of id tuples with the same bytes, mostly of one
word. A window is aligned once and remembered by its tuples: offsets inside it where tokens of
both end cut it into groups, and every pair of tokens of a group is a link.

A corpus has very many links but few different ones in a document, so each document's different links are
written once with how often they occur; counts are one aggregation. Then a head of the most frequent
links, bounded in number, is broadcast and looked up where the documents are; links beyond the head,
each in few documents, are joined.

The byte-level tokenizer is read from a tokenizers file; its merges are done by rank, which for merges listed in
id order is the same. The other is a sentencepiece model whose pieces hold a space in front only, so
that what stands between spaces can be encoded by itself and remembered; a model that is not so
encodes whole texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bpe import PATTERN, byte_letters
from millrace.llm.common import cut, give_back, mix, text_slices

#: Bits of an id in a link, a << ID_BITS | b.
ID_BITS = 21
#: Links that are broadcast at most.
HEAD = 1_000_000
#: Remembered words, and windows, which may have IDS ids each on average; beyond that a memory is emptied. Words longer than LONG letters are not remembered.
REMEMBERED, LONG, IDS = 600_000, 64, 16
#: Steps of a doubling in which links are counted by frequency.
STEPS = 8
_MADE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")] + [T.StructField("groups", T.StringType()), T.StructField("links", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))]
)


class ByteTokens:
    """A byte-level BPE file of the tokenizers library. Special tokens' strings are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte, vocab = {c: i for i, c in enumerate(byte_letters())}, spec["model"]["vocab"]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in vocab.items() if token not in special}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("merges are not in the order of their ids")
        self.encode = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes = [b""] * (1 + max(vocab.values()))
        for token, i in ranks.items():
            self.bytes[i] = token


class PieceTokens:
    """A sentencepiece model with byte fallback, which adds a space before a text."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.size = np.array([len(x) for x in self.bytes], np.int64)
        alone = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.normalize("ﬁ Å  ½\n") == "▁ﬁ▁Å▁▁½\n"
        # a word with the spaces before it; spaces at the text's end belong to the last one
        self.words = re.compile(r" +[^ ]+(?: +\Z)?|\A +\Z" if alone else r"(?s).+").findall
        self.known: dict[str, bytes | None] = {}

    def learn(self, words: list[str]) -> None:
        """Remembers the ids of words; None where the pieces aren't the word."""
        ids = self.model.encode([w[1:] for w in words], num_threads=1) if words else []
        flat = np.fromiter(chain.from_iterable(ids), np.int32)
        packed, ends = flat.tobytes(), np.cumsum([0, *map(len, ids)])
        whole = [w.encode() for w in words]
        size = np.concatenate([[0], np.cumsum(self.size[flat])])
        fits = np.diff(size[ends]) == np.array([len(w) for w in whole], np.int64)
        if b"".join(map(self.bytes.__getitem__, flat.tolist())) != b"".join(whole) or not fits.all():
            fits = [b"".join(map(self.bytes.__getitem__, x)) == w for x, w in zip(ids, whole, strict=True)]
        ends = (4 * ends).tolist()
        self.known |= {w: packed[s:e] if same else None for w, s, e, same in zip(words, ends, ends[1:], fits, strict=False)}

    def encode_batch(self, texts: list[str]) -> list[bytes | None]:
        """Ids of each text, which begins with a space that the model adds by itself, as int32 bytes; None where the pieces aren't the text."""
        known = self.known
        split = [self.words(t) for t in texts]
        new = set().union(*split) - known.keys()
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set().union(*split)
        self.learn(list(new))
        out = []
        for words in split:
            try:
                out.append(b"".join(map(known.__getitem__, words)))
            except TypeError:  # a word that isn't its pieces
                out.append(None)
        for word in new:
            if len(word) > LONG:
                del known[word]
        return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of sizes[0] places, then those of starts[1] and so on."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def window_hashes(a: np.ndarray, first_a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, first_b: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """64 bits for each window's pair of id tuples."""
    hashes = np.zeros(len(first_a), np.uint64)
    for ids, first, sizes in ((a, first_a, sizes_a), (b, first_b, sizes_b)):
        if len(first):
            place = (np.arange(len(ids)) - np.repeat(first, sizes)).astype(np.uint64)
            hashes = mix(hashes + np.add.reduceat(mix(ids.astype(np.uint64) + (place << np.uint64(32)) + np.uint64(1)), first))
    return hashes


class Lists:
    """Lists of numbers one behind the other, which only grow until they are emptied."""

    def __init__(self, kind: type = np.int64):
        self.ends, self.n, self.flat = np.zeros(1024, np.int64), 0, np.zeros(4096, kind)

    def add(self, sizes: np.ndarray, values: np.ndarray) -> None:
        begin = int(self.ends[self.n])
        while self.n + len(sizes) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while begin + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[begin : begin + len(values)] = values
        self.ends[self.n + 1 : self.n + 1 + len(sizes)] = begin + np.cumsum(sizes)
        self.n += len(sizes)

    def sizes(self, which: np.ndarray) -> np.ndarray:
        return self.ends[which + 1] - self.ends[which]

    def take(self, which: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.ends[which], self.sizes(which))]

    def same(self, which: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Whether each of the lists is the one given, values holding those of all."""
        fits = self.sizes(which) == sizes
        upto = np.concatenate([[0], np.cumsum(sizes)])
        at = spread(upto[:-1][fits], sizes[fits])
        differs = np.concatenate([[0], np.cumsum(self.take(which[fits]) != values[at])])
        ends = np.concatenate([[0], np.cumsum(sizes[fits])])
        fits[fits] = differs[ends[1:]] == differs[ends[:-1]]
        return fits


class Aligner:
    """Aligns texts, remembering words and windows. One per worker process and pair of files."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        if max(len(self.a.bytes), len(self.b.bytes)) >= 1 << ID_BITS:
            raise ValueError("too many ids for a link")
        self.a_size, self.b_size = (np.array([len(x) for x in s.bytes], np.int64) for s in (self.a, self.b))
        self.a_spaced, self.b_spaced = (np.array([x.startswith(b" ") for x in s.bytes]) for s in (self.a, self.b))
        # an id as text with what may follow it: another id of its side, the other side, a group, a window
        self.written = [f"{i}{x}" for i in range(max(len(self.a.bytes), len(self.b.bytes))) for x in (",", "|", ";", "\n")]
        self.forget()

    def forget(self) -> None:
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # known windows by hash
        self.text: list[str] = []
        self.ids = [Lists(np.int32), Lists(np.int32)]
        self.links, self.n_groups = Lists(), Lists()

    def windows(self, ids: list[np.ndarray], first: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        """The number of each window, whose ids stand at first; new ones are aligned and remembered.

        Windows are looked up by hash and compared by their ids, so a hash that two of them share costs time only.
        """
        hashes = window_hashes(ids[0], first[0], sizes[0], ids[1], first[1], sizes[1])
        part = lambda which: [(sizes[k][which], ids[k][spread(first[k][which], sizes[k][which])]) for k in (0, 1)]
        while True:
            order = np.argsort(hashes)
            begins = np.concatenate([[True], np.diff(hashes[order]) != 0]) if len(order) else np.zeros(0, bool)
            one, which = order[begins], np.empty(len(order), np.int64)
            which[order] = np.cumsum(begins) - 1
            at = np.minimum(np.searchsorted(self.hashes, hashes[one]), max(len(self.hashes) - 1, 0))
            known = self.hashes[at] == hashes[one] if len(self.hashes) else np.zeros(len(one), bool)
            number = np.empty(len(one), np.int64)
            number[known] = self.numbers[at[known]]
            fresh = np.flatnonzero(~known)
            number[fresh] = len(self.text) + np.arange(len(fresh))
            self.learn(part(one[fresh]))
            place = np.searchsorted(self.hashes, hashes[one[fresh]])
            self.hashes, self.numbers = np.insert(self.hashes, place, hashes[one[fresh]]), np.insert(self.numbers, place, number[fresh])
            found = number[which]
            wrong = ~np.logical_and(*[held.same(found, *given) for held, given in zip(self.ids, part(np.arange(len(found))), strict=True)])
            if not wrong.any():
                return found
            hashes[wrong] = mix(hashes[wrong] + np.uint64(1))

    def learn(self, windows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Aligns windows, given by the sizes and ids of both sides, and gives them the next numbers."""
        (count_a, ids_a), (count_b, ids_b) = windows
        if not len(count_a):
            return
        n, ids, count = len(count_a), [ids_a, ids_b], [count_a, count_b]
        for held, given in zip(self.ids, windows, strict=True):
            held.add(*given)
        ends = [np.cumsum(size[x]) for size, x in zip((self.a_size, self.b_size), ids, strict=True)]
        shared = np.intersect1d(*ends, assume_unique=True)  # of all windows, which have the same bytes on both sides
        group = [np.searchsorted(shared, x) for x in ends]
        per_group = [np.bincount(x, minlength=len(shared)) for x in group]
        window_of = np.empty(len(shared), np.int64)
        window_of[group[0]] = np.repeat(np.arange(n), count[0])
        last = np.append(window_of[1:] != window_of[:-1], True)
        # the tokens by group, first those of a: one text for all windows, parted again where they end
        place = np.argsort(np.concatenate([group[0] * 2, group[1] * 2 + 1]), kind="stable")
        side_of = np.concatenate([group[0] * 2, group[1] * 2 + 1])[place]
        follows = np.append(side_of[1:] != side_of[:-1], True)
        mark = np.where(~follows, 0, np.where(side_of % 2 == 0, 1, np.where(last[side_of // 2], 3, 2)))
        codes = np.concatenate(ids).astype(np.int64)[place] * 4 + mark
        self.text += "".join(map(self.written.__getitem__, codes.tolist())).split("\n")[:-1]
        # all pairs of a group: each a as often as there are b, beside the group's b
        times = per_group[1][group[0]]
        left = np.repeat(ids[0].astype(np.int64), times)
        first_b = np.cumsum(per_group[1]) - per_group[1]
        right = ids[1].astype(np.int64)[spread(first_b[group[0]], times)]
        self.links.add(np.bincount(window_of, weights=per_group[0] * per_group[1], minlength=n).astype(np.int64), left << ID_BITS | right)
        self.n_groups.add(np.ones(n, np.int64), np.bincount(window_of, minlength=n))

    def batch(self, texts: list[str | None]) -> dict[str, pa.Array]:
        """Columns of _MADE for texts."""
        n = len(texts)
        spoken = [i for i, t in enumerate(texts) if t]
        full = [" " + texts[i] for i in spoken]
        # the merges of a keep all bytes, those of b are compared with the text
        right = [(i, self.a.encode(t), b) for i, t, b in zip(spoken, full, self.b.encode_batch(full), strict=True) if b is not None]
        docs = np.array([i for i, _, _ in right], np.int64)
        n_a, n_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
        n_a[docs], n_b[docs] = [len(x) for _, x, _ in right], [len(b) // 4 for _, _, b in right]
        a = np.fromiter(chain.from_iterable(x for _, x, _ in right), np.int32, n_a.sum())
        b = np.frombuffer(b"".join(b for _, _, b in right), np.int32)
        # offsets run on over the documents, whose bytes are the same on both sides
        from_a, from_b = (np.cumsum(size[x]) - size[x] for size, x in ((self.a_size, a), (self.b_size, b)))
        spaced = np.zeros(int(self.a_size[a].sum()) + 1, bool)
        spaced[from_b[self.b_spaced[b]]] = True
        first_a = np.flatnonzero(spaced[from_a] & self.a_spaced[a])
        spaced[:] = False
        spaced[from_a[first_a]] = True
        first_b = np.flatnonzero(spaced[from_b])
        doc = np.searchsorted(np.cumsum(n_a[docs]), first_a, side="right")  # of each window, among docs
        if len(self.text) > REMEMBERED or self.ids[0].ends[self.ids[0].n] > IDS * REMEMBERED:
            self.forget()
        sizes = [np.diff(np.append(first_a, len(a))), np.diff(np.append(first_b, len(b)))]
        window_of = self.windows([a, b], [first_a, first_b], sizes)
        windows = window_of.tolist()
        groups, at = [""] * n, 0
        for i, end in zip(docs.tolist(), np.searchsorted(doc, np.arange(len(docs)), side="right").tolist(), strict=True):
            groups[i] = ";".join(map(self.text.__getitem__, windows[at:end]))
            at = end
        # each document's windows once, with how often, then its links once, with how often
        many = len(self.text) + 1
        used, often = np.unique(docs[doc] * many + window_of, return_counts=True)
        owner, window = used // many, used % many
        sizes = self.links.sizes(window)
        n_groups, n_links = (np.bincount(owner, weights=x * often, minlength=n).astype(np.int64) for x in (self.n_groups.take(window), sizes))
        held, times, owner = self.links.take(window), np.repeat(often, sizes), np.repeat(owner, sizes)
        both = owner << 2 * ID_BITS | held  # a batch has fewer rows than bits are left
        order = np.argsort(both)
        both, times = both[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(both) != 0])) if len(both) else order
        times = np.add.reduceat(times, first) if len(first) else times
        owner, held = both >> 2 * ID_BITS, both & ((1 << 2 * ID_BITS) - 1)
        upto = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=n))]).astype(np.int32))
        return {
            "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups), "n_links": pa.array(n_links), "groups": pa.array(groups, pa.string()),
            "links": pa.ListArray.from_arrays(upto, pa.array(held[first])), "times": pa.ListArray.from_arrays(upto, pa.array(times)),
        }


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process and pair of files, which every executor has at these paths."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def aligned(df: DataFrame, a_path: str, b_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns in keep (default: all) with n_a, n_b, n_groups, n_links, groups, links and times.

    The tokens are those of a space and the text. groups is 'a1,a2|b1;a3|b2,b3', ids of both sides;
    links are the different pairs a << ID_BITS | b of the document, in order, times how often each
    occurs. A null or empty text, or one whose tokens' bytes aren't the space and the text on both sides, has no
    tokens: zeros, empty arrays and an empty groups. Columns called like the new ones are replaced.
    Rows are independent: repeated rows, ties and empty tables need no rule, a text of any length is encoded whole.
    """
    kept = [c for c in (keep if keep is not None else df.columns) if c not in _MADE.names]
    carry = [f"c{i}" for i in range(len(kept))]
    source = df.select(*[df[c].alias(a) for c, a in zip(kept, carry, strict=True)], df[text].alias("t"))
    schema = T.StructType([T.StructField(a, df.schema[c].dataType) for a, c in zip(carry, kept, strict=True)] + _MADE.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = aligner(a_path, b_path)
        for batch in batches:
            column = batch.column(len(carry))
            for lo, hi in text_slices(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                made = found.batch(column.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, hi - lo) for i in range(len(carry))], *[made[n] for n in _MADE.names]], names=[*carry, *_MADE.names])
        give_back()

    return source.mapInArrow(run, schema).toDF(*kept, *_MADE.names)


def link_counts(rows: DataFrame) -> DataFrame:
    """link, a, b, n_docs and best (n_docs is the highest of its a, ties included) of all links of written rows."""
    counts = cut(rows.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n_docs")), "links")
    counts = counts.select("link", F.shiftright("link", ID_BITS).alias("a"), F.col("link").bitwiseAND((1 << ID_BITS) - 1).alias("b"), "n_docs")
    highest = counts.groupBy("a").agg(F.max("n_docs").alias("_highest"))
    return counts.join(highest, "a").select("link", "a", "b", "n_docs", (F.col("n_docs") == F.col("_highest")).alias("best"))


def head_level(counts: DataFrame, most: int = HEAD) -> int:
    """The lowest frequency level (STEPS to a doubling) from which on at most so many links stand."""
    sizes = counts.groupBy(level().alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    total, lowest = 0, sizes[0].level + 1 if sizes else 0
    for row in sizes:
        total += row.n
        if total > most:
            break
        lowest = row.level
    return lowest


def level() -> Column:
    return F.floor(F.log2("n_docs") * STEPS).cast("int")


def with_counts(rows: DataFrame, counts: DataFrame, most: int = HEAD) -> DataFrame:
    """rows with n_best (links with the highest count of their a) and count_sum (of n_docs over links), without links and times.

    rows are written, with a column _row that is theirs alone; counts are their link_counts(), written.
    """
    spark = rows.sparkSession
    lowest = head_level(counts, most)
    head = counts.where(level() >= lowest).select("link", "n_docs", "best").toArrow().combine_chunks()
    order = np.argsort(head["link"].to_numpy())
    shared = spark.sparkContext.broadcast(tuple(head[c].to_numpy()[order] for c in ("link", "n_docs", "best")))
    kept = [c for c in rows.columns if c not in ("links", "times")]
    added = [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("rare_times", T.ArrayType(T.LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, n_docs, best = shared.value
        for batch in batches:
            lists = [batch.column(batch.schema.get_field_index(c)) for c in ("links", "times")]
            held, times = (x.flatten().to_numpy() for x in lists)
            owner = np.repeat(np.arange(batch.num_rows), lists[0].value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(link, held), max(len(link) - 1, 0))
            known = link[at] == held if len(link) else np.zeros(len(held), bool)
            at, n = at[known], batch.num_rows
            sums = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
            np.add.at(sums[0], owner[known], times[known] * best[at])
            np.add.at(sums[1], owner[known], times[known] * n_docs[at])
            upto = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[~known], minlength=n))]).astype(np.int32))
            rare = [pa.ListArray.from_arrays(upto, pa.array(x[~known])) for x in (held, times)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], *map(pa.array, sums), *rare], names=[*kept, *[f.name for f in added]])

    near = cut(rows.mapInArrow(run, T.StructType([rows.schema[c] for c in kept] + added)), "counted")
    shared.unpersist()
    far = near.where(F.size("rare") > 0)
    each = far.select("_row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("_row", F.col("x.rare").alias("link"), F.col("x.rare_times").alias("times"))
    sums = each.join(counts.where(level() < lowest), "link").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n_docs")).alias("_sum"))
    added_up = far.join(sums, "_row").select(*kept, (F.col("n_best") + F.col("_best")).alias("n_best"), (F.col("count_sum") + F.col("_sum")).alias("count_sum"))
    return near.where(F.size("rare") == 0).select(*kept, "n_best", "count_sum").unionByName(added_up)
