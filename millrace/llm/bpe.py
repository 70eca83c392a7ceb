"""Byte-level BPE by a pair occurrence index.

The distinct pre-tokens of an Arrow batch lie one behind the other in flat symbol lists. For each
mergeable pair the index keeps all positions where it stands; the active ranks are taken in
ascending order, each merges at all its positions at once, and only the lists of the pairs to the
left and right of a merge are updated.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import give_back, text_slices

#: The published pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points below this are matched by explicit classes, which is faster than Unicode properties.
NEAR = 0x250
#: Pre-tokens longer than this many bytes are not remembered between batches.
LONG_WORD = 64
#: Remembered pre-tokens; beyond that the memory is emptied.
REMEMBERED = 300_000


def _class(kind: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(NEAR) if unicodedata.category(chr(i))[0] == kind)


def _near_pattern() -> re.Pattern:
    """PATTERN for texts whose code points are all below NEAR."""
    letter, number, space = _class("L"), _class("N"), r"\t-\r \x85\xa0"
    return re.compile(
        rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files: itself if visible, else the next from U+0100."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class PairIndexCoder:
    """Encodes and decodes with a vocabulary file of the tokenizers library (kind: byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        to_byte = {c: i for i, c in enumerate(letters)}
        self.byte_ids = [vocab[c] for c in letters]
        self.ranks: dict[int, int] = {}
        self.merges: list[tuple[int, int, int]] = []
        for pair in spec["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = vocab[left], vocab[right]
            self.ranks.setdefault(a << 32 | b, len(self.merges))
            self.merges.append((a, b, vocab[left + right]))
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.near, self.any = _near_pattern(), regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.far = re.compile(f"[^\x00-{chr(NEAR - 1)}]")
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order; added tokens stand whole."""
        find = self.any.findall if self.far.search(text) else self.near.findall
        if self.split_added is None or not any(x in text for x in self.added):
            return find(text)
        out: list[str] = []
        for part in self.split_added.split(text):
            out += [part] if part in self.added else find(part)
        return out

    def index_words(self, tokens: list[str]) -> list[bytes]:
        """Ids, as little-endian int32 bytes, of each pre-token, all merged together through the pair index."""
        symbol: list[int] = []
        after: list[int] = []
        before: list[int] = []
        starts: list[int] = []
        at: dict[int, list[int]] = {}
        ranks, merges, byte_ids = self.ranks, self.merges, self.byte_ids
        for token in tokens:
            start = len(symbol)
            starts.append(start)
            symbol += [byte_ids[b] for b in token.encode("utf-8", "surrogatepass")]
            end = len(symbol)
            after += range(start + 1, end + 1)
            before += range(start - 1, end - 1)
            after[-1], before[start] = -1, -1
            for i in range(start, end - 1):
                r = ranks.get(symbol[i] << 32 | symbol[i + 1])
                if r is not None:
                    at.setdefault(r, []).append(i)
        active = list(at)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            left, right, new = merges[rank]
            places = at.pop(rank, None)
            if not places:
                continue
            places.sort()
            for i in places:
                j = after[i]
                if symbol[i] != left or j < 0 or symbol[j] != right:
                    continue
                symbol[i], symbol[j] = new, -1
                k = after[i] = after[j]
                p = before[i]
                if k >= 0:
                    before[k] = i
                    r = ranks.get(new << 32 | symbol[k])
                    if r is not None:
                        if r in at:
                            at[r].append(i)
                        else:
                            at[r] = [i]
                            heapq.heappush(active, r)
                if p >= 0:
                    r = ranks.get(symbol[p] << 32 | new)
                    if r is not None:
                        if r in at:
                            at[r].append(p)
                        else:
                            at[r] = [p]
                            heapq.heappush(active, r)
        flat = np.array(symbol, np.int32)
        kept = flat >= 0
        ends = np.append(starts[1:], len(symbol)).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(kept)])
        packed = flat[kept].astype("<i4").tobytes()
        return [packed[4 * a : 4 * b] for a, b in zip(upto[starts].tolist(), upto[ends].tolist(), strict=True)]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as int32 bytes. Null is as empty."""
        known = self.known
        split = [self.pieces(t) if t else [] for t in texts]
        new = set().union(*split) - known.keys()
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set().union(*split)
        fresh = sorted(new - self.added.keys())
        known |= zip(fresh, self.index_words(fresh), strict=True) if fresh else ()
        for token in new & self.added.keys():
            known[token] = np.int32(self.added[token]).tobytes()
        out = [b"".join(map(known.__getitem__, x)) for x in split]
        for token in fresh:
            if len(token) > LONG_WORD:
                del known[token]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_CODERS: dict[str, PairIndexCoder] = {}


def coder(path: str) -> PairIndexCoder:
    """One per worker process and vocabulary file, which every executor has at this path."""
    if path not in _CODERS:
        _CODERS[path] = PairIndexCoder(path)
    return _CODERS[path]


def with_tokens(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids: str = "token_ids", decoded: str | None = "decoded_text") -> DataFrame:
    """df's columns in keep (default: all) with the ids of the whole text and, if named, the text decoded from them.

    Nulls and empty texts give no ids and an empty decoded text. Columns of df called like ids or
    decoded are replaced. Rows are independent, so repeated rows, ties and empty tables need no rule;
    a text of any length is encoded whole.
    """
    kept = [c for c in (keep if keep is not None else df.columns) if c not in (ids, decoded)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else []))
    carry = [f"c{i}" for i in range(len(kept))]
    source = df.select(*[df[c].alias(a) for c, a in zip(kept, carry, strict=True)], df[text].alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            column = batch.column(len(kept))
            for lo, hi in text_slices(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                texts = column.slice(lo, hi - lo).to_pylist()
                packed = c.encode_batch(texts)
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
                flat = np.frombuffer(b"".join(packed), "<i4")
                arrays = [batch.column(i).slice(lo, hi - lo) for i in range(len(kept))]
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                if decoded:
                    arrays.append(pa.array([c.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=[*carry, ids, *([decoded] if decoded else [])])
        c.known.clear()
        give_back()

    out = T.StructType([T.StructField(a, f.dataType) for a, f in zip(carry, schema.fields, strict=False)] + schema.fields[len(kept) :])
    return source.mapInArrow(run, out).toDF(*schema.names)
