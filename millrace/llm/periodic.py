"""Periodic runs of words by maximal pairs of an LCP-interval tree.

A run of n words with period q is a maximal pair: its first n - q words stand again q words on, with
other words (or an end) before and after both. So the maximal pairs of long enough matches at short enough
distance are the runs, and nothing has to be extended: distance d and match m give min_words words
or more if m + d >= min_words, and min_periods periods if m >= (min_periods - 1) * d. Of pairs that
span the same words, the least distance is the smallest period; the others are multiples of it.

No match below least_match() words meets both. Stretches of a document in which no match of so many
words stands twice, or only further apart than a run as long as the stretch allows, hold no run; prefix
doubling over all documents of a batch at once, which lets go of what doesn't repeat in its document,
finds the others. For each of them a suffix array and its common prefixes are made, and the
LCP-interval tree is walked bottom-up: a node holds the positions of its suffixes in order, and a list
of them for each left word. Where children meet, the smaller one looks up its positions in the larger
one within the distance that the node's match allows, under other left words only.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import give_back, text_slices

MIN_WORDS, MIN_PERIODS = 24, 3
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def least_match(min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> int:
    """The fewest words that the two occurrences of a pair share if the pair is a run."""
    return min(max((min_periods - 1) * d, min_words - d, 1) for d in range(1, max(min_words, 1) + 1))


def repeated(ids: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a stretch of width ids begins that its document holds twice, and a number for each such stretch."""
    rank, at = np.full(len(ids), -1, np.int64), np.arange(len(ids))
    key = doc * (int(ids.max(initial=0)) + 1) + ids
    size = 1
    while True:
        _, number, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = count[number] > 1
        at, number = at[twice], number[twice]
        rank[at] = number
        if size == width or not len(at):
            return at, number
        step, before = min(size, width - size), at
        at = at[at + step < len(ids)]
        at = at[(rank[at + step] >= 0) & (doc[at] == doc[at + step])]
        key = rank[at] * (int(rank.max(initial=0)) + 1) + rank[at + step]
        rank[before] = -1
        size += step


def stretches(at: np.ndarray, number: np.ndarray, doc: np.ndarray, width: int, min_periods: int) -> list[tuple[int, int]]:
    """First and end word of the stretches of repeated matches that may hold a run."""
    if not len(at):
        return []
    order = np.lexsort((at, number))
    gap = np.diff(at[order])
    gap = np.where(np.diff(number[order]) == 0, gap, np.iinfo(np.int64).max)
    near = np.full(len(at), np.iinfo(np.int64).max)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    # both copies of a run's match lie in one stretch, as they overlap or touch
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) > width) | (np.diff(doc[at]) != 0)]))
    first, last = at[new], at[np.concatenate([new[1:], [len(at)]]) - 1]
    fits = np.minimum.reduceat(near, new) <= (last - first + width) // min_periods
    return list(zip(first[fits].tolist(), (last[fits] + width).tolist(), strict=True))


def suffix_array(ids: np.ndarray) -> tuple[list[int], list[int]]:
    """Suffixes in order, by prefix doubling, and the words that each shares with the one before."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1]
    size = 1
    while rank.max() < n - 1:
        ahead = np.zeros(n, np.int64)
        ahead[: max(n - size, 0)] = rank[size:] + 1
        rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1]
        size *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    suffixes, places, words = order.tolist(), rank.tolist(), ids.tolist()
    shared, m = [0] * n, 0
    for i, place in enumerate(places):
        if not place:
            m = 0
            continue
        j = suffixes[place - 1]
        most = n - max(i, j)
        while m < most and words[i + m] == words[j + m]:
            m += 1
        shared[place] = m
        m = m - 1 if m else 0
    return suffixes, shared


class Positions:
    """Positions of a node's suffixes in order, all of them and by left word."""

    __slots__ = ("all", "by_left")

    def __init__(self, at: int, left: int):
        self.all, self.by_left = [at], {left: [at]}


def runs_of(ids: np.ndarray, before: int, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in a stretch of ids, before being the id that stands before it (-1 for none)."""
    least = least_match(min_words, min_periods)
    if len(ids) <= least:
        return []
    left = [before, *ids[:-1].tolist()]
    found: dict[tuple[int, int], int] = {}

    def met(a: Positions, b: Positions, match: int) -> Positions:
        small, large = (a, b) if len(a.all) < len(b.all) else (b, a)
        far, close = match // (min_periods - 1), max(1, min_words - match)
        for p in small.all:
            lo, hi = bisect_left(large.all, p - far), bisect_right(large.all, p + far)
            if lo == hi:
                continue
            mine = left[p]
            if hi - lo <= 2 * len(large.by_left):
                others = [q for q in large.all[lo:hi] if left[q] != mine]
            else:
                others = [q for word, at in large.by_left.items() if word != mine for q in at[bisect_left(at, p - far) : bisect_right(at, p + far)]]
            for q in others:
                d = abs(p - q)
                if d >= close:
                    span = (min(p, q), match + d)
                    if d < found.get(span, d + 1):
                        found[span] = d
        for p in small.all:
            insort(large.all, p)
            insort(large.by_left.setdefault(left[p], []), p)
        return large

    suffixes, shared = suffix_array(ids)
    shared.append(0)
    open_: list[tuple[int, Positions]] = []
    for place, at in enumerate(suffixes):
        match = shared[place + 1]
        if not open_ and match < least:
            continue
        node = Positions(at, left[at])
        while open_ and open_[-1][0] > match:
            above, held = open_.pop()
            node = met(held, node, above)
        if match < least:
            open_.clear()
        elif open_ and open_[-1][0] == match:
            open_[-1] = (match, met(open_[-1][1], node, match))
        else:
            open_.append((match, node))
    return sorted((start, length, d) for (start, length), d in found.items())


def runs(docs: list[list[bytes]], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each document's runs, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    sizes = np.array([len(d) for d in docs], np.int64)
    doc = np.repeat(np.arange(len(docs)), sizes)
    ids, at = np.empty(len(doc), np.int64), 0
    for words in docs:
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids[at : at + len(words)] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        at += len(words)
    begins = np.cumsum(sizes) - sizes
    width = least_match(min_words, min_periods)
    places, numbers = repeated(ids, doc, width)
    for first, end in stretches(places, numbers, doc, width, min_periods):
        d = int(doc[first])
        start = first - int(begins[d])
        out[d] += [(start + s, n, q) for s, n, q in runs_of(ids[first:end], int(ids[first - 1]) if start else -1, min_words, min_periods)]
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def top_run(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period, of ties the first, then that of the smallest period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed_words(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """words without what stands in a run after its first period."""
    out, at = [], 0
    for first, end in sorted((start + q, start + n) for start, n, q in found):
        if end > at:
            out += words[at : max(at, first)]
            at = end
    return out + words[at:]


def with_runs(df: DataFrame, text: str = "text", keep: list[str] | None = None, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """df's columns in keep (default: all) with n_words, runs, top_run and collapsed.

    Words are parted by ASCII white space and keep their case. runs are array of (start, length, period), by start, then
    period; top_run has the greatest length / period, of ties the first, and is null without a run;
    collapsed is the words outside the runs' later periods, joined by one space. Null and empty texts
    have no words, no runs and an empty collapsed text. Columns called like the new ones are replaced.
    Rows are independent: repeated rows, ties in ids and empty tables need no rule, a text of any
    length is looked through whole. min_periods is 2 or more.
    """
    if min_periods < 2:
        raise ValueError("a run has two periods at least")
    made = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("top_run", RUN), T.StructField("collapsed", T.StringType())]
    kept = [c for c in (keep if keep is not None else df.columns) if c not in {f.name for f in made}]
    carry = [f"c{i}" for i in range(len(kept))]
    source = df.select(*[df[c].alias(a) for c, a in zip(kept, carry, strict=True)], df[text].alias("t"))
    schema = T.StructType([T.StructField(a, df.schema[c].dataType) for a, c in zip(carry, kept, strict=True)] + made)
    names = [f.name for f in RUN]

    def as_structs(found: list[tuple[int, int, int]], absent: list[bool] | None = None) -> pa.StructArray:
        columns = np.array(found, np.int64).reshape(-1, 3)
        return pa.StructArray.from_arrays([pa.array(columns[:, i]) for i in range(3)], names=names, mask=None if absent is None else pa.array(absent, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(carry))
            for lo, hi in text_slices(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                words = [x.split() if x else [] for x in column.slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
                found = runs(words, min_words, min_periods)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                best = [top_run(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).slice(lo, hi - lo) for i in range(len(carry))],
                        pa.array([len(x) for x in words], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), as_structs([r for x in found for r in x])),
                        as_structs([x or (0, 0, 0) for x in best], [x is None for x in best]),
                        pa.array([b" ".join(collapsed_words(w, x)) if x else b" ".join(w) for w, x in zip(words, found, strict=True)], pa.binary()).cast(pa.string()),
                    ],
                    names=[*carry, *[f.name for f in made]],
                )
        give_back()

    return source.mapInArrow(run, schema).toDF(*kept, *[f.name for f in made])
