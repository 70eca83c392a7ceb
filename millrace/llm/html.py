"""Main text of web pages, with a suffix array per host for boilerplate.

A page is read into blocks of text. Elements that never hold main text (menus, scripts, forms, what
is named an advert, a notice, reader comments and so on) are left out, and where a page has an
article or main element the rest is outside it. Names say little on most sites, so the token streams
of a host's different pages are laid end to end and their suffixes sorted by prefix doubling; the
intervals of suffixes with RUN common tokens or more are the long substrings that pages share. Those
on at least LEAST_PAGES pages and LEAST_SHARE of the host's are boilerplate: every token that they
cover goes, the runs between stay. Any longer repeat is covered by its runs of RUN tokens, so
doubling stops there.

A host of any size is dealt into shards by bytes. A run that enough of a host's pages hold is on as
large a share of the pages of some shard; these candidates are counted over all shards, so the
result is the same for any shard size.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WordHashes, cut, shingle_hashes, word_hashes
from millrace.llm.urls import host_of

#: Characters of a shard's texts, about; runs of all hosts that are broadcast, at most (beyond: a shuffled join).
SHARD_CHARS, BROADCAST_RUNS = 1_000_000, 1_000_000
#: Tokens of a boilerplate run at least; different pages that hold it at least, as a number and as a share of the host's.
RUN, LEAST_PAGES, LEAST_SHARE = 8, 3, 0.5
#: Texts that a task remembers in order to pass copies on once.
SEEN = 500_000

#: Elements and names that never hold main text, and elements that begin a block.
DROP_TAGS = frozenset("nav header footer aside form head title noscript template button select option textarea iframe svg math object canvas audio video dialog menu map fieldset label".split())
RAW_TAGS = "script|style|textarea|title|noscript|template|iframe|svg"
DROP_ROLES = frozenset("navigation banner contentinfo complementary dialog alertdialog alert search form menu menubar toolbar".split())
#: Names of what is no part of an article wherever it stands, and names of places of a page.
FOREIGN_NAMES = "ad|ads|advert|adverts|advertisement|advertising|adsense|adbox|adblock|adslot|adunit|adspace|adzone|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|comment|comments|commentlist|disqus|respond|replies|pagination|pager"
PLACE_NAMES = "banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|header|masthead|footer|sidebar|sidenav|aside|widget|notice|alert|popup|modal|overlay|toolbar|skip"
#: Beginnings of names that say what an element has or lacks, or is part of; and places that an article has itself.
STATE_NAMES = "has|have|no|not|with|without|is|show|shows|hide|hides"
OWN_NAMES = "article|post|entry|story|content"
OWN_PLACES = "header|masthead|banner"
BLOCK_TAGS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end may be left out; they never enclose others here.
LOOSE_TAGS = frozenset("p li dt dd tr td th thead tbody tfoot option".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|$)|<({RAW_TAGS})\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-z][a-z0-9:-]*)((?:\s++|/|\"[^\"]*\"|'[^']*'|[^>\"'\s/]++)*+)>|<[a-z/!?][^>]*(?:>|$)|([^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


_word = lambda words: re.compile(rf"(?:^|[-_])(?:{words})(?:$|[-_])")
_FOREIGN, _PLACE, _OTHER_PLACE = _word(FOREIGN_NAMES), _word(PLACE_NAMES), _word("|".join(x for x in PLACE_NAMES.split("|") if x not in OWN_PLACES.split("|")))
_STATE, _OWN, _LAST = re.compile(rf"(?:{STATE_NAMES})[-_]"), re.compile(rf"(?:{OWN_NAMES})[-_]"), re.compile(rf"(?:^|[-_])(?:{FOREIGN_NAMES})$")

FOREIGN, PLACE = 2, 1


def _named_away(value: str) -> int:
    """FOREIGN if one of an element's names is that of something that no article has in it, PLACE if one is that of another place of the page, else 0."""
    found = 0
    for name in value.split():
        if _STATE.match(name):
            continue
        if _FOREIGN.search(name):
            return FOREIGN
        if (_OTHER_PLACE if _OWN.match(name) else _PLACE).search(name):
            found = PLACE
    return found


def _dropped(tag: str, attributes: str) -> int:
    """FOREIGN, PLACE or 0: whether an element is left out, and if it is even around an article."""
    if tag in DROP_TAGS:
        return FOREIGN
    if not attributes or tag in ("html", "body", "main"):
        return 0
    found = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in DROP_ROLES:
            return FOREIGN
        if name in ("class", "id"):
            # an article goes by a name that ends as a comment's, an advert's and so on does
            found = max(found, (FOREIGN if any(_LAST.search(x) and not _STATE.match(x) for x in value.split()) else 0) if tag == "article" else _named_away(value))
    return found


def blocks(page: str | None) -> list[str]:
    """The page's blocks of possible main text in order, white space as single spaces."""
    if not page:
        return []
    found: list[tuple[bool, str]] = []
    parts: list[str] = []
    open_tags: list[tuple[str, int, bool]] = []  # tag, why it starts a dropped part if it does, starts a main part
    dropped = main = 0

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            found.append((main > 0, text))

    for raw, slash, tag, attributes, text in _TOKEN.findall(page):
        if text:
            if not dropped:
                parts.append(entities.unescape(text))
            continue
        if raw or not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS and not dropped:
            flush()
        if tag in VOID_TAGS:
            continue
        if slash:
            if any(t == tag for t, _, _ in open_tags):
                while True:
                    t, d, m = open_tags.pop()
                    dropped, main = dropped - (d > 0), main - m
                    if t == tag:
                        break
        elif not attributes.endswith("/"):
            if tag in LOOSE_TAGS and open_tags and open_tags[-1][0] == tag:  # left out by its name and never closed: the next one ends it
                _, d, m = open_tags.pop()
                dropped, main = dropped - (d > 0), main - m
            drop = _dropped(tag, attributes)
            if drop or tag in BLOCK_TAGS and tag not in LOOSE_TAGS:
                is_main = tag in ("article", "main") or "role" in attributes and re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I) is not None
                if is_main and dropped and not drop and all(d < FOREIGN for _, d, _ in open_tags):
                    # what was named as a place holds the article: its name is that of the whole page
                    open_tags = [(t, 0, m) for t, _, m in open_tags]
                    dropped = 0
                open_tags.append((tag, drop, is_main and not drop))
                dropped, main = dropped + (drop > 0), main + (is_main and not drop)
    if not dropped:
        flush()
    if any(m for m, _ in found):
        return [t for m, t in found if m]
    return [t for _, t in found]


def repeated_runs(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of streams that hold it) of every run of RUN tokens (given as hashes) of different streams."""
    streams = [x for x in streams if len(x) >= RUN]
    if not streams:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # end to end; the suffixes of fewer than RUN tokens of each stream start no run
    flat = np.concatenate(streams)
    size = np.fromiter(map(len, streams), np.int64, len(streams))
    page = np.repeat(np.arange(len(streams)), size)
    rank, width = np.unique(flat, return_inverse=True)[1].astype(np.int64), 1
    while width < RUN:
        ahead = np.full(len(rank), -1, np.int64)
        ahead[:-width] = rank[width:]
        rank = np.unique(rank * (len(rank) + 2) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        width *= 2
    whole = np.arange(len(flat)) + RUN <= np.repeat(np.cumsum(size), size)
    order = np.flatnonzero(whole)
    order = order[np.lexsort((page[order], rank[order]))]  # the suffix array by the first RUN tokens
    r, p = rank[order], page[order]
    new_run = np.concatenate([[True], r[1:] != r[:-1]])
    new_page = new_run | np.concatenate([[True], p[1:] != p[:-1]])
    held = np.bincount(np.cumsum(new_run) - 1, weights=new_page).astype(np.int64)  # different pages of each interval
    return shingle_hashes(flat, RUN)[order[new_run]], held


def covered(stream: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which tokens of a stream lie in one of these runs (hashes, sorted)."""
    cover = np.zeros(len(stream) + 1, np.int64)
    if len(stream) >= RUN and len(runs):
        own = shingle_hashes(stream, RUN)
        starts = np.flatnonzero(runs[np.minimum(np.searchsorted(runs, own), len(runs) - 1)] == own)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + RUN, -1)
    return np.cumsum(cover)[:-1] > 0


def _tokens(text: str | None) -> list[str]:
    return text.split(" ") if text else []


def _stream(text: str | None, memory: WordHashes) -> np.ndarray:
    return word_hashes([t.encode("utf-8", "surrogatepass") for t in _tokens(text)], memory)


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The texts of a shard in a batch as one compressed row: less to shuffle than a row each."""
    for frame in frames:
        for (host, shard), part in frame.groupby(["host", "shard"], dropna=False):
            texts = "\n".join(part["text"]).encode("utf-8", "surrogatepass")  # no text holds a line break
            yield pd.DataFrame({"host": [host], "shard": [shard], "pages": [part["pages"].iloc[0]], "shards": [part["shards"].iloc[0]], "texts": [zstandard.compress(texts)]})


def _different(texts: pd.Series) -> list[np.ndarray]:
    """Streams of the different texts in packed rows."""
    memory = WordHashes()
    return [_stream(t, memory) for t in {t for x in texts for t in zstandard.decompress(x).decode("utf-8", "surrogatepass").split("\n")}]


def block_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, text (its possible main text), page (hash of the text), first (whether this task meets the text first)."""
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            texts = [" ".join(blocks(x.as_py())) for x in batch.column(3)]
            hashes = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t in texts]
            first = []
            for key in zip(batch.column(2).to_pylist(), hashes, strict=True):
                first.append(key not in seen)
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
            columns = [*batch.columns[:3], pa.array(texts, pa.string()), pa.array(hashes, pa.int64()), pa.array(first, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "text", "page", "first"])

    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    return rows.mapInArrow(run, f"page_id {id_type}, url string, host string, text string, page long, first boolean")


def boilerplate(texts: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """host, run: hashes of the runs that enough different pages of a host hold. texts as of block_texts()."""
    pages = texts.groupBy("host", "page").agg(F.max(F.length("text")).alias("chars"))
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages"), F.greatest(F.ceil(F.sum("chars") / shard_chars), F.lit(1)).alias("shards"))
    hosts = cut(hosts.where(F.col("pages") >= LEAST_PAGES), "hosts")
    if hosts.isEmpty():
        return hosts.select("host", F.lit(0).cast("long").alias("run"))
    few = F.broadcast(hosts) if hosts.count() <= BROADCAST_RUNS else hosts
    dealt = texts.where("first").join(few, "host").select("host", "text", "pages", "shards", F.pmod("page", "shards").alias("shard"))
    dealt = dealt.mapInPandas(_packed, "host string, shard long, pages long, shards long, texts binary")

    def candidates(frame: pd.DataFrame) -> pd.DataFrame:
        streams = _different(frame["texts"])
        runs, held = repeated_runs(streams)
        one = frame["shards"].iloc[0] == 1
        good = held >= (max(LEAST_PAGES, math.ceil(LEAST_SHARE * frame["pages"].iloc[0])) if one else math.ceil(LEAST_SHARE * len(streams)))
        return pd.DataFrame({"host": frame["host"].iloc[0], "run": runs[good].view(np.int64), "whole": one})

    found = cut(dealt.groupBy("host", "shard").applyInPandas(candidates, "host string, run long, whole boolean"), "runs")
    done = found.where("whole").select("host", "run")
    if hosts.where("shards > 1").isEmpty():
        return done
    asked = found.where("not whole").select("host", "run").distinct().join(hosts, "host").select("host", "run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"host": [], "run": [], "n": []}).astype({"host": object, "run": "int64", "n": "int64"})
        runs, held = repeated_runs(_different(left["texts"]))
        good = np.isin(runs, right["run"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"host": left["host"].iloc[0], "run": runs[good].view(np.int64), "n": held[good]})

    counted = dealt.where("shards > 1").groupBy("host", "shard").cogroup(asked.groupBy("host", "shard")).applyInPandas(count, "host string, run long, n long")
    total = counted.groupBy("host", "run").agg(F.sum("n").alias("n")).join(hosts, "host")
    enough = (F.col("n") >= LEAST_PAGES) & (F.col("n") >= F.ceil(LEAST_SHARE * F.col("pages")))
    return done.unionByName(total.where(enough).select("host", "run"))


def _without(texts: pd.Series, runs: pd.Series) -> pd.Series:
    memory, out = WordHashes(), []
    for text, gone in zip(texts, runs, strict=True):
        marks = covered(_stream(text, memory), np.sort(np.asarray(gone, np.int64).view(np.uint64)))
        out.append(" ".join(t for t, c in zip(_tokens(text), marks, strict=True) if not c) if marks.any() else text)
    return pd.Series(out, dtype=object)


def main_texts(pages: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages (page_id, url, html; other columns, whatever their names, are ignored).

    A null or empty html, and one without main text, gives an empty text. A null url, or one without
    a host, belongs to the host ''. Character references are decoded, white space inside a block is
    one space, and blocks are joined by one space in page order. Repeated rows give repeated rows;
    pages of equal text count once as evidence, so a page under several urls is no boilerplate, nor
    is anything on hosts of fewer than LEAST_PAGES different pages. Pages of any length are read
    whole. An empty table gives an empty table.
    """
    texts = cut(block_texts(pages), "texts", "zstd")
    runs = cut(boilerplate(texts, shard_chars), "boilerplate")
    out = lambda rows, text: rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
    n = runs.count()
    if not n:
        return out(texts, F.col("text"))
    lists = runs.groupBy("host").agg(F.collect_list("run").alias("runs"))
    both = texts.join(F.broadcast(lists) if n <= BROADCAST_RUNS else lists, "host", "left")
    clean = F.pandas_udf(_without, "string").asNondeterministic()
    return out(both.where("runs is null"), F.col("text")).unionByName(out(both.where("runs is not null"), clean("text", "runs")))
