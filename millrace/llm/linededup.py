"""Removal of repeated line runs with a suffix array over line-ID sequences.

Documents are sequences of line IDs. Prefix doubling ranks the suffixes that start in repeated lines
by their first 1, 2, 4, ... lines; a rank is a row number of a range-partitioned sort, so it keeps
the order and is not counted in one task. Suffixes that share their first l lines are one interval
of longest common prefix l or more, named by two overlapping ranks. In each interval the first
occurrence stays and the later ones are deleted.

Runs are looked up by their minimal windows: from each line forward, and from each line backward,
the fewest lines with min_words words. Every line of a repeated run of min_words words or more lies
in a minimal window inside that run, and equal runs have equal windows, so the later copies of the
windows are together all later copies of maximal repeated runs of that size, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import cut

#: Words that a run needs in all to be deleted where it repeats.
MIN_WORDS = 50
_DOC = ["doc_id", "version"]
_WINDOWS = "doc_id long, version long, stretch long, seq long, r long, starts array<int>"


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, version (hash of the text), seq (number among lines with words), pos (among all lines), line and line2 (128 bits of hash), n_words."""
    placed = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("value")))
    spoken = F.filter(placed, lambda s: s["value"].rlike(r"\S"))
    lines = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.posexplode(spoken).alias("seq", "at"))
    return lines.select(*_DOC, F.col("seq").cast("long").alias("seq"), F.col("at.pos").alias("pos"), F.xxhash64("at.value").alias("line"), F.xxhash64(F.lit(1), "at.value").alias("line2"), F.regexp_count("at.value", F.lit(r"\S+")).alias("n_words"))


def _ranked(keys: DataFrame, *by: str) -> DataFrame:
    """keys with their rank in the order of by: row numbers of a range-partitioned sort, with gaps."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(keys.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _minimal_windows(min_words: int):
    """For frames sorted by document and seq: stretches of lines without a gap, and the lengths of the minimal windows that start at each line."""

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        doc, version, seq = (frame[c].to_numpy() for c in ("key", "version", "seq"))
        new = np.ones(len(frame), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (seq[1:] != seq[:-1] + 1)
        stretch, words = np.cumsum(new), frame["n_words"].to_numpy()
        upto = np.cumsum(words)
        before = upto - words
        rows = np.arange(len(frame))
        end = np.searchsorted(upto, before + min_words)
        ok = (end < len(frame)) & (stretch[np.minimum(end, len(frame) - 1)] == stretch)
        start = np.searchsorted(before, upto - min_words, side="right") - 1
        fine = (start >= 0) & (stretch[np.maximum(start, 0)] == stretch)
        first, size = np.concatenate([rows[ok], start[fine]]), np.concatenate([end[ok] - rows[ok], rows[fine] - start[fine]]) + 1
        pairs = np.unique(np.stack([first, size], 1), axis=0) if len(first) else np.zeros((0, 2), np.int64)
        inside = np.zeros(len(frame) + 1, np.int64)
        np.add.at(inside, pairs[:, 0], 1)
        np.add.at(inside, pairs[:, 0] + pairs[:, 1], -1)
        used = np.cumsum(inside)[:-1] > 0
        cuts = np.searchsorted(pairs[:, 0], rows)
        ends = np.searchsorted(pairs[:, 0], rows, side="right")
        first_seq = seq[np.maximum.accumulate(np.where(new, rows, 0))]  # names the stretch
        out = frame[["doc_id", "version"]].assign(stretch=first_seq, seq=seq, r=frame["r"], starts=[pairs[a:b, 1].astype(np.int32) for a, b in zip(cuts, ends, strict=True)])
        return out[used]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []  # rows of a document that may go on in the next batch
        for frame in frames:
            kept.append(frame)
            last = frame.iloc[-1] if len(frame) else None
            if last is None or (kept[0]["key"].iloc[0] == last["key"] and kept[0]["version"].iloc[0] == last["version"]):
                continue
            whole = pd.concat(kept, ignore_index=True)
            same = ((whole["key"] == last["key"]) & (whole["version"] == last["version"])).to_numpy()
            yield find(whole[~same])
            kept = [whole[same]]
        if kept:
            yield find(pd.concat(kept, ignore_index=True))

    return run


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, version, removed: positions of the lines in later copies of runs of min_words words or more; documents without any are left out."""
    lines = cut(line_table(docs), "lines")
    ranks = _ranked(lines.groupBy("line", "line2").agg(F.count("*").alias("n")).where("n > 1").select("line", "line2"), "line", "line2")
    repeated = lines.join(ranks, ["line", "line2"]).select(*_DOC, "seq", "pos", "n_words", F.col("rank").alias("r"))
    dealt = cut(repeated.repartition(*_DOC).dropDuplicates([*_DOC, "seq"]), "suffixes")
    sorted_ = dealt.repartition(*_DOC).sortWithinPartitions(*_DOC, "seq").select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "version", "seq", "n_words", "r")
    level = cut(sorted_.mapInPandas(_minimal_windows(min_words), _WINDOWS), "level")
    longest = level.agg(F.max(F.array_max("starts"))).first()[0] or 0

    size, named = 1, None
    while size <= longest:
        place = Window.partitionBy(*_DOC, "stretch").orderBy("seq")
        # windows of size to 2 * size - 1 lines: two ranks of size lines each cover them
        # and stand n - size lines apart: where a line between is gone, the window is not repeated
        ahead = F.collect_list(F.struct("seq", "r")).over(place.rowsBetween(0, size - 1))
        mine = F.filter("starts", lambda n: (n >= size) & (n < 2 * size))
        windows = level.withColumn("ahead", ahead).select(*_DOC, "seq", F.col("r").alias("left"), "ahead", F.explode(mine).alias("n"))
        windows = windows.where(F.size("ahead") > F.col("n") - size).withColumn("end", F.element_at("ahead", (F.col("n") - size + 1).cast("int")))
        windows = windows.where(F.col("end.seq") == F.col("seq") + F.col("n") - size).select(*_DOC, "seq", "n", "left", F.col("end.r").alias("right"))
        named = windows if named is None else named.unionByName(windows)
        if 2 * size <= longest:
            pairs = level.withColumn("next", F.lead("r", size).over(place)).withColumn("there", F.lead("seq", size).over(place)).where(F.col("there") == F.col("seq") + size)
            twice = _ranked(pairs.groupBy("r", "next").agg(F.count("*").alias("c")).where("c > 1").select("r", "next"), "r", "next")
            level = cut(pairs.join(twice, ["r", "next"]).select(*_DOC, "stretch", "seq", F.col("rank").alias("r"), "starts"), "level")
        size *= 2
    if named is None:
        return dealt.select(*_DOC, F.array("pos").alias("removed")).limit(0)
    named = cut(named, "windows")
    here = F.struct(*_DOC, "seq")
    first = named.groupBy("n", "left", "right").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first != last")
    # written first, so that Spark may split a window with very many copies at the join
    later = named.join(cut(first, "first"), ["n", "left", "right"]).where(~F.struct(*_DOC, "seq").eqNullSafe(F.col("first")))
    gone = later.select(*_DOC, F.explode(F.sequence("seq", F.col("seq") + F.col("n") - 1)).alias("seq")).distinct()
    where = dealt.alias("d").join(gone.alias("g"), F.expr("d.doc_id <=> g.doc_id and d.version = g.version and d.seq = g.seq"), "left_semi")
    return where.groupBy(*_DOC).agg(F.sort_array(F.collect_list("pos")).alias("removed"))


def _without(texts: pd.Series, removed: pd.Series) -> pd.Series:
    out = []
    for text, gone in zip(texts, removed, strict=True):
        if text is None:
            out.append(None)
            continue
        lines = text.split("\n")
        drop = set(gone.tolist())
        out.append("\n".join(x for i, x in enumerate(lines) if i not in drop))
    return pd.Series(out, dtype=object)


#: Not to be evaluated again by a filter on its result.
_without_lines = F.pandas_udf(_without, T.StringType()).asNondeterministic()


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text without later copies of repeated line runs, and removed_lines: the positions deleted (0 is the first line).

    First means the smallest doc_id, a null one before all, then the text's hash, then the line. Runs
    repeated inside one document count too. Rows repeated with the same doc_id and text are one
    document and stay alike. Null texts stay null, empty ones empty, with no removed lines; a blank
    line neither parts a run nor is deleted. A column called removed_lines is replaced; other
    columns pass through. An empty table gives an empty table.
    """
    base = docs.drop("removed_lines")
    removed = repeated_lines(docs, min_words).select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "removed")
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_version"))
    both = base.join(removed.hint("shuffle_hash"), match, "left")
    clean = F.coalesce(_without_lines(F.when(F.col("removed").isNotNull(), F.col("text")), F.col("removed")), F.col("text"))
    return both.select(*[clean.alias("text") if c == "text" else base[c] for c in base.columns], F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"))
