"""Chat formatting by linking quotations, with DataFrame functions only.

Lines that start with '>' are quotations; the number of marks is the level. A run of lines of one
level is a quoted passage. It is normalised, so that other line breaks make no difference, hashed
and joined to the first earlier message of its conversation with an own passage, paragraph or line
of that hash; where the whole passage is unknown its paragraphs are looked for, then its lines. A
message replies to the message that most of its quotations of the lowest level come from. Replies are
ordered behind what they answer, and quotations are taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.ranking import with_row_number
from millrace.llm.common import cut

#: A line that announces a quotation, dropped only where a quotation follows.
ATTRIBUTION = r"(?i)^\s*(on\b.*\bwrote|le\b.*a écrit|am\b.*schrieb.*|el\b.*escribió)\s*:\s*$"
_MARKS = r"^(?:\s*>)+"
#: Whether a text may have a quoted line at all; a text without one is not taken apart.
QUOTES = r"(?m)^\s*>"


def lines_of(text: Column) -> Column:
    """Array of (level, body) of the text's lines, a final carriage return aside."""
    return F.transform(
        F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\r$", "")),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), r"[^>]", "")).alias("level"), F.regexp_replace(x, _MARKS, "").alias("body")),
    )


def normalised(body: Column) -> Column:
    """Lower-cased words with single spaces, without surrounding punctuation; empty if nothing remains."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(body), r"\s+", " ")), r"^[\p{Punct} ]+|[\p{Punct} ]+$", "")


def own_text(text: Column) -> Column:
    """The unquoted lines, without announcements of a quotation, blank ends cut."""
    lines = lines_of(text)
    # each line beside the next one's level
    placed = F.zip_with(lines, F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda s, t: F.struct(s["level"].alias("level"), s["body"].alias("body"), t["level"].alias("next")))
    own = F.filter(placed, lambda s: (s["level"] == 0) & ~(s["body"].rlike(ATTRIBUTION) & (F.coalesce(s["next"], F.lit(0)) > 0)))
    parted = F.array_join(F.transform(own, lambda s: s["body"]), "\n")
    whole = F.regexp_replace(text, r"\r(?=\n|\z)", "")
    return F.regexp_replace(F.when(text.rlike(QUOTES), parted).otherwise(whole), r"^\s+|\s+$", "")


def runs_of(lines: Column) -> Column:
    """Array of (level, part): the runs of lines of one level; lines has to be a column of its own."""
    n = F.size(lines)
    starts = F.filter(F.transform(lines, lambda s, i: F.when((i == 0) | (s["level"] != F.get(lines, i - 1)["level"]), i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(n))
    return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(lines, a)["level"].alias("level"), F.transform(F.slice(lines, a + 1, b - a), lambda s: s["body"]).alias("part")))


def units(part: Column) -> Column:
    """Array of (kind, passage, n): the passage (3), its paragraphs (2) and its lines (1), normalised, with the number of lines with words."""
    spoken = lambda text: F.size(F.filter(F.split(text, "\n"), lambda x: normalised(x) != "")).cast("long")
    whole = F.array_join(part, "\n")
    unit = lambda kind, text: F.struct(F.lit(kind).alias("kind"), normalised(text).alias("passage"), spoken(text).alias("n"))
    paragraphs = F.transform(F.split(whole, r"\n\s*\n"), lambda x: unit(2, x))
    return F.filter(F.concat(F.array(unit(3, whole)), paragraphs, F.transform(part, lambda x: unit(1, x))), lambda u: u["passage"] != "")


def conversations(messages: DataFrame) -> DataFrame:
    """One row a message: its columns with text without quotations, and how it hangs together.

    reply_to: turn of the message that it quotes (most quoted lines of its lowest quoted level; on a
    tie the later one), null if it quotes nothing known. root_turn and depth: start of its thread and
    steps from there. position: its place in its conversation, from 1, in the order (root_turn, depth,
    turn), in which threads stand one behind the other and each reply behind what it answers.
    n_quoted, n_linked: quoted lines with words, and those of passages, or of their paragraphs or
    lines, found in an earlier message. Linking is within a conv_id; what several earlier messages
    hold is the first one's. Only minima and counts are gathered by key, and places come from
    range-partitioned sorts, so a conversation or passage of any size is spread.

    Null texts stay null without quotations; empty ones stay empty. Messages with a null conv_id or
    turn quote nothing and have no position. Repeated rows of one (conv_id, turn) are read together
    for links, share a position and are returned one by one. A text of any length is read whole.
    Columns called like new ones are replaced. An empty table gives an empty table.
    """
    new = ["reply_to", "root_turn", "depth", "position", "n_quoted", "n_linked", "max_level"]
    base = messages.drop(*new)
    key = ["conv_id", "turn"]
    known = base.where("conv_id is not null and turn is not null").select(*key, "text")
    # only conversations in which somebody quotes are read line by line
    quoting = known.where(F.col("text").rlike(QUOTES)).select("conv_id").distinct()
    lines = cut(known.join(quoting, "conv_id", "left_semi").select(*key, F.monotonically_increasing_id().alias("row"), lines_of(F.col("text")).alias("lines")), "lines")
    runs = lines.select(*key, "row", F.posexplode(runs_of(F.col("lines"))).alias("run", "r")).select(*key, "row", "run", F.col("r.level").alias("level"), F.col("r.part").alias("part"))
    parts = cut(runs, "parts").select(*key, "row", "run", "level", F.explode(units(F.col("part"))).alias("u"))
    parts = parts.select(*key, "row", "run", "level", F.col("u.kind").alias("kind"), F.md5("u.passage").alias("passage"), F.col("u.n").alias("n"))
    quoted = cut(parts.where("level > 0"), "quoted")
    origin = parts.where("level = 0").groupBy("conv_id", "passage").agg(F.min("turn").alias("origin"))
    asked = cut(quoted.select("conv_id", "passage").distinct(), "asked")
    found = cut(origin.join(asked, ["conv_id", "passage"], "left_semi"), "origins")
    linked = quoted.join(found, ["conv_id", "passage"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    linked = cut(linked.select(*key, "row", "run", "level", "kind", "origin", "n"), "linked")
    best = cut(linked.where("origin is not null").groupBy("row", "run").agg(F.max("kind").alias("kind")), "best")
    votes = linked.where("origin is not null").join(best, ["row", "run", "kind"]).groupBy(*key, "level", "origin").agg(F.sum("n").alias("n"))
    votes = cut(votes, "votes")
    # every quoted line is in one whole passage
    told = linked.where("kind = 3").groupBy(*key).agg(F.sum("n").alias("n_quoted"), F.max("level").alias("max_level"))
    totals = told.join(votes.groupBy(*key).agg(F.sum("n").alias("n_linked")), key, "left")
    replies = cut(votes.groupBy(*key).agg(F.max_by("origin", F.struct(-F.col("level"), "n", "origin")).alias("reply_to")), "replies")
    facts = totals.join(replies, key, "left").join(_threads(replies), key, "left")
    turns = known.select(*key).distinct().join(facts, key, "left").withColumns({"root_turn": F.coalesce("root_turn", "turn"), "depth": F.coalesce("depth", F.lit(0)).cast("long")})
    placed = cut(with_row_number(turns, ["root_turn", "depth", "turn"], "position", 1, ["conv_id"]), "placed")
    both = base.join(placed, key, "left")
    return both.select(
        *[own_text(F.col("text")).alias("text") if c == "text" else base[c] for c in base.columns],
        "reply_to",
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "position",
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("max_level", F.lit(0)).cast("long").alias("max_level"),
    )


def _threads(replies: DataFrame) -> DataFrame:
    """conv_id, turn, root_turn, depth of every reply, by pointer doubling: as many rounds as the longest chain has bits."""
    at = replies.select("conv_id", "turn", F.col("reply_to").alias("root_turn"), F.lit(1).cast("long").alias("depth"))
    while True:
        up = at.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("further"), F.col("depth").alias("steps"))
        moved = cut(at.join(up, ["conv_id", "root_turn"], "left"), "threads")
        at = moved.select("conv_id", "turn", F.coalesce("further", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("steps", F.lit(0))).alias("depth"))
        if moved.where("further is not null").isEmpty():
            return at
