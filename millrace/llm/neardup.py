"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A sketch has SIZE coordinates. In round i each shingle falls into a hashed bin with value (i, hash);
a bin keeps its smallest value. After SIZE rounds, round SIZE + j throws every shingle into bin j, so
after 2 * SIZE rounds at the latest no bin is empty; a set of SIZE * ln(SIZE) shingles fills all in
about the first round. Two sets agree in a coordinate with the probability of their Jaccard
similarity, and the number of agreements is concentrated as for independent MinHashes.

Texts with equal shingle sets are one class from the start, and a class is compared with the hubs of
its band buckets only, so copies and near-copies of one text cost comparisons by member, not pairs.
What the hubs leave open meets through rare shingles (see meeting_keys).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WordHashes, cut, give_back, mix, shingle_hashes, word_hashes, words
from millrace.llm.graph import components

#: Words of a shingle; similarity in hundredths from which documents are linked.
WIDTH, PERCENT = 5, 75
#: Coordinates in a band and bands. At similarity 0.75 a link shares no band once in 190,000.
ROWS, BANDS = 4, 32
SIZE = ROWS * BANDS
#: log2 of the bits of the filter of wanted documents, at most: 16 MB.
FILTER_BITS = 27
#: Size classes of shingle sets grow by this factor. Rounds in which one class stands for a key before all of a key's are paired.
SIZE_STEP, LEAD_ROUNDS = 1.05, 3
_SKETCH = "doc_id long, h long, n_shingles long, digest binary, bands array<long>"


def shingle_set(text: str | None, memory: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    return np.unique(shingle_hashes(word_hashes(words(text), memory), WIDTH))


def sketch(elements: np.ndarray) -> np.ndarray:
    """SIZE coordinates of a set that is not empty."""
    out = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64)
    filled, start = False, 0
    while start < SIZE and not filled:
        stop = min(SIZE, start + max(1, 1024 // len(elements)))
        rounds = np.arange(start, stop, dtype=np.uint64)[:, None]
        h = mix(elements[None, :] + (rounds + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        bins = ((h >> np.uint64(32)) * np.uint64(SIZE) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out, bins.ravel(), ((rounds << np.uint64(56)) | (mix(h) >> np.uint64(8))).ravel())
        filled, start = bool((out < np.iinfo(np.uint64).max).all()), stop
    if not filled:
        for j in np.flatnonzero(out == np.iinfo(np.uint64).max):
            h = mix(elements + np.array([SIZE + j + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out[j] = (mix(h) >> np.uint64(8)).min() | np.uint64(SIZE + j) << np.uint64(56)
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    parts = coordinates.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
    return key.view(np.int64)


def digest_of(elements: np.ndarray) -> bytes | None:
    """128 bits that name the whole set; None for an empty one."""
    return xxhash.xxh3_128_digest(elements.tobytes()) if len(elements) else None


def row_key() -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64("doc_id", "text")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, h (row_key), n_shingles, digest of the whole set (null if empty), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            sizes, digests, bands = [], [], []
            for t in batch.column(2):
                s = shingle_set(t.as_py(), memory)
                sizes.append(len(s))
                digests.append(digest_of(s))
                bands.append(band_keys(sketch(s)) if len(s) else [])
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "n_shingles", "digest", "bands"])
        memory.clear()
        give_back()

    return docs.select("doc_id", row_key().alias("h"), "text").mapInArrow(run, _SKETCH)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls and the whole shingle set of the classes in wanted (cls, h and digest of one of its rows).

    A bitmap of row keys, FILTER_BITS bits at most, tells tasks which texts to read, so the other
    texts are neither read by Python nor shuffled; what it lets through by chance goes at the join.
    Where there are too many for it, rows are joined before. Both ways give the same sets.
    """
    n = wanted.count()
    bits = max(16, (8 * n).bit_length())
    rows = docs.select(row_key().alias("h"), "text")
    if bits > FILTER_BITS:
        rows, mask_on = rows.join(wanted.select("h").distinct(), "h", "left_semi"), None
    else:
        value = F.pmod("h", F.lit(2**bits)) + 1
        found = wanted.select(value.alias("v")).groupBy(F.bitmap_bucket_number("v").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("b")).collect()
        mask = np.zeros((2 ** (bits - 15), 2**12), np.uint8)
        for r in found:
            mask[r.k - 1] = np.frombuffer(r.b, np.uint8)
        mask_on = docs.sparkSession.sparkContext.broadcast(mask.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            if mask_on:
                at = batch.column(0).to_numpy()
                batch = batch.filter(pa.array(mask_on.value[at >> 3] >> (at & 7) & 1 == 1))
            sets = [shingle_set(t.as_py(), memory) for t in batch.column(1)]
            digests = pa.array([digest_of(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([digests, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["digest", "shingles"])
        memory.clear()
        give_back()

    texts = rows.select(F.pmod("h", F.lit(2**bits)).alias("at"), "text").mapInArrow(run, "digest binary, shingles array<long>")
    return texts.join(wanted.select("cls", "digest"), "digest").select("cls", "shingles").dropDuplicates(["cls"])


def compared(pairs: DataFrame, sets: DataFrame, more: list[str] = ()) -> DataFrame:
    """The pairs (a, b, more) of classes with na, nb (sizes of their whole shingle sets) and common (of the intersection)."""
    side = lambda x: sets.select(F.col("cls").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.select("a", "b", *more).join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", *more, F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))


def linked() -> Column:
    """Whether a compared pair is similar enough."""
    return 100 * F.col("common") >= PERCENT * (F.col("na") + F.col("nb") - F.col("common"))


def candidates(open_rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of a hub and a class from the classes (cls) in each band bucket (key), size being the bucket's.

    A class is popular as its buckets are large; its hub is the most popular one it shares a bucket
    with, near-copies thus having their original. Each class is paired with the hubs of all classes
    in its buckets, so any two classes that share a bucket have been compared with a common hub.
    """
    popular = open_rows.groupBy("cls").agg(F.sum("size").alias("popularity"))
    lead = open_rows.join(popular, "cls").groupBy("key").agg(F.max(F.struct("popularity", "cls")).alias("lead"))
    hubs = open_rows.join(lead, "key").groupBy("cls").agg(F.max("lead")["cls"].alias("hub"))
    near = open_rows.join(hubs, "cls").select("key", "hub").distinct()
    return open_rows.select("key", "cls").join(near, "key").where("cls != hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()


def still_open(members: DataFrame) -> DataFrame:
    """cls of the members (hub, cls, label, n, common) that may link with a member of the same hub and another label.

    |A & B| <= min(|A & H|, |B & H|) + min(|A - H|, |B - H|) for classes A and B of a hub H. Each
    member is held against the best that the others of its hub have: all of them, or, for the hub's
    most frequent label, all but that label.
    """
    own = members.withColumn("extra", F.col("n") - F.col("common"))
    labels = own.groupBy("hub", "label").agg(F.count("*").alias("times"), F.max("common").alias("c"), F.max("extra").alias("e"), F.min("n").alias("least"))
    labels = cut(labels, "labels")
    big = labels.groupBy("hub").agg(F.count("*").alias("kinds"), F.max(F.struct("times", "label"))["label"].alias("big")).where("kinds > 1")
    other = F.col("label") != F.col("big")
    best = [f(F.when(other, F.col(x)) if which == "some" else F.col(x)).alias(f"{which}_{x}") for which in ("all", "some") for f, x in ((F.max, "c"), (F.max, "e"), (F.min, "least"))]
    hubs = labels.join(big, "hub").groupBy("hub", "big").agg(*best)
    near = own.join(hubs, "hub")
    c, e, least = (F.when(other, F.col(f"all_{x}")).otherwise(F.col(f"some_{x}")) for x in ("c", "e", "least"))
    can = (100 + PERCENT) * (F.least("common", c) + F.least("extra", e)) >= PERCENT * (F.col("n") + least)
    return near.where(can).select("cls").distinct()


def meeting_keys(wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """key, cls, n, left, own, its: any two classes of wanted (cls) that are similar enough share a key at which may_link() holds.

    Shingles are ordered by how many of these classes hold them, rare ones first. If two sets of n
    and m shingles are linked, they have PERCENT / (100 + PERCENT) * (n + m) shingles in common, so
    the first common one has at least as many from its place on (left) in each. A shingle therefore
    is a key only for partners of a size that its place allows, and the frequent end of a set is
    never a key. Keys are hashes of (shingle, both size classes): equal hashes by chance only cost a
    comparison. Only classes of the size class that the other asks for (own of one is its of the
    other) need to be paired at a key, as others meet at that of their own sizes.
    """
    told = cut(sets.join(wanted, "cls", "left_semi").select("cls", F.size("shingles").alias("n"), F.explode("shingles").alias("s")), "told")
    times = told.groupBy("s").agg(F.count("*").alias("times")).where("times > 1")
    # a shingle of one class alone is no key; those come first, and their number gives the places of the rest
    order = told.join(times, "s").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("times", "s"))).alias("order"))
    size_class = lambda x: F.floor(F.log(x.cast("double")) / F.lit(float(np.log(SIZE_STEP)))).cast("int")
    placed = order.select("cls", "n", F.size("order").alias("shared"), F.posexplode("order").alias("i", "o")).withColumn("left", F.col("shared") - F.col("i"))
    low = F.ceil(F.col("n") * PERCENT / 100)
    high = F.least(F.floor(F.col("n") * 100 / PERCENT), F.floor(F.col("left") * ((100 + PERCENT) / PERCENT) + 1e-9) - F.col("n"))
    keyed = placed.withColumns({"own": size_class(F.col("n")), "low": low, "high": high}).where("high >= low")
    # neighbouring whole numbers have logarithms far further apart than rounding, so classes keep the order of sizes
    sizes = F.sequence(size_class(F.col("low")), size_class(F.col("high")))
    spread = keyed.select("cls", "n", "left", F.col("o.s").alias("s"), "own", F.explode(sizes).alias("its"))
    return spread.select(F.xxhash64("s", F.least("own", "its"), F.greatest("own", "its")).alias("key"), "cls", "n", "left", "own", "its")


def may_link(n: str, left: str, m: str, its_left: str) -> Column:
    """Whether sets of n and m shingles may be linked if this is their first common one."""
    return (100 + PERCENT) * F.least(left, its_left) >= PERCENT * (F.col(n) + F.col(m))


def relabelled(rows: DataFrame, moves: list[DataFrame]) -> DataFrame:
    """rows (cls; other columns stay) with label, the class that names cls's component after moves (node, label), one upon the other."""
    rows = rows.drop("label").withColumn("label", F.col("cls"))
    return reduce(moved, moves, rows)


def moved(rows: DataFrame, move: DataFrame) -> DataFrame:
    """rows with the labels that a move (node, label) between labels gives."""
    step = move.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return rows.join(step, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")


def more_moves(keys: DataFrame, sets: DataFrame, moves: list[DataFrame]) -> list[DataFrame]:
    """moves and what links between classes that share a key of meeting_keys() add to them.

    In each of LEAD_ROUNDS rounds one class of a key is compared with those of other components
    there and then leaves the key; what it links with becomes one component, and a key whose classes
    are all of one is done. What remains is paired within its key, those of the key's most frequent
    component with the others only. New links join components as they stand, so only those of a round
    are walked through, never the ones before them again.
    """
    rows = cut(relabelled(keys, moves), "keyed")
    for round_ in range(LEAD_ROUNDS + 1):
        ends = rows.groupBy("key").agg(F.min(F.struct("label", "cls", "n", "left", "own")).alias("lead"), F.max("label").alias("last")).where("lead.label != last")
        rows = cut(rows.join(ends.select("key", F.col("lead.label").alias("its_label"), F.col("lead.cls").alias("its_cls"), F.col("lead.n").alias("m"), F.col("lead.left").alias("its_left"), F.col("lead.own").alias("its_own")), "key"), "mixed")
        if rows.isEmpty():
            break
        if round_ < LEAD_ROUNDS:
            pairs = rows.where((F.col("label") != F.col("its_label")) & (F.col("its") == F.col("its_own")) & may_link("n", "left", "m", "its_left")).select(F.col("its_cls").alias("x"), F.col("cls").alias("y"), F.col("its_label").alias("lx"), F.col("label").alias("ly"))
            rows = rows.where("cls != its_cls").select("key", "cls", "n", "left", "own", "its", "label")
        else:
            times = rows.groupBy("key", "label").agg(F.count("*").alias("times"))
            big = times.groupBy("key").agg(F.max(F.struct("times", "label"))["label"].alias("big"))
            few = cut(rows.join(big, "key").where("label != big").select("key", F.col("cls").alias("x"), F.col("label").alias("lx"), F.col("n").alias("m"), F.col("left").alias("its_left"), F.col("own").alias("its"), "big"), "few")
            pairs = few.join(rows.select("key", F.col("cls").alias("y"), F.col("label").alias("ly"), "n", "left", "its"), ["key", "its"]).where(F.expr("lx < ly or ly = big") & may_link("n", "left", "m", "its_left")).select("x", "y", "lx", "ly")
        first = F.col("x") < F.col("y")
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(first, F.col("lx")).otherwise(F.col("ly")).alias("la"), F.when(first, F.col("ly")).otherwise(F.col("lx")).alias("lb"))
        pairs = cut(pairs.distinct(), "pairs")
        found = cut(compared(pairs, sets, ["la", "lb"]).where(linked()).select(F.col("la").alias("a"), F.col("lb").alias("b")), "found")
        if not found.isEmpty():
            moves = [*moves, components(found)]
            rows = cut(moved(rows, moves[-1]), "keyed")
    return moves


def placed_rows(docs: DataFrame) -> DataFrame:
    """groups() with h (row_key), and label: names the group, null for a row without shingles."""
    found = cut(sketches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "sketches")
    classes = found.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("h").alias("h"), F.first("bands").alias("bands"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    rows = cut(classes.select("cls", F.explode("bands").alias("key")), "bands")
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    open_rows = cut(rows.join(shared, "key"), "open")
    pairs = cut(candidates(open_rows), "candidates")
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    wanted = cut(classes.select("cls", "digest", "h").join(wanted, "cls", "left_semi"), "wanted")
    sets = cut(shingle_sets(docs, wanted), "sets")
    tested = cut(compared(pairs, sets), "tested")
    moves = [components(tested.where(linked()).select("a", "b"))]
    members = relabelled(tested.select(F.col("a").alias("hub"), F.col("b").alias("cls"), F.col("nb").alias("n"), "common"), moves)
    open_members = cut(still_open(cut(members, "members")), "open")
    if not open_members.isEmpty():
        moves = more_moves(meeting_keys(open_members, sets), sets, moves)
    labels = cut(relabelled(classes.select("cls", "digest", "rep"), moves), "labels")
    least = labels.groupBy("label").agg(F.min("rep").alias("component_id"))
    own = cut(labels.join(least, "label").select("digest", "label", "component_id", (F.col("cls") == F.col("label")).alias("leads")), "own")
    base = found.select("doc_id", "h", "n_shingles", "digest")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & F.col("leads"))
    some = base.where("digest is not null").join(own, "digest").select("doc_id", "h", "n_shingles", "component_id", kept.alias("kept"), "label")
    none = base.where("digest is null").select("doc_id", "h", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(None).cast("long").alias("label"))
    return some.unionByName(none)


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs (doc_id, text; other columns are ignored).

    Texts with equal sets are one class before anything is compared; sets are named by 128 bits.
    Classes that share a band bucket are compared with common hubs, whole set against whole set; those
    that may still link with others of their hub meet by rare shingles and are compared themselves. So a link is lost only if its texts share no band, whatever the size of a group.

    Rows with a null or empty text have no shingles, link with nothing, are their own component and
    are kept. Repeated rows are alike. Rows of one doc_id with different texts are placed each by its
    own text. Rows without a doc_id take part like others: a group's component_id is its smallest
    doc_id, and where no row of a group has one it is null and one class of the group is kept. Very
    long texts are compared whole. An empty table gives an empty table.
    """
    return placed_rows(docs).select("doc_id", "n_shingles", "component_id", "kept")


def kept_rows(docs: DataFrame) -> DataFrame:
    """doc_id and h (row_key) of one row of each group; rows without shingles are left out."""
    of_group = placed_rows(docs).where("kept and label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "h")).alias("row"))
    return of_group.select("row.doc_id", "row.h")
