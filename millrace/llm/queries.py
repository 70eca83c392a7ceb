"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from millrace.llm import align, bpe, decontam, html, knn, langid, linededup, lm, neardup, packing, periodic, quotes, urls
from millrace.llm.common import cut, fold, small_batches, table


def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under a model of those whose crc32 fold of seven is not 2."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = fold(F.col("doc_id"), 7)
    scored, _ = lm.score_documents(docs.withColumn("held_out", F.coalesce(remainder == 2, F.lit(True))), ~F.col("held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotations, with what it answers and where it stands in its conversation."""
    return quotes.conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


_NORMAL = r"regexp_replace(trim(regexp_replace(lower({}), '\s+', ' ', 'g')), '^[[:punct:] ]+|[[:punct:] ]+$', '', 'g')"
_SPOKEN = "len(list_filter(string_split({}, chr(10)), lambda y: " + _NORMAL.format("y") + " <> ''))"
OP2_SQL = rf"""
WITH RECURSIVE l AS (
  SELECT conv_id, turn, role, text, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\r$', '')) AS raw, row_number() OVER () AS row FROM conversations
), n AS (
  SELECT *, list_transform(raw, lambda x: len(regexp_replace(regexp_extract(x, '^(?:\s*>)+'), '[^>]', '', 'g'))) AS levels, list_transform(raw, lambda x: regexp_replace(x, '^(?:\s*>)+', '')) AS bodies FROM l
), e AS (
  SELECT row, conv_id, turn, unnest(levels) AS level, unnest(bodies) AS body, unnest(range(len(levels))) AS i FROM n WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), f AS (
  SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY row ORDER BY i) THEN 1 ELSE 0 END AS new FROM e
), g AS (
  SELECT *, sum(new) OVER (PARTITION BY row ORDER BY i) AS run FROM f
), w AS (
  SELECT row, conv_id, turn, run, level, string_agg(body, chr(10) ORDER BY i) AS whole FROM g GROUP BY ALL
), u AS (
  SELECT row, conv_id, turn, run, level, 3 AS kind, whole AS t FROM w
  UNION ALL SELECT row, conv_id, turn, run, level, 2, unnest(string_split_regex(whole, '\n\s*\n')) FROM w
  UNION ALL SELECT row, conv_id, turn, run, level, 1, body FROM g
), p AS (
  SELECT row, conv_id, turn, run, level, kind, {_NORMAL.format("t")} AS passage, {_SPOKEN.format("t")} AS n FROM u
), o AS (
  SELECT conv_id, passage, min(turn) AS origin FROM p WHERE level = 0 AND passage <> '' GROUP BY ALL
), k AS (
  SELECT q.*, CASE WHEN origin < q.turn THEN origin END AS origin FROM p q LEFT JOIN o USING (conv_id, passage) WHERE level > 0 AND passage <> ''
), c AS (
  SELECT *, max(kind) FILTER (origin IS NOT NULL) OVER (PARTITION BY row, run) AS best FROM k
), v AS (
  SELECT conv_id, turn, level, origin, sum(n) AS n FROM c WHERE origin IS NOT NULL AND kind = best GROUP BY ALL
), totals AS (
  SELECT conv_id, turn, sum(n) FILTER (kind = 3) AS n_quoted, sum(n) FILTER (origin IS NOT NULL AND kind = best) AS n_linked, max(level) AS max_level FROM c GROUP BY ALL
), best AS (
  SELECT conv_id, turn, origin AS reply_to FROM v QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, origin DESC) = 1
), walk AS (
  SELECT conv_id, turn, reply_to AS root_turn, 1 AS depth FROM best
  UNION ALL
  SELECT w.conv_id, w.turn, b.reply_to, w.depth + 1 FROM walk w JOIN best b ON b.conv_id = w.conv_id AND b.turn = w.root_turn
), threads AS (
  SELECT conv_id, turn, min(root_turn) AS root_turn, max(depth) AS depth FROM walk GROUP BY ALL
), placed AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(root_turn, turn), coalesce(depth, 0), turn) AS position
  FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL) LEFT JOIN threads USING (conv_id, turn)
), mine AS (
  SELECT row, list_filter(list_zip(levels, bodies), lambda x, i: x[1] = 0 AND NOT (regexp_matches(x[2], '(?i)^\s*(on\b.*\bwrote|le\b.*a écrit|am\b.*schrieb.*|el\b.*escribió)\s*:\s*$') AND i < len(levels) AND levels[i + 1] > 0)) AS own FROM n
)
SELECT n.conv_id, n.turn, role, CASE WHEN text IS NULL THEN NULL ELSE regexp_replace(array_to_string(list_transform(own, lambda x: x[2]), chr(10)), '^\s+|\s+$', '', 'g') END AS text, reply_to,
  coalesce(root_turn, n.turn) AS root_turn, CAST(coalesce(depth, 0) AS BIGINT) AS depth, position, CAST(coalesce(n_quoted, 0) AS BIGINT) AS n_quoted, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, CAST(coalesce(max_level, 0) AS BIGINT) AS max_level
FROM n LEFT JOIN mine USING (row) LEFT JOIN totals USING (conv_id, turn) LEFT JOIN best USING (conv_id, turn) LEFT JOIN threads USING (conv_id, turn) LEFT JOIN placed USING (conv_id, turn)
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    small_batches(spark)
    coded = bpe.with_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded_text", 256).alias("decoded_sha256"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of repeated line runs."""
    small_batches(spark)
    return linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of highest integer inner product for each embedding whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").where(knn.usable(F.col("embedding")))
    return knn.top_k(rows.select(F.col("vec_id").cast("long").alias("vec_id"), knn.integers(F.col("embedding")).alias("v")), F.col("vec_id") % 20 == 0, 20)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    small_batches(spark)
    return neardup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), g AS (
  SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d
), c AS (
  SELECT list_sort(s) AS s, len(s) AS n, min(doc_id) AS id FROM g WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY ALL
), e AS (
  SELECT id, n, unnest(s) AS x FROM c
), p AS (
  SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.x = b.x AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r AS (
  SELECT id AS a, id AS b FROM c UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), m AS (
  SELECT a AS id, min(b) AS component_id FROM r GROUP BY a
)
SELECT doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM g LEFT JOIN c ON c.s = list_sort(g.s) LEFT JOIN m USING (id)
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose crc32 fold of five is not 0."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(fold(F.col("doc_id"), 5) != 0))
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(True))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


#: Fixed values: (host, path, verdict) of the contract's rules.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, and where."""
    small_batches(spark)
    held = decontam.with_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return held.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    small_batches(spark)
    return html.main_texts(table(spark, sf_dir, "pages"))


def repeating_tails(docs: DataFrame) -> DataFrame:
    """docs where of every tenth document, by h = crc32 of the id, the words from the a-th on repeat with period p (a = g % n, p = 1 + (n - a) div (3 + g % 8), g = h div 10); others, null ids and texts without words stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = docs.withColumn("_h", h).withColumn("_w", F.when(F.col("_h") % 10 == 0, words)).withColumn("_n", F.size("_w"))
    chosen = chosen.withColumn("_a", F.when(F.col("_n") > 0, F.expr("(_h div 10) % _n")).cast("int"))
    chosen = chosen.withColumn("_p", F.expr("1 + (_n - _a) div (3 + (_h div 10) % 8)").cast("int"))
    tail = F.flatten(F.array_repeat(F.expr("slice(_w, _a + 1, _p)"), F.expr("cast(ceil((_n - _a) / _p) as int)")))
    changed = F.concat(F.expr("slice(_w, 1, _a)"), F.slice(tail, F.lit(1), F.col("_n") - F.col("_a")))
    return chosen.withColumn("text", F.when(F.col("_n") > 0, F.array_join(changed, " ")).otherwise(F.col("text"))).select(*docs.columns)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document with repeating tails, the greatest of them, and digests of the runs and of the words that stay."""
    small_batches(spark)
    found = periodic.with_runs(repeating_tails(table(spark, sf_dir, "documents").select("doc_id", "text")), keep=["doc_id"])
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top_run.*",
        F.expr("(1000 * top_run.length) div top_run.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence of 2048 tokens at most and its place there."""
    small_batches(spark)
    made = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    digests = cut(made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    small_batches(spark, 10_000)
    return packing.packed(digests)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers in every document, with how common its links are in the corpus."""
    small_batches(spark)
    made = align.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = cut(made.withColumn("groups_sha256", digest).drop("groups").withColumn("_row", F.monotonically_increasing_id()), "aligned", "zstd")
    counts = cut(align.link_counts(rows), "link-counts")
    return align.with_counts(rows, counts).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {f.__name__: f for f in (op1_maxent_lm, op2_quote_linking, op3_bpe, op4_line_dedup, op5_exact_topk, op6_near_dedup, op7_language_id, op8_url_filter, op9_decontamination, op10_html_text, op11_periodic_runs, op12_best_fit_packing, op13_token_alignment)}
ORACLES = {"op2_quote_linking": OP2_SQL, "op5_exact_topk": OP5_SQL, "op6_near_dedup": OP6_SQL, "op8_url_filter": urls.oracle(URL_RULES)}
