"""URL filtering by rules and a path-template tree, with DataFrame functions only.

Every host has a tree of path segments. Runs of digits are wildcards from the start. At each level
the children of a node that fewer than SUPPORT pages have are variable and share one wildcard;
labelled siblings with more pages whose share of blocked pages doesn't differ significantly from all
theirs are merged into one branch; every other branch stays literal, however many there are. A
template is rejected if its smoothed share of blocked labelled pages is REJECT or more, it has
LABELLED of them at least, and they are most of its pages: a few labelled pages do not speak for
many others. Only distinct paths with counts go through the levels, not pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut

#: Pages from which a branch is no variable segment. Segments below DEPTH are one wildcard.
SUPPORT, DEPTH = 3, 6
#: Labelled pages that a rejected template has at least, and their share of its pages.
LABELLED, LABELLED_SHARE = 5, 2 / 3
#: Standard errors within which a branch counts as like its siblings; smoothed share of blocked pages from which a template goes.
SIMILAR_Z, REJECT = 1.96, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANY, LIKE, BELOW = "*", "~", "**"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty for null or no '://'."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; empty for null or no '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_first(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0])))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest rule (host, path, verdict) that fits; nulls where none does.

    Of rules of equal length the one with the longer host wins, then the one listed first.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(longest_first(rules)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The path's segments with each run of digits as a wildcard, those below DEPTH as one."""
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, "[0-9]+", ANY))
    return F.when(F.size(segments) > DEPTH, F.concat(F.slice(segments, 1, DEPTH), F.array(F.lit(BELOW)))).otherwise(segments)


def template_tree(paths: DataFrame) -> DataFrame:
    """host, shape, template, purity (null where its labelled pages are too few) from host, shape (array of segments), pages, blocked, allowed (counts of the shape)."""
    counts = ["pages", "blocked", "allowed"]
    tree = cut(paths.select("host", "shape", F.col("shape").alias("template"), *counts), "tree")
    deepest = tree.agg(F.max(F.size("shape"))).first()[0] or 0
    for level in range(deepest):
        at = tree.where(F.size("template") > level).withColumn("parent", F.slice("template", 1, level)).withColumn("segment", F.col("template")[level])
        nodes = at.groupBy("host", "parent", "segment").agg(*[F.sum(c).alias(c) for c in counts])
        labelled, steady = F.col("blocked") + F.col("allowed"), F.col("pages") >= SUPPORT
        of_steady = lambda c: F.sum(F.when(steady, c).otherwise(0))
        above = nodes.groupBy("host", "parent").agg(F.count_if(steady & (labelled > 0)).alias("known"), of_steady(F.col("blocked")).alias("all_blocked"), of_steady(labelled).alias("all_labelled"))
        share = F.try_divide(F.col("all_blocked").cast("double"), F.col("all_labelled"))
        near = F.abs(F.col("blocked") - share * labelled) <= SIMILAR_Z * F.sqrt(labelled * share * (1 - share)) + 0.5
        to = F.when(~steady, F.lit(ANY)).when((labelled > 0) & (F.col("known") > 1) & near, F.lit(LIKE))
        renamed = cut(nodes.join(above, ["host", "parent"]).select("host", "parent", "segment", to.alias("to")).where("to is not null and to != segment"), "renamed")
        new = at.join(renamed, ["host", "parent", "segment"], "left")
        template = F.when(F.col("to").isNull(), F.col("template")).otherwise(F.transform("template", lambda s, i: F.when(i == level, F.col("to")).otherwise(s)))
        rest = tree.where(F.size("template") <= level)
        tree = cut(new.select("host", "shape", template.alias("template"), *counts).unionByName(rest), "tree")
    sums = tree.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in counts])
    labelled = F.col("blocked") + F.col("allowed")
    trusted = (labelled >= LABELLED) & (labelled >= LABELLED_SHARE * F.col("pages"))
    purity = cut(sums.select("host", "template", F.when(trusted, (F.col("blocked") + 1) / (labelled + 2)).alias("purity")), "purity")
    return tree.select("host", "shape", "template").join(purity, ["host", "template"])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and template; columns of these names are replaced.

    The rules' verdicts are the labels of the template tree; it decides where no rule fits. A null
    url and one without '://' have an empty host and path, like any other host: no rule fits, and
    its template has no label, so it is allowed. Repeated rows count as often as they stand there.
    Urls of any length are read whole; of a very deep path all segments below DEPTH are one in its
    template. An empty table gives an empty table.
    """
    new = ["host", "path", "rule", "verdict", "template"]
    base = pages.withColumn("_host", host_of(F.col(url))).withColumn("_path", path_of(F.col(url)))
    rule, verdict = matching_rule(F.col("_host"), F.col("_path"), rules)
    base = base.withColumns({"_rule": rule, "_said": verdict, "_shape": shape(F.col("_path"))})
    paths = base.groupBy(F.col("_host").alias("host"), F.col("_shape").alias("shape")).agg(F.count("*").alias("pages"), F.count_if(F.col("_said") == "block").alias("blocked"), F.count_if(F.col("_said") == "allow").alias("allowed"))
    tree = template_tree(paths).select(F.col("host").alias("_host"), F.col("shape").alias("_shape"), F.concat_ws("/", "template").alias("_template"), "purity")
    both = base.join(tree, ["_host", "_shape"], "left")
    said = F.coalesce("_said", F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    kept = [base[c] for c in pages.columns if c not in new]
    return both.select(*kept, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), said.alias("verdict"), F.col("_template").alias("template"))


def oracle(rules: list[tuple[str, str, str]], id_column: str = "page_id") -> str:
    """judge() as SQL: one step of the tree after another."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{pick(h, p, v)}'" for h, p, v in longest_first(rules)) + " END"
    steps = []
    for k in range(DEPTH + 1):
        share = "(all_blocked / all_labelled)"
        steps.append(f"""
n{k} AS (SELECT host, template[1:{k}] AS parent, template[{k + 1}] AS segment, sum(pages) AS pages, sum(blocked) AS blocked, sum(allowed) AS allowed FROM t{k} WHERE len(template) > {k} GROUP BY ALL),
a{k} AS (SELECT host, parent, count(*) FILTER (pages >= {SUPPORT} AND blocked + allowed > 0) AS known, CAST(sum(blocked) FILTER (pages >= {SUPPORT}) AS DOUBLE) AS all_blocked, CAST(sum(blocked + allowed) FILTER (pages >= {SUPPORT}) AS DOUBLE) AS all_labelled FROM n{k} GROUP BY ALL),
r{k} AS (SELECT host, parent, segment, CASE WHEN pages < {SUPPORT} THEN '{ANY}' WHEN blocked + allowed > 0 AND known > 1
  AND abs(blocked - {share} * (blocked + allowed)) <= {SIMILAR_Z} * sqrt((blocked + allowed) * {share} * (1 - {share})) + 0.5 THEN '{LIKE}' END AS seg FROM n{k} JOIN a{k} USING (host, parent)),
t{k + 1} AS (SELECT t.host, shape, CASE WHEN seg IS NULL THEN template ELSE list_concat(list_append(template[1:{k}], seg), template[{k + 2}:]) END AS template, pages, blocked, allowed
  FROM t{k} t LEFT JOIN r{k} r ON r.host = t.host AND r.parent = template[1:{k}] AND r.segment = template[{k + 1}] AND len(template) > {k}),""")
    return f"""
WITH u AS (SELECT {id_column}, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
s AS (SELECT *, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS said, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '[0-9]+', '{ANY}', 'g')) AS segs FROM u),
b AS (SELECT * EXCLUDE segs, CASE WHEN len(segs) > {DEPTH} THEN list_append(segs[1:{DEPTH}], '{BELOW}') ELSE segs END AS shape FROM s),
t0 AS (SELECT host, shape, shape AS template, count(*) AS pages, count(*) FILTER (said = 'block') AS blocked, count(*) FILTER (said = 'allow') AS allowed FROM b GROUP BY ALL),
{"".join(steps)}
p AS (SELECT host, template, CASE WHEN sum(blocked + allowed) >= {LABELLED} AND sum(blocked + allowed) >= {LABELLED_SHARE!r} * sum(pages) THEN (sum(blocked) + 1) / (sum(blocked) + sum(allowed) + 2) END AS purity FROM t{DEPTH + 1} GROUP BY ALL)
SELECT {id_column}, b.host, path, rule, coalesce(said, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, array_to_string(t.template, '/') AS template
FROM b JOIN t{DEPTH + 1} t ON t.host = b.host AND t.shape = b.shape JOIN p ON p.host = t.host AND p.template = t.template
"""
