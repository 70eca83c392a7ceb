"""Quotation linking and url filtering against their SQL and small cases by hand."""

import random

from pyspark.sql import functions as F

from millrace.llm import queries, quotes, urls

THREAD = [
    (1, 0, "a", "Shall we meet on Monday?\nI am free all day.\r\n\nBest"),
    (1, 1, "b", "On Sunday A wrote:\n> Shall we meet on  monday?\n> I am free all day.\nMonday is fine."),
    (1, 2, "a", "> > Shall we meet on Monday?\n> Monday is fine.\n\nSee you then."),
    (1, 3, "c", "> something nobody said\nHello"),
    (1, 4, "c", "Another topic"),
    (1, 5, "c", "> Another topic\n>> Hello\nyes\n\n"),
    (2, 0, "a", "> Another topic\nquote from elsewhere"),
    (3, 0, None, None),
    (3, 1, "x", ""),
    (None, 1, "x", "> a\nb"),
    (4, None, "x", "> a\nb"),
    (5, 0, "x", "same"),
    (5, 1, "x", "same"),
    (5, 2, "x", "> same\n> same\nok"),
]


def test_quotes_by_hand(spark):
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(spark.createDataFrame(THREAD, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x"))).collect()}
    assert len(got) == len(THREAD)
    pick = lambda c, t: (got[c, t].reply_to, got[c, t].root_turn, got[c, t].depth, got[c, t].n_quoted, got[c, t].n_linked, got[c, t].text)
    assert pick(1, 1) == (0, 0, 1, 2, 2, "Monday is fine.")
    assert pick(1, 2) == (1, 0, 2, 2, 2, "See you then.")
    assert pick(1, 3) == (None, 3, 0, 1, 0, "Hello")
    assert pick(1, 5) == (4, 4, 1, 2, 2, "yes")
    assert pick(2, 0) == (None, 0, 0, 1, 0, "quote from elsewhere")
    assert pick(5, 2) == (0, 0, 1, 2, 2, "ok")
    assert got[3, 0].text is None and got[None, 1].text == "b"


def test_rewrapped_passages_and_threads(spark):
    first = "One two three four\nfive six seven.\n\nYes"
    rows = [(1, 0, first), (1, 1, "Yes"), (1, 2, "> one two three\n> four five six seven.\nAgreed"), (1, 3, ">> one two three four five six seven.\n>> yes\n> Agreed\nSo be it"), (1, 4, "> Yes\nWhich?"), (1, 5, "> no such line\n> Yes\n")]
    got = {r.turn: (r.reply_to, r.root_turn, r.depth, r.position, r.n_quoted, r.n_linked) for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    # a passage is found whole although its lines are broken elsewhere; "yes" is the first one's who says it
    assert got == {0: (None, 0, 0, 1, 0, 0), 2: (0, 0, 1, 2, 2, 2), 4: (0, 0, 1, 3, 1, 1), 5: (0, 0, 1, 4, 2, 1), 3: (2, 0, 2, 5, 3, 3), 1: (None, 1, 0, 6, 0, 0)}


def test_thousands_of_quoted_messages_equal_sql(spark, same_as_sql, tmp_path):
    rng, rows = random.Random(3), []
    for conv in range(60):
        said = []
        for turn in range(60 if conv else 800):
            own = "\n".join(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6))) + rng.choice(["", ".", "\n"]) for _ in range(rng.randrange(1, 5)))
            quote = ""
            if said and rng.random() < 0.7:
                words = rng.choice(said).split(" ")
                quote = "\n".join("> " + x for x in (" ".join(words) if rng.random() < 0.5 else "\n".join(words)).split("\n")) + "\n"
            said.append(own)
            rows.append((conv, turn, "r", quote + own))
    rows += [rows[-1], (None, None, None, None), (1, 99, "r", ""), (1, 100, "r", "> " + "a b " * 50_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sum(1 for r in same_as_sql("op2_quote_linking", tmp_path) if r[4] is not None) > 1000


def test_quotes_equal_sql(spark, sf_dir, same_as_sql, tmp_path):
    same_as_sql("op2_quote_linking", sf_dir)
    spark.createDataFrame(THREAD, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    same_as_sql("op2_quote_linking", tmp_path)
    assert quotes.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://EXAMPLE.com/en/1?x#y": ("example.com", "/en/1", "example.com/en/", "block"),
        "http://www.example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "https://a.net/es/://x": ("a.net", "/es/://x", "net/es/", "block"),
        "x://b.net?q=/es/": ("b.net", "", None, "allow"),
        "ftp://a.com": ("a.com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    frame = spark.createDataFrame([(i, u, "z") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(frame, queries.URL_RULES).collect()}
    assert got == cases
    assert urls.judge(frame.limit(0), queries.URL_RULES).collect() == []


def test_tree_generalises_merges_and_rejects(spark):
    rows = [("h", [f"w{c}", "x"], 1, 1, 0) for c in "abcdefghijklmnopqrstuvwxyz"]  # variable segments, all blocked
    rows += [("g", ["a"], 100, 50, 50), ("g", ["b"], 100, 48, 52), ("g", ["c"], 90, 90, 0), ("g", ["d"], 9, 0, 0)]
    rows += [("k", [f"s{i}"], 9, 9 * (i < 2), 0) for i in range(50)]  # many sections, two of them blocked
    got = {(r.host, tuple(r["shape"])): (tuple(r.template), r.purity) for r in urls.template_tree(spark.createDataFrame(rows, "host string, shape array<string>, pages long, blocked long, allowed long")).collect()}
    assert got["h", ("wa", "x")] == (("*", "x"), 27 / 28)
    assert got["g", ("c",)] == (("c",), 91 / 92) and got["g", ("d",)] == (("d",), None)
    assert got["k", ("s7",)] == (("s7",), None) and got["k", ("s0",)] == (("~",), 19 / 20)


#: Most users of h.org are blocked one by one; of i.org only a few.
USER_RULES = [(f"{h}.org", f"/user/{c}", "block") for h, n in (("h", 20), ("i", 6)) for c in "abcdefghijklmnopqrstuvwxyz"[:n]] + [("org", "/about", "allow"), ("b.org", "/x", "block"), ("org", "/x/y", "allow"), ("c.b.org", "/", "allow")]


def test_templates_decide_where_no_rule_fits(spark, tmp_path):
    rows = [f"http://{h}.org/user/{c}/{i}" for h in "hi" for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")] + [f"http://h.org/news/{i}" for i in range(9)] + ["http://h.org/about", "http://b.org/x/y", "http://c.b.org/x", "http://h.org/" + "a/" * 30_000, "http://h.org/user/y/5", "http://h.org/user/z/5"]
    frame = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(frame, USER_RULES).collect()}
    assert got[25] == (None, "block") and got[51] == (None, "allow")  # by their templates
    assert all(got[i] == (None, "allow") for i in range(52, 61))
    assert got[61] == ("org/about", "allow") and got[62] == ("b.org/x", "block") and got[63] == ("c.b.org/", "allow")
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = db.execute(f"select page_id, rule, verdict from ({urls.oracle(USER_RULES)})").fetchall()
    assert {i: (r, v) for i, r, v in want} == got


def test_urls_equal_sql(spark, sf_dir, same_as_sql, tmp_path):
    same_as_sql("op8_url_filter", sf_dir)
    spark.createDataFrame([(i, f"http://h{i % 3}.net/{'es' if i % 4 else 'x'}/w{chr(97 + i % 26)}/{i}/a/b/c/d/e") for i in range(400)] + [(1, None), (None, "q")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    same_as_sql("op8_url_filter", tmp_path)


def test_topk_equals_sql(sf_dir, same_as_sql):
    same_as_sql("op5_exact_topk", sf_dir)
