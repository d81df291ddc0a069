import random
import time
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from loomline.llm import queries, url_filter

RULES = queries.URL_RULES


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, host string, verdict string")


def test_hosts_paths_and_longest_rule(spark):
    urls = {
        "http://A.B.Example.org/es/x?y#z": ("a.b.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "http://x.org": ("x.org", "", None, "allow"),
        "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
        "x://y.com/de/?a://b": ("y.com", "/de/", "com/de/", "block"),
        "http://com/de/": ("com", "/de/", "com/de/", "block"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://É.COM/FR/": ("É.com", "/FR/", None, "allow"),
        "http://h?q/x": ("h", "", None, "allow"),
        "a\nb://c\n.org/d": ("c\n.org", "/d", "org/", "allow"),
    }
    rows = [(k, u) for k, u in enumerate(urls)] + [(None, "http://x.org/"), (99, None), (99, None)]
    out = url_filter.judge_urls(frame(spark, rows), RULES).collect()
    assert len(out) == len(rows)
    by = {r.page_id: tuple(r)[1:] for r in out}
    assert {u: by[k] for k, u in enumerate(urls)} == urls
    assert by[99] == ("", "", None, "allow") and by[None] == ("x.org", "/", "org/", "allow")


def test_mined_rules_are_those_of_counting(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    fixed = url_filter.fitting_rule(url_filter.url_host(F.col("url")), url_filter.url_path(F.col("url")), RULES)
    table = pages.select(url_filter.url_tokens(F.col("url")).alias("tokens"), fixed["verdict"].alias("verdict"))
    mined = url_filter.mine_rules(table)
    known = [(frozenset(r.tokens), r.verdict == "block") for r in table.collect() if r.verdict]
    want = {}
    for size in (1, 2, 3):
        for rule in {c for t, _ in known for c in combinations(sorted(t), size)}:
            hit = [b for t, b in known if t.issuperset(rule)]
            if sum(hit) >= 0.01 * len(known) and sum(hit) / len(hit) >= 0.8 and not any(p in want for n in range(1, size) for p in combinations(rule, n)):
                want[rule] = sum(hit) / len(hit)
    # the tokens of an item occur in the same rows: each choice of them is a rule
    got = {tuple(sorted(choice)): round(r.confidence, 9) for r in mined for choice in product(*r.items)}
    assert got == {k: round(v, 9) for k, v in want.items()} and mined
    judged = {r.page_id: r for r in url_filter.judge_urls(pages, RULES).collect()}
    for p in pages.select("page_id", url_filter.url_tokens(F.col("url")).alias("tokens")).collect():
        if judged[p.page_id].rule is None:
            assert (judged[p.page_id].verdict == "block") == any(set(r) <= set(p.tokens) for r in want)


def test_given_labels_and_nothing_to_mine(spark):
    labelled = spark.createDataFrame([("http://s.net/spam/1", "block")] * 3 + [("http://s.net/ham/1", "allow")] * 3 + [("http://z.net/", None)], "url string, verdict string")
    pages = frame(spark, [(1, "http://t.net/spam/2"), (2, "http://t.net/ham/2")])
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(pages, [], labelled=labelled).collect()} == {1: "block", 2: "allow"}
    assert {r.verdict for r in url_filter.judge_urls(pages, []).collect()} == {"allow"}
    assert url_filter.judge_urls(frame(spark, []), RULES).count() == 0


def test_a_rule_of_three_tokens(spark):
    """Blocked only where a, b and c meet; two of them, or one, are allowed more often than not."""
    rows = [("http://x.net/a/b/c", "block")] * 30 + [(f"http://x.net/{p}", "allow") for p in ("a/b", "a/c", "b/c") for _ in range(40)]
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    table = labelled.select(url_filter.url_tokens(F.col("url")).alias("tokens"), "verdict")
    assert [r.items for r in url_filter.mine_rules(table)] == [(("p:a",), ("p:b",), ("p:c",))]
    assert url_filter.mine_rules(table, max_tokens=2) == []
    pages = frame(spark, [(1, "http://y.net/c/x/b/a"), (2, "http://y.net/a/b"), (3, "http://y.net/b/c/a?q")])
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(pages, [], labelled=labelled).collect()} == {1: "block", 2: "allow", 3: "block"}


@pytest.mark.parametrize("n", [4, 6, 13])
def test_longer_rules(spark, n):
    """Blocked only where n tokens meet: any n - 1 of them are allowed more often than not."""
    parts = [f"p{chr(97 + k)}" for k in range(n)]
    rows = [("http://x.net/" + "/".join(parts), "block")] * 30 + [("http://x.net/" + "/".join(parts[:k] + parts[k + 1 :]), "allow") for k in range(n) for _ in range(9)]
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    table = labelled.select(url_filter.url_tokens(F.col("url")).alias("tokens"), "verdict")
    assert [r.items for r in url_filter.mine_rules(table)] == [tuple((f"p:{p}",) for p in parts)]
    assert url_filter.mine_rules(table, max_tokens=n - 1) == []
    pages = frame(spark, [(1, "http://y.net/x/" + "/".join(parts[::-1])), (2, "http://y.net/" + "/".join(parts[1:])), (3, rows[0][0])])
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(pages, [], labelled=labelled).collect()} == {1: "block", 2: "allow", 3: "block"}


def test_random_rules_against_all_subsets(spark):
    pick = random.Random(3)
    tokens = [f"t{k}" for k in range(9)]
    rows = []
    for _ in range(250):
        held = sorted(pick.sample(tokens, pick.randint(0, 8)))
        rows.append((held, None if pick.random() < 0.05 else "block" if {"t0", "t1", "t2", "t3"} <= set(held) or pick.random() < 0.25 else "allow"))
    known = [(frozenset(t), v == "block") for t, v in rows if v]
    want = {}
    for size in range(1, 10):
        for rule in map(frozenset, combinations(tokens, size)):
            hit = [b for t, b in known if rule <= t]
            if sum(hit) >= 0.02 * len(known) and sum(hit) / len(hit) >= 0.7 and not any(w < rule for w in want):
                want[rule] = sum(hit) / len(hit)
    mined = url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), min_support=0.02, min_confidence=0.7)
    got = {frozenset(c): r.confidence for r in mined for c in product(*r.items)}
    assert got == want and max(map(len, want)) >= 4


def test_many_rules_match_by_a_table(spark):
    rules = [url_filter.TokenRule(((f"p:a{k}", f"p:alias{k}"), (f"p:b{k}",)), 1.0, 0.1) for k in range(3000)]
    urls = spark.createDataFrame([("u1", ["p:a7", "p:b7"]), ("u2", ["p:a7", "p:b8"]), ("u3", ["p:alias2999", "x", "p:b2999"]), ("u4", ["p:a1", "p:alias1"]), ("u5", [])], "url string, tokens array<string>")
    for few in (10, 100_000):
        assert {r.url for r in url_filter.matching(urls, rules, broadcast_rows=few).collect()} == {"u1", "u3"}


def test_repeated_long_urls(spark):
    """A URL of 40 segments in one row of a hundred, blocked in some and allowed in others, and variants of it that each lack a segment."""
    long = [f"s{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    rows = [("http://a.net/" + "/".join(long), v) for v in ("block", "block", "allow") for _ in range(40)]
    rows += [("http://b.net/" + "/".join(long[:k] + long[k + 1 :]), v) for k in range(40) for v in ("block", "allow")]
    rows += [(f"http://c{k}.net/p{k}", "allow") for k in range(4000)]
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    began = time.monotonic()
    pages = frame(spark, [(1, rows[0][0]), (2, "http://z.net/" + "/".join(long[:5]))])
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(pages, [], labelled=labelled).collect()} == {1: "allow", 2: "allow"}
    assert time.monotonic() - began < 60


def test_long_baskets_keep_every_combination(spark):
    items = list(range(17))
    table = spark.createDataFrame([(items,), (items[:12],), ([5],)], "items array<int>")
    got = [r[0] for r in table.select(url_filter._baskets(F.col("items"), 3)).collect()]
    assert got[1:] == [[items[:12]], [[5]]] and all(len(b) <= 12 for b in got[0])
    assert {c for b in got[0] for c in combinations(b, 3)} == set(combinations(items, 3))
