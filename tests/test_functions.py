import random

import pytest
from pyspark.sql import functions as F

from loomline.functions import dates, similarity, text, urls


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_text(spark):
    assert one(spark, text.normalize_text, "  a ﻿ b\n", "é", "\u0085", " \t", None) == ["a b", "é", "\u0085", None, None]
    assert one(spark, text.identity_part, "Ａ B", "ﬁx  Y") == ["a b", "fix y"]
    assert one(spark, lambda c: text.bounded_text(c, 3), " a  bcd ", " ") == ["a b", None]
    assert one(spark, text.title_tokens, "L’été, don't-stop 2x! 東京 a'") == [["l’été", "don't", "stop", "2x", "東京", "a"]]
    html = "<p>A&amp;lt;B&nbsp;<script>x</script>C<!-- no -->D<style >y</style\n>&quot;&#39;</p><noscript>n</noscript> é"
    assert one(spark, text.html_text, html) == ["A<B C D y \"' é"]
    got = one(spark, lambda c: text.bounded_page_text(c, 2), "<b>abc</b>", "<i></i>")
    assert [tuple(g) for g in got] == [("ok", "ab", True), ("unsupported-content", None, False)]
    assert one(spark, text.content_type, " Text/HTML; charset=x", "a/b") == ["text/html", "a/b"]
    assert [r[0] for r in spark.range(1).select(text.percent(F.lit(0.98765))).collect()] == ["98.77%"]


URLS = {
    "HTTP://Ex.COM:80": ("http://ex.com/", "http://ex.com/"),
    "https://a.b/p/../q/./r?b=2&a=1&UTM_x=1&a=0#f": ("https://a.b/q/r?b=2&a=1&UTM_x=1&a=0", "https://a.b/q/r?a=1&a=0&b=2"),
    "http://a.b/?fbclid=1": ("http://a.b/?fbclid=1", "http://a.b/"),
    "http://a.b/é x?q=a b%20c": ("http://a.b/%C3%A9%20x?q=a%20b%20c", "http://a.b/%C3%A9%20x?q=a+b+c"),
    "http://a.b:8080/x": ("http://a.b:8080/x", "http://a.b:8080/x"),
    "http://user@a.b/": None, "http://:p@a.b/": None, "ftp://a.b/": None, "a.b/c": None, "http://": None, "http://a b/": None, "http://a.b:99999/": None,
    "  http://a.b/x  ": ("http://a.b/x", "http://a.b/x"), "http:\\\\a.b\\c": ("http://a.b/c", "http://a.b/c"), "http://[::1]/x": ("http://[::1]/x", "http://[::1]/x"), "http://münchen.de/": ("http://xn--mnchen-3ya.de/", "http://xn--mnchen-3ya.de/"),
}


def test_urls(spark):
    got = one(spark, urls.normal_forms, *URLS, None)
    assert {u: tuple(g) for u, g in zip(URLS, got, strict=False)} == {u: w or (None, None) for u, w in URLS.items()}
    assert tuple(got[-1]) == (None, None)


def test_quick_urls_are_the_exact_ones(spark):
    plain = ["https://a.example.org/x/y-1.html?b=1&a=2&a=1&gclid=3#top", "http://a-b.c/p", "http://a.b/p/?utm_source=x", "http://a.b/p?x=&y=1", "https://a.b.c/p/q#a?b"]
    assert [tuple(g) for g in one(spark, urls.normal_forms, *plain)] == [urls.normalize_url(u) for u in plain]


def test_url_safety(spark):
    cases = {"http://localhost/": "blocked", "http://a.local/": "blocked", "http://db.internal:1/": "blocked", "http://10.0.0.1/": "blocked", "http://100.64.0.1/": "blocked", "http://100.63.255.255/": "public", "http://8.8.8.8/": "public", "http://[::1]/": "blocked", "http://[2606:4700::1]/": "public", "http://[fd00::1]/": "blocked", "http://ok.org/": "lookup", None: "blocked"}
    assert one(spark, urls.url_safety, *cases) == list(cases.values())


#: Hosts and the addresses they stand for, "" where they are none.
ADDRESSES = {
    "0x7f.1": "127.0.0.1", "0x7F.0x0.0x0.0x1": "127.0.0.1", "017700000001": "127.0.0.1", "2130706433": "127.0.0.1", "127.1": "127.0.0.1", "10.1.257": "10.1.1.1", "0x": "0.0.0.0", "0": "0.0.0.0", "8.8.8.8.": "8.8.8.8",
    "134744072": "8.8.8.8", "0x08.0x08.0x0808": "8.8.8.8", "010.8.8.8": "8.8.8.8", "08.1.1.1": "", "1.2.3.4.5": "", "256.1.1.1": "", "1.2.3.256": "", "4294967296": "", "4294967295": "255.255.255.255", "a.1": "", "1..2": "", "0xg": "0xg", "1.0x0000000000000001": "1.0.0.1",
}


def test_numbers_as_addresses(spark):
    got = one(spark, urls.normal_forms, *[f"http://{h}/x" for h in ADDRESSES])
    assert [g.url for g in got] == [f"http://{a}/x" if a else None for a in ADDRESSES.values()]
    native = one(spark, lambda c: urls._as_address(F.lower(c)), *ADDRESSES)
    assert native == list(ADDRESSES.values())
    safety = dict(zip(ADDRESSES, one(spark, urls.url_safety, *[f"http://{h}/" for h in ADDRESSES]), strict=True))
    assert safety["0x7f.1"] == safety["2130706433"] == safety["08.1.1.1"] == "blocked" and safety["134744072"] == safety["010.8.8.8"] == "public" and safety["0xg"] == "lookup"


def test_subsequences_by_bits():
    pick = random.Random(1)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for k, y in enumerate(b, 1):
                last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
        return row[-1]

    for _ in range(300):
        a, b = ([f"t{pick.randrange(6)}" for _ in range(pick.randrange(0, 90))] for _ in range(2))
        assert similarity.lcs_length(a, b) == plain(a, b) == similarity.lcs_length(b, a)


def test_dates(spark):
    cases = {"2024-01-02T03:04:05Z": 1704164645000, "2024-01-02T03:04:05.678+01:00": 1704161045678, "2024-01-02": 1704153600000, "Tue, 02 Jan 2024 03:04:05 GMT": 1704164645000, "2 Jan 2024 03:04:05 -0100": 1704168245000, "nonsense": None, "2024-13-01": None}
    assert one(spark, lambda c: dates.millis(dates.parse_date(c)), *cases) == list(cases.values())


def test_similarity(spark):
    df = spark.createDataFrame([(["a", "b", "b"], ["b", "c"]), ([], ["x"]), (["a", "b", "c", "d"], ["a", "c", "d", "b"])], "a array<string>, b array<string>")
    out = df.select(similarity.token_jaccard(F.col("a"), F.col("b")), similarity.token_order(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in out] == [(1 / 3, 1 / 3), (0.0, 0.0), (1.0, 0.75)]
    v = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    assert v.select(similarity.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.96)
    for bad in ([], [0.0, 0.0], [1.0]):
        with pytest.raises(Exception, match="vector"):
            spark.createDataFrame([([3.0, 4.0], bad)], "a array<double>, b array<double>").select(similarity.cosine(F.col("a"), F.col("b"))).collect()
