"""URL filtering: fixed host and path rules first, mined association rules for the rest.

FP-growth mines combinations of URL tokens from the labelled URLs that are to be
blocked. Of the combinations that reach the support, those whose confidence over
all labelled URLs reaches its bound are rules, unless a part of them is one
already. A URL is looked up in an inverted index from token to the rules that
hold it: a rule fits when as many of the URL's items lead to it as it has.

Rules are of any length. FP-growth mines combinations of up to three items; longer
ones grow from those by an item at a time, joined from two that share all but
their last. Only minimal rules are wanted, so a combination is grown while it
could still become one:

- each part of it is frequent among blocked URLs and is no rule;
- it stands in the items of URLs that are confidently blocked as they are (what
  holds only in mixed ones can't be more confident than the best of them);
- each of its items changes its counts (else the part without it says as much).

A URL that many rows repeat must not yield every subset of its tokens, so tokens
without the support among blocked URLs are left out, and so are those that are
rules by themselves; tokens that occur in the very same labelled URLs are one
item; and a basket of more than ``BASKET`` items is cut into blocks for FP-growth,
of which every three make a basket of their own, so that each combination is still
in one. Combinations are counted anew on the uncut ones.

Minimum support bounds the items: at most (mean tokens a blocked URL) / support,
however large the table. All steps are DataFrame operations.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import materialise, with_row_key

BASKET = 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    """Judges the URLs of a host and its subdomains whose path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TokenRule:
    """Blocks URLs that hold one token of each of ``items``; an item's tokens occur in the same labelled URLs."""

    items: tuple[tuple[str, ...], ...]
    confidence: float
    support: float


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[HostRule]) -> Column:
    """The fitting rule with the longest name (of equal ones the first given), as struct<rule,verdict>; null if none fits."""
    ordered = sorted(rules, key=lambda r: -len(r.name))
    fits = [(((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered]
    return F.coalesce(*[F.when(test, value) for test, value in fits]) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def url_tokens(url: Column) -> Column:
    """Distinct tokens: the host and each of its parents, path segments with digit runs as ``0``, query keys, presence of a fragment."""
    host, path = url_host(url), url_path(url)
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("h:"), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, r"(?s)^([^=]*)", 1)))
    fragment = F.when(F.coalesce(url, F.lit("")).contains("#"), F.array(F.lit("#"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.when(host == "", F.array().cast("array<string>")).otherwise(hosts), segments, keys, fragment))


def _baskets(items: Column, parts: int) -> Column:
    """array<array<int>>: the items, or, if there are more than BASKET, every ``parts`` blocks of them."""
    width = BASKET // parts
    blocks = F.transform(F.sequence(F.lit(1), F.size(items), F.lit(width)), lambda at: F.slice(items, at, width))
    joined = F.transform(blocks, lambda x, k: F.struct(k.alias("last"), x.alias("items")))
    for _ in range(parts - 1):
        more = lambda c: F.transform(F.filter(F.transform(blocks, lambda x, k: F.struct(k.alias("last"), x.alias("items"))), lambda x: x["last"] > c["last"]), lambda x: F.struct(x["last"].alias("last"), F.concat(c["items"], x["items"]).alias("items")))
        joined = F.flatten(F.transform(joined, more))
    return F.when(F.size(items) <= BASKET, F.array(items)).otherwise(F.transform(joined, lambda c: c["items"]))


def _counted(combos: DataFrame, held: DataFrame, need: int) -> DataFrame:
    """(combo, hit, every, hope) of the frequent ones of combos, by the uncut baskets; hope: a confidently blocked basket holds it."""
    by_rarest = combos.select("combo", F.array_min("combo").alias("item"))  # items are numbered from the rarest on
    met = held.select("hit", "every", "pure", "items", F.explode("items").alias("item")).join(by_rarest, "item").where(F.size(F.array_except("combo", "items")) == 0)
    return materialise(met.groupBy("combo").agg(F.sum("hit").alias("hit"), F.sum("every").alias("every"), F.max("pure").alias("hope")).where(F.col("hit") >= need), "combinations")


def _parts(combos: DataFrame) -> DataFrame:
    """combos with ``part``, a row for each combination of one item less."""
    return combos.withColumn("part", F.explode(F.transform(F.sequence(F.lit(1), F.size("combo")), lambda k: F.filter("combo", lambda x, i: i != k - 1))))


def _of_open_parts(combos: DataFrame, open_: DataFrame) -> DataFrame:
    """(combo, least) of those combos of which each part is open; least: the smallest sum of a part's counts."""
    known = open_.select(F.col("combo").alias("part"), (F.col("hit") + F.col("every")).alias("both"))
    return _parts(combos).join(known, "part").groupBy("combo").agg(F.count("*").alias("n"), F.min("both").alias("least")).where("n = size(combo)").drop("n")


def _grown(open_: DataFrame) -> DataFrame:
    """Combinations of one item more, from two that share all but their last."""
    ends = open_.select(F.expr("slice(combo, 1, size(combo) - 1)").alias("head"), F.element_at("combo", -1).alias("last"))
    others = ends.select("head", F.col("last").alias("more"))
    return ends.join(others, "head").where("last < more").select(F.concat("head", F.array("last", "more")).alias("combo"))


def mine_rules(labelled: DataFrame, *, min_support: float = 0.01, min_confidence: float = 0.8, max_tokens: int | None = None, blocking: str = "block") -> list[TokenRule]:
    """Token rules from (tokens array<string>, verdict string), of any number of items unless ``max_tokens`` bounds it.

    Support is the share of labelled rows that hold a rule's tokens and are
    blocked. A rule of which a part is one already is left out. Rows with a null
    verdict don't count, null and empty token arrays count as rows without a
    token, a repeated token counts once. No labelled rows: no rules.
    """
    known = labelled.where(F.col("verdict").isNotNull()).select(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))).alias("tokens"), (F.col("verdict") == blocking).alias("blocked"))
    # rows that repeat are one with a count; the key goes by content, so that it is stable
    known = materialise(with_row_key(known.groupBy("tokens", "blocked").agg(F.count("*").alias("n"))), "labelled")
    total = known.agg(F.sum("n")).first()[0] or 0
    need = max(1, math.ceil(min_support * total))
    each = known.select("row_key", "blocked", "n", F.explode("tokens").alias("token"))
    sums = [F.sum(F.when(F.col("blocked"), F.col("n")).otherwise(0)).alias("hit"), F.sum("n").alias("every")]
    same = [F.count("*").alias("rows"), F.bit_xor(F.xxhash64("row_key")).alias("x"), F.bit_xor(F.xxhash64("row_key", F.lit(1))).alias("y")]
    # bounded by the support: see the module's text
    found = each.groupBy("token").agg(*sums, *same).where(F.col("hit") >= need).groupBy("hit", "every", "rows", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("tokens")).collect()
    items = sorted(((tuple(r["tokens"]), r["hit"], r["every"]) for r in found), key=lambda i: (i[2], i[0]))
    rules = [TokenRule((t,), hit / every, hit / total) for t, hit, every in items if hit / every >= min_confidence]
    open_ = [t for t, hit, every in items if hit / every < min_confidence]
    most = max_tokens or len(open_)
    if most < 2 or len(open_) < 2:
        return sorted(rules, key=lambda r: r.items)
    number = known.sparkSession.createDataFrame([(t, k) for k, tokens in enumerate(open_) for t in tokens], "token string, item int")
    held = each.join(F.broadcast(number), "token").groupBy("row_key", "blocked", "n").agg(F.array_sort(F.collect_set("item")).alias("items")).where(F.size("items") > 1)  # as many rows as frequent tokens
    held = materialise(held.groupBy("items").agg(*sums).withColumn("pure", F.col("hit") / F.col("every") >= min_confidence), "baskets")
    cut = held.where("hit > 0").select(F.explode(_baskets(F.col("items"), min(3, most))).alias("items"), "hit").select("items", F.explode(F.array_repeat(F.lit(0), F.col("hit").cast("int"))).alias("copy")).select("items")
    baskets = cut.count()
    if not baskets or held.where("pure").isEmpty():
        return sorted(rules, key=lambda r: r.items)
    mined = FPGrowth(itemsCol="items", minSupport=min(1.0, need / baskets * (1 - 1e-9)), minConfidence=0.0).fit(cut).freqItemsets
    short = _counted(mined.where(F.size("items").between(2, min(3, most))).select(F.array_sort("items").alias("combo")), held, need)
    sure = F.col("hit") / F.col("every") >= min_confidence
    undecided = None
    size = 2
    while size <= most:
        if size <= 3:
            counted = short.where(F.size("combo") == size)
            if undecided is not None:
                counted = counted.join(_of_open_parts(counted.select("combo"), undecided), "combo")
        else:
            wanted = materialise(_of_open_parts(_grown(undecided), undecided), "grown")
            counted = _counted(wanted, held, need).join(wanted, "combo")
        counted = materialise(counted, "counted")
        for r in counted.where(sure).collect():
            rules.append(TokenRule(tuple(sorted(open_[k] for k in r["combo"])), r["hit"] / r["every"], r["hit"] / total))
        left = counted.where(~sure & F.col("hope"))
        undecided = left if size < 3 else left.where("hit + every < least")
        if undecided.isEmpty():
            break
        size += 1
    return sorted(rules, key=lambda r: r.items)


def matching(urls: DataFrame, rules: Sequence[TokenRule], *, broadcast_rows: int = 100_000) -> DataFrame:
    """Distinct ``url`` of urls (url, tokens) that hold one token of each item of some rule.

    The inverted index is a table from token to the rules and items that it stands
    for, broadcast where it has few rows, else joined on the token.
    """
    rows = [(token, k, j, len(rule.items)) for k, rule in enumerate(rules) for j, item in enumerate(rule.items) for token in item]
    index = urls.sparkSession.createDataFrame(rows, "token string, rule int, item int, needed int")
    each = urls.select("url", F.explode("tokens").alias("token"))
    met = each.join(F.broadcast(index) if len(rows) <= broadcast_rows else index, "token")
    full = met.groupBy("url", "rule", "needed").agg(F.size(F.collect_set("item")).alias("n")).where("n = needed")
    return full.select("url").distinct()


def judge_urls(
    pages: DataFrame, rules: Sequence[HostRule], *, id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None, min_support: float = 0.01, min_confidence: float = 0.8, max_tokens: int | None = None
) -> DataFrame:
    """One row per input row: its id, host, path, rule, verdict.

    The fixed rules decide where one fits; elsewhere the mined rules block, and
    what they don't match is allowed. ``labelled`` (url, verdict) are the URLs to
    mine; without it, those of ``pages`` that a fixed rule judges. Null URLs and
    ones without ``://`` have an empty host and path; null ones are allowed.
    Repeated rows each get a row; of fixed rules with names of one length the first
    given decides; URLs of any length are taken whole; an empty table gives no
    rows; other columns aren't read.
    """
    rows = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("url"))
    if labelled is None:
        fixed = fitting_rule(url_host(F.col("url")), url_path(F.col("url")), rules)
        examples = rows.select(url_tokens(F.col("url")).alias("tokens"), fixed["verdict"].alias("verdict"))
    else:
        examples = labelled.select(url_tokens(F.col("url")).alias("tokens"), F.col("verdict"))
    mined = mine_rules(examples, min_support=min_support, min_confidence=min_confidence, max_tokens=max_tokens)
    fixed = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = rows.select(id_col, "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).withColumn("fixed", fixed)
    if mined:
        others = judged.where("fixed IS NULL AND url IS NOT NULL").select("url").distinct()
        hits = matching(others.withColumn("tokens", url_tokens(F.col("url"))), mined).select(F.col("url").alias("hit"))
        judged = judged.join(hits, judged["url"] == hits["hit"], "left")  # URLs that a fixed rule judges have no hit
    else:
        judged = judged.withColumn("hit", F.lit(None).cast("string"))
    method = F.when(F.col("hit").isNotNull(), "block").otherwise("allow")
    return judged.select(id_col, "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", method).alias("verdict"))
