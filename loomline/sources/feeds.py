"""Landed provider responses to raw articles: JSON search results, RSS 2.0 and Atom.

Fetching is not the engine's work: responses lie in a table (source, body,
fetched_at), one row for each. A response gives its articles in order, or an
error kind.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import SPACE
from loomline.functions.urls import SCRIPT_SPACE, normalize_url

ARTICLE_SCHEMA = "array<struct<pos:int,payload:string>>"
DC = "{http://purl.org/dc/elements/1.1/}"
ATOM = "{http://www.w3.org/2005/Atom}"
FEEDS = 256  # feeds whose articles a task holds


class UnsupportedSource(KeyError):
    """No source of that id is registered."""


@dataclass(frozen=True)
class FeedConfig:
    """A configured RSS or Atom source."""

    id: str
    name: str
    feed_url: str

    def __post_init__(self):
        if not re.fullmatch(r"[a-z0-9][a-z0-9._-]{0,99}", self.id) or self.id == "gnews":
            raise ValueError(f"not a source id: {self.id}")
        if not 1 <= len(self.name.strip()) <= 200:
            raise ValueError("a source's name has 1 to 200 characters")
        if normalize_url(self.feed_url) is None:
            raise ValueError("a feed's URL is http or https without credentials")


def registry(feeds: Sequence[FeedConfig]) -> dict[str, tuple[str, str]]:
    """Source id -> (name, type), with the JSON provider; an id given twice raises."""
    found: dict[str, tuple[str, str]] = {"gnews": ("GNews", "api")}
    for feed in feeds:
        if feed.id in found:
            raise ValueError(f"source id given twice: {feed.id}")
        found[feed.id] = (feed.name.strip(), "rss")
    return found


def resolve(sources: Mapping[str, tuple[str, str]], source_id: str) -> tuple[str, str]:
    if source_id not in sources:
        raise UnsupportedSource(source_id)
    return sources[source_id]


def search_query(text: Column) -> Column:
    """A provider query: dollar signs and white space become single blanks; null unless 1 to 200 characters are left."""
    clean = F.trim(F.regexp_replace(F.replace(text, F.lit("$"), F.lit(" ")), SPACE + "+", " "))
    return F.when(F.char_length(clean).between(1, 200), clean)


def _clean(text: str | None) -> str | None:
    return (text or "").strip(SCRIPT_SPACE) or None


def _local(tag: str) -> str:
    if tag.startswith(DC):
        return "dc:" + tag[len(DC) :]
    return tag.rpartition("}")[2] if tag.startswith(ATOM) else tag


def _children(node: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in node if _local(c.tag) == name]


def _text(node: ET.Element, *names: str) -> str | None:
    """The first of the named children that has text of its own."""
    for name in names:
        for child in _children(node, name)[:1]:
            found = _clean("".join([child.text or "", *[c.tail or "" for c in child]]))
            if found:
                return found
    return None


def _guid(item: ET.Element) -> str | None:
    """A guid's text; numeric ones without attributes are dropped, as are blank ones."""
    for node in _children(item, "guid")[:1]:
        found = _clean(node.text)
        numeric = found is not None and re.fullmatch(r"[-+]?[0-9]+(\.[0-9]+)?", found)
        return None if numeric and not node.attrib else found
    return None


def _link(entry: ET.Element) -> str | None:
    for node in _children(entry, "link"):
        if not node.attrib:
            if found := _clean(node.text):
                return found
            continue
        href, rel = _clean(node.get("href")), _clean(node.get("rel"))
        if href and rel in (None, "alternate"):
            return href
    return None


def _category(node: ET.Element, atom: bool) -> str | None:
    for child in _children(node, "category"):
        found = _clean(child.text) if not child.attrib else _clean(child.get("term")) if atom else None
        if found:
            return found
    return None


def parse_feed(xml: str, publisher: str | None = None, limit: int | None = None) -> tuple[str | None, list[dict]]:
    """(error kind, articles) of a feed. The limit counts articles that came out."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return "invalid-xml", []
    kind = _local(root.tag)
    if kind == "rss" and (channels := _children(root, "channel")):
        head, nodes, atom = channels[0], _children(channels[0], "item"), False
    elif kind == "feed":
        head, nodes, atom = root, _children(root, "entry"), True
    else:
        return "invalid-feed", []
    publisher = publisher or _text(head, "title")
    out = []
    for node in nodes:
        if not len(node):
            continue
        if atom:
            authors = _children(node, "author")[:1]
            author = (_text(authors[0], "name") if len(authors[0]) else _clean(authors[0].text)) if authors else None
            found = {"externalId": _text(node, "id"), "url": _link(node), "publishedAt": _text(node, "published", "updated"), "author": author, "summary": _text(node, "summary", "content")}
        else:
            found = {"externalId": _guid(node), "url": _text(node, "link"), "publishedAt": _text(node, "pubDate", "dc:date"), "author": _text(node, "author", "dc:creator"), "summary": _text(node, "description", "summary")}
        found |= {"title": _text(node, "title"), "category": _category(node, atom)}
        article = {k: v for k, v in found.items() if v is not None}
        if publisher:
            article["publisher"] = {"name": publisher}
        out.append(article | {"metadata": {"feedFormat": "atom" if atom else "rss"}})
    return None, out[:limit]


def read_feeds(landed: DataFrame, *, body_col: str = "body", publisher_col: str | None = None, limit: int | None = None) -> DataFrame:
    """landed with error (invalid-xml, invalid-feed or null) and articles, an array of struct<pos,payload> with JSON payloads."""
    publisher = F.col(publisher_col) if publisher_col else F.lit(None).cast("string")

    @F.pandas_udf(f"struct<error:string,articles:{ARTICLE_SCHEMA}>")
    def parse(bodies: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        # what came out is passed on a few feeds at a time, however many Spark hands over
        for body, name in ((b[at : at + FEEDS], n[at : at + FEEDS]) for b, n in bodies for at in range(0, len(b), FEEDS)):
            found = [parse_feed(b or "", n, limit) for b, n in zip(body, name, strict=True)]
            yield pd.DataFrame({"error": [e for e, _ in found], "articles": [[{"pos": k, "payload": json.dumps(a, ensure_ascii=False)} for k, a in enumerate(rows)] for _, rows in found]})

    return landed.withColumn("_p", parse(F.col(body_col), publisher)).select(*landed.columns, "_p.error", "_p.articles")


def read_gnews(landed: DataFrame, *, body_col: str = "body", limit: int = 100) -> DataFrame:
    """landed with error (invalid-json, invalid-response or null), articles and truncated, for responses of the JSON provider.

    One malformed article makes the whole response invalid.
    """
    v = F.try_parse_json(F.col(body_col))
    rows = landed.withColumn("_v", v).withColumn("_rows", F.try_variant_get("_v", "$.articles", "array<variant>"))
    kind = lambda a, path: F.schema_of_variant(F.try_variant_get(a, path, "variant"))
    has = lambda a, path: F.coalesce(kind(a, path) == "STRING", F.lit(False))
    may = lambda a, path, null: F.coalesce(kind(a, path).isin("STRING", *(["VOID"] if null else [])), F.lit(True))

    def fine(a: Column) -> Column:
        test = F.schema_of_variant(a).startswith("OBJECT")
        for field in ("id", "title", "url", "publishedAt", "source.id", "source.name", "source.url"):
            test &= has(a, f"$.{field}")
        for field, null in (("description", True), ("content", True), ("image", True), ("lang", False), ("source.country", False)):
            test &= may(a, f"$.{field}", null)
        return test

    total = F.try_variant_get("_v", "$.totalArticles", "long")
    sound = F.coalesce((kind(F.col("_v"), "$.totalArticles") == "BIGINT") & (total >= 0) & F.forall("_rows", fine), F.lit(False))
    text = lambda a, path: F.try_variant_get(a, path, "string")

    def payload(a: Column) -> Column:
        meta = F.to_json(F.struct(text(a, "$.description").alias("description"), text(a, "$.image").alias("image"), text(a, "$.lang").alias("language"), text(a, "$.source.url").alias("sourceUrl"), text(a, "$.source.country").alias("sourceCountry")), {"ignoreNullFields": "false"})
        body = F.to_json(F.struct(text(a, "$.id").alias("externalId"), text(a, "$.title").alias("title"), text(a, "$.url").alias("url"), text(a, "$.publishedAt").alias("publishedAt"), F.nullif(text(a, "$.description"), F.lit("")).alias("summary"), F.struct(text(a, "$.source.id").alias("id"), text(a, "$.source.name").alias("name")).alias("publisher")))
        return F.concat(F.substring(body, F.lit(1), F.char_length(body) - 1), F.lit(',"metadata":'), meta, F.lit("}"))

    error = F.when(F.col("_v").isNull(), "invalid-json").when(~sound, "invalid-response")
    articles = F.when(sound, F.transform(F.slice("_rows", 1, limit), lambda a, k: F.struct(k.cast("int").alias("pos"), payload(a).alias("payload")))).otherwise(F.array().cast(ARTICLE_SCHEMA))
    return rows.withColumns({"error": error, "articles": articles, "truncated": F.coalesce(sound & (total > F.least(F.size("_rows"), F.lit(limit))), F.lit(False))}).drop("_v", "_rows")


def raw_articles(read: DataFrame, *cols: str) -> DataFrame:
    """One row for each article: the columns named, pos and the payload as VARIANT."""
    return read.select(*cols, F.explode("articles").alias("a")).select(*cols, "a.pos", F.parse_json(F.col("a.payload")).alias("payload"))
