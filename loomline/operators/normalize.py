"""Raw articles to normalised ones, with one typed reason for each reject.

Payloads are VARIANT, because an absent field and a JSON null differ and types
must not be coerced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.dates import blank, parse_date
from loomline.functions.text import normalize_text
from loomline.functions.urls import normal_forms

TEXT_FIELDS = ("externalId", "title", "url", "publishedAt", "author", "summary", "category")


def _part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _kind(v: Column, path: str) -> Column:
    """absent, or the type that schema_of_variant names (VOID for a JSON null)."""
    part = _part(v, path)
    return F.when(F.is_variant_null(part), "VOID").when(part.isNull(), "absent").otherwise(F.schema_of_variant(part))


def _text(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def _object(v: Column, path: str = "$") -> Column:
    kind = F.schema_of_variant(v) if path == "$" else _kind(v, path)
    return kind.startswith("OBJECT")


def valid_source(source: Column) -> Column:
    """An object with an id and a name that aren't blank and a type of api or rss."""
    named = [(_kind(source, f"$.{f}") == "STRING") & ~blank(_text(source, f"$.{f}")) for f in ("id", "name")]
    return F.coalesce(_object(source) & named[0] & named[1] & _text(source, "$.type").isin("api", "rss"), F.lit(False))


def valid_shape(article: Column) -> Column:
    """An object whose fields are absent or of their type: a JSON null is neither."""
    test = _object(article)
    for field in TEXT_FIELDS:
        test &= _kind(article, f"$.{field}").isin("absent", "STRING")
    name = (_kind(article, "$.publisher.name") == "STRING") & ~blank(_text(article, "$.publisher.name"))
    own = (_kind(article, "$.publisher.id") == "absent") | ((_kind(article, "$.publisher.id") == "STRING") & ~blank(_text(article, "$.publisher.id")))
    test &= (_kind(article, "$.publisher") == "absent") | (_object(article, "$.publisher") & name & own)
    test &= (_kind(article, "$.metadata") == "absent") | _object(article, "$.metadata")
    return F.coalesce(test, F.lit(False))


def normalize_articles(raw: DataFrame, *, source_col: str = "source", payload_col: str = "payload", discovered_col: str = "fetched_at") -> DataFrame:
    """All rows of raw with ``reject_reason`` (null: accepted) and ``article``, a struct that is null for rejects.

    Reasons are checked in the order invalid-source, invalid-article-shape,
    missing-title, missing-url, invalid-url, invalid-published-at.
    """
    source, payload = F.col(source_col), F.col(payload_col)
    rows = raw.withColumns({"_source_ok": valid_source(source), "_shape_ok": valid_shape(payload), "_title": normalize_text(_text(payload, "$.title")), "_raw_url": _text(payload, "$.url"), "_date": _text(payload, "$.publishedAt")})
    rows = rows.withColumns({"_forms": normal_forms(F.col("_raw_url")), "_published": parse_date(F.col("_date"))})
    reason = (
        F.when(~F.col("_source_ok"), "invalid-source")
        .when(~F.col("_shape_ok"), "invalid-article-shape")
        .when(F.col("_title").isNull(), "missing-title")
        .when(blank(F.col("_raw_url")), "missing-url")
        .when(F.col("_forms.url").isNull(), "invalid-url")
        .when(~blank(F.col("_date")) & F.col("_published").isNull(), "invalid-published-at")
    )
    trimmed = lambda path: F.trim(_text(source, path))
    article = F.struct(
        F.col("_title").alias("title"),
        F.col("_forms.url").alias("url"),
        F.col("_forms.canonical_url").alias("canonical_url"),
        F.struct(trimmed("$.id").alias("id"), trimmed("$.name").alias("name"), trimmed("$.type").alias("type")).alias("source"),
        F.when(_object(payload, "$.publisher"), F.struct(normalize_text(_text(payload, "$.publisher.name")).alias("name"), normalize_text(_text(payload, "$.publisher.id")).alias("id"))).alias("publisher"),
        normalize_text(_text(payload, "$.externalId")).alias("external_id"),
        F.col("_published").alias("published_at"),
        F.col(discovered_col).alias("discovered_at"),
        *[normalize_text(_text(payload, f"$.{f}")).alias(f) for f in ("author", "summary", "category")],
        F.when(_object(payload, "$.metadata"), F.to_json(_part(payload, "$.metadata"))).alias("metadata"),
    )
    rows = rows.withColumn("reject_reason", reason)
    return rows.withColumn("article", F.when(F.col("reject_reason").isNull(), article)).drop("_source_ok", "_shape_ok", "_title", "_raw_url", "_date", "_forms", "_published")


def split(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted articles, with the other columns beside theirs, and rejects."""
    rest = [c for c in normalized.columns if c not in ("article", "reject_reason", "source", "payload")]
    return normalized.where("reject_reason IS NULL").select(*rest, "article.*"), normalized.where("reject_reason IS NOT NULL").drop("article")
