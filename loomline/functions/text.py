"""Text functions: ECMAScript white space, Unicode normal forms, HTML to text, title tokens."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.vocabulary import PAGE_TEXT_MAX

#: What ECMAScript's \s matches.
SPACE = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
TOKEN = "[\\p{L}\\p{N}]+(?:['’][\\p{L}\\p{N}]+)*"
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))  # in this order


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def _ascii(text: Column) -> Column:
    return text.rlike("^[\\x00-\\x7F]*$")


def nfc(text: Column) -> Column:
    """Normal form C. ASCII texts, which it leaves alone, are handed to the Python worker as null."""
    return F.when(_ascii(text), text).otherwise(_nfc(F.when(~_ascii(text), text)))


def nfkc(text: Column) -> Column:
    return F.when(_ascii(text), text).otherwise(_nfkc(F.when(~_ascii(text), text)))


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def normalize_text(text: Column) -> Column:
    """NFC, collapsed; null where nothing is left."""
    return F.nullif(collapse(nfc(text)), F.lit(""))


def identity_part(text: Column) -> Column:
    """The form that identities are compared in: NFKC, collapsed, lower case."""
    return F.lower(collapse(nfkc(text)))


def bounded_text(text: Column, most: int) -> Column:
    """Collapsed and cut to a length; null where nothing is left."""
    return F.substring(F.nullif(collapse(text), F.lit("")), 1, most)


def title_tokens(title: Column) -> Column:
    """Lower-case words of letters and digits, with inner apostrophes, in order and with repeats."""
    return F.regexp_extract_all(F.lower(title), F.lit(TOKEN), F.lit(0))


def html_text(html: Column) -> Column:
    """Text of a page: script, style and noscript blocks, comments and tags become blanks, basic entities are decoded in a fixed order, white space is collapsed."""
    out = html
    for block in ("script", "style", "noscript"):
        out = F.regexp_replace(out, f"(?is)<{block}\\b[^>]*>.*?</{block}>", " ")
    out = F.regexp_replace(F.regexp_replace(out, "(?s)<!--.*?-->", " "), "<[^>]+>", " ")
    for entity, plain in ENTITIES:
        out = F.regexp_replace(out, f"(?i){entity}", plain)
    return collapse(out)


def bounded_page_text(html: Column, most: int = PAGE_TEXT_MAX) -> Column:
    """struct<status,text,truncated> of a page's text, unsupported-content if it has none."""
    text = html_text(html)
    empty = F.coalesce(F.char_length(text), F.lit(0)) == 0
    return F.struct(F.when(empty, "unsupported-content").otherwise("ok").alias("status"), F.when(~empty, F.substring(text, 1, most)).alias("text"), (~empty & (F.char_length(text) > most)).alias("truncated"))


def content_type(header: Column) -> Column:
    """Media type of a Content-Type header."""
    return F.lower(F.trim(F.split(header, ";")[0]))


def percent(value: Column) -> Column:
    """A share as a percentage with two decimals."""
    return F.concat(F.format_string("%.2f", value * 100), F.lit("%"))
