"""Published dates: ISO 8601 and RFC 2822, in UTC, to the millisecond."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.text import SPACE

PATTERNS = ("yyyy-MM-dd'T'HH:mm:ss[.SSS][.SS][.S]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSS]X", "yyyy-MM-dd'T'HH:mm:ss[.SSS]", "yyyy-MM-dd'T'HH:mm[XXX]", "yyyy-MM-dd", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm Z")


def parse_date(text: Column) -> Column:
    """A timestamp, or null for what neither format reads. A weekday in front is skipped."""
    plain = F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", ""), "^[A-Za-z]{3},\\s*", "")
    found = F.coalesce(*[F.try_to_timestamp(plain, F.lit(p)) for p in PATTERNS])
    return F.date_trunc("millisecond", found)


def blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, SPACE, ""), F.lit("")) == ""


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
