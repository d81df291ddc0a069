"""Read models: recent lists, latest rows, details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.vocabulary import LIST_DEFAULT, LIST_MAX


def check_limit(limit: int, most: int = LIST_MAX) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"a limit is from 1 to {most}")
    return limit


def recent(rows: DataFrame, published: str, then: str, key: str, limit: int = LIST_DEFAULT) -> DataFrame:
    """The newest rows: published descending with nulls last, then the second time descending, then the key."""
    return rows.orderBy(F.col(published).desc_nulls_last(), F.col(then).desc(), F.col(key)).limit(check_limit(limit))


def with_member_count(owners: DataFrame, members: DataFrame, owner_key: str, member_key: str, name: str = "members") -> DataFrame:
    """All owners and how many members each has; members are counted before they are joined."""
    counts = members.groupBy(F.col(member_key).alias(owner_key)).agg(F.count("*").alias(name))
    return owners.join(counts, owner_key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def latest_per_key(rows: DataFrame, key: str, created: str, row_id: str, *payload: str) -> DataFrame:
    """Of each key the row created last, of equal times the one with the largest id."""
    cols = [row_id, *payload]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(created, row_id)).alias("r"), F.max(created).alias(created)).select(key, created, "r.*")


def detail(owners: DataFrame, members: DataFrame, owner_key: str, member_key: str, order: list[str], payload: list[str], name: str = "members") -> DataFrame:
    """Owners with an array of their members in order."""
    cell = F.struct(*order, *[p for p in payload if p not in order])
    lists = members.groupBy(F.col(member_key).alias(owner_key)).agg(F.array_sort(F.collect_list(cell)).alias(name))
    return owners.join(lists, owner_key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def kebab(column: Column) -> Column:
    """ENUM_NAME to enum-name."""
    return F.lower(F.replace(column, F.lit("_"), F.lit("-")))


def screaming(column: Column) -> Column:
    """enum-name to ENUM_NAME."""
    return F.upper(F.replace(column, F.lit("-"), F.lit("_")))


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys, for equality; null where the text isn't JSON."""
    return F.to_json(F.try_parse_json(text))
