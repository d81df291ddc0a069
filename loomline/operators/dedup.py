"""Ordered duplicate removal over several keys, without transitive merges.

A row is a duplicate if an earlier row that is itself kept holds one of its
keys; duplicates register nothing. That is the first maximal independent set in
row order, and is found in rounds: a row falls if a kept row before it holds one
of its keys, and is kept if no row before it that holds one of its keys is kept
or open. Keys are aggregated to their first kept and first open row, so a key
that many rows hold costs its rows once a round, never their pairs. A round reads
only what is still open and the kept rows of its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import identity_part
from loomline.operators.graph import settle


def article_keys(source_id: Column, external_id: Column, canonical_url: Column, publisher: Column, title: Column) -> Column:
    """array<struct<priority,type,value>> of the keys an article has, by priority."""
    entry = lambda k, kind, value: F.struct(F.lit(k).alias("priority"), F.lit(kind).alias("type"), value.alias("value"))
    every = F.array(
        entry(0, "source-external-id", F.concat(identity_part(source_id), F.lit(":"), identity_part(external_id))),
        entry(1, "canonical-url", canonical_url),
        entry(2, "publisher-title", F.concat(identity_part(publisher), F.lit(":"), identity_part(title))),
    )
    return F.filter(every, lambda k: k["value"].isNotNull())


def ordered_dedup(rows: DataFrame, *, order_col: str = "seq", keys_col: str = "keys", batch_col: str | None = None) -> DataFrame:
    """(order, batch, status unique|duplicate, reason, matched_key, original) of rows with a distinct long order and an array of keys.

    The reason is the first key by priority that a kept earlier row holds, the
    original that row's order. Batches, if given, don't see each other.
    """
    batch = F.col(batch_col).cast("string") if batch_col else F.lit("")
    rows = rows.select(F.col(order_col).cast("long").alias("seq"), batch.alias("batch"), F.col(keys_col).alias("keys"))
    holds = settle(rows.select("seq", "batch", F.explode("keys").alias("k")).select("seq", "batch", "k.priority", "k.type", "k.value"))
    on = ["batch", "type", "value"]
    state = rows.where(F.size("keys") == 0).select("seq", F.lit("unique").alias("status"))
    open_, kept = holds, None
    while True:
        first = open_.groupBy(*on).agg(F.min("seq").alias("open"))
        first = first.withColumn("kept", F.lit(None).cast("long")) if kept is None else first.join(kept, on, "left")
        seen = open_.join(first, on).groupBy("seq").agg(F.bool_or(F.coalesce(F.col("kept") < F.col("seq"), F.lit(False))).alias("falls"), F.bool_and(F.coalesce(F.col("kept") > F.col("seq"), F.lit(True)) & (F.col("open") == F.col("seq"))).alias("stays"))
        judged = settle(seen.where("falls OR stays").select("seq", F.when(F.col("falls"), "duplicate").otherwise("unique").alias("status")))
        state = state.unionByName(judged)
        now = open_.join(judged.where("status = 'unique'"), "seq", "left_semi").groupBy(*on).agg(F.min("seq").alias("kept"))
        left = settle(open_.join(judged, "seq", "left_anti"))
        if left.isEmpty():
            break
        both = now if kept is None else now.unionByName(kept).groupBy(*on).agg(F.min("kept").alias("kept"))
        kept = settle(both.join(left.select(*on).distinct(), on, "left_semi"))
        open_ = left
    state = settle(state)
    placed = holds.join(state, "seq")
    kept = placed.where("status = 'unique'").groupBy(*on).agg(F.min("seq").alias("original"))
    met = placed.where("status = 'duplicate'").join(kept, on).where("original < seq")
    why = met.groupBy("seq").agg(F.min(F.struct("priority", "type", "value", "original")).alias("w"))
    out = rows.select("seq", "batch").join(state, "seq").join(why, "seq", "left")
    return out.select(F.col("seq").alias(order_col), *([F.col("batch").alias(batch_col)] if batch_col else []), "status", F.col("w.type").alias("reason"), F.col("w.value").alias("matched_key"), F.col("w.original").alias("original"))
