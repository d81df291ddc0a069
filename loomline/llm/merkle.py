"""Merkle manifest of a table: every row a leaf, a tree for each group, a tree over the groups.

Leaves get their place in their group by a range sort and running counts. Runs of
``block`` places are gathered to ordered arrays of fixed size, which SQL's
``sequence``, ``transform``, ``slice`` and ``aggregate`` collapse by as many
levels as such an array has; the arrays' roots are the leaves of the next round.
A round shrinks the table ``block`` times, so a group of any size takes a few
rounds, and no task ever holds more than a block. Rows keep their siblings by
level, so that a row's proof is folded without the others.

A digest is the lower-case hex SHA-256 of its inputs laid end to end, digests as
hex text. ``fan_out`` consecutive nodes become one; the last run of a level may be
shorter, and even a lone node is hashed, while its level holds another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.arrays import let
from loomline.llm.common import discard, materialise, unused

PROOF = "array<struct<before:string,after:string>>"
BLOCK_LEVELS = 10


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(*columns: Column) -> Column:
    """The digest of a row's framed cells."""
    return digest(*[framed(c) for c in columns])


def _collapse(nodes: Column, fan_out: int) -> Column:
    """The level above an ordered level."""
    runs = F.sequence(F.lit(1), F.greatest(F.size(nodes), F.lit(1)), F.lit(fan_out))
    return F.transform(runs, lambda at: F.sha2(F.array_join(F.slice(nodes, at, fan_out), "").cast("binary"), 256))


def _levels(nodes: Column, n: Column, fan_out: int) -> Column:
    """All levels from the nodes up, n of them above."""
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(nodes), lambda levels, _: F.array_append(levels, _collapse(F.element_at(levels, -1), fan_out)))


def _siblings(levels: Column, at: Column, n: Column, fan_out: int) -> Column:
    """What stands before and after a node in its run, at each of n levels; at: its index on the lowest."""

    def around(level: Column) -> Column:
        def run(place: Column) -> Column:
            first = place - place % fan_out
            nodes = F.get(levels, level)
            before = F.array_join(F.slice(nodes, (first + 1).cast("int"), (place - first).cast("int")), "")
            after = F.array_join(F.slice(nodes, (place + 2).cast("int"), (first + fan_out - 1 - place).cast("int")), "")
            return F.struct(before.alias("before"), after.alias("after"))

        return let(F.floor(at / F.pow(F.lit(float(fan_out)), level)), run)

    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, around)


def _placed(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """rows with place (from 0, by order in the group) and of (the group's rows), and the rows' own key as the last tie.

    The rows are sorted by ranges; a row's place is its place in its range and
    what earlier ranges hold of the group. Only counts are gathered by group.
    """
    keyed = rows.withColumn("_tie", F.monotonically_increasing_id())
    keyed = materialise(keyed, "merkle-rows")
    keys = [group, *order, "_tie"]
    sorted_rows = materialise(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "merkle-sorted")
    discard(keyed)
    counts = sorted_rows.groupBy("_part", group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(group).orderBy("_part")
    offsets = counts.select("_part", group, "_first", (F.sum("_n").over(earlier) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("of"))
    return sorted_rows.join(offsets, ["_part", group]).withColumn("place", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_tie", "_first", "_before")


def _round(nodes: DataFrame, fan_out: int, levels: int, carry: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, roots) of nodes (grp, place, of, node, carry).

    rows: the nodes with their parent's place and their siblings up to it. roots:
    (grp, place, of, node), the parents.
    """
    block = fan_out**levels
    few = F.greatest(F.lit(0), F.ceil(F.log("of") / F.log(F.lit(float(fan_out))) - 1e-9)).cast("int")  # levels until one node is left
    cell = F.struct("place", "node", *carry)
    gathered = nodes.groupBy("grp", F.expr(f"place div {block}").alias("parent")).agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.first("of").alias("of"))
    gathered = gathered.withColumn("n", F.least(F.lit(levels), few))
    tree = gathered.withColumn("levels", _levels(F.transform("cells", lambda c: c["node"]), F.col("n"), fan_out))
    own = F.transform("cells", lambda c, at: F.struct(*[c[x].alias(x) for x in ("place", "node", *carry)], _siblings(F.col("levels"), at, F.col("n"), fan_out).alias("proof")))
    tree = materialise(tree.select("grp", "parent", "of", own.alias("cells"), F.element_at(F.element_at("levels", -1), 1).alias("node")), "merkle-blocks")
    roots = tree.select("grp", F.col("parent").alias("place"), F.ceil(F.col("of") / block).alias("of"), "node")
    return tree.select("grp", "parent", "cells"), roots


def _tree(nodes: DataFrame, fan_out: int, levels: int, carry: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, above, roots) of nodes (grp, place, of, node, carry).

    blocks: (grp, parent, cells) of the lowest round. above: (grp, place, proof) of
    the blocks' roots. roots: (grp, node), one a group.
    """
    blocks, roots = _round(nodes, fan_out, levels, carry)
    upper = []
    while not roots.where("of > 1").isEmpty():
        rows, roots = _round(roots, fan_out, levels, [])  # a group that is done goes through unchanged
        upper.append(rows)
    above = roots.select("grp", F.col("place"), F.array().cast(PROOF).alias("proof"))
    for rows in reversed(upper):
        tops = above.select("grp", F.col("place").alias("parent"), F.col("proof").alias("rest"))
        joined = rows.join(tops, ["grp", "parent"]).select("grp", F.explode("cells").alias("c"), "rest")
        above = joined.select("grp", F.col("c.place").alias("place"), F.concat("c.proof", "rest").alias("proof"))
    return blocks, above, roots.select("grp", "node")


def manifest(rows: DataFrame, leaf: Column, *, group_col: str, order_cols: Sequence[str], carry: Sequence[str] = (), fan_out: int = 2, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per input row: the order and carried columns, leaf, subroot, root and proof.

    leaf is a row's digest in hex (``leaf_digest``). Groups are those of
    group_col, null being one of its own, ordered null first, then bytewise. In a
    group leaves ascend by order_cols, nulls first, then by their digests; rows that
    repeat are leaves each. proof holds, level by level up to the root, what stands
    before and after the row's node in its run, as hex laid end to end: ``fold``
    leads from a leaf to the root with it. Very long cells are hashed whole where
    they are read and moved no further. An empty table has no rows and so no root.
    Columns not named aren't read, whatever their names.
    """
    if fan_out < 2 or block_levels < 1:
        raise ValueError("fan_out is 2 or more, block_levels 1 or more")
    kept = [f"c{k}" for k in range(len(order_cols) + len(carry))]
    cells = [F.col(f"`{c}`").alias(name) for c, name in zip([*order_cols, *carry], kept, strict=True)]
    # a leading sign keeps null apart from every text, and first
    flat = rows.select(F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit("")).alias("grp"), *cells, leaf.alias("node"))
    placed = _placed(flat, "grp", [*kept[: len(order_cols)], "node"])
    blocks, above, subroots = _tree(placed, fan_out, block_levels, kept)
    subroots = materialise(subroots, "merkle-subroots")
    tops = _placed(subroots.select(F.lit(0).alias("one"), "grp", "node"), "one", ["grp"])
    top_blocks, top_above, root = _tree(tops.withColumnRenamed("grp", "name").withColumnRenamed("one", "grp"), fan_out, block_levels, ["name"])
    top_above = top_above.select("grp", F.col("place").alias("parent"), F.col("proof").alias("rest"))
    of_groups = top_blocks.join(top_above, ["grp", "parent"]).select("grp", F.explode("cells").alias("c"), "rest")
    of_groups = of_groups.join(root.select("grp", F.col("node").alias("root")), "grp").select(F.col("c.name").alias("grp"), F.col("c.node").alias("subroot"), F.concat("c.proof", "rest").alias("last"), "root")
    above = above.join(of_groups, "grp").select("grp", F.col("place").alias("parent"), F.concat("proof", "last").alias("rest"), "subroot", "root")
    out = blocks.join(above, ["grp", "parent"]).select(F.explode("cells").alias("c"), "rest", "subroot", "root")
    names = unused(rows.select(*[F.col(f"`{c}`") for c in [*order_cols, *carry]]), "leaf", "subroot", "root", "proof")
    return out.select(
        *[F.col(f"c.{k}").alias(c) for k, c in zip(kept, [*order_cols, *carry], strict=True)],
        F.col("c.node").alias(names[0]), F.col("subroot").alias(names[1]), F.col("root").alias(names[2]), F.concat("c.proof", "rest").alias(names[3]),
    )


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.concat(level["before"], node, level["after"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda level: F.concat(level["before"], level["after"])), "").cast("binary"), 256)
