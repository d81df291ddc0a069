"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows are documents, columns word shingles; the product of the matrix with its
transpose holds all overlap counts. Only blocks that can hold a link are
multiplied, and pairs that cannot reach the threshold are dropped before and
while counts add up. No link is lost:

1. Documents with one set are one row of the matrix.
2. Columns are cut by hash into blocks, with more blocks than two linked
   documents of such sizes can have differing shingles: sets linked at Jaccard t
   differ in at most (1-t)/(1+t) times the sum of their sizes. Each differing
   shingle spoils one block, so linked documents agree exactly on at least
   ``need`` of their blocks. Sizes are cut into octaves, and the seams between
   them have cuts of their own.
3. A document that agrees with others on fewer than ``need`` blocks has no
   partner. What is left keeps, in order of rising frequency, all but its last
   need - 1 agreements: one of those it shares with any partner is among them, and
   passages that many documents hold drop out.
4. Documents that agree on a kept block may link. What such agreements connect is
   multiplied together where that is at most ``TOGETHER`` tiles; of larger ones
   every block's documents are a group of their own, so that a chain of weak
   agreements costs its length. Groups of the same documents are one.
5. A group of more than one tile first meets ``PIVOTS`` of its documents. Those
   that link with a pivot are in its component and need not meet each other, so
   a group of copies of one text costs its size times the few that don't link.
6. Tiles are multiplied, a run of columns at a time. Pairs whose sizes differ too
   much, or whose count so far and columns to come cannot reach the threshold,
   are dropped. A tile passes on a spanning tree of its links.

Sets are named by 128 bits. A group of g documents of which r link with no pivot
costs r * g counts inside its tiles and moves r * g / ``tile`` rows; two tiles of
sets are the most that meet in a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import discard, first_of_each, hold_memory, materialise, no_text_as_empty, unused, with_row_key
from loomline.llm.components import connected_components
from loomline.llm.shingles import forget_powers, mix, shingle_sets

EVERY_NULL = -(1 << 63)
SEEN_MOST = 1 << 20
TOGETHER = 4
PIVOTS = 4


def grids(n: int, pct: int) -> list[tuple[int, int, int]]:
    """(grid number, blocks, blocks that a link within the grid can spoil for a set of n shingles) for each grid that holds the size n."""
    differ = lambda total: (100 - pct) * total // (100 + pct)
    octave = n.bit_length() - 1
    top = (2 << octave) - 1
    out = [(2 * octave, differ(2 * top), differ(n + min(n * 100 // pct, top)))]
    for k in (octave, octave + 1):  # the seam below size 2**k
        seam = 1 << k
        over = (seam * 100 - 1) // pct  # the largest partner of a set below the seam
        if k and pct * seam <= 100 * n and n <= over:
            other = min(n * 100 // pct, over) if n < seam else seam - 1
            out.append((2 * k + 1, differ(seam - 1 + over), differ(n + other)))
    return [(g, spoilt + spoilt // 10 + 4, own) for g, spoilt, own in out]


def agreements(hashes: np.ndarray, pct: int) -> list[tuple[int, np.ndarray]]:
    """(need, signatures of the blocks that aren't empty) of a sorted set for each of its grids."""
    n, out = len(hashes), []
    mixed = mix(hashes)
    high = hashes >> np.uint64(32)
    poor = False
    for grid, blocks, spoilt in grids(n, pct):
        block = (high * np.uint64(blocks)) >> np.uint64(32)
        start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        signature = mix(np.add.reduceat(mixed, start) ^ mix(block[start] * np.uint64(256) + np.uint64(grid)))
        need = len(start) - spoilt
        poor |= need < 1
        out.append((max(1, need), signature))
    if poor:  # links between two such sets: they share one of their least hashes
        first = hashes[: n - (pct * n + 99) // 100 + 1]
        out.append((1, mix(first ^ np.uint64(0x9E3779B97F4A7C15))))
    return out


def _incidence(pct: int, width: int):
    """(row_key, id, text_key, n, key, grids) of each text; key names its set, grids only for the first of equal sets in a task."""
    grid_type = pa.list_(pa.struct([("need", pa.int32()), ("signatures", pa.list_(pa.int64()))]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory("shingles", forget_powers)
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                values, counts = shingle_sets([t or "" for t in part.column(3).to_pylist()], width)
                ends = np.cumsum(counts)
                nodes, grid_of, needs, grid_ends, signatures = [], [0], [], [0], []
                for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
                    own = values[end - n : end]
                    key = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    nodes.append(key if n else None)
                    if n and key not in seen:
                        if len(seen) >= SEEN_MOST:
                            seen.clear()
                        seen.add(key)
                        for need, signature in agreements(own, pct):
                            needs.append(need)
                            signatures.append(signature.view(np.int64))
                            grid_ends.append(grid_ends[-1] + len(signature))
                    grid_of.append(len(needs))
                flat = np.concatenate(signatures) if signatures else np.empty(0, np.int64)
                inner = pa.ListArray.from_arrays(pa.array(grid_ends, pa.int32()), pa.array(flat))
                structs = pa.StructArray.from_arrays([pa.array(needs, pa.int32()), inner], fields=list(grid_type.value_type))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(grid_of, pa.int32()), structs)], ["row_key", "id", "text_key", "n", "key", "grids"])

    return rows


def _columns(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, column) of each entry of the columns that more than one set has, by column, and the columns' lengths."""
    value, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.empty(0, np.int64)
    lengths = np.diff(np.r_[first, len(value)])
    shared = lengths > 1
    column = np.repeat(np.where(shared, np.cumsum(shared) - 1, -1), lengths)
    return owner[column >= 0], column[column >= 0], lengths[shared]


def _sparse_counts(owner: np.ndarray, lengths: np.ndarray, g: int) -> np.ndarray:
    """Overlaps by the pairs of entries of each column."""
    partners = np.repeat(lengths, lengths)
    begin = np.repeat(np.r_[0, np.cumsum(lengths)[:-1]], lengths)
    left = np.repeat(owner, partners)
    right = owner[np.arange(partners.sum()) - np.repeat(np.cumsum(partners) - partners, partners) + np.repeat(begin, partners)]
    return np.bincount(left * g + right, minlength=g * g).reshape(g, g)


def linked(sets: list[np.ndarray], pct: int, columns: int = 4096) -> np.ndarray:
    """The square matrix of which sorted sets are linked, by counts added up over runs of columns.

    A run of columns with few entries is multiplied entry by entry, one with
    many as a matrix.
    """
    g = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, g)
    total = sizes[:, None] + sizes
    alive = 100 * np.minimum(sizes[:, None], sizes) >= pct * np.maximum(sizes[:, None], sizes)
    np.fill_diagonal(alive, False)
    owner, column, lengths = _columns(sets)
    left = np.bincount(owner, minlength=g)
    overlap = np.zeros((g, g))
    for at in range(0, len(lengths), columns):
        begin, end = np.searchsorted(column, (at, at + columns))
        some = lengths[at : at + columns]
        if (some.astype(np.float64) ** 2).sum() <= min(1 << 22, g * g * len(some) / 64):
            overlap += _sparse_counts(owner[begin:end], some, g)
        else:
            x = np.zeros((g, len(some)), np.float32)
            x[owner[begin:end], column[begin:end] - at] = 1
            overlap += x @ x.T
        left = left - np.bincount(owner[begin:end], minlength=g)
        alive &= (100 + pct) * (overlap + np.minimum(left[:, None], left)) >= pct * total
        if not alive.any():
            break
    return alive & (100 * overlap >= pct * (total - overlap))


def _spanning(keys: np.ndarray, links: np.ndarray) -> list[tuple[bytes, bytes]]:
    """A star for each component of a tile."""
    label = np.arange(len(keys))
    while True:
        new = np.minimum(label, np.where(links, label, len(keys)).min(1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(keys[k], keys[label[k]]) for k in np.flatnonzero(label != np.arange(len(keys)))]


def _multiply(pct: int):
    def tile(pdf):
        import pandas as pd

        edges: list[tuple[bytes, bytes]] = []
        for _, group in pdf.groupby("unit", sort=False):
            links = linked([np.frombuffer(x, np.uint64) for x in group["hashes"]], pct)
            edges += _spanning(group["key"].to_numpy(), links)
        return pd.DataFrame(edges, columns=["a", "b"])

    return tile


def _meet_pivots(pct: int):
    """(key, pivot) of a tile's rows that link with a pivot, the first such."""

    def tile(pdf):
        import pandas as pd

        rows, pivots = pdf[~pdf["pivot"]], pdf[pdf["pivot"]].drop_duplicates("key").sort_values("key")
        keys = rows["key"].to_numpy()
        sizes = np.array([len(x) // 8 for x in rows["hashes"]], np.int64)
        every = np.frombuffer(b"".join(rows["hashes"]), np.uint64)
        start = np.cumsum(sizes) - sizes
        edges = []
        for key, hashes in zip(pivots["key"], pivots["hashes"], strict=True):
            own = np.frombuffer(hashes, np.uint64)
            place = np.minimum(np.searchsorted(own, every), len(own) - 1)
            both = np.add.reduceat(own[place] == every, start) if len(start) else sizes
            edges += [(keys[k], key) for k in np.flatnonzero(100 * both >= pct * (sizes + len(own) - both)) if keys[k] != key]
        return pd.DataFrame(edges, columns=["a", "b"])

    return tile


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (node, slot, signature) sorted by signature and node those whose neighbour has the same signature, equal rows once.

    What stands at either end of a partition stays, since its neighbour is elsewhere.
    """
    held, before = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        node, slot, signature = (batch.column(k).to_numpy() for k in range(3))
        if held:
            node, slot, signature = np.r_[held[0], node], np.r_[held[1], slot], np.r_[held[2], signature]
        new = np.r_[True, (signature[1:] != signature[:-1]) | (node[1:] != node[:-1])]
        node, slot, signature = node[new], slot[new], signature[new]
        like = signature[1:] == signature[:-1]
        stays = np.r_[before, like][:-1] | like
        before = bool(like[-1]) if len(like) else before
        held = (node[-1:], slot[-1:], signature[-1:])
        if stays.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][stays]) for c in (node, slot, signature)], ["node", "slot", "signature"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], ["node", "slot", "signature"])


def _candidates(rows: DataFrame) -> DataFrame:
    """(node, signature) of agreements that may belong to a link; node is the first half of a key, and keys that share it count as one, which keeps more."""
    each = rows.where(F.size("grids") > 0).select(_node(F.col("key")).alias("node"), F.posexplode("grids").alias("grid", "g")).select("node", (F.col("g.need") * 4 + F.col("grid")).cast("int").alias("slot"), F.explode("g.signatures").alias("signature"))
    # dealt by range of signature and node, a signature that many sets share is several tasks' work
    agreed = materialise(each.repartitionByRange("signature", "node").sortWithinPartitions("signature", "node").mapInArrow(_agreeing, "node long, slot int, signature long"), "agreements")
    shared = lambda out: out.join(out.groupBy("signature").agg(F.count("*").alias("df")).where("df > 1"), "signature")
    in_grid = Window.partitionBy("node", "slot")  # at most as many rows as a set has blocks
    need = F.shiftright("slot", 2)
    out = agreed
    for _ in range(2):  # who falls away takes agreements from others
        out = shared(out.withColumn("c", F.count("*").over(in_grid)).where(F.col("c") >= need).drop("c", "df"))
    out = out.withColumn("c", F.count("*").over(in_grid)).withColumn("rank", F.row_number().over(in_grid.orderBy("df", "signature")))
    kept = materialise(out.where((F.col("c") >= need) & (F.col("rank") <= F.col("c") - need + 1)).select("node", "signature"), "kept")
    discard(agreed)
    return kept


def _node(key: Column) -> Column:
    """The first eight bytes of a key as a number."""
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long")


def _hashes(docs: DataFrame, width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory("shingles", forget_powers)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                values, counts = shingle_sets([t or "" for t in batch.slice(at, 512).column(0).to_pylist()], width)
                sets = [x.tobytes() for x in np.split(values, np.cumsum(counts)[:-1])] if len(counts) else []
                keys = [hashlib.blake2b(x, digest_size=16).digest() for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "hashes"])

    return docs.mapInArrow(rows, "key binary, hashes binary")


EDGES = "a binary, b binary"


def _tile_count(tile: int) -> Column:
    return F.ceil(F.count("*") / tile).cast("int")


def _by_components(sets: DataFrame, sizes: DataFrame, members: int, pct: int, tile: int) -> DataFrame:
    """Edges within components (component, tiles) of at most TOGETHER tiles; small ones share a task."""
    buckets = max(1, math.ceil(members / (2 * tile)))
    dealt = sets.join(sizes.where(F.col("tiles") <= TOGETHER), "component").withColumn("i", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    small = dealt.where("tiles = 1").select(F.col("component").alias("unit"), "key", "hashes", F.pmod(F.xxhash64("component"), F.lit(buckets)).alias("bucket"), F.lit(-1).alias("one"), F.lit(-1).alias("two"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least("i", j).alias("one"), F.greatest("i", j).alias("two")))
    several = dealt.where("tiles > 1").select(F.col("component").alias("unit"), "key", "hashes", F.col("component").alias("bucket"), F.explode(pairs).alias("p")).select("unit", "key", "hashes", "bucket", "p.one", "p.two")
    return small.unionByName(several).groupBy("bucket", "one", "two").applyInPandas(_multiply(pct), EDGES)


def _by_signatures(sets: DataFrame, kept: DataFrame, groups: DataFrame, sizes: DataFrame, pct: int, tile: int) -> DataFrame:
    """Edges within larger components: of each two documents that agree on a kept block."""
    nodes = groups.join(sizes.where(F.col("tiles") > TOGETHER), "component").select("node")
    agreed = materialise(kept.join(nodes, "node"), "agreed")
    same = agreed.groupBy("signature").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    chosen = same.groupBy("n", "x", "y").agg(F.min("signature").alias("signature")).select("signature", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    rows = agreed.join(chosen, "signature").join(sets.drop("component").withColumn("node", _node(F.col("key"))), "node").select("signature", "tiles", "key", "hashes")
    rows = materialise(rows, "groups")
    discard(agreed)
    single = rows.where("tiles = 1").select(F.col("signature").alias("unit"), "key", "hashes", F.col("signature").alias("bucket"), F.lit(-1).cast("long").alias("one"), F.lit(-1).cast("long").alias("two"))
    edges = single.groupBy("bucket", "one", "two").applyInPandas(_multiply(pct), EDGES)
    large = rows.where("tiles > 1")
    if large.isEmpty():
        return edges
    least = [F.min(F.struct(F.xxhash64("key", F.lit(k)).alias("h"), "key", "hashes")) for k in range(PIVOTS)]
    pivots = large.groupBy("signature", "tiles").agg(F.array(*least).alias("p")).select("signature", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("i"), F.explode("p").alias("p"))
    dealt = large.select("signature", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int").alias("i"), "key", "hashes", F.lit(False).alias("pivot"))
    stars = dealt.unionByName(pivots.select("signature", "i", "p.key", "p.hashes", F.lit(True).alias("pivot"))).groupBy("signature", "i").applyInPandas(_meet_pivots(pct), EDGES)
    stars = materialise(stars.distinct(), "stars")
    labels = connected_components(stars).select(F.col("node").alias("key"), "label")
    placed = materialise(large.select("signature", "key", "hashes").join(labels, "key", "left").withColumn("label", F.coalesce("label", F.lit(b""))), "placed")
    tiles = placed.groupBy("signature", "label").agg(_tile_count(tile).alias("own_tiles"))
    name = lambda j: F.xxhash64("label", j)
    own = placed.join(tiles, ["signature", "label"]).withColumn("own", name(F.pmod(F.xxhash64("key"), F.col("own_tiles")).cast("int")))
    others = tiles.select("signature", "label", F.explode(F.sequence(F.lit(0), F.col("own_tiles") - 1)).alias("j")).select("signature", name(F.col("j")).alias("other"), F.col("label").alias("other_label"))
    met = own.join(others, "signature").where((F.col("label") == b"") | (F.col("label") != F.col("other_label")))
    pairs = met.select(F.col("signature").alias("unit"), "key", "hashes", F.col("signature").alias("bucket"), F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
    return edges.unionByName(stars).unionByName(pairs.groupBy("bucket", "one", "two").applyInPandas(_multiply(pct), EDGES))


def _links(texts: DataFrame, rows: DataFrame, *, pct: int, width: int, tile: int, broadcast_ids: int) -> DataFrame | None:
    """(node, label), both keys, of what is linked with another."""
    kept = _candidates(rows)
    least = kept.groupBy("signature").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).where("pivot < top")
    stars = kept.join(least, "signature").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    groups = materialise(connected_components(stars).withColumnRenamed("label", "component"), "groups")
    members = groups.count()
    if not members:
        discard(kept)
        return None
    # one row of each set to take its text from; equal sets are one before they are dealt out
    one = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id")).withColumn("node", _node(F.col("key")))
    source = one.join(groups, "node", "left_semi").select(F.coalesce("id", F.lit(EVERY_NULL)).alias("source")).distinct()
    keyed = texts.withColumn("source", F.coalesce("id", F.lit(EVERY_NULL)))
    found = keyed.join(F.broadcast(source) if members <= broadcast_ids else source, "source", "left_semi").select("text")
    sets = _hashes(found, width).withColumn("node", _node(F.col("key"))).join(groups, "node").groupBy("key", "component").agg(F.first("hashes").alias("hashes"))
    sets = materialise(sets, "sets")
    sizes = materialise(groups.groupBy("component").agg(_tile_count(tile).alias("tiles")), "sizes")
    edges = _by_components(sets, sizes, members, pct, tile)
    if not sizes.where(F.col("tiles") > TOGETHER).isEmpty():
        edges = edges.unionByName(_by_signatures(sets, kept, groups, sizes, pct, tile))
    edges = materialise(edges, "links")
    discard(kept, sets, groups)
    return connected_components(edges)


def _labelled(docs: DataFrame, id_col: str, text_col: str, pct: int, width: int, tile: int, broadcast_ids: int) -> DataFrame:
    """(row_key, id, text_key, n, key) of each row; key names the component, null without words."""
    if not 50 <= pct <= 100:
        raise ValueError("pct is from 50 to 100")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), no_text_as_empty(text_col).alias("text"))
    schema = "row_key long, id long, text_key long, n long, key binary, grids array<struct<need:int,signatures:array<long>>>"
    keyed = with_row_key(texts).select("row_key", "id", F.xxhash64("text").alias("text_key"), "text")
    rows = materialise(keyed.mapInArrow(_incidence(pct, width), schema), "incidence")
    labels = _links(texts, rows, pct=pct, width=width, tile=tile, broadcast_ids=broadcast_ids)
    narrow = rows.select("row_key", "id", "text_key", "n", "key")
    if labels is None:
        return narrow
    return narrow.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("key", F.coalesce("label", "key")).drop("label")


def ngram_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", pct: int = 80, width: int = 5, tile: int = 512, broadcast_ids: int = 500_000) -> DataFrame:
    """One row per input row: its id, n_shingles, component_id.

    Documents are linked when 100 * overlap >= pct * union of their sets of
    ``width``-word shingles; a component is what links reach, named by its
    smallest id. Texts without words, and null ones, are linked with nothing and
    are their own components. Repeated rows are in one component. A row with a
    null id is in its component but does not name it unless it has no other.
    Texts of any length are taken whole, a text by one task. An empty table gives no rows; other columns aren't read.
    """
    labelled = _labelled(docs, id_col, text_col, pct, width, tile, broadcast_ids)
    # written, so that the join below deals out both sides anew and Spark can split a hot component
    labelled = materialise(labelled.select("id", "n", "key"), "labelled")
    named = materialise(labelled.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("component_id")), "named")
    return labelled.join(named, "key", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", pct: int = 80, width: int = 5, tile: int = 512, broadcast_ids: int = 500_000) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, of which one stands for each component: the one with the smallest id.

    A null id comes after all others, rows that share an id go by a hash of
    their text; of rows that share both the one whose columns, as JSON, come
    first stays, of equal rows one. Rows without words (null and empty texts
    too) all stay. An empty table stays empty.
    """
    labelled = materialise(_labelled(docs, id_col, text_col, pct, width, tile, broadcast_ids).select("id", "text_key", "key"), "labelled")
    first = labelled.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("k")).select("k.id", "k.text_key")
    one, key, text_key = unused(docs, "_id", "_key", "_text_key")
    stay = first.unionByName(labelled.where("key IS NULL").select("id", "text_key").distinct()).select(F.col("id").alias(one), F.col("text_key").alias(key))
    stay = materialise(stay, "stay")
    keyed = docs.withColumn(text_key, F.xxhash64(no_text_as_empty(text_col)))
    out = keyed.join(stay, F.col(text_key).eqNullSafe(F.col(key)) & F.col(id_col).cast("long").eqNullSafe(F.col(one)), "left_semi")
    repeats = labelled.where("key IS NOT NULL").groupBy("id", "text_key").count().where("count > 1")
    if not repeats.isEmpty():  # ties are only looked at where there are any
        worded = F.coalesce(F.col(text_col).rlike("[^ \\t\\n\\x0B\\f\\r]"), F.lit(False))
        out = first_of_each(out.where(worded), [text_key, id_col], docs.columns).unionByName(out.where(~worded))
    return out.drop(text_key)
