"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search.

Distinct vectors are the nodes. They are sorted along random hyperplane codes
and cut into blocks of at most ``BLOCK`` nodes, so a node's number names its
block and near nodes often share one. The first graph comes from a few such
orders: nodes of a run of ``chunk`` are compared with each other. More than one
order is needed to connect the runs. Then rounds of
NN-descent join the neighbours of neighbours: a block gathers, by joins on the
block, the vectors of all nodes its own point to or are pointed to by; each of
its nodes introduces those to each other, new ones to all; what is nearer than a
node's worst neighbour goes back to that node's block.

Vectors are scaled to a length of at most 1 and get one more component that makes
it 1, so that the graph links what is near whatever the lengths; a query leaves
that component out. It starts at its own node and keeps the ``beam`` best nodes met.
Each round joins the best ``EXPAND`` of those not expanded yet with the graph, whose
rows hold the vectors of a node's neighbours and of nodes pointing to it in half
precision, until none is left. The best are scored again on the original vectors in
double precision.

Blocks, neighbour lists and beams have fixed bounds. What many send to one block (a
hub's, or that of the longest vectors, which all queries meet) is dealt to copies of
the block, or thinned in parts, from ``LOAD`` bytes on. Equal vectors are one node,
however many rows share it. Vectors of each number of components have a graph of
their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import discard, materialise

BITS = 8
BLOCK = 1 << BITS
EXPAND = 64
LOAD = 24 << 20
PROPOSED = 12
GRAPH = "nid long, node long, vector binary, ids binary, scores binary, fresh binary"
MESSAGE = "block long, sender long, kind int, first binary, second binary, third binary"


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>, n) of the rows that take part: an id, no null or non-finite component, not zero; n is the number of components."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine).distinct().withColumn("n", F.size("v"))


def _release() -> None:
    """Give freed memory back to the system, large arrays as soon as they go: workers are reused and share a small executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own ways
        pass


def _message(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["block", "sender", "kind", "first", "second", "third"])


def _rows_frame(rows: list[tuple]):
    import pandas as pd

    return pd.DataFrame(rows, columns=["block", "sender", "kind", "first", "second", "third"])


def _stack(column, dtype, width: int | None = None) -> np.ndarray:
    """Binary cells of equal lengths as the rows of a matrix."""
    flat = np.frombuffer(b"".join(column), dtype)
    return flat.reshape(len(column), -1 if len(column) else (width or 0))


def _best(i: np.ndarray, j: np.ndarray, s: np.ndarray, fresh: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """For each i its k best j, best first; of repeats one that isn't fresh stays."""
    order = np.lexsort((fresh, j, i))
    i, j, s, fresh = i[order], j[order], s[order], fresh[order]
    first = np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])] if len(i) else np.empty(0, bool)
    i, j, s, fresh = i[first], j[first], s[first], fresh[first]
    order = np.lexsort((j, -s, i))
    i, j, s, fresh = i[order], j[order], s[order], fresh[order]
    start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, np.int64)
    rank = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
    keep = rank < k
    return i[keep], j[keep], s[keep], fresh[keep], rank[keep]


def _graph_rows(nids, nodes, vectors, i, j, s, fresh, rank, k: int):
    """Rows of the graph from flat edges; places without a neighbour hold id -1 and score -inf."""
    import pandas as pd

    n = len(nids)
    at = np.searchsorted(nids, i)
    ids, scores, new = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf, np.float32), np.zeros((n, k), np.uint8)
    ids[at, rank], scores[at, rank], new[at, rank] = j, s, fresh
    return pd.DataFrame({"nid": nids, "node": nodes, "vector": vectors, "ids": [x.tobytes() for x in ids], "scores": [x.tobytes() for x in scores], "fresh": [x.tobytes() for x in new]})


class Order:
    """A linear order by the codes of random hyperplanes between sampled vectors, then by a projection."""

    def __init__(self, sample: np.ndarray, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        a, b = sample[rng.integers(0, len(sample), bits + 1)], sample[rng.integers(0, len(sample), bits + 1)]
        noise = rng.normal(size=a.shape) * (1e-3 * np.abs(sample).max())
        self.normals, self.bits = (a - b + noise).astype(np.float32), bits
        self.offsets = (self.normals * (a + b) / 2).sum(1).astype(np.float32)

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        side = x @ self.normals.T - self.offsets
        code = np.zeros(len(x), np.int64)
        parity = np.zeros(len(x), np.int64)
        for k in range(self.bits):  # Gray code: following codes differ in one side
            parity ^= side[:, k] > 0
            code = code << 1 | parity
        return code, side[:, -1].astype(np.float64)


def _ordered(rows: DataFrame, order: Order, parts: int) -> DataFrame:
    """rows (nid, node, vector) sorted along an order, in partitions that follow it."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stack([c.as_buffer() for c in batch.column("vector")], np.float32, order.normals.shape[1])
            code, along = order.keys(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(along)], [*batch.schema.names, "code", "along"])

    out = rows.mapInArrow(keyed, "nid long, node long, vector binary, code long, along double")
    return out.repartitionByRange(parts, "code", "along", "node").sortWithinPartitions("code", "along", "node")


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a partition in runs of a size."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - rows)
            batch = batch.slice(part.num_rows)
            held.append(part)
            rows += part.num_rows
            if rows == size:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (nid, node, vector) numbered in their order, so that blocks are full whatever the number of partitions."""
    placed = materialise(rows.withColumn("at", F.monotonically_increasing_id()).select("node", "vector", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("pos")), "placed")
    sizes = placed.groupBy("part").agg(F.count("*").alias("rows"))  # a row for each partition
    offsets = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("offset"))
    out = materialise(placed.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("pos")).alias("nid"), "node", "vector"), "numbered")
    discard(placed)
    return out


def _likeness(v: np.ndarray, distance: bool) -> np.ndarray:
    """Products of all rows, or half their squared distances below 0; summed in float64, since vectors that lie close differ in late digits."""
    v = v.astype(np.float64)
    s = v @ v.swapaxes(-1, -2)
    if distance:
        half = (v * v).sum(-1) / 2
        s -= half[..., :, None] + half[..., None, :]
    return s.astype(np.float32)


def _compare_runs(k: int, chunk: int, distance: bool):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, chunk):
            nid = run.column("nid").to_numpy()
            x = _stack([c.as_buffer() for c in run.column("vector")], np.float32)
            scores = _likeness(x, distance)
            np.fill_diagonal(scores, -np.inf)
            most = min(k, len(nid) - 1)
            ids, best = np.full((len(nid), k), -1, np.int64), np.full((len(nid), k), -np.inf, np.float32)
            if most:
                at = np.argpartition(-scores, most - 1, axis=1)[:, :most]
                ids[:, :most], best[:, :most] = nid[at], np.take_along_axis(scores, at, 1)
            yield pa.RecordBatch.from_arrays([pa.array(nid), run.column("node").combine_chunks(), run.column("vector").combine_chunks(), pa.array([r.tobytes() for r in ids]), pa.array([r.tobytes() for r in best])], ["nid", "node", "vector", "ids", "scores"])

    return compare


def _merge_first(k: int):
    def merge(pdf):
        one = pdf.drop_duplicates("nid").sort_values("nid")
        ids, scores = _stack(pdf["ids"], np.int64), _stack(pdf["scores"], np.float32)
        i = np.repeat(pdf["nid"].to_numpy(), k)
        fine = ids.ravel() >= 0
        edges = _best(i[fine], ids.ravel()[fine], scores.ravel()[fine], np.ones(int(fine.sum()), np.uint8), k)
        return _graph_rows(one["nid"].to_numpy(), one["node"].to_numpy(), one["vector"], *edges, k)

    return merge


def _by_block(nid="nid"):
    return F.shiftright(nid, BITS).alias("block")


def _released(what):
    """what, after the memory of the group before is given back."""

    def run(key, left, right):
        _release()
        return what(key, left, right)

    return run


def _meet(left: DataFrame, right: DataFrame, what, schema: str) -> DataFrame:
    """Join the two sides' rows of each block; both have a column block."""
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(_released(what), schema)


def _loud(messages: DataFrame, load: int) -> DataFrame:
    """(block, copies) of the blocks that get more than ``load`` bytes; at most their sum / load rows."""
    size = F.sum(F.length("first") + F.length("second") + F.length("third"))
    return messages.groupBy("block").agg(F.ceil(size / load).cast("int").alias("copies")).where("copies > 1")


def _copy() -> Column:
    return F.pmod(F.xxhash64("sender", "first"), F.col("copies")).cast("int").alias("copy")


def _meet_dealt(graph: DataFrame, messages: DataFrame, what, schema: str) -> DataFrame:
    """_meet for what answers each message on its own: a block that gets many is copied, each copy gets a part."""
    messages = materialise(messages, "messages")
    loud = materialise(_loud(messages, LOAD), "loud")
    if loud.isEmpty():
        return _meet(graph, messages, what, schema)
    few = _meet(graph, messages.join(loud, "block", "left_anti"), what, schema)
    names = messages.columns
    left = graph.join(loud, "block").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select(*graph.columns, "copy")
    right = messages.join(loud, "block").select(*names, _copy())
    return few.unionByName(left.groupBy("block", "copy").cogroup(right.groupBy("block", "copy")).applyInPandas(_released(lambda key, g, m: what(key, g.drop(columns="copy"), m)), schema))


def _thinned(messages: DataFrame, k: int, third: list[tuple[str, str]]) -> DataFrame:
    """Messages of edges (i, j, third with a score s), of which a block that gets many keeps the k best of each node, part by part."""
    messages = materialise(messages, "messages")
    loud = materialise(_loud(messages, LOAD), "loud")
    if loud.isEmpty():
        return messages
    kind = np.dtype(third)

    def thin(key, pdf):
        i, j = (np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("first", "second"))
        more = np.frombuffer(b"".join(pdf["third"]), kind)
        i, j, _, at, _ = _best(i, j, more["s"], np.arange(len(i)), k)
        return _rows_frame(_to_blocks(i, int(pdf["sender"].iloc[0]), int(pdf["kind"].iloc[0]), i, j, more[at]))

    parts = messages.join(loud, "block").select(*messages.columns, _copy())
    thin_parts = parts.groupBy("block", "copy").applyInPandas(thin, MESSAGE)
    return messages.join(loud, "block", "left_anti").unionByName(thin_parts)


def _same(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]) if len(values) else np.empty(0, np.int64)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _to_blocks(at: np.ndarray, sender: int, kind: int, *columns: np.ndarray) -> list[tuple]:
    """Messages of columns, cut by the blocks of ``at``."""
    block = at >> BITS
    order = np.argsort(block, kind="stable")
    out = []
    for begin, end in _same(block[order]):
        some = order[begin:end]
        cells = [c[some].tobytes() for c in columns]
        out.append((int(block[some[0]]), sender, kind, *(cells + [b""] * (3 - len(cells)))))
    return out


def _reversed(k: int):
    """Each edge told to the node it points to: of a task's, the k best for a node."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _stack([c.as_buffer() for c in batch.column("ids")], np.int64, k).ravel()
            scores = _stack([c.as_buffer() for c in batch.column("scores")], np.float32, k).ravel()
            fresh = _stack([c.as_buffer() for c in batch.column("fresh")], np.uint8, k).ravel()
            of = np.repeat(batch.column("nid").to_numpy(), k)
            fine = ids >= 0
            i, j, s, f, _ = _best(ids[fine], of[fine], scores[fine], fresh[fine], k)
            yield _message(_to_blocks(i, -1, 0, i, j, np.rec.fromarrays([s, f], dtype=[("s", "<f4"), ("f", "u1")])))

    return tell


def _gather_lists(k: int):
    """A block's lists of known nodes (kind 0, to itself) and what it asks other blocks for (kind 1)."""

    def gather(key, graph, told):
        block = int(key[0])
        if not len(graph):
            return _rows_frame([])
        graph = graph.sort_values("nid")
        nids = graph["nid"].to_numpy()
        ids, fresh = _stack(graph["ids"], np.int64), _stack(graph["fresh"], np.uint8)
        i, j = np.frombuffer(b"".join(told["first"]), np.int64), np.frombuffer(b"".join(told["second"]), np.int64)
        sf = np.frombuffer(b"".join(told["third"]), np.dtype([("s", "<f4"), ("f", "u1")]))
        i, j, _, f, rank = _best(i, j, sf["s"], sf["f"], k)
        back, back_fresh = np.full((len(nids), k), -1, np.int64), np.zeros((len(nids), k), np.uint8)
        at = np.searchsorted(nids, i)
        back[at, rank], back_fresh[at, rank] = j, f
        known, new = np.concatenate([ids, back], 1), np.concatenate([fresh, back_fresh], 1)
        order = np.lexsort((1 - new, known), axis=1)  # of a node known both ways one stays, fresh if either is
        known, new = np.take_along_axis(known, order, 1), np.take_along_axis(new, order, 1)
        known[:, 1:][known[:, 1:] == known[:, :-1]] = -1
        active = (new.astype(bool) & (known >= 0)).any(1)  # a node with nothing fresh introduces nobody
        known, new = known[active], new[active]
        asked = np.unique(known[known >= 0])
        return _rows_frame([(block, block, 0, known.tobytes(), new.tobytes(), b""), *_to_blocks(asked, block, 1, asked)])

    return gather


def _answer(dtype):
    """The vectors and worst scores of the nodes that other blocks asked for."""

    def answer(key, graph, asked):
        graph = graph.sort_values("nid")
        nids, vectors, worst = graph["nid"].to_numpy(), _stack(graph["vector"], np.float32), _stack(graph["scores"], np.float32)
        out = []
        for sender, first in zip(asked["sender"], asked["first"], strict=True):
            want = np.frombuffer(first, np.int64)
            at = np.searchsorted(nids, want)
            out.append((int(sender), int(key[0]), 2, first, vectors[at].astype(dtype).tobytes(), worst[at, -1].tobytes()))
        return _rows_frame(out)

    return answer


def _introduce(k: int, distance: bool):
    """Within each list, pairs with a fresh node that are nearer than the worst neighbour of either; of a block's the PROPOSED best go to each node, which hears from many blocks."""

    def introduce(key, lists, answers):
        if not len(lists) or not len(answers):
            return _rows_frame([])
        ids = np.frombuffer(b"".join(answers["first"]), np.int64)
        x = np.frombuffer(b"".join(answers["second"]), np.float32).reshape(len(ids), -1)
        worst = np.frombuffer(b"".join(answers["third"]), np.float32)
        order = np.argsort(ids)
        ids, x, worst = ids[order], x[order], worst[order]
        known = np.frombuffer(lists["first"].iloc[0], np.int64).reshape(-1, 2 * k)
        new = np.frombuffer(lists["second"].iloc[0], np.uint8).reshape(-1, 2 * k).astype(bool) & (known >= 0)
        i, j, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        for begin in range(0, len(known), 32):
            some, fresh = known[begin : begin + 32], new[begin : begin + 32]
            at = np.searchsorted(ids, np.where(some >= 0, some, ids[0]))
            score = _likeness(x[at], distance)
            fine = (some >= 0)[:, :, None] & (some >= 0)[:, None, :] & (fresh[:, :, None] | fresh[:, None, :]) & (score > worst[at][:, :, None])
            fine[:, np.arange(2 * k), np.arange(2 * k)] = False
            r, a, b = np.nonzero(fine)
            i, j, s = np.r_[i, some[r, a]], np.r_[j, some[r, b]], np.r_[s, score[r, a, b]]
            i, j, s, _, _ = _best(i, j, s, np.ones(len(i), np.uint8), PROPOSED)
        return _rows_frame(_to_blocks(i, int(key[0]), 3, i, j, s))

    return introduce


def _take(k: int):
    """A block's graph with the proposals taken in; edges that were there are no longer fresh."""

    def take(key, graph, proposals):
        import pandas as pd

        graph = graph.sort_values("nid")
        nids = graph["nid"].to_numpy()
        ids, scores = _stack(graph["ids"], np.int64).ravel(), _stack(graph["scores"], np.float32).ravel()
        i, fine = np.repeat(nids, k), ids >= 0
        more = [np.frombuffer(b"".join(proposals[c]), t) for c, t in (("first", np.int64), ("second", np.int64), ("third", np.float32))] if len(proposals) else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)]
        fresh = np.r_[np.zeros(int(fine.sum()), np.uint8), np.ones(len(more[0]), np.uint8)]
        edges = _best(np.r_[i[fine], more[0]], np.r_[ids[fine], more[1]], np.r_[scores[fine], more[2]], fresh, k)
        return _graph_rows(nids, graph["node"].to_numpy(), graph["vector"], *edges, k) if len(nids) else pd.DataFrame(columns=["nid", "node", "vector", "ids", "scores", "fresh"])

    return take


def build_graph(vectors: DataFrame, count: int, sample: np.ndarray, *, k: int = 32, orders: int = 4, chunk: int = 1024, rounds: int | None = None, settled: float = 0.002, distance: bool = False) -> DataFrame:
    """The graph (GRAPH) of vectors (node long, vector binary of float32) by products or distances; rounds end when under a share ``settled`` of edges is fresh, or after ``rounds`` if given."""
    parts = max(1, math.ceil(count / (4 * chunk)))
    bits = min(40, max(1, math.ceil(math.log2(max(2, count / chunk))) + 3))
    rows = vectors.select(F.lit(0).cast("long").alias("nid"), "node", "vector")
    numbered = _numbered(_ordered(rows, Order(sample, bits, 0), parts))
    first = None
    for seed in range(orders):
        near = _ordered(numbered, Order(sample, bits, seed), parts).select("nid", "node", "vector").mapInArrow(_compare_runs(k, chunk, distance), "nid long, node long, vector binary, ids binary, scores binary")
        first = near if first is None else first.unionByName(near)
    graph = materialise(first.groupBy(_by_block()).applyInPandas(_merge_first(k), GRAPH), "graph")
    discard(numbered)
    done = 0
    while rounds is None or done < rounds:
        done += 1
        own = graph.withColumn("block", F.shiftright("nid", BITS))
        told = graph.select("nid", "ids", "scores", "fresh").mapInArrow(_reversed(k), MESSAGE)
        told = _thinned(told, k, [("s", "<f4"), ("f", "u1")])
        lists = materialise(_meet(own, told, _gather_lists(k), MESSAGE), "lists")
        answers = _meet_dealt(own, lists.where("kind = 1"), _answer(np.float32), MESSAGE)
        proposals = _thinned(_meet(lists.where("kind = 0"), answers, _introduce(k, distance), MESSAGE), k, [("s", "<f4")])
        after = materialise(_meet(own, proposals, _take(k), GRAPH), "graph")
        discard(graph, lists)
        graph = after
        if after.agg(F.sum(F.length(F.replace(F.hex("fresh"), F.lit("00"), F.lit(""))) / 2)).first()[0] < settled * count * k:
            break
    return graph


def _pointed_at(k: int):
    """Each edge told to the node it points to, with the last two components of the node it comes from."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _stack([c.as_buffer() for c in batch.column("ids")], np.int64, k).ravel()
            scores = _stack([c.as_buffer() for c in batch.column("scores")], np.float32, k).ravel()
            last, band = np.repeat(_stack([c.as_buffer() for c in batch.column("vector")], np.float32)[:, -2:], k, axis=0).T
            length = band + np.log2(np.maximum(1 - last.astype(np.float64) ** 2, 1e-30)) / 2
            of = np.repeat(batch.column("nid").to_numpy(), k)
            fine = ids >= 0
            # of a task's edges to a node k go on: those that come from the longest vectors
            i, j, _, at, _ = _best(ids[fine], of[fine], length[fine], np.flatnonzero(fine), k)
            yield _message(_to_blocks(i, -1, 0, i, j, np.rec.fromarrays([scores[at], last[at], band[at]], dtype=[("s", "<f4"), ("last", "<f4"), ("band", "<f4")])))

    return tell


def _both_ways(k: int):
    """Rows (nid, ids, vector) with a node's neighbours and the k nodes pointing to it that have the largest inner products with it."""

    def join(key, graph, told):
        import pandas as pd

        if not len(graph):
            return pd.DataFrame({"nid": [], "ids": [], "vector": []})
        graph = graph.sort_values("nid")
        nids, own = graph["nid"].to_numpy(), _stack(graph["ids"], np.int64)
        last = _stack(graph["vector"], np.float32)[:, -2].astype(np.float64)
        back = np.full((len(nids), k), -1, np.int64)
        if len(told):
            i, j = np.frombuffer(b"".join(told["first"]), np.int64), np.frombuffer(b"".join(told["second"]), np.int64)
            more = np.frombuffer(b"".join(told["third"]), np.dtype([("s", "<f4"), ("last", "<f4"), ("band", "<f4")]))
            i, j, _, _, rank = _best(i, j, (1 + more["s"] - last[np.searchsorted(nids, i)] * more["last"]) * np.exp2(more["band"].astype(np.float64)), np.zeros(len(i), np.uint8), k)
            back[np.searchsorted(nids, i), rank] = j
        ids = np.sort(np.concatenate([own, back], 1), axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        return pd.DataFrame({"nid": nids, "ids": [r.tobytes() for r in ids], "vector": graph["vector"]})

    return join


def _with_vectors(k: int):
    """Requests for the vectors of a block's neighbours (kind 1)."""

    def ask(key, pdf):
        ids = np.unique(_stack(pdf["ids"], np.int64))
        ids = ids[ids >= 0]
        return _rows_frame(_to_blocks(ids, int(key[0]), 1, ids))

    return ask


def _attach(k: int):
    """Each node's neighbours as differences from it in float16, with the size of each difference and the neighbour's power of two: the nearer, the finer."""

    def attach(key, graph, answers):
        import pandas as pd

        if not len(graph) or not len(answers):
            return pd.DataFrame(columns=["nid", "ids", "vector", "vectors", "sizes"])
        ids = np.frombuffer(b"".join(answers["first"]), np.int64)
        x = np.frombuffer(b"".join(answers["second"]), np.float32).reshape(len(ids), -1)
        order = np.argsort(ids)
        near = _stack(graph["ids"], np.int64)
        at = order[np.minimum(np.searchsorted(ids, near.clip(0), sorter=order), len(ids) - 1)]
        vectors, sizes = [], []
        for own, r in zip(_stack(graph["vector"], np.float32), at, strict=True):
            apart = x[r, :-2] - own[:-2]
            size = np.abs(apart).max(1)
            size[size == 0] = 1
            vectors.append((apart / size[:, None]).astype(np.float16).tobytes())
            sizes.append(np.column_stack([size, x[r, -1]]).tobytes())
        return pd.DataFrame({"nid": graph["nid"], "ids": graph["ids"], "vector": graph["vector"], "vectors": vectors, "sizes": sizes})

    return attach


BEAM = "nid long, node long, vector binary, ids binary, scores binary, expanded binary"


def _expand(beam: int):
    """Each query's best nodes not expanded yet, told to their blocks with the query's vector."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = np.dtype([("row", "<i4"), ("u", "<i8")])
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                nids = part.column("nid").to_numpy()
                x = _stack([c.as_buffer() for c in part.column("vector")], np.float32)
                ids = _stack([c.as_buffer() for c in part.column("ids")], np.int64)
                scores = _stack([c.as_buffer() for c in part.column("scores")], np.float32)
                done = _stack([c.as_buffer() for c in part.column("expanded")], np.uint8)
                open_ = (ids >= 0) & (done == 0)
                row, col = np.nonzero(open_ & (np.cumsum(open_, axis=1) <= EXPAND))  # the best come first
                u = ids[row, col]
                block = u >> BITS
                order = np.argsort(block, kind="stable")
                out = []
                for a, b in _same(block[order]):
                    some = order[a:b]
                    rows, local = np.unique(row[some], return_inverse=True)
                    pairs = np.empty(len(some), pair)
                    pairs["row"], pairs["u"] = local, u[some]
                    head = np.rec.fromarrays([nids[rows], scores[rows, -1]], dtype=[("q", "<i8"), ("worst", "<f4")])
                    out.append((int(block[some[0]]), 0, 4, head.tobytes(), x[rows].tobytes(), pairs.tobytes()))
                if out:
                    yield _message(out)

    return tell


def _score(k: int, beam: int):
    """Scores of the neighbours of the nodes that queries expand, told to the queries' blocks."""

    def score(key, graph, asked):
        if not len(graph) or not len(asked):
            return _rows_frame([])
        graph = graph.sort_values("nid")
        nids, ids = graph["nid"].to_numpy(), _stack(graph["ids"], np.int64)
        x = _stack(graph["vectors"], np.float16).reshape(len(nids), k, -1)
        own, sizes = _stack(graph["vector"], np.float32)[:, :-2], _stack(graph["sizes"], np.float32).reshape(len(nids), k, 2)
        out = []
        for first, second, third in zip(asked["first"], asked["second"], asked["third"], strict=True):
            head = np.frombuffer(first, np.dtype([("q", "<i8"), ("worst", "<f4")]))
            v = np.frombuffer(second, np.float32).reshape(len(head), -1)
            pairs = np.frombuffer(third, np.dtype([("row", "<i4"), ("u", "<i8")]))
            found = []
            for begin in range(0, len(pairs), 2048):
                row, at = pairs["row"][begin : begin + 2048], np.searchsorted(nids, pairs["u"][begin : begin + 2048])
                s = np.matmul(x[at].astype(np.float32), v[row, :-2, None])[:, :, 0] * sizes[at, :, 0]
                s = (s + (own[at] * v[row, :-2]).sum(1)[:, None]) * np.exp2(sizes[at, :, 1])
                near = ids[at]
                fine = (near >= 0) & (s > head["worst"][row][:, None])
                r, c = np.nonzero(fine)
                found.append((head["q"][row[r]], near[r, c], s[r, c]))
            q, j, s = (np.concatenate(c) for c in zip(*found, strict=True))
            q, j, s, _, _ = _best(q, j, s, np.zeros(len(q), np.uint8), beam)
            out += _to_blocks(q, int(key[0]), 5, q, j, s)
        return _rows_frame(out)

    return score


def _advance(beam: int):
    """Each query's beam with the scores taken in; what was sent out counts as expanded."""

    def advance(key, states, told):
        states = states.sort_values("nid")
        nids = states["nid"].to_numpy()
        ids, scores = _stack(states["ids"], np.int64), _stack(states["scores"], np.float32)
        i, fine = np.repeat(nids, beam), ids.ravel() >= 0
        more = [np.frombuffer(b"".join(told[c]), t) for c, t in (("first", np.int64), ("second", np.int64), ("third", np.float32))] if len(told) else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)]
        fresh = np.r_[np.zeros(int(fine.sum()), np.uint8), np.ones(len(more[0]), np.uint8)]
        edges = _best(np.r_[i[fine], more[0]], np.r_[ids.ravel()[fine], more[1]], np.r_[scores.ravel()[fine], more[2]], fresh, beam)
        out = _graph_rows(nids, states["node"].to_numpy(), states["vector"], *edges, beam)
        # what was sent out is expanded, as is what was before
        was = _stack(states["expanded"], np.uint8)
        open_ = fine.reshape(ids.shape) & (was == 0)
        waits = open_ & (np.cumsum(open_, axis=1) > EXPAND)
        waiting = {(int(n), int(u)) for n, u in zip(np.repeat(nids, waits.sum(1)), ids[waits], strict=True)}
        done = []
        for n, x, f in zip(nids.tolist(), out["ids"], out["fresh"], strict=True):
            flags = 1 - np.frombuffer(f, np.uint8)
            if waiting:
                flags = flags & np.fromiter(((n, u) not in waiting for u in np.frombuffer(x, np.int64).tolist()), bool, beam)
            done.append(flags.astype(np.uint8).tobytes())
        out["fresh"] = done
        return out.rename(columns={"fresh": "expanded"})

    return advance


def _start(beam: int, entries: np.ndarray, entry_ids: np.ndarray):
    """Beams that hold the query's own node and the entries."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = _stack([c.as_buffer() for c in batch.column("vector")], np.float32).copy()
            band = np.exp2(x[:, -1])
            x[:, -2:] = 0  # so that scores are inner products of the vectors without the component that evens their lengths
            nid = batch.column("nid").to_numpy()
            ids, scores = np.full((n, beam), -1, np.int64), np.full((n, beam), -np.inf, np.float32)
            ids[:, 0], scores[:, 0] = nid, (x * x).sum(1) * band
            if len(entries):
                most = slice(1, 1 + len(entries))
                own = entry_ids == nid[:, None]
                ids[:, most] = np.where(own, -1, entry_ids)
                scores[:, most] = np.where(own, -np.inf, (x @ entries.T) * np.exp2(entries[:, -1]))
            order = np.argsort(-scores, axis=1, kind="stable")
            ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
            cells = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("nid"), batch.column("node"), cells(x), cells(ids), cells(scores), cells(np.zeros((n, beam), np.uint8))], ["nid", "node", "vector", "ids", "scores", "expanded"])

    return start


def search_graph(graph: DataFrame, query_nodes: DataFrame, entry_nodes: list[int], *, k: int, beam: int) -> DataFrame:
    """(node, nid array<long> best first) for the nodes of query_nodes (node) by greedy search, until all of a beam is expanded.

    Vectors end in the component that evens their length and the power of two that they were divided by. Searches begin at the query's own node and at entry_nodes.
    """
    entries = graph.where(F.col("node").isin(entry_nodes)).select("nid", "vector").collect() if entry_nodes else []
    first = _start(beam, _stack([r["vector"] for r in entries], np.float32), np.array([r["nid"] for r in entries], np.int64))
    own = graph.select("nid", "node", "vector", "ids", "scores").withColumn("block", F.shiftright("nid", BITS))
    told = graph.select("nid", "vector", "ids", "scores").mapInArrow(_pointed_at(k), MESSAGE)
    linked = materialise(_meet(own, told, _both_ways(k), "nid long, ids binary, vector binary"), "linked")
    asks = linked.select("nid", "ids").groupBy(_by_block()).applyInPandas(_with_vectors(k), MESSAGE)
    answers = _meet_dealt(own, asks, _answer(np.float32), MESSAGE)
    near = materialise(_meet(linked.withColumn("block", F.shiftright("nid", BITS)), answers, _attach(k), "nid long, ids binary, vector binary, vectors binary, sizes binary"), "near")
    discard(linked)
    near_blocks = near.withColumn("block", F.shiftright("nid", BITS))
    states = materialise(graph.join(query_nodes, "node", "left_semi").select("nid", "node", "vector").mapInArrow(first, BEAM), "beams")
    while True:
        told = states.mapInArrow(_expand(beam), MESSAGE)
        scored = _meet_dealt(near_blocks, told, _score(2 * k, beam), MESSAGE)
        after = materialise(_meet(states.withColumn("block", F.shiftright("nid", BITS)), scored, _advance(beam), BEAM), "beams")
        discard(states)
        states = after
        unexpanded = F.exists(F.sequence(F.lit(1), F.lit(beam)), lambda p: (F.substring("expanded", p, F.lit(1)) == F.lit(b"\x00")) & (F.substring("ids", p * 8 - 7, F.lit(8)) != F.lit(b"\xff" * 8)))
        if states.where(unexpanded).isEmpty():
            break
    discard(near)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _stack([c.as_buffer() for c in batch.column("ids")], np.int64, beam)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r[r >= 0] for r in ids], pa.list_(pa.int64()))], ["node", "nids"])

    return states.select("node", "ids").mapInArrow(lists, "node long, nids array<long>")


def nearest(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, top: int = 20, k: int = 32, orders: int = 4, rounds: int | None = None, beam: int | None = None, sample_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` the ``top`` nearest other rows found.

    Rows without an id, and vectors that are null, zero or hold null or non-finite
    components, take no part; vectors are compared with those of as many
    components, one number after the other. Repeated rows count once, rows that
    share an id with different vectors are candidates each. Ties go to the smaller
    id; equal vectors are all candidates. With fewer candidates than ``top`` all
    found are given; empty tables give no rows. Other columns, whatever their
    names, aren't read. ``sample_rows`` vectors choose the hyperplanes; every
    vector is indexed. Unless given, ``rounds`` go on until the graph is settled and
    ``beam`` grows with the logarithm of the table. The graph is one of distances
    between vectors divided by the length of the longest of their band, so that a
    few long ones don't flatten the others; all of a beam is scored exactly.
    """
    every_length = materialise(valid_vectors(table, id_col, vector_col), "vectors")
    out = table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    how = {"top": top, "every": every, "k": k, "orders": orders, "rounds": rounds, "beam": beam, "sample_rows": sample_rows}
    for r in every_length.groupBy("n").count().where("count > 1").orderBy("n").collect():  # a table's embeddings have few lengths
        out = out.unionByName(_nearest_of_length(every_length.where(F.col("n") == r["n"]).select("id", "v"), **how))
    return out


def _nearest_of_length(valid: DataFrame, *, top: int, every: int, k: int, orders: int, rounds: int | None, beam: int | None, sample_rows: int) -> DataFrame:
    """nearest of (id, v) with equally many components."""
    nodes = materialise(valid.groupBy("v").agg(F.min("id").alias("node")), "nodes")
    count, all_rows = nodes.count(), valid.count()
    beam = beam or 256 + 32 * max(0, math.ceil(math.log2(count / 10_000)))
    same = nodes.select("node", F.col("node").alias("id")) if count == all_rows else valid.join(nodes, "v").select("node", "id")
    # rows that share a vector: the least ids are all that can be among the nearest
    if count != all_rows:
        salted = Window.partitionBy("node", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
        ranked = same.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= top + 1).drop("r").withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= top + 1)
        members = ranked.groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("members"))
    else:
        members = same.groupBy("node").agg(F.collect_list("id").alias("members"))
    queries = same.where(F.col("id") % every == 0)
    sample = np.array([r["v"] for r in nodes.orderBy(F.xxhash64("node"), "node").limit(sample_rows).collect()], np.float64)
    largest = F.array_max(F.transform("v", F.abs))
    length = F.log2(largest) + F.log2(F.aggregate(F.transform("v", lambda a: a / largest), F.lit(0.0), lambda acc, a: acc + a * a)) / 2  # of any finite vector
    lengths = materialise(nodes.select("node", length.alias("length")), "lengths")
    median, top_length = lengths.agg(F.percentile_approx("length", 0.5, 10_000), F.max("length")).first()
    bulk = lengths.where(F.col("length") <= median + 3).agg(F.max("length")).first()[0]  # the longest of at most eight times the median
    entries = [r["node"] for r in lengths.where(F.col("length") > bulk).orderBy(F.desc("length"), "node").limit(min(32, beam - 1)).collect()]
    band = F.ceil((F.col("length") - bulk) / 6 - 1e-9).cast("int") * 6

    def unit(x: np.ndarray) -> np.ndarray:
        """Divided by the longest length of the band (64 times the next one's), with one more component that makes every length 1."""
        most = np.abs(x).max(1)
        x, log = x / most[:, None], np.log2(most)
        length = log + np.log2((x * x).sum(1)) / 2
        x = x * np.exp2(log - bulk - np.ceil((length - bulk) / 6 - 1e-9) * 6)[:, None]
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))]).astype(np.float32)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in unit(flat)], pa.binary())], ["node", "vector"])

    vectors = nodes.select("node", "v").mapInArrow(pack, "node long, vector binary")
    graph = build_graph(vectors, count, unit(sample), k=k, orders=orders, rounds=rounds, distance=True)
    bands = lengths.select("node", (band - max(0, math.ceil((top_length - bulk) / 6 - 1e-9) * 6)).alias("band"))

    def with_band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stack([c.as_buffer() for c in batch.column("vector")], np.float32)
            x = np.column_stack([x, batch.column("band").to_numpy().astype(np.float32)])
            yield batch.drop_columns(["band"]).set_column(2, "vector", pa.array([r.tobytes() for r in x], pa.binary()))

    graph = materialise(graph.join(bands, "node").select("nid", "node", "vector", "ids", "scores", "fresh", "band").mapInArrow(with_band, GRAPH), "graph")
    found = search_graph(graph, queries.select("node").distinct(), entries, k=k, beam=beam)
    pairs = found.select(F.col("node").alias("q"), F.explode("nids").alias("nid"))
    pairs = pairs.join(graph.select("nid", "node"), "nid").select("q", "node")
    with_v = pairs.join(nodes, "node").withColumnRenamed("v", "w").join(nodes.select(F.col("node").alias("q"), "v"), "q")
    score = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    scored = with_v.select("q", "node", score.alias("score")).join(members, "node").select("q", F.explode("members").alias("vec_id"), "score")
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= top + 1)
    lists = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    out = queries.select(F.col("node").alias("q"), F.col("id").alias("query_id")).join(lists, "q")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    return out.select("query_id", F.posexplode(others).alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
