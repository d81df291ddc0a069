"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A piece's bytes are the leaves of a complete binary tree. Leaf i holds the rank
of the pair that starts at i and every inner node the leftmost minimum below it,
so the root names the next merge. A merge takes the right part out of the
piece and changes the ranks of two live neighbours: two point updates of
logarithmic length. Equal ranks resolve to the leftmost pair.

Pieces of one tree size are worked on together, one merge of each at a step, in
numpy; long pieces (runs of one letter, say) take the same path and cost
n log n. Text is split by the public pattern; the ids of short pieces are
remembered in a table of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomline.llm.common import hold_memory
from loomline.llm.pretokens import Remembered, Splitter

NONE = np.int64(1) << 40  # rank of a pair that no merge has


class Vocabulary:
    """Ranks of byte strings, and the rank of every pair of tokens that can merge."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.split = Splitter(pattern)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pairs = pairs
        # an open-addressing table, twice as large as needed or more
        self.shift = np.uint64(64 - max(4, (2 * len(pairs)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.merged = np.full(size, -1, np.int64), np.full(size, NONE, np.int64)
        keys, merged = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        at = self._slot(keys)
        self.mask, self.most = size - 1, 1
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of several keys for a slot, one stays
            won = self.keys[at] == keys
            self.merged[at[won]] = merged[won]
            keys, merged, at = keys[~won], merged[~won], (at[~won] + 1) & self.mask
            self.most += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NONE where there is none."""
        keys = left << 20 | right
        at, out = self._slot(keys), np.full(len(keys), NONE, np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.most):
            here = self.keys[at]
            hit = here == keys[open_]
            out[open_[hit]] = self.merged[at[hit]]
            on = ~hit & (here != -1)
            open_, at = open_[on], (at[on] + 1) & self.mask
            if not len(open_):
                break
        return out

    def merge_pieces(self, pieces: Sequence[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:  # a token by itself, as the merges of such a vocabulary also give
                out[k] = np.array([whole], np.int64)
            elif piece:
                by_size.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(k)
        for size, which in by_size.items():
            step = max(1, (1 << 20) // size)
            for at in range(0, len(which), step):
                some = which[at : at + step]
                few = len(some) < 32 and size >= 64  # too few at a time for numpy to pay
                ids = [self._merge_tree(pieces[k], size) for k in some] if few else self._merge_trees([pieces[k] for k in some], size)
                for k, x in zip(some, ids, strict=True):
                    out[k] = x
        return out

    def _merge_tree(self, piece: bytes, size: int) -> np.ndarray:
        """As _merge_trees, for one piece."""
        rank, n, none = self.pairs.get, len(piece), int(NONE) * size
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)
        for i in range(n - 1):
            found = rank(ids[i] << 20 | ids[i + 1])
            if found is not None:
                tree[size + i] = found * size + i
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(place: int, value: int) -> None:
            node = size + place
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                node >>= 1
                least = value if value < other else other
                if tree[node] == least:
                    break
                tree[node] = value = least

        while tree[1] < none:
            found, left = divmod(tree[1], size)
            right = after[left]
            end = after[right]
            ids[left], ids[right], after[left] = found, -1, end
            put(right, none)
            value = None
            if end < n:
                before[end] = left
                value = rank(found << 20 | ids[end])
            put(left, none if value is None else value * size + left)
            start = before[left]
            if start >= 0:
                value = rank(ids[start] << 20 | found)
                put(start, none if value is None else value * size + start)
        return np.array([x for x in ids if x >= 0], np.int64)

    def _merge_trees(self, pieces: list[bytes], size: int) -> list[np.ndarray]:
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, size), -1, np.int64)
        ids[np.arange(size) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, size + 1), (n, 1))
        before = np.tile(np.arange(-1, size - 1), (n, 1))
        # a node holds rank * size + place, so the least value is the leftmost of the least ranks
        tree = np.full((n, 2 * size), NONE * size, np.int64)
        pairs = np.arange(size - 1) < (lengths - 1)[:, None]
        row, col = np.nonzero(pairs)
        tree[row, size + col] = self.pair_rank(ids[row, col], ids[row, col + 1]) * size + col
        level = size >> 1
        while level:
            below = tree[:, 2 * level : 4 * level]
            tree[:, level : 2 * level] = np.minimum(below[:, ::2], below[:, 1::2])
            level >>= 1
        live = np.flatnonzero(tree[:, 1] < NONE * size)
        while len(live):
            top = tree[live, 1]
            left = top % size
            right = after[live, left]
            end = after[live, right]
            ids[live, left], ids[live, right] = top // size, -1
            after[live, left] = end
            inner = end < lengths[live]
            before[live[inner], end[inner]] = left[inner]
            tree[live, size + right] = NONE * size
            value = np.full(len(live), NONE * size)
            value[inner] = self.pair_rank(ids[live[inner], left[inner]], ids[live[inner], end[inner]]) * size + left[inner]
            tree[live, size + left] = value
            start = before[live, left]
            has = start >= 0
            tree[live[has], size + start[has]] = self.pair_rank(ids[live[has], start[has]], ids[live[has], left[has]]) * size + start[has]
            for rows, place in ((live, right), (live, left), (live[has], start[has])):
                node = (size + place) >> 1
                while node.size and node[0]:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
            live = live[tree[live, 1] < NONE * size]
        kept = ids >= 0
        return np.split(ids[kept], np.cumsum(kept.sum(1))[:-1])


class Encoder:
    """Encodes texts piece by piece, remembering the ids of short pieces within a bound.

    About ``together`` characters are worked on at a time.
    """

    def __init__(self, vocabulary: Vocabulary, remember: int = 250_000, short: int = 48, together: int = 1 << 20):
        self.vocabulary, self.short, self.together = vocabulary, short, together
        self.known = Remembered(remember)

    def encode_batch(self, texts: Sequence[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = self.vocabulary.split
        ends = np.cumsum([len(t) for t in texts]) // self.together
        cuts = np.flatnonzero(np.diff(ends, prepend=-1, append=-1)) if len(texts) else []
        for first, end in zip(cuts[:-1], cuts[1:], strict=True):
            some = [split(t) for t in texts[first:end]]
            new = self.known.missing(set().union(*some))
            ids = self.vocabulary.merge_pieces([p.encode("utf-8", "surrogatepass") for p in new])
            table = self.known
            table.update((p, x.astype("<u4").tobytes()) for p, x in zip(new, ids, strict=True))
            for pieces in some:
                yield b"".join(map(table.__getitem__, pieces))
            for p in new:
                if len(p) > self.short:
                    del table[p]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids that encode_batch gave."""
        tokens = self.vocabulary.tokens
        return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    hold_memory("bpe", _loaded.clear)
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Encoder(Vocabulary(path, pattern))
    return _loaded[path, pattern]


def encode_table(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, ids binary (little-endian unsigned 32-bit), decoded binary.

    A null text is empty and has no ids. Texts of any length are encoded whole,
    repeated rows each; an empty table gives no rows; other columns aren't read, and
    the id may have any name.
    """
    return _over_texts(docs, path, pattern, id_col, text_col, "ids binary, decoded binary", lambda ids, decoded: (ids, decoded), [pa.binary(), pa.binary()])


def digest_table(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_table, but n_tokens long, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256, so that no ids leave the workers."""

    def digests(ids: bytes, decoded: bytes):
        numbers = np.frombuffer(ids, "<u4").tolist()
        return len(numbers), hashlib.sha256(" ".join(map(str, numbers)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _over_texts(docs, path, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests, [pa.int64(), pa.string(), pa.string()])


def _over_texts(docs, path, pattern, id_col, text_col, columns, make, types):
    quoted = f"`{id_col.replace('`', '``')}`"  # any name of a column
    names = [id_col, *(x.split()[0] for x in columns.split(", "))]
    schema = f"{quoted} {docs.schema[id_col].dataType.simpleString()}, {columns}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t or "" for t in part.column(1).to_pylist()]
                made = [make(ids, engine.decode(ids)) for ids in engine.encode_batch(texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*made), types, strict=True))], names)

    return docs.select(quoted, f"`{text_col.replace('`', '``')}`").mapInArrow(rows, schema)
