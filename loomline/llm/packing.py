"""Packing documents into sequences by first-fit decreasing over a tournament tree.

A document's ids are cut into full pieces, each a sequence by itself, and a
rest. Documents are dealt at random into groups of about ``group_docs``; in a
group, the rests go in order of decreasing length to the first sequence with
room. The tournament tree holds the free room of the sequences, the largest of
two at each node, so the first that fits is found in logarithmic time. Groups
are packed on their own, so the work is spread and no task grows with the
table. Only lengths and checksums are shuffled, never ids.
"""

from __future__ import annotations

import json
import math
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import hold_memory, materialise, with_row_key
from loomline.llm.pretokens import BYTE_LEVEL, Remembered, Splitter

GROUP_STRIDE = 1 << 32  # sequence ids of a group start at its number times this


class TournamentTree:
    """Free room of sequences; finds the first with enough of it."""

    def __init__(self, most: int, room: int):
        self.size, self.room, self.used = 1 << max(0, most - 1).bit_length(), room, 0
        self.tree = [0] * (2 * self.size)

    def _put(self, place: int, free: int) -> None:
        tree, node = self.tree, self.size + place
        tree[node] = free
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left > right else right
            node >>= 1

    def place(self, length: int) -> tuple[int, int]:
        """The sequence that takes a piece of this length, and the piece's offset there."""
        tree = self.tree
        if tree[1] < length:
            at = self.used
            self.used += 1
            self._put(at, self.room - length)
            return at, 0
        node = 1
        while node < self.size:
            node *= 2
            if tree[node] < length:
                node += 1
        at, free = node - self.size, tree[node]
        self._put(at, free - length)
        return at, self.room - free


def first_fit_decreasing(lengths: Sequence[int], room: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and offset of each piece; equal lengths in the order given."""
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable").tolist()
    tree = TournamentTree(len(order), room)
    bins, offsets = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    for k in order:
        bins[k], offsets[k] = tree.place(int(lengths[k]))
    return bins, offsets


class TextTokenizer:
    """Ids of whole texts by the ``tokenizers`` library, followed by ``end_id``.

    A byte-level BPE without normaliser encodes the pieces of its split one by
    one, so the ids of short pieces are remembered, within a bound. Texts with an
    added token, and tokenizers of any other make, go to the library whole.
    """

    def __init__(self, path: str, end_id: int = 0, remember: int = 400_000, short: int = 48):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = int(end_id).to_bytes(4, "little")
        self.short, self.known = short, Remembered(remember)
        made = json.loads(self.tokenizer.to_str())
        pre = made.get("pre_tokenizer") or {}
        self.by_piece = made.get("normalizer") is None and made["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not made["model"].get("dropout")
        self.added = [t["content"] for t in made.get("added_tokens") or []]
        self.split = Splitter(BYTE_LEVEL)  # that of ByteLevel(use_regex)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_batch(self, texts: Sequence[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        for at in range(0, len(texts), 256):
            some = texts[at : at + 256]
            cut = [self.split(t) if self.by_piece and not any(a in t for a in self.added) else None for t in some]
            new = self.known.missing(set().union(*filter(None, cut)))
            self.known.update(zip(new, self._whole(new), strict=True))
            for text, pieces in zip(some, cut, strict=True):
                yield (b"".join(map(self.known.__getitem__, pieces)) if pieces is not None else self._whole([text])[0]) + self.end
            for p in new:
                if len(p) > self.short:
                    del self.known[p]


_loaded: dict[tuple[str, int], TextTokenizer] = {}


def tokenizer(path: str, end_id: int) -> TextTokenizer:
    """The worker's tokenizer for a file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
    hold_memory("packing", _loaded.clear)
    if (path, end_id) not in _loaded:
        _loaded[path, end_id] = TextTokenizer(path, end_id)
    return _loaded[path, end_id]


def piece_checksums(docs: DataFrame, path: str, *, id_col: str, text_col: str, room: int, end_id: int) -> DataFrame:
    """(id, n ids, CRC-32 of each piece of ``room`` ids and the rest) of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, end_id).encode_batch
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                counts, sums = [], []
                for ids in encode([t or "" for t in part.column(1).to_pylist()]):
                    counts.append(len(ids) // 4)
                    sums.append([zlib.crc32(ids[at : at + 4 * room]) for at in range(0, len(ids), 4 * room)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["id", "doc_tokens", "sums"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(rows, f"id {kind}, doc_tokens long, sums array<long>")


def pack_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", room: int = 1024, end_id: int = 0, group_docs: int = 16_384, seed: int = 17) -> DataFrame:
    """One row per piece: the document's id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty and so is its end id alone. Rows are packed each by
    itself, also ones that repeat or whose id is null: groups are dealt by a key
    of the row, not of the document. Each task gets one group. An empty table
    gives no rows; other columns aren't read.
    """
    narrow = materialise(with_row_key(piece_checksums(docs, path, id_col=id_col, text_col=text_col, room=room, end_id=end_id)), "pieces")
    groups = max(1, math.ceil(narrow.count() / group_docs))
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("row_key", kind="stable")
        tokens = pdf["doc_tokens"].to_numpy()
        per = -(-tokens // room)
        doc = np.repeat(np.arange(len(pdf)), per)
        index = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        start = index * room
        length = np.minimum(tokens[doc] - start, room)
        rest = length < room
        sequence, offset = np.empty(len(doc), np.int64), np.zeros(len(doc), np.int64)
        bins, offset[rest] = first_fit_decreasing(length[rest], room)
        used = int(bins.max()) + 1 if len(bins) else 0
        sequence[rest] = bins
        sequence[~rest] = used + np.arange(int((~rest).sum()))
        ids = pdf["id"].iloc[doc].reset_index(drop=True)
        return pd.DataFrame(
            {"id": ids, "start": start, "length": length, "ids_crc32": np.concatenate([*map(np.asarray, pdf["sums"])]).astype(np.int64), "doc_tokens": tokens[doc], "sequence_id": int(key[0]) * GROUP_STRIDE + sequence, "offset": offset}
        )

    dealt = narrow.groupBy(F.pmod(F.xxhash64("row_key", F.lit(seed)), F.lit(groups)).alias("group_no"))
    return dealt.applyInPandas(pack, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)
