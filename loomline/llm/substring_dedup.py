"""Removal of passages that stand in an earlier document, over a compacted De Bruijn graph of word windows.

A window of ``width`` words is an edge, named by a 64-bit hash; edges that follow
each other in a text meet at the words they share. Only edges of two or more
documents matter. Each has source coordinates: the smallest document that has it
and its first place there.

1. Documents are dealt to groups of bounded size. A group tells each of its edges
   once, with its first coordinates, to the edge's bucket of the hash range. An edge
   that a third of the documents have costs one entry a group.
2. A bucket finds the edges of several documents and their source coordinates, and
   answers the groups that asked.
3. A group meets its texts again. Windows with an earlier source are removed; those
   whose sources advance in step form spans, and the windows that a document is the
   source of form pieces, with their words.
4. Every span is verified against the words at its source coordinates. Hashes that
   turn out to be shared by different windows are told to a second run, which names
   the windows that have them by SHA-256.
5. Pieces are cut where texts branch off or come in, and joined where one leads only
   to the other and that comes only from the one: nonbranching paths, found by
   pointer jumping in joins.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm import shingles
from loomline.llm.common import discard, free_shuffles, materialise, no_text_as_empty

WIDTH = 13
BUCKET_BYTES = 20 << 20  # of text, for a bucket of the hash range
GROUP_BYTES, LEAST_SIZE = 8 << 20, 14  # a group's texts; texts below 2**14 bytes are one class
FLUSH_BYTES = 6 << 20
SUSPECTS_MOST = 1 << 24  # hashes that different windows share, as a bound on what is broadcast
AT_ONCE = 1 << 17  # words hashed at a time
MISSING = np.iinfo(np.int64).max
MORE = np.uint32(1 << 31)
AS_THEY_ARE = np.arange(256, dtype=np.uint8)
DOC = np.dtype([("size", "<i4"), ("part", "<i8"), ("id", "<i8"), ("mark", "<i4"), ("n", "<i4")])
SOURCE = np.dtype([("id", "<i8"), ("mark", "<i4"), ("at", "<u4")])
ENTRIES = "bucket int, docs binary, hashes binary, places binary"
ANSWERS = "size int, part long, hashes binary, sources binary"


def planes(values: np.ndarray) -> bytes:
    """An array byte by byte of its items, which compresses well where neighbours are alike."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def from_planes(data: bytes, kind: np.dtype) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def _runs(new: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of the runs that begin where new is true."""
    cuts = np.flatnonzero(new)
    yield from zip(cuts.tolist(), [*cuts[1:].tolist(), len(new)], strict=True)


@dataclass(frozen=True)
class Naming:
    """How windows of ``width`` words are named: by a hash of so many bits (fewer than 64 for tests), by SHA-256 where that is one of the suspects (sorted)."""

    width: int
    bits: int = 64
    suspects: object = None  # a broadcast array

    def sure(self, names: np.ndarray, words: list[bytes]) -> np.ndarray:
        """The names with those of suspects replaced."""
        known = self.suspects.value if self.suspects is not None else ()
        if not len(known) or not len(names):
            return names
        at = np.minimum(np.searchsorted(known, names), len(known) - 1)
        out = names.copy()
        for k in np.flatnonzero(known[at] == names).tolist():
            out[k] = int.from_bytes(hashlib.sha256(b" ".join(words[k : k + self.width])).digest()[:8], "little")
        return out


def window_hashes(texts: list[list[bytes]], naming: Naming) -> Iterator[tuple[int, np.ndarray]]:
    """(text, hashes of its windows in order) of texts as words; a long text comes in parts, in order."""
    width = naming.width
    batch: list[tuple[int, int, int]] = []

    def hashed() -> Iterator[tuple[int, np.ndarray]]:
        words = [w for k, a, b in batch for w in texts[k][a:b]]
        if words:
            data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
            one, _ = shingles._word_hashes(data, np.array([len(data)]), AS_THEY_ARE)
            sums = np.zeros(len(one) + 1, np.uint64)
            up = shingles._power("up", len(one))
            np.cumsum(one * up, out=sums[1:])
            n = len(one) - width + 1
            every = shingles.mix((sums[width:] - sums[:n]) * shingles._power("down", len(one))[:n]) if n > 0 else np.empty(0, np.uint64)
            if naming.bits < 64:
                every = (every >> np.uint64(64 - naming.bits)) << np.uint64(64 - naming.bits)
            every = naming.sure(every, words)
            at = 0
            for k, a, b in batch:
                yield k, every[at : at + b - a - width + 1]
                at += b - a
        batch.clear()

    size = 0
    for k, words in enumerate(texts):
        if len(words) < width:
            continue
        for a in range(0, len(words) - width + 1, AT_ONCE):
            b = min(len(words), a + AT_ONCE + width - 1)
            batch.append((k, a, b))
            size += b - a
            if size >= AT_ONCE:
                yield from hashed()
                size = 0
    yield from hashed()


def _edges(buckets: int, naming: Naming):
    """Entries for the buckets, from documents (size, part, id, mark, text) with rows of a group close together."""

    def entries(docs: list[tuple]) -> Iterator[pa.RecordBatch]:
        docs.sort(key=lambda d: d[:4])
        texts = [d[4].split() for d in docs]
        who, hashes, places = [], [], []
        parts: dict[int, int] = {}
        for k, h in window_hashes(texts, naming):
            begin = parts.get(k, 0)
            who.append(np.full(len(h), k, np.uint32))
            hashes.append(h)
            places.append(np.arange(begin, begin + len(h), dtype=np.uint32))
            parts[k] = begin + len(h)
        if not who:
            return
        doc, h, at = np.concatenate(who), np.concatenate(hashes), np.concatenate(places)
        head = np.array([(*d[:4], 0) for d in docs], DOC)
        group = np.cumsum(np.r_[0, (head["size"][1:] != head["size"][:-1]) | (head["part"][1:] != head["part"][:-1])])
        order = np.argsort(h, kind="stable")  # so by document and place within a hash
        g, hs = group[doc[order]], h[order]
        first = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (g[1:] != g[:-1])])
        last = np.r_[first[1:], len(hs)] - 1
        more = head["id"][doc[order[first]]] != head["id"][doc[order[last]]]
        kept = order[first]
        at[kept[more]] |= MORE
        kept.sort()
        doc, h, at = doc[kept], h[kept], at[kept]
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        dealt = bucket[order]
        out = []
        for a, b in _runs(np.r_[True, dealt[1:] != dealt[:-1]]):
            mine = order[a:b]
            some, n = np.unique(doc[mine], return_counts=True)
            told = head[some].copy()
            told["n"] = n
            out.append({"bucket": int(dealt[a]), "docs": planes(told), "hashes": h[mine].tobytes(), "places": planes(at[mine])})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("docs", "hashes", "places")]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for s, part, doc_id, mark, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                held.append((s, part, MISSING if doc_id is None else doc_id, mark, data))
                size += len(data)
                if size >= FLUSH_BYTES:
                    yield from entries(held)
                    held, size = [], 0
        yield from entries(held)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each group that has an edge of several documents: the edge's hash and source coordinates."""
    docs = [from_planes(x.as_py(), DOC) for x in table.column("docs")]
    h = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")])
    at = np.concatenate([from_planes(x.as_py(), "<u4") for x in table.column("places")])
    doc = np.concatenate(docs)
    who = np.repeat(np.arange(len(doc)), doc["n"])
    order = np.argsort(h)
    hs = h[order]
    start = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
    count = np.diff(np.r_[start, len(hs)])
    maybe = (count > 1) | np.logical_or.reduceat(at[order] & MORE > 0, start) if len(start) else np.empty(0, bool)
    kept = order[np.repeat(maybe, count)]
    h, at, who = h[kept], at[kept], who[kept]
    by_doc = np.lexsort((doc["mark"], doc["id"]))
    rank = np.empty(len(doc), np.int64)
    new = np.r_[0, (doc["id"][by_doc][1:] != doc["id"][by_doc][:-1]) | (doc["mark"][by_doc][1:] != doc["mark"][by_doc][:-1])].astype(np.int64) if len(doc) else np.empty(0, np.int64)
    rank[by_doc] = np.cumsum(new)
    place = (rank[who] << 32) | (at & ~MORE).astype(np.int64)
    order = np.lexsort((place, h))
    h, at, who = h[order], at[order], who[order]
    out = {c: [] for c in ("size", "part", "hashes", "sources")}
    if len(h):
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        count = np.diff(np.r_[start, len(h)])
        source = np.empty(len(start), SOURCE)
        source["id"], source["mark"], source["at"] = doc["id"][who[start]], doc["mark"][who[start]], at[start] & ~MORE
        several = np.logical_or.reduceat((doc["id"][who] != np.repeat(source["id"], count)) | (at & MORE > 0), start)
        kept = np.repeat(several, count)
        of = np.repeat(np.arange(len(start)), count)[kept]
        h, who = h[kept], who[kept]
        order = np.lexsort((source["at"][of], source["mark"][of], source["id"][of], doc["part"][who], doc["size"][who]))
        h, of, size, part = h[order], of[order], doc["size"][who[order]], doc["part"][who[order]]
        for a, b in _runs(np.r_[True, (size[1:] != size[:-1]) | (part[1:] != part[:-1])]) if len(h) else ():
            out["size"].append(int(size[a]))
            out["part"].append(int(part[a]))
            out["hashes"].append(h[a:b].tobytes())
            out["sources"].append(planes(source[of[a:b]]))
    return pa.table(out, pa.schema([("size", pa.int32()), ("part", pa.int64()), ("hashes", pa.binary()), ("sources", pa.binary())]))


SPANS = "array<struct<start:long,n:long,source_id:long,source_mark:long,source_start:long,digest:string>>"
PIECES = "array<struct<start:long,n:long,words:string>>"
MET = f"doc_id long, mark long, n_words long, n_removed long, kept string, kept_sha256 string, spans {SPANS}, pieces {PIECES}"
_SPAN = pa.struct([*[(c, pa.int64()) for c in ("start", "n", "source_id", "source_mark", "source_start")], ("digest", pa.string())])
_PIECE = pa.struct([("start", pa.int64()), ("n", pa.int64()), ("words", pa.string())])
_MET = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "mark", "n_words", "n_removed")], ("kept", pa.string()), ("kept_sha256", pa.string()), ("spans", pa.list_(_SPAN)), ("pieces", pa.list_(_PIECE))])


def _meet(naming: Naming, keep_texts: bool):
    """What becomes of a group's documents, given the answers to its edges."""
    width = naming.width

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x.as_py(), np.uint64) for x in answers.column("hashes")]
        sources = [from_planes(x.as_py(), SOURCE) for x in answers.column("sources")]
        known, source = np.concatenate([np.empty(0, np.uint64), *hashes]), np.concatenate([np.empty(0, SOURCE), *sources])
        order = np.argsort(known)
        known, source = known[order], source[order]
        ids, marks = docs.column("doc_id").to_pylist(), docs.column("mark").to_pylist()
        texts = [t.encode("utf-8", "surrogatepass").split() for t in docs.column("text").to_pylist()]
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
        begun = [0] * len(texts)
        for k, h in window_hashes(texts, naming):
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[at] == h)
                found[k].append((hit + begun[k], at[hit]))
            begun[k] += len(h)
        out = []
        for k, words in enumerate(texts):
            mine = MISSING if ids[k] is None else ids[k]
            row = {"doc_id": ids[k], "mark": marks[k], "n_words": len(words), "spans": [], "pieces": []}
            left = words
            places = np.concatenate([p for p, _ in found[k]]) if found[k] else np.empty(0, np.int64)
            if len(places):
                of = source[np.concatenate([s for _, s in found[k]])]
                late = of["id"] < mine
                p, s = places[late], of[late]
                if len(p):
                    ahead = s["at"].astype(np.int64) - p
                    new = np.r_[True, (np.diff(p) != 1) | (s["id"][1:] != s["id"][:-1]) | (s["mark"][1:] != s["mark"][:-1]) | (np.diff(ahead) != 0)]
                    gone = np.zeros(len(words) + 1, np.int64)
                    for a, b in _runs(new):
                        begin, n = int(p[a]), b - a
                        gone[begin] += 1
                        gone[begin + n + width - 1] -= 1
                        digest = hashlib.sha256(b" ".join(words[begin : begin + n + width - 1])).hexdigest()
                        row["spans"].append(dict(zip(_SPAN.names, (begin, n, int(s["id"][a]), int(s["mark"][a]), int(s["at"][a]), digest), strict=True)))
                    stays = np.cumsum(gone[:-1]) == 0
                    left = [words[i] for i in np.flatnonzero(stays).tolist()]
                own = ~late & (of["id"] == mine) & (of["mark"] == marks[k]) & (of["at"] == places)
                p = places[own]
                if len(p):
                    for a, b in _runs(np.r_[True, np.diff(p) != 1]):
                        begin, n = int(p[a]), b - a
                        row["pieces"].append({"start": begin, "n": n, "words": b" ".join(words[begin : begin + n + width - 1]).decode("utf-8", "surrogatepass")})
            kept = b" ".join(left)
            out.append(row | {"n_removed": len(words) - len(left), "kept": kept.decode("utf-8", "surrogatepass") if keep_texts else None, "kept_sha256": hashlib.sha256(kept).hexdigest()})
        return pa.Table.from_pylist(out, _MET)

    return run


def _unit(id_col: str, mark_col: str, start_col: str) -> Column:
    return F.concat_ws("/", id_col, mark_col, start_col)


def _paths(spans: DataFrame, pieces: DataFrame) -> DataFrame:
    """(id, mark, start, n, path, place) of pieces' nonbranching parts; place: how many parts of the path come before it.

    spans: id, mark, start, n, source_id, source_mark, source_start. pieces: id,
    mark, start, n. Two edges meet where one follows the other in a text. A part
    ends where the edge has more than one next, or the next more than one before.
    """
    own = pieces.select("id", "mark", "start", "n", F.col("id").alias("source_id"), F.col("mark").alias("source_mark"), F.col("start").alias("source_start"))
    text = Window.partitionBy("id", "mark").orderBy("start")
    walk = spans.select(*own.columns).unionByName(own)
    after = lambda c: F.lead(c).over(text).alias(f"next_{c}")
    walk = walk.select("start", "n", "source_id", "source_mark", "source_start", *[after(c) for c in ("start", "source_id", "source_mark", "source_start")]).where("next_start = start + n")
    steps = materialise(walk.select(F.col("source_id").alias("a_id"), F.col("source_mark").alias("a_mark"), F.expr("source_start + n").alias("a_end"), F.col("next_source_id").alias("b_id"), F.col("next_source_mark").alias("b_mark"), F.col("next_source_start").alias("b_start")).distinct(), "steps")
    cuts = steps.select(F.col("a_id").alias("id"), F.col("a_mark").alias("mark"), F.col("a_end").alias("cut")).unionByName(steps.select(F.col("b_id").alias("id"), F.col("b_mark").alias("mark"), F.col("b_start").alias("cut"))).distinct()
    inside = pieces.join(cuts, ["id", "mark"], "left").withColumn("cut", F.when((F.col("cut") > F.col("start")) & (F.col("cut") < F.expr("start + n")), F.col("cut")))
    starts = inside.groupBy("id", "mark", "start", "n").agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    parts = starts.select("id", "mark", F.posexplode(F.concat(F.array("start"), "cuts")).alias("k", "at"), F.concat("cuts", F.array(F.expr("start + n"))).alias("ends")).select("id", "mark", F.col("at").alias("start"), (F.get("ends", F.col("k")) - F.col("at")).alias("n"), (F.col("k") > 0).alias("entered"), (F.col("k") < F.size("ends") - 1).alias("left"))
    parts = materialise(parts.withColumn("unit", _unit("id", "mark", "start")), "parts")
    out = steps.groupBy("a_id", "a_mark", "a_end").agg(F.count("*").alias("outs"), F.min(_unit("b_id", "b_mark", "b_start")).alias("next")).where("outs = 1")
    once = steps.groupBy("b_id", "b_mark", "b_start").agg(F.count("*").alias("ins")).where("ins = 1").select(_unit("b_id", "b_mark", "b_start").alias("next"))
    ending = parts.where("NOT left").select("unit", F.col("id").alias("a_id"), F.col("mark").alias("a_mark"), F.expr("start + n").alias("a_end"))
    begins = parts.where("NOT entered").select(F.col("unit").alias("next"))
    links = ending.join(out, ["a_id", "a_mark", "a_end"]).join(once, "next", "left_semi").join(begins, "next", "left_semi").where("unit <> next").select(F.col("next").alias("unit"), F.col("unit").alias("back"))
    led = _jump(materialise(links, "links"))
    known = parts.join(led, "unit", "left")
    return known.select("id", "mark", "start", "n", F.coalesce("head", "unit").alias("path"), F.coalesce("place", F.lit(0)).cast("long").alias("place"))


def _jump(links: DataFrame) -> DataFrame:
    """(unit, head, place) of units with one before them (unit, back); a ring begins at its least unit."""
    n = links.count()
    now = materialise(links.select("unit", "back", F.lit(1).cast("long").alias("hops"), F.least("unit", "back").alias("low")), "jumps")
    reached = 1
    while n:
        far = now.select(F.col("unit").alias("back"), F.col("back").alias("b"), F.col("hops").alias("h"), F.col("low").alias("l"))
        after = materialise(now.join(far, "back", "left").select("unit", F.coalesce("b", "back").alias("back"), (F.col("hops") + F.coalesce("h", F.lit(0))).alias("hops"), F.least("low", F.coalesce("l", "low")).alias("low")), "jumps")
        discard(now)
        now, reached = after, reached * 2
        if now.join(now.select(F.col("unit").alias("back")), "back", "left_semi").isEmpty():
            break
        if reached > n:  # whoever still has one before is in a ring
            heads = now.join(now.select(F.col("unit").alias("back")), "back", "left_semi").select(F.col("low").alias("unit")).distinct()
            return _jump(materialise(links.join(heads, "unit", "left_anti"), "links"))
    return now.select("unit", F.col("back").alias("head"), F.col("hops").alias("place"))


@dataclass
class Substrings:
    """``documents``: doc_id, n_words, n_removed, kept_sha256, n_spans, n_paths and, if asked for, kept (the words left).
    ``spans``: doc_id, start, n_words, source_id, source_start (in words), paths, one row for each verified span.
    ``paths``: path, place, source_id, source_start, n_words, words, the parts of the nonbranching paths in order."""

    documents: DataFrame
    spans: DataFrame
    paths: DataFrame


INTERVAL = ["source_id", "source_mark", "source_start", "n"]


def _id() -> Column:
    return F.coalesce("doc_id", F.lit(int(MISSING)))


def _slice(words: str, begin: Column, n: Column) -> Column:
    """n words of a text from one on."""
    return F.array_join(F.slice(F.split(words, " "), (begin + 1).cast("int"), n.cast("int")), " ")


def _found(grouped: DataFrame, buckets: int, naming: Naming, keep_texts: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents as MET, spans, pieces) of the grouped texts; rows that repeat have their spans and pieces once."""
    entries = grouped.select("size", "part", "doc_id", "mark", "text").mapInArrow(_edges(buckets, naming), ENTRIES)
    answers = materialise(entries.groupBy("bucket").applyInArrow(_answer, ANSWERS), "edge-sources", "zstd")
    del entries
    free_shuffles(grouped.sparkSession)
    keys = ["size", "part"]
    met = materialise(grouped.groupBy(*keys).cogroup(answers.groupBy(*keys)).applyInArrow(_meet(naming, keep_texts), MET), "met-texts", "zstd")
    discard(answers)
    free_shuffles(grouped.sparkSession)
    spans = materialise(met.where("size(spans) > 0").select(_id().alias("id"), "doc_id", "mark", F.explode("spans").alias("s")).select("id", "doc_id", "mark", "s.*").distinct(), "spans")
    pieces = materialise(met.where("size(pieces) > 0").select(_id().alias("id"), "mark", F.explode("pieces").alias("p")).select("id", "mark", "p.*").distinct(), "pieces")
    return met, spans, pieces


def _shared(spans: DataFrame, pieces: DataFrame, naming: Naming) -> np.ndarray:
    """Hashes of windows in spans whose words aren't those at their source coordinates."""
    asked = spans.groupBy(*INTERVAL).agg(F.min("digest").alias("digest"), F.max("digest").alias("other"))
    whole = pieces.select(F.col("id").alias("source_id"), F.col("mark").alias("source_mark"), F.col("start").alias("begin"), F.col("n").alias("size"), "words")
    within = (F.col("source_start") >= F.col("begin")) & (F.col("source_start") + F.col("n") <= F.col("begin") + F.col("size"))
    held = asked.join(whole, ["source_id", "source_mark"]).where(within).withColumn("said", _slice("words", F.col("source_start") - F.col("begin"), F.col("n") + naming.width - 1))
    wrong = held.where((F.col("digest") != F.col("other")) | (F.sha2(F.col("said").cast("binary"), 256) != F.col("digest"))).select("said")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass").split() for t in batch.column(0).to_pylist()]
            every = np.concatenate([np.empty(0, np.uint64), *[h for _, h in window_hashes(texts, naming)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(every).view(np.int64))], ["h"])

    rows = wrong.distinct().mapInArrow(names, "h long").distinct().limit(SUSPECTS_MOST + 1).collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bucket_bytes: int = BUCKET_BYTES, keep_texts: bool = False, bits: int = 64) -> Substrings:
    """Remove each word of a window that also starts in a document with a smaller id.

    Words are runs of anything but blanks, unchanged; texts are taken whole, however
    long. A null text has no words. Windows are judged on the input. A null id counts
    as the largest, and rows that share an id remove nothing from each other; whole
    rows that repeat all give the same. An empty table gives no rows. Only the id and
    the text are read. ``bits`` weakens the hash, for tests of what happens when
    different windows share one.
    """
    text = no_text_as_empty(f"`{text_col}`")
    size = F.greatest(F.lit(LEAST_SIZE), F.ceil(F.log2(F.octet_length(text) + 1))).cast("int")
    many = F.greatest(F.lit(1), F.floor(F.lit(GROUP_BYTES) / F.pow(F.lit(2.0), size))).cast("long")
    flat = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), size.alias("size"), F.hash(text, F.octet_length(text)).cast("long").alias("mark"), many.alias("many"), F.monotonically_increasing_id().alias("row"))
    grouped = materialise(flat.select("size", F.expr("row div many").alias("part"), "doc_id", "mark", "text"), "grouped-texts", "zstd")
    total = grouped.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, suspects = max(1, math.ceil(total / bucket_bytes)), np.empty(0, np.uint64)
    while True:
        naming = Naming(width, bits, docs.sparkSession.sparkContext.broadcast(suspects) if len(suspects) else None)
        met, spans, pieces = _found(grouped, buckets, naming, keep_texts)
        shared = _shared(spans, pieces, naming)
        if not len(shared):
            break
        if len(suspects) + len(shared) > SUSPECTS_MOST:
            raise ValueError("more windows share a hash than can be told to all tasks")
        suspects = np.union1d(suspects, shared)
        discard(met, spans, pieces)
    discard(grouped)
    parts = materialise(_paths(spans, pieces.select("id", "mark", "start", "n")), "paths")
    on = parts.select(F.col("id").alias("source_id"), F.col("mark").alias("source_mark"), F.col("start").alias("begin"), F.col("n").alias("size"), "path")
    meets = (F.col("begin") < F.col("source_start") + F.col("n")) & (F.col("begin") + F.col("size") > F.col("source_start"))
    routed = spans.select(*INTERVAL).distinct().join(on, ["source_id", "source_mark"]).where(meets).groupBy(*INTERVAL).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    routed = materialise(spans.join(routed, INTERVAL), "routed-spans")
    counts = routed.groupBy("id", "mark").agg(F.count("*").alias("n_spans"), F.size(F.array_distinct(F.flatten(F.collect_list("paths")))).cast("long").alias("n_paths"))
    shown = met.withColumn("id", _id()).join(counts, ["id", "mark"], "left")
    documents = shown.select(F.col("doc_id").alias(id_col), "n_words", "n_removed", "kept_sha256", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_spans", "n_paths")], *(["kept"] if keep_texts else []))
    q, p = parts.alias("q"), pieces.alias("p")
    lies = (F.col("q.id") == F.col("p.id")) & (F.col("q.mark") == F.col("p.mark")) & (F.col("q.start") >= F.col("p.start")) & (F.col("q.start") < F.col("p.start") + F.col("p.n"))
    paths = q.join(p, lies).select("q.path", "q.place", F.col("q.id").alias("source_id"), F.col("q.start").alias("source_start"), (F.col("q.n") + width - 1).alias("n_words"), _slice("p.words", F.col("q.start") - F.col("p.start"), F.col("q.n") + width - 1).alias("words"))
    found = routed.select(F.col("doc_id").alias(id_col), "start", (F.col("n") + width - 1).alias("n_words"), "source_id", "source_start", "paths")
    return Substrings(documents, found, paths)
