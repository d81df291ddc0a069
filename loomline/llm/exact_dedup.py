"""Exact duplicates by a tree-merge of sorted digest runs.

Every partition sorts the SHA-256 digests of its texts into one run for each
digest range, with equal digests already collapsed. Runs then meet in rounds of
a binomial tree: run i joins run i with its low bits cleared, ``log2(fan_in)``
binary rounds at a time, and are merged multiway: sorted runs are woven by binary
search, none is sorted again. Each level keeps, for a digest, the identifier that
stays, the number of rows, the byte length and a second hash of the text; two
entries of one digest that differ in either stop the job, so an identifier only
survives a level after its group has been verified.

Ranges hold about ``range_rows`` rows, so the last run of a range has a bounded
size whatever the table's, and a digest that a third of the rows share takes
one entry for each partition.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import first_of_each, materialise, no_text_as_empty, unused, with_row_key

ENTRY = np.dtype([("digest", "S32"), ("id", "<i8"), ("row", "<i8"), ("rows", "<i8"), ("bytes", "<i8"), ("check", "<i8")])
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
RUNS = "range_no int, run long, entries binary"


def _collapse(entries: np.ndarray, keep: str) -> np.ndarray:
    """The run of unsorted entries."""
    if not len(entries):
        return entries
    entries = entries[np.lexsort((entries["row"], entries["id"], entries["digest"]))]
    first = np.flatnonzero(np.r_[True, entries["digest"][1:] != entries["digest"][:-1]])
    last = np.r_[first[1:], len(entries)] - 1
    for proof in ("bytes", "check"):
        _verify(np.minimum.reduceat(entries[proof], first), np.maximum.reduceat(entries[proof], first))
    out = entries[last if keep == "largest" else first].copy()
    out["rows"] = np.add.reduceat(entries["rows"], first)
    return out


def _verify(one: np.ndarray, two: np.ndarray) -> None:
    if not np.array_equal(one, two):
        raise ValueError("texts that differ in length or in a second hash share a digest")


def _weave(a: np.ndarray, b: np.ndarray, keep: str) -> np.ndarray:
    """Two sorted runs as one."""
    at = np.searchsorted(a["digest"], b["digest"])
    both = np.zeros(len(b), bool)
    inside = at < len(a)
    both[inside] = a["digest"][at[inside]] == b["digest"][inside]
    new = ~both
    places = at[new] + np.arange(new.sum())
    out = np.empty(len(a) + len(places), ENTRY)
    of_a = np.ones(len(out), bool)
    of_a[places] = False
    out[places] = b[new]
    merged = a.copy()
    x, y = a[at[both]], b[both]
    for proof in ("bytes", "check"):
        _verify(x[proof], y[proof])
    later = (y["id"] > x["id"]) | ((y["id"] == x["id"]) & (y["row"] > x["row"]))
    stays = np.where(later if keep == "largest" else ~later, y, x)
    stays["rows"] = x["rows"] + y["rows"]
    merged[at[both]] = stays
    out[of_a] = merged
    return out


def merge_runs(runs: list[np.ndarray], keep: str) -> np.ndarray:
    """Merge sorted runs into one, the shortest first: an entry for each digest, with the identifier that stays."""
    heap = [(len(r), k, r) for k, r in enumerate(runs)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, k, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        woven = _weave(b, a, keep)
        heapq.heappush(heap, (len(woven), k, woven))
    return heap[0][2] if heap else np.empty(0, ENTRY)


def _leaf_runs(ranges: int, keep: str):
    """One run for each range from a partition of (digest, id, row, bytes, check)."""
    missing = LOWEST if keep == "largest" else HIGHEST

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs, pending, rows = [], [], 0
        for batch in batches:
            part = np.empty(batch.num_rows, ENTRY)
            part["digest"] = np.array(batch.column(0).to_pylist(), "S32") if batch.num_rows else []
            part["id"] = batch.column(1).fill_null(int(missing)).to_numpy(zero_copy_only=False)
            part["row"] = batch.column(2).to_numpy(zero_copy_only=False)
            part["bytes"] = batch.column(3).to_numpy(zero_copy_only=False)
            part["check"] = batch.column(4).to_numpy(zero_copy_only=False)
            part["rows"] = 1
            pending.append(part)
            rows += len(part)
            if rows >= 1 << 20:
                runs, pending, rows = [merge_runs([*runs, _collapse(np.concatenate(pending), keep)], keep)], [], 0
        run = merge_runs([*runs, _collapse(np.concatenate([np.empty(0, ENTRY), *pending]), keep)], keep)
        if len(run):
            lead = np.frombuffer(run["digest"].tobytes(), ">u4")[::8].astype(np.int64) if len(run) else []
            of = (lead * ranges) >> 32
            cuts = np.searchsorted(of, np.arange(ranges + 1))
            full = [k for k in range(ranges) if cuts[k] < cuts[k + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full, pa.int32()),
                    pa.array([TaskContext.get().partitionId()] * len(full), pa.int64()),
                    pa.array([run[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary()),
                ],
                ["range_no", "run", "entries"],
            )

    return leaf


def _merge_level(keep: str):
    def merge(key, pdf):
        import pandas as pd

        runs = [np.frombuffer(x, ENTRY) for x in pdf["entries"]]
        return pd.DataFrame({"range_no": [key[0]], "run": [key[1]], "entries": [merge_runs(runs, keep).tobytes()]})

    return merge


def _entries(keep: str):
    missing = LOWEST if keep == "largest" else HIGHEST

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                run = np.frombuffer(blob.as_buffer(), ENTRY)
                for at in range(0, len(run), 1 << 16):
                    x = run[at : at + (1 << 16)]
                    ids = pa.array(x["id"], pa.int64(), mask=x["id"] == missing)
                    digests = pa.Array.from_buffers(pa.binary(32), len(x), [None, pa.py_buffer(np.ascontiguousarray(x["digest"]).tobytes())])
                    yield pa.RecordBatch.from_arrays([digests.cast(pa.binary()), ids, pa.array(x["row"]), pa.array(x["rows"])], ["digest", "keep_id", "keep_row", "group_size"])

    return rows


def digest_groups(digests: DataFrame, *, keep: str = "smallest", fan_in: int = 8, range_rows: int = 1 << 20) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) of a table (digest binary, id, row_key, n_bytes, check)."""
    ranges = max(1, math.ceil(digests.count() / range_rows))
    parts = max(1, digests.rdd.getNumPartitions())
    runs = digests.select("digest", "id", "row_key", "n_bytes", "check").mapInArrow(_leaf_runs(ranges, keep), RUNS)
    for _ in range(math.ceil(math.log(parts, fan_in)) if parts > 1 else 0):
        runs = runs.groupBy("range_no", F.expr(f"run div {fan_in}").alias("run")).applyInPandas(_merge_level(keep), RUNS)
    return runs.select("entries").mapInArrow(_entries(keep), "digest binary, keep_id long, keep_row long, group_size long")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 8, range_rows: int = 1 << 20) -> DataFrame:
    """One row per input row: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical byte for byte; null counts as empty. Of equal
    texts the row with the smallest (or ``keep="largest"``) id stays. A null id
    only stays if all ids of its group are null. Rows that repeat both id and
    text are a tie, of which one is kept. Texts of any length are hashed whole where
    they are read. An empty table gives no rows. Other columns are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    text = no_text_as_empty(text_col)
    digests = materialise(with_row_key(docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("check"))), "digests")
    groups = digest_groups(digests, keep=keep, fan_in=fan_in, range_rows=range_rows)
    return digests.join(groups, "digest").select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row_key") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, whatever their names.

    Null texts count as empty; a null id stays only where all of its text's are
    null. Of rows that share id and text but differ elsewhere, the one whose other
    columns, as JSON, come first stays; of whole rows that repeat, one. An empty
    table stays empty.
    """
    one, sha, digest = unused(docs, "_id", "_sha", "_digest")
    found = exact_dedup(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, keep=keep)
    stay = found.where("kept").select(F.col(id_col).alias(one), F.col("text_sha256").alias(sha))
    out = docs.withColumn(digest, F.sha2(no_text_as_empty(text_col), 256)).join(stay, F.col(digest).eqNullSafe(F.col(sha)) & F.col(id_col).cast("long").eqNullSafe(F.col(one)), "left_semi")
    repeats = found.groupBy(id_col, "text_sha256").agg(F.count("*").alias("_n"), F.max("kept").alias("_k")).where("_n > 1 and _k")
    if not repeats.isEmpty():  # ties are only looked at where there are any
        out = first_of_each(out, [digest, id_col], docs.columns)
    return out.drop(digest)
