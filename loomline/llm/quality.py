"""Text quality by compression: zstandard dictionaries of good and of bad texts.

A dictionary is built from the pieces of the labelled texts of each class. A text
is cut into blocks of each of a few sizes, so that a long text cannot turn into
its own dictionary, and each block is compressed with either. The difference of
the two sizes tells which class the text resembles. It is normalised twice: by
the larger size, averaged over the blocks, and, summed, by the text's bytes; nothing
else of a text is looked at. A logistic fit on these differences turns them into a
calibrated score. The labelled texts are
dealt to ``FOLDS`` folds: each fold leaves one set of dictionaries unseen, the
differences of all folds together fit the calibration, and the scores by each set
of dictionaries are averaged.

Learning takes at most ``sample_rows`` texts of each class, and no further ones
once ``sample_bytes`` bytes are reached. Every text is scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import hold_memory, no_text_as_empty


FOLDS = 3


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _engine(dictionary: bytes, level: int):
    """(compress, size of nothing) with a dictionary."""
    kind = zstandard.DICT_TYPE_AUTO if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=kind) if dictionary else None
    if held:
        held.precompute_compress(level=level)
    compress = zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    return compress, len(compress(b""))


@dataclass
class Fold:
    """The dictionaries of all folds but one, and the calibration."""

    good: bytes
    bad: bytes
    blocks: tuple[int, ...]
    level: int
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def differences(self, texts: Sequence[str]) -> np.ndarray:
        """For each block size the mean over a text's blocks of (bad - good) / max(bad, good), then for each the sum of bad - good by the text's bytes; 0 for an empty text."""
        (good, no_good), (bad, no_bad) = _engine(self.good, self.level), _engine(self.bad, self.level)
        n = len(self.blocks)
        out = np.zeros((len(texts), 2 * n))
        for i, text in enumerate(texts):
            data = memoryview(text.encode("utf-8", "surrogatepass"))
            for j, size in enumerate(self.blocks):
                if j and len(data) <= self.blocks[j - 1]:  # one block, as with the size before
                    out[i, j], out[i, n + j] = out[i, j - 1], out[i, n + j - 1]
                    continue
                share, total, at = 0.0, 0, 0
                for at in range(0, len(data), size):
                    block = data[at : at + size]
                    a, b = len(good(block)) - no_good, len(bad(block)) - no_bad
                    share += (b - a) / max(1, a, b)
                    total += b - a
                out[i, j], out[i, n + j] = share / (at // size + 1), total / max(1, len(data))
        return out

    def terms(self, differences: np.ndarray) -> np.ndarray:
        """The standardised differences, their products and 1."""
        z = (differences - self.mean) / self.scale
        n = z.shape[1]
        return np.column_stack([z, *(z[:, i] * z[:, j] for i in range(n) for j in range(i + 1)), np.ones(len(z))])

    def calibrate(self, differences: np.ndarray, y: np.ndarray, prior: float) -> None:
        self.mean, self.scale = differences.mean(0), differences.std(0) + 1e-9
        x = self.terms(differences)
        w, ridge = np.zeros(x.shape[1]), np.array([0.3] * (x.shape[1] - 1) + [1e-6])
        loss = lambda v: np.logaddexp(0, x @ v).sum() - y @ (x @ v) + (ridge * v * v).sum() / 2
        for _ in range(40):  # Newton's method, with shorter steps where a whole one would not descend
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
            while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
                step = step / 2
            w = w - step
        w[-1] += prior - np.log(y.sum() / (len(y) - y.sum()))  # the sample's shares are not the table's
        self.weights = w

    def probability(self, texts: Sequence[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.terms(self.differences(texts)) @ self.weights, -500, 500)))


@dataclass
class QualityModel:
    """Small enough to go with every task (2 * FOLDS dictionaries of ``dictionary_bytes``); without folds, every score is the share of good texts."""

    share: float
    folds: list[Fold] = field(default_factory=list)

    def score(self, texts: Sequence[str]) -> np.ndarray:
        """Probability that a text is good."""
        if not self.folds:
            return np.full(len(texts), self.share)
        return np.mean([f.probability(texts) for f in self.folds], axis=0)


def _dictionary(texts: list[bytes], size: int, piece: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, [t[at : at + piece] for t in texts for at in range(0, len(t), piece)]).as_bytes()
    except zstandard.ZstdError:  # too few or too small texts to train on: their bytes as they are
        return b"\n".join(texts)[-size:]


def fit(good: list[str], bad: list[str], share_good: float, *, dictionary_bytes: int = 112_640, piece: int = 256, blocks: Sequence[int] = (256, 1024, 4096), level: int = 3) -> QualityModel:
    """Learn from texts of each class. With fewer of either than two for each fold, every score is the share."""
    share = min(max(share_good, 1e-3), 1 - 1e-3)
    model = QualityModel(share)
    if min(len(good), len(bad)) < 2 * FOLDS:
        return model
    parts = [[t.encode("utf-8", "surrogatepass") for t in x] for x in (good, bad)]
    unseen, labels = [], []
    for k in range(FOLDS):
        seen = [[t for i, t in enumerate(x) if i % FOLDS != k] for x in parts]
        model.folds.append(Fold(*(_dictionary(x, dictionary_bytes, piece) for x in seen), tuple(blocks), level))
        unseen.append(model.folds[-1].differences([*good[k::FOLDS], *bad[k::FOLDS]]))
        labels += [1.0] * len(good[k::FOLDS]) + [0.0] * len(bad[k::FOLDS])
    for one in model.folds:
        one.calibrate(np.concatenate(unseen), np.array(labels), np.log(share / (1 - share)))
    return model


def fit_table(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out_fold: int = 0, sample_rows: int = 2200, sample_bytes: int = 16 << 20, seed: int = 5, **how) -> QualityModel:
    """Learn from the labelled rows outside the held-out fold.

    Labels other than 0 and 1, and ids labelled both, are left out. The sample
    takes the rows of a class in order of a hash of their id, whole texts of any
    length: at most ``sample_rows``, and none after the one that reaches
    ``sample_bytes``. Of texts that share an id the least counts.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("top")).where("y = top").select("id", "y").where(fold(F.col("id")) != held_out_fold)
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not shares:
        return fit([], [], 0.5, **how)
    texts: dict[int, list[str]] = {}
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows)
        found = docs.select(F.col(id_col).alias("id"), no_text_as_empty(text_col).alias("text")).join(F.broadcast(some.select("id")), "id")  # at most sample_rows ids
        order = Window.orderBy(F.xxhash64("id", F.lit(seed)), "id").rowsBetween(Window.unboundedPreceding, -1)
        one = found.groupBy("id").agg(F.min("text").alias("text")).withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(order), F.lit(0)))
        rows = one.where(F.col("before") < sample_bytes).orderBy("before", F.xxhash64("id", F.lit(seed)), "id").collect()
        texts[y] = [r["text"] for r in rows]
    return fit(texts[1], texts[0], shares.get(1, 0) / sum(shares.values()), **how)


def score_table(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, score_col: str = "score") -> DataFrame:
    """The rows of docs with ``score`` double and ``predicted`` int, whatever other columns they have (ones named so are replaced).

    Null and empty texts are scored as empty, very long ones whole, block by block;
    every row keeps its own score, also where rows repeat. An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in (score_col, "predicted")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory("quality", None)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                score = model.score([t or "" for t in part.column(kept.index(text_col)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*kept, score_col, "predicted"])

    schema = T.StructType([*docs.select(*kept).schema, T.StructField(score_col, T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*kept).mapInArrow(rows, schema)
