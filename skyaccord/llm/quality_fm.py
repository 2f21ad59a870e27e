"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): all pairwise
interactions in time linear in the number of features. It is fitted with numpy on a bounded sample of
labelled documents (max_train); scoring is a map over whole texts, without a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyaccord.llm.common import SLICE_ROWS, id_crc32, map_rows, text_bytes

WORD_BITS = 15
#: Statistics are cut into so many steps, each a feature of its own.
STEPS = 12
STATISTICS = ("words", "distinct", "word_length", "marks", "symbols", "digits", "capitals", "repeated_lines", "top_word", "wide")
METADATA = ("n_chars",)
N_FEATURES = (1 << WORD_BITS) + STEPS * (len(STATISTICS) + len(METADATA))
_MARKS, _SYMBOLS, _DIGITS = b".,;:!?", b"#*$%&|<>", b"0123456789"
_UPPER = bytes(range(65, 91))


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def features(text: bytes | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one whole text. Null and empty texts have statistics and metadata alone."""
    text = text or b""
    words = text.split()
    counts = Counter(text.lower().split())
    size, n, kinds = max(len(text), 1), max(len(words), 1), len(counts)
    mask, crc = (1 << WORD_BITS) - 1, zlib.crc32
    index = [crc(w) & mask for w in counts]
    value = np.sqrt(np.fromiter(counts.values(), np.float64, kinds))
    if kinds:
        value /= np.sqrt(n)  # of unit length
    lines = [x for x in text.split(b"\n") if x.strip()]
    steps = (
        math.log2(len(words) + 1) / 16,
        kinds / n,
        sum(map(len, words)) / n / 16,
        6 * _count(text, _MARKS) / size,
        6 * _count(text, _SYMBOLS) / size,
        6 * _count(text, _DIGITS) / size,
        3 * _count(text, _UPPER) / size,
        1 - len(set(lines)) / max(len(lines), 1),
        max(counts.values(), default=0) / n,
        _count(text, bytes(range(128, 256))) / size,
        -1.0 if n_chars is None or n_chars < 0 else math.log2(n_chars + 1) / 24,
    )
    base = 1 << WORD_BITS
    index += [base + k * STEPS + (STEPS - 1 if x < 0 else min(STEPS - 2, int(x * (STEPS - 1)))) for k, x in enumerate(steps)]
    return np.array(index, np.int64), np.concatenate((value, np.full(len(steps), 0.5))).astype(np.float32)


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """starts: where each row's features begin; every row has some."""
        xv = self.factors[index] * value[:, None]
        sums = np.add.reduceat(xv, starts, axis=0)
        squares = np.add.reduceat(xv * xv, starts, axis=0)
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + 0.5 * (sums * sums - squares).sum(axis=1)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        starts = np.concatenate(([0], np.cumsum([len(i) for i, _ in rows])[:-1]))
        z = self.logits(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 8, epochs: int = 12, rate: float = 0.05, decay: float = 2e-5, batch: int = 64, seed: int = 7) -> FactorisationMachine:
    """AdaGrad on the log loss. Without rows every score is 0.5; with one class only, near that class."""
    rng = np.random.default_rng(seed)
    fm = FactorisationMachine(0.0, np.zeros(N_FEATURES, np.float32), rng.normal(0, 0.02, (N_FEATURES, rank)).astype(np.float32))
    if not rows:
        fm.factors[:] = 0
        return fm
    share = np.clip(labels.mean(), 0.01, 0.99)
    fm.bias = float(np.log(share / (1 - share)))
    g_bias, g_linear, g_factors = 1e-6, np.full(N_FEATURES, 1e-6, np.float32), np.full((N_FEATURES, rank), 1e-6, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            sizes = np.array([len(rows[i][0]) for i in some])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            index, value = np.concatenate([rows[i][0] for i in some]), np.concatenate([rows[i][1] for i in some])
            xv = fm.factors[index] * value[:, None]
            sums = np.add.reduceat(xv, starts, axis=0)
            z = fm.bias + np.add.reduceat(fm.linear[index] * value, starts) + 0.5 * (sums * sums - np.add.reduceat(xv * xv, starts, axis=0)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[some]).astype(np.float32)
            e = np.repeat(error, sizes)
            touched, where = np.unique(index, return_inverse=True)
            d_linear = np.bincount(where, e * value, len(touched)).astype(np.float32) + decay * fm.linear[touched]
            per = e[:, None] * value[:, None] * (np.repeat(sums, sizes, axis=0) - xv)
            d_factors = np.stack([np.bincount(where, per[:, f], len(touched)) for f in range(per.shape[1])], axis=1).astype(np.float32) + decay * fm.factors[touched]
            g_bias += float(error.sum()) ** 2
            g_linear[touched] += d_linear**2
            g_factors[touched] += d_factors**2
            fm.bias -= rate * float(error.sum()) / math.sqrt(g_bias)
            fm.linear[touched] -= rate * d_linear / np.sqrt(g_linear[touched])
            fm.factors[touched] -= rate * d_factors / np.sqrt(g_factors[touched])
    return fm


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fold: int | None = 5, max_train: int = 4000) -> FactorisationMachine:
    """Fits on at most max_train labelled ids, the least by a hash, outside the held-out fold (crc32(id) mod fold = 0).

    Ids labelled both ways or with null count as unlabelled; a repeated id is fitted once for each of its different
    texts, and of all those rows again at most max_train. Only the features of that bounded sample reach the driver.
    """
    named = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    if fold:
        named = named.filter(id_crc32("id") % fold != 0)
    sure = named.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most")
    sample = sure.select("id", "label").orderBy(F.xxhash64("id"), "id").limit(max_train)
    n_chars = F.col("`n_chars`").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_bytes(text_col).alias("text"), n_chars.alias("n_chars"))
    picked = texts.join(F.broadcast(sample), "id").withColumn("row", F.xxhash64("text", "n_chars"))
    keys = picked.select("id", "row").distinct().orderBy(F.xxhash64("id", "row"), "id", "row").limit(max_train)
    picked = picked.join(F.broadcast(keys), ["id", "row"]).dropDuplicates(["id", "row"]).select("id", "text", "n_chars", "label")  # at most max_train rows

    def fn(batch: pa.RecordBatch) -> dict:
        rows = [features(t, n) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        return {"id": batch.column(0), "label": batch.column(3), "i": pa.array([r[0].astype(np.int32).tobytes() for r in rows], pa.binary()), "v": pa.array([r[1].tobytes() for r in rows], pa.binary())}

    got = map_rows(picked, fn, "id long, label int, i binary, v binary").toArrow().sort_by([("id", "ascending"), ("i", "ascending")])
    rows = [(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(v, np.float32)) for i, v in zip(got["i"].to_pylist(), got["v"].to_pylist())]
    return fit(rows, got["label"].to_numpy().astype(np.float32))


def score(docs: DataFrame, fm: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score), a row for each row; null and empty texts are scored too."""
    n_chars = F.col("`n_chars`").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_bytes(text_col).alias("text"), n_chars.alias("n_chars"))

    def fn(batch: pa.RecordBatch) -> dict:
        rows = [features(t, n) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        return {"id": batch.column(0), "score": pa.array(fm.scores(rows), pa.float64())}

    return map_rows(narrow, fn, "id long, score double")


def keep_good(docs: DataFrame, fm: FactorisationMachine, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs whose score reaches the threshold, all columns as they are; no shuffle."""
    text_at, chars_at = docs.columns.index(text_col), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                chars = batch.column(chars_at).to_pylist() if chars_at is not None else [None] * batch.num_rows
                rows = [features(t.encode() if t else None, n) for t, n in zip(batch.column(text_at).to_pylist(), chars)]
                yield batch.filter(pa.array(fm.scores(rows) >= threshold))

    return docs.mapInArrow(run, docs.schema)
