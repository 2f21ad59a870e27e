"""Language identification with error-correcting output codes.

Every language has a codeword. One logistic classifier over hashed byte trigrams is fitted for each bit, and
a text takes the language whose codeword has the least loss over all bits; a small margin to the second is
flagged as ambiguous. The classifiers are fitted on a bounded sample for each language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyaccord.lineage import stored
from skyaccord.llm.common import id_crc32, map_rows

HASH_BITS = 13
DIM = 1 << HASH_BITS
UNDETERMINED = "und"
#: Rows of the sample that are spread out at a time.
BATCH = 256
#: All ASCII but letters becomes one blank; letters are lower-cased before.
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def trigram_slots(text: str) -> np.ndarray:
    b = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(_FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    code = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    return (code * np.uint32(2654435761) >> np.uint32(32 - HASH_BITS)).astype(np.int64)


def trigram_vector(text: str) -> np.ndarray:
    """Square roots of the counts of hashed trigrams, of unit length."""
    v = np.sqrt(np.bincount(trigram_slots(text), minlength=DIM)).astype(np.float32)
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +-1. Up to five languages: all splits in two. More: of random codes the one whose closest rows lie farthest apart."""
    if n < 2:
        return np.ones((n, 1), np.float32)
    if n <= 5:
        splits = [[1 if (k >> i) & 1 else -1 for i in range(n)] for k in range(1, 1 << (n - 1))]
        return np.array(splits, np.float32).T
    rng, bits, best, far = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = ((bits - code @ code.T) / 2 + np.eye(n) * bits).min()
        if apart > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, apart
    return (code if best is None else best).astype(np.float32)


@dataclass
class OutputCodes:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decode(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score 0 to 1, ambiguous) of each text; `und` with score 0 for null, for no letter, or if nothing was learned."""
        at = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        out: list[tuple[str, float, bool]] = [(UNDETERMINED, 0.0, True)] * len(texts)
        for some in (at[k : k + 64] for k in range(0, len(at), 64)):
            margins = np.stack([trigram_vector(texts[i]) for i in some]) @ self.weights + self.bias
            loss = np.logaddexp(0, -self.code[None] * margins[:, None, :]).sum(axis=2)
            share = np.exp(loss.min(axis=1, keepdims=True) - loss)
            share /= share.sum(axis=1, keepdims=True)
            for i, k, p in zip(some, loss.argmin(axis=1), share):
                second = np.partition(p, -2)[-2] if len(p) > 1 else 0.0
                out[i] = (self.languages[k], float(p[k]), bool(p[k] - second < 0.2))
        return out


def fit(starts: np.ndarray, slots: np.ndarray, values: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 25, rate: float = 0.05, decay: float = 1e-5) -> OutputCodes:
    """Logistic regression for each bit by Adam over batches; every language has the same weight.

    Row i has the features slots[starts[i] : starts[i + 1]]; a batch at a time is spread out to all DIM columns.
    """
    code = codewords(len(languages))
    w, b = np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    if len(languages) > 1:
        share = len(y) / np.bincount(y, minlength=len(languages))[y] / len(languages)
        m, s, step, rng = np.zeros_like(w), np.zeros_like(w), 0, np.random.default_rng(5)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for some in (order[k : k + BATCH] for k in range(0, len(y), BATCH)):
                x = np.zeros((len(some), DIM), np.float32)
                for row, i in zip(x, some):
                    row[slots[starts[i] : starts[i + 1]]] = values[starts[i] : starts[i + 1]]
                target, step = code[y[some]], step + 1
                pull = (-share[some, None] * target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) / len(some)).astype(np.float32)
                g = x.T @ pull + decay * w
                m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
                b -= rate * pull.sum(axis=0)
    return OutputCodes(languages, code, w, b)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int | None = 3, per_language: int = 400, max_sample: int = 20_000) -> OutputCodes:
    """Fits on at most per_language documents of each language, and at most max_sample (but one of each) in all, outside the held-out fold (crc32(id) mod fold = 1).

    The documents with the least hashes of id and text are taken; rows that repeat both count as one, however many
    there are. Null languages and texts without a letter teach nothing. Features of whole texts are made on the
    executors; the driver gets those of the sample, as sparse rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if fold:
        rows = rows.filter(id_crc32("id") % fold != 1)
    rows = rows.withColumn("draw", F.xxhash64("id", "text"))
    names = rows.select("lang", "draw").distinct()
    counts = stored(names.groupBy("lang").agg(F.count("*").alias("n")))
    n_langs = counts.count()
    few = max(1, min(per_language, max_sample // max(1, n_langs)))
    # Hashes are even over 64 bits: this many of the least ones nearly always hold the few wanted, and a rank cuts the rest.
    limit = counts.select("lang", (F.lit(float(-(1 << 63))) + F.lit(float(1 << 64)) * F.least(F.lit(1.0), F.lit(float(2 * few + 50)) / F.col("n"))).alias("limit"))
    least = names.join(F.broadcast(limit) if n_langs <= 10_000 else limit, "lang").filter(F.col("draw") <= F.col("limit")).select("lang", "draw")
    taken = stored(least.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).filter(F.col("k") <= few).drop("k"))
    sample = rows.select("lang", "draw", "text").join(F.broadcast(taken) if n_langs <= max_sample else taken, ["lang", "draw"]).groupBy("lang", "draw").agg(F.first("text").alias("text")).select("lang", "text")

    def fn(batch: pa.RecordBatch) -> dict:
        found = [np.unique(trigram_slots(t), return_counts=True) for t in batch.column(1).to_pylist()]
        return {"lang": batch.column(0), "slot": pa.array([s.astype(np.int16).tobytes() for s, _ in found], pa.binary()), "n": pa.array([n.astype(np.int32).tobytes() for _, n in found], pa.binary())}

    got = map_rows(sample, fn, "lang string, slot binary, n binary").toArrow().sort_by([("lang", "ascending"), ("slot", "ascending"), ("n", "ascending")])
    langs = got["lang"].to_pylist()
    languages = sorted(set(langs))
    number = {lang: k for k, lang in enumerate(languages)}
    slots, values = [], []
    for slot, n in zip(got["slot"].to_pylist(), got["n"].to_pylist()):
        v = np.sqrt(np.frombuffer(n, np.int32)).astype(np.float32)
        slots.append(np.frombuffer(slot, np.int16))
        values.append(v / np.linalg.norm(v))
    starts = np.concatenate(([0], np.cumsum([len(s) for s in slots]))).astype(np.int64)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return fit(starts, join(slots, np.int16), join(values, np.float32), np.array([number[n] for n in langs], np.int64), languages)


def identify(docs: DataFrame, model: OutputCodes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous), a row for each row, over whole texts; no shuffle."""

    def fn(batch: pa.RecordBatch) -> dict:
        got = model.decode(batch.column(1).to_pylist())
        return {"id": batch.column(0), "lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64()), "ambiguous": pa.array([g[2] for g in got], pa.bool_())}

    return map_rows(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")), fn, "id long, lang_pred string, score double, ambiguous boolean")
