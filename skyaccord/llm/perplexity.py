"""Quality rules with n-gram perplexity under a modified Kneser-Ney model.

Tokens are the bytes of the text as they stand, so no script or case is folded. Every language has two models,
counted by Spark over the two halves of its documents (split by a hash of the text, so exact copies share a
half); a document is scored by the model of the half it does not belong to. Counts, discounts, backoff and
probabilities are tables of distinct n-grams that grow with the corpus: no task, and not the driver, holds them
whole. Hashes of n-grams are dealt out by their prefix; what a slice of documents wants of a block travels as one
sorted hash array, is looked up there in the model's sorted hash array, and comes back to the slice, whose texts
travel once, compressed. Each language gets a band of perplexity from all its documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyaccord.lineage import checkpointed, stored
from skyaccord.llm.common import cut_slices, ipc_bytes, packed, unpacked

ORDER = 5
#: Rows of a counted table up to which it is broadcast.
BROADCAST_ROWS = 10_000
#: Odd, so that multiplying by it modulo 2^40 maps different n-grams to different hashes; with its inverse.
_MIX, _BITS = 0x9E3779B97F, 8 * ORDER
_UNMIX, _MASK = pow(_MIX, -1, 1 << _BITS), np.uint64((1 << _BITS) - 1)


def ngram_codes(text: bytes) -> np.ndarray:
    """The ORDER bytes that end at each byte, packed in an integer; the text begins after blanks."""
    b = np.frombuffer(b" " * (ORDER - 1) + text, np.uint8).astype(np.uint64)
    code = np.zeros(len(text), np.uint64)
    for k in range(ORDER):
        code = code << np.uint64(8) | b[k : k + len(text)]
    return code


def hashes(codes: np.ndarray) -> np.ndarray:
    return codes * np.uint64(_MIX) & _MASK


def unhashed(values: np.ndarray) -> np.ndarray:
    return values * np.uint64(_UNMIX) & _MASK


_LETTER = bytes(1 if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 0 for b in range(256))


def n_letters(text: bytes) -> int:
    """ASCII letters and bytes of longer characters, at least 1."""
    return max(1, text.translate(_LETTER).count(1))


def half_of(text: bytes) -> int:
    """The half of the corpus that a text belongs to."""
    return zlib.crc32(text) & 1


def _sorted_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the texts' n-grams in order, and their counts; about a million n-grams are held at a time before they are reduced."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < 1 << 20 or end == at):
            size += len(texts[end])
            end += 1
        parts.append(np.unique(hashes(np.concatenate([ngram_codes(t) for t in texts[at:end]])), return_counts=True))
        at = end
        if len(parts) == 16:
            parts = [_merged(parts)]
    return _merged(parts)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(parts) == 1:
        return parts[0][0], parts[0][1].astype(np.int64)
    every, n = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(every, kind="stable")
    every, upto = every[order], np.concatenate(([0], np.cumsum(n[order], dtype=np.int64)))
    new = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[new], np.diff(upto[np.append(new, len(every))])


def _groups(rows: pa.Table) -> dict[tuple[str | None, int], list[bytes]]:
    """Texts of a slice by language and half."""
    groups: dict[tuple[str | None, int], list[bytes]] = {}
    for lang, text in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist()):
        if text:
            groups.setdefault((lang, half_of(text)), []).append(text)
    return groups


def _block_starts(blocks: int) -> np.ndarray:
    """The least hash of each block; blocks are equal ranges of hashes."""
    return np.array([-(-(b << _BITS) // blocks) for b in range(blocks)], np.uint64)


def gather_ngrams(narrow: DataFrame, blocks: int) -> DataFrame:
    """(block, slice, lang, half, hashes, n): sorted hash arrays of the n-grams of every slice by language and half, dealt out by block in the shared folder.

    narrow: (id, lang, text as bytes).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in cut_slices(batches):
            groups = _groups(rows)
            while groups:
                (lang, half), texts = groups.popitem()
                found, n = _sorted_counts(texts)
                cuts = [*np.searchsorted(found, _block_starts(blocks)), len(found)]
                some = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
                size = len(some)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([b for b, _, _ in some], pa.int32()), "slice": pa.array([key] * size, pa.int64()), "lang": pa.array([lang] * size, pa.string()), "half": pa.array([half] * size, pa.int32()),
                    "hashes": pa.array([packed(np.diff(found[lo:hi], prepend=np.uint64(0))) for _, lo, hi in some], pa.binary()), "n": pa.array([packed(n[lo:hi]) for _, lo, hi in some], pa.binary()),
                })

    dealt = narrow.mapInArrow(run, "block int, slice long, lang string, half int, hashes binary, n binary").repartition(blocks, "block")
    return checkpointed(dealt.sortWithinPartitions("block", "lang", "half"))


def count_ngrams(gathered: DataFrame) -> DataFrame:
    """(lang, gram, c0, c1): each distinct n-gram of a language with its count in either half. No shuffle: a block lies in one partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for (_, lang), group in groupby(rows, key=lambda r: (r["block"], r["lang"])):
            parts: tuple[list, list] = ([], [])
            for r in group:
                parts[r["half"]].append((np.cumsum(unpacked(r["hashes"], np.uint64)), unpacked(r["n"], np.int64)))
            found = [_merged(p) for p in parts]
            every = np.union1d(found[0][0], found[1][0])
            counts = np.zeros((2, len(every)), np.int64)
            for h, (values, n) in enumerate(found):
                counts[h, np.searchsorted(every, values)] = n
            for at in range(0, len(every), 100_000):
                part = slice(at, at + 100_000)
                grams = unhashed(every[part]).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(grams), "c0": pa.array(counts[0, part]), "c1": pa.array(counts[1, part])})

    return gathered.mapInArrow(run, "lang string, gram long, c0 long, c1 long")


def _taken(c: Column, d: list[Column]) -> Column:
    return F.when(c <= 0, F.lit(0.0)).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def _discounts(t: DataFrame, half: int) -> list[Column]:
    """Three discounts of a half from its counts of counts 1 to 4 (each at least 1), kept within [0.05, j - 0.05]."""
    n = [F.greatest(F.count(F.when(t[f"c{half}"] == j, 1)), F.lit(1)).cast("double") for j in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    return [F.least(F.greatest(j - (j + 1) * y * n[j] / n[j - 1], F.lit(0.05)), F.lit(j - 0.05)).alias(f"d{half}{j}") for j in (1, 2, 3)]


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, gram, p0, p1): interpolated probability of an n-gram's last byte after the others, under the model of each half.

    counts: (lang, gram, c0, c1), a row for each distinct n-gram with its count in either half. Lower orders count
    the different bytes that stand before. A group of a context has at most 256 rows, so no key is hot. A context that a half has not met
    gives the probability of the shorter one; before any byte all 256 are alike.
    """
    levels = [stored(counts)]
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[-1].withColumn("gram", F.col("gram").bitwiseAND((1 << 8 * k) - 1))
        levels.append(stored(shorter.groupBy("lang", "gram").agg(*[F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in ("c0", "c1")])))
    lower = None
    for k, t in enumerate(reversed(levels), 1):
        d = t.groupBy("lang").agg(*_discounts(t, 0), *_discounts(t, 1))
        if lower is None:
            few = levels[-1].select("lang").distinct().count() <= BROADCAST_ROWS
        d = d.withColumnRenamed("lang", "d_lang")
        rows = t.join(F.broadcast(d) if few else d, t.lang.eqNullSafe(d.d_lang)).drop("d_lang")
        context = Window.partitionBy("lang", F.shiftright("gram", 8))
        held = []
        for h in "01":
            taken = _taken(F.col(f"c{h}"), [F.col(f"d{h}{j}") for j in (1, 2, 3)])
            rows = rows.withColumns({f"left{h}": F.col(f"c{h}") - taken, f"taken{h}": taken})
            held += [F.sum(f"c{h}").over(context).alias(f"all{h}"), F.sum(f"taken{h}").over(context).alias(f"lost{h}")]
        rows = rows.select("lang", "gram", "left0", "left1", *held)
        if lower is None:
            rows = rows.withColumns({"q0": F.lit(1 / 256), "q1": F.lit(1 / 256)})
        else:
            low = lower.select(F.col("lang").alias("l"), F.col("gram").alias("g"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
            rows = rows.join(low, rows.lang.eqNullSafe(low.l) & (F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1) == low.g))
        p = [F.when(F.col(f"all{h}") > 0, (F.col(f"left{h}") + F.col(f"lost{h}") * F.col(f"q{h}")) / F.col(f"all{h}")).otherwise(F.col(f"q{h}")).alias(f"p{h}") for h in "01"]
        lower = stored(rows.select("lang", "gram", *p))
    return lower


SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def base_rules(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text (null: zeros)."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(text.count(s) for s in SPACES)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, upto = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), chars, sum(text.count(s) for s in SYMBOLS), len(lines) - len(set(lines)), repeated


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, base columns, log_ppl), a row for each row; log_ppl is null without a byte.

    log_ppl: the negative log probability of the whole text over its letters (at least 1), so that what is spent
    on marks, digits and blanks weighs on the letters that they go with.

    docs is read twice and must give the same rows in the same order, as a table does.
    """
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), lang.alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    blocks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gathered = gather_ngrams(narrow, blocks)
    model = _with_blocks(kneser_ney(count_ngrams(gathered)), blocks)
    found = gathered.select("block", "slice", "lang", "half", "hashes").groupBy("block").cogroup(model.groupBy("block")).applyInArrow(_looked_up, "slice long, lang string, half int, block int, logs binary")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in cut_slices(batches):
            yield pa.RecordBatch.from_pydict({"slice": pa.array([key], pa.int64()), "rows": pa.array([ipc_bytes(rows)], pa.binary())})

    texts = narrow.mapInArrow(pack, "slice long, rows binary")
    return texts.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(_scored, MEASURED_DDL)


def _with_blocks(model: DataFrame, blocks: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = hashes(b.column(1).to_numpy().astype(np.uint64))
            block = np.searchsorted(_block_starts(blocks), values, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), b.column(0), pa.array(values.astype(np.int64)), b.column(2), b.column(3)], ["block", "lang", "hash", "p0", "p1"])

    return model.select("lang", "gram", "p0", "p1").mapInArrow(run, "block int, lang string, hash long, p0 double, p1 double")


def _looked_up(rows: pa.Table, model: pa.Table) -> pa.Table:
    """The log probabilities of each array's n-grams in its order, under the model of the other half."""
    tables = {}
    langs = model.column("lang").combine_chunks()
    for lang in langs.unique().to_pylist():
        some = model.filter(pc.is_null(langs) if lang is None else pc.equal(langs, lang)).sort_by("hash")
        logs = [np.log(some.column(p).to_numpy()).astype(np.float32) for p in ("p0", "p1")]
        tables[lang] = some.column("hash").to_numpy().astype(np.uint64), logs
    out = []
    for r in rows.to_pylist():
        table, logs = tables[r["lang"]]
        out.append(packed(logs[1 - r["half"]][np.searchsorted(table, np.cumsum(unpacked(r["hashes"], np.uint64)))]))
    return pa.Table.from_arrays([*[rows.column(c).combine_chunks() for c in ("slice", "lang", "half", "block")], pa.array(out, pa.binary())], ["slice", "lang", "half", "block", "logs"])


MEASURED_DDL = "id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = pa.schema([("id", pa.int64()), ("lang", pa.string()), *[(n, pa.int64()) for n in BASE], ("log_ppl", pa.float64())])


def _scored(texts: pa.Table, found: pa.Table) -> pa.Table:
    """A slice's documents with their base columns and log perplexities; the arrays of its blocks, joined, are its sorted n-grams."""
    arrays: dict[tuple[str | None, int], list[np.ndarray]] = {}
    for r in sorted(found.to_pylist(), key=lambda r: r["block"]):
        arrays.setdefault((r["lang"], r["half"]), []).append(unpacked(r["logs"], np.float32))
    out = []
    for row in texts.column("rows").to_pylist():
        rows = pa.ipc.open_stream(row).read_all()
        tables = {key: (_sorted_counts(group)[0], np.concatenate(arrays.get(key, [np.empty(0, np.float32)]))) for key, group in _groups(rows).items()}
        if any(len(h) != len(logs) for h, logs in tables.values()):
            raise RuntimeError("the table gave other rows when it was read again")
        base, log_ppl = [], []
        for lang, text in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist()):
            base.append(base_rules(text.decode() if text else None))
            if text:
                table, logs = tables[lang, half_of(text)]
                seen, n = np.unique(hashes(ngram_codes(text)), return_counts=True)
                log_ppl.append(float(-(logs[np.searchsorted(table, seen)].astype(np.float64) * n).sum() / n_letters(text)))
            else:
                log_ppl.append(None)
        columns = [pa.array([b[k] for b in base], pa.int64()) for k in range(len(BASE))]
        out.append(pa.Table.from_arrays([rows.column(0).combine_chunks(), rows.column(1).combine_chunks(), *columns, pa.array(log_ppl, pa.float64())], schema=MEASURED))
    return pa.concat_tables(out) if out else MEASURED.empty_table()


def bands(measured: DataFrame, width: float = 8.0, least: float = 0.02) -> DataFrame:
    """(lang, low, high) of the log perplexity from all documents that pass the base rules: median +- max(width x 1.4826 MAD, least).

    Exact medians over values rounded to 0.001, weighted by their counts. Null lang is a language of its own.
    """
    good = measured.filter(~F.col("base_failed") & F.col("log_ppl").isNotNull())
    counts = good.groupBy("lang", F.round("log_ppl", 3).alias("x")).agg(F.count("*").alias("n"))
    middle = counts.groupBy("lang").agg(F.expr("percentile(x, 0.5, n)").alias("m"))
    near = F.col("a.lang").eqNullSafe(F.col("b.lang"))
    off = counts.alias("a").join(middle.alias("b"), near).select("a.lang", "m", F.abs(F.col("x") - F.col("m")).alias("d"), "n")
    spread = off.groupBy("lang", "m").agg(F.expr("percentile(d, 0.5, n)").alias("mad"))
    half = F.greatest(F.col("mad") * width * 1.4826, F.lit(least))
    return spread.select("lang", (F.col("m") - half).alias("low"), (F.col("m") + half).alias("high"))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", width: float = 8.0) -> DataFrame:
    """(id, base columns, base_failed, log_ppl, low, high, kept), a row for each row.

    kept: the base rules pass and the perplexity lies in the language's band. Null and empty texts have no
    words, so they fail the base rules; a text of a language without a band is kept. Repeated rows are scored
    alike. A language whose texts all lie in one half has no model for them: all its bytes are alike.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stored(measure(docs, id_col, text_col, lang_col).withColumn("base_failed", failed))
    limits = stored(bands(rows, width))  # a row for each language
    if limits.count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    joined = rows.alias("a").join(limits.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")), "left")
    return joined.select("a.*", "low", "high", (~F.col("base_failed") & inside).alias("kept"))
