"""Benchmark decontamination with an FM-index for each shard of the corpus.

A shard is a slice of a task's documents. The documents are read once: every shard's words, hashed, become a
full-text index (the wavelet matrix of their Burrows-Wheeler transform and a sample of suffix positions) that is
stored in the shared folder. The benchmark's windows come in blocks; every block is searched in every shard's
index by backward search through wavelet ranks, what it finds is located by walking to sampled suffixes, and
overlapping occurrences of all blocks are merged to removal spans. An index can be searched with any number of phrases.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyaccord.lineage import stored
from skyaccord.llm.common import cut_slices, fresh_names, ipc_bytes, text_bytes, word_hashes

WINDOW = 13
#: Text bytes of benchmark items in one block of windows.
BLOCK_BYTES = 8_000_000
#: Text bytes of a shard, and the words that one index holds at most; a longer text is cut into overlapping parts.
SHARD_BYTES, PART_WORDS = 8_000_000, 1 << 20
#: Every how many positions a suffix is sampled.
SAMPLE = 8
#: Rows of a counted table up to which it is broadcast.
BROADCAST_ROWS = 20_000
SPANS = "array<struct<start: long, end: long>>"
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased; none of a null text."""
    return text.translate(_WORD).split() if text else []


def hashes_of(text: bytes | None) -> np.ndarray:
    """64-bit hashes of words_of."""
    return word_hashes(text.translate(_WORD)) if text else np.empty(0, np.uint64)


class WaveletMatrix:
    """Ranks of symbols in an integer sequence, level by level from the highest bit. planes: the bits of each level."""

    def __init__(self, planes: list[np.ndarray]):
        self.planes, self.bits = planes, len(planes)
        self.ones = [np.concatenate(([0], np.cumsum(p, dtype=np.int32))).astype(np.int32) for p in planes]
        self.zeros = [len(p) - int(o[-1]) for p, o in zip(planes, self.ones)]

    @staticmethod
    def of(seq: np.ndarray) -> WaveletMatrix:
        planes = []
        for b in range(max(1, int(seq.max(initial=0)).bit_length()) - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(bool)
            planes.append(bit)
            seq = np.concatenate((seq[~bit], seq[bit]))
        return WaveletMatrix(planes)

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        start, end = np.zeros_like(upto), upto
        for b, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            one = (symbol >> b) & 1 == 1
            s, e = ones[start], ones[end]
            start, end = np.where(one, zeros + s, start - s), np.where(one, zeros + e, end - e)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros):
            one = ones[at + 1] - ones[at]
            out = out << 1 | one
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; seq ends with its unique least symbol 0. As many symbols as fit are compared at first, and only suffixes that are still tied are sorted again."""
    n, bits = len(seq), max(1, int(seq.max(initial=0)).bit_length())
    k = max(1, min(8, 62 // bits))
    padded, key = np.concatenate((seq, np.zeros(k, np.int64))), np.zeros(n, np.int64)
    for i in range(k):
        key = key << bits | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    rank, place, compared = np.empty(n, np.int64), np.arange(n), key[order]
    while True:
        # place: where the tied suffixes stand; their new groups start where what was compared changes.
        first = np.concatenate(([True], compared[1:] != compared[:-1]))
        group = np.maximum.accumulate(np.where(first, place, 0))
        rank[order[place]] = group
        tied = ~(first & np.concatenate((first[1:], [True])))
        place, group = place[tied], group[tied]
        if not len(place):
            return order
        idx = order[place]
        compared = group * n + rank[idx + k]
        by = np.argsort(compared, kind="stable")
        order[place], compared = idx[by], compared[by]
        k *= 2


class FMIndex:
    """Symbols are positive; 0 is put at the end."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE):
        seq = np.append(seq.astype(np.int64), 0)
        sa = suffix_array(seq)
        sampled = sa % sample == 0
        self._hold(WaveletMatrix.of(seq[sa - 1]), np.bincount(seq, minlength=int(seq.max()) + 2), sampled, sa[sampled])

    def _hold(self, wavelet: WaveletMatrix, counts: np.ndarray, sampled: np.ndarray, positions: np.ndarray) -> None:
        self.n, self.wavelet, self.counts = len(sampled), wavelet, counts
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.sampled, self.positions = sampled, positions.astype(np.int64)
        self.sample_rank = np.concatenate(([0], np.cumsum(sampled)))

    def arrays(self) -> dict[str, np.ndarray]:
        """What the index consists of, bits packed."""
        planes = np.concatenate([np.packbits(p) for p in self.wavelet.planes])
        return {"planes": planes, "counts": self.counts.astype(np.uint32), "sampled": np.packbits(self.sampled), "positions": self.positions.astype(np.uint32), "size": np.array([self.n, self.wavelet.bits], np.int64)}

    @staticmethod
    def of_arrays(held: dict[str, np.ndarray]) -> FMIndex:
        n, bits = held["size"].tolist()
        planes = [np.unpackbits(p, count=n).astype(bool) for p in held["planes"].reshape(bits, -1)]
        index = FMIndex.__new__(FMIndex)
        index._hold(WaveletMatrix(planes), held["counts"].astype(np.int64), np.unpackbits(held["sampled"], count=n).astype(bool), held["positions"])
        return index

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of patterns (a row each, padded with 0 in front)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, column]
            known = (symbol > 0) & (symbol < len(self.first) - 2)  # first has max + 3 entries
            low[alive[(symbol > 0) & ~known]] = high[alive[(symbol > 0) & ~known]] = 0
            step, symbol = alive[known], symbol[known]
            low[step] = self.first[symbol] + self.wavelet.rank(symbol, low[step])
            high[step] = self.first[symbol] + self.wavelet.rank(symbol, high[step])
            alive = alive[high[alive] > low[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk backward to the nearest sampled suffix."""
        out, steps, todo = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            done = self.sampled[rows[todo]]
            out[todo[done]] = self.positions[self.sample_rank[rows[todo[done]]]] + steps
            todo = todo[~done]
            symbol = self.wavelet.access(rows[todo])
            rows[todo] = self.first[symbol] + self.wavelet.rank(symbol, rows[todo])
            steps += 1
        return out


@dataclass
class Windows:
    """Distinct windows of a block of benchmark items, as numbers 1, 2, ... of their words in a sorted vocabulary of hashes."""

    vocabulary: np.ndarray
    patterns: np.ndarray
    lengths: np.ndarray
    #: Items that hold a window: item_of[item_start[w] : item_start[w + 1]].
    item_start: np.ndarray
    item_of: np.ndarray
    items: list[str]

    @staticmethod
    def of(items: list[tuple[str, bytes | None]], width: int = WINDOW) -> Windows:
        names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(names)}
        split = [(number[name], hashes_of(text)) for name, text in items]
        split = [(k, h) for k, h in split if len(h)]
        vocabulary = np.unique(np.concatenate([h for _, h in split])) if split else np.empty(0, np.uint64)
        rows, owner = [np.empty((0, width), np.int32)], [np.empty(0, np.int64)]
        for k, h in split:
            at = (np.searchsorted(vocabulary, h) + 1).astype(np.int32)
            own = np.lib.stride_tricks.sliding_window_view(at, width) if len(at) >= width else np.concatenate((np.zeros(width - len(at), np.int32), at))[None]
            rows.append(own)
            owner.append(np.full(len(own), k))
        every, own = np.concatenate(rows), np.concatenate(owner)
        same = np.zeros(len(every), np.uint64)
        for column in every.T:
            same = (same ^ (same >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64)
        _, first, window = np.unique(same, return_index=True, return_inverse=True)
        if (every != every[first][window]).any():
            raise RuntimeError("two windows share a hash")
        pairs = np.unique(np.stack([window, own]), axis=1) if len(own) else np.empty((2, 0), np.int64)
        patterns = every[first]
        return Windows(vocabulary, patterns, (patterns > 0).sum(axis=1), np.searchsorted(pairs[0], np.arange(len(patterns) + 1)), pairs[1], names)

    def find(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """(n_words, merged spans, items) of each of a few texts, through an index of their own."""
        split = [hashes_of(t) for t in texts]
        parts = [(d, 0, h) for d, h in enumerate(split) if len(h)]
        found = ShardIndex.of(parts).find(self) if parts else {}
        return [(len(h), *found.get(d, ([], set()))) for d, h in enumerate(split)]


@dataclass
class ShardIndex:
    """The FM-index of a shard's words. Symbol 1 stands after every part of a document, word symbols follow the sorted vocabulary of hashes."""

    vocabulary: np.ndarray
    index: FMIndex
    #: Of each part: where it starts in the sequence, its document in the shard, and its first word in the document.
    starts: np.ndarray
    docs: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def of(parts: list[tuple[int, int, np.ndarray]]) -> ShardIndex:
        vocabulary, symbol = np.unique(np.concatenate([h for _, _, h in parts]), return_inverse=True)
        sizes = np.array([len(h) for _, _, h in parts], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        seq = np.ones(int(sizes.sum()) + len(parts), np.int64)
        inside = np.ones(len(seq), bool)
        inside[starts + sizes] = False
        seq[inside] = symbol.ravel() + 2
        return ShardIndex(vocabulary, FMIndex(seq), starts, np.array([d for d, _, _ in parts], np.int64), np.array([o for _, o, _ in parts], np.int64))

    def to_bytes(self) -> bytes:
        held = self.index.arrays() | {"vocabulary": self.vocabulary, "starts": self.starts, "docs": self.docs, "offsets": self.offsets}
        columns = {k: pa.array([v.tobytes()], pa.large_binary()) for k, v in held.items()}
        return ipc_bytes(pa.table(columns).replace_schema_metadata({k: v.dtype.str for k, v in held.items()}), 1)

    @staticmethod
    def from_bytes(data: bytes) -> ShardIndex:
        table = pa.ipc.open_stream(data).read_all()
        kinds = {k.decode(): v.decode() for k, v in table.schema.metadata.items()}
        held = {k: np.frombuffer(table.column(k)[0].as_py(), kinds[k]) for k in kinds}
        return ShardIndex(held["vocabulary"], FMIndex.of_arrays(held), held["starts"], held["docs"], held["offsets"])

    def occurrences(self, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, window) of every occurrence of a window."""
        at = np.minimum(np.searchsorted(self.vocabulary, windows.vocabulary), len(self.vocabulary) - 1)
        symbol = np.concatenate(([0], np.where(self.vocabulary[at] == windows.vocabulary, at + 2, -1)))
        patterns = symbol[windows.patterns]
        possible = np.flatnonzero((patterns >= 0).all(axis=1))
        low, high = self.index.search(patterns[possible])
        found = np.flatnonzero(high > low)
        times = (high - low)[found]
        rows = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[found], times)
        at = self.index.locate(rows)
        part = np.searchsorted(self.starts, at, "right") - 1
        return self.docs[part], at - self.starts[part] + self.offsets[part], np.repeat(possible[found], times)

    def find(self, windows: Windows) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """Merged spans of hit words and the items found, of each document with any."""
        doc, start, window = self.occurrences(windows)
        order = np.lexsort((start, doc))
        out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for d, b, e in zip(doc[order].tolist(), start[order].tolist(), (start + windows.lengths[window])[order].tolist()):
            spans = out.setdefault(d, ([], set()))[0]
            if spans and b <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
            else:
                spans.append((b, e))
        for d, w in np.unique(np.stack([doc, window]), axis=1).T.tolist():
            out[d][1].update(windows.items[i] for i in windows.item_of[windows.item_start[w] : windows.item_start[w + 1]])
        return out


def _parts(text: bytes, width: int, most: int) -> list[bytes]:
    """A text in parts of about `most` bytes that overlap, so that their windows together are the windows of the text."""
    if len(text) <= most:
        return [text]
    words = words_of(text)
    step = max(1, len(words) * most // len(text))
    return [b" ".join(words[k : k + step + width - 1]) for k in range(0, max(1, len(words) - width + 1), step)]


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block): the windows of the test items, about block_bytes of text in a row; made by tasks, none holds the benchmark.

    Null items and texts without a word have no window: nothing names what a null item would report. A longer item stands in several blocks.
    """
    rows = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("id"), text_bytes(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bytes]] = []
        size = 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in _parts(text, width, block_bytes):
                    if held and size + len(part) > block_bytes:
                        yield block(held)
                        held, size = [], 0
                    held.append((name, part))
                    size += len(part)
        if held:
            yield block(held)

    def block(items: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Windows.of(items, width))], pa.binary())], ["block"])

    return rows.repartition(max(1, -(-size // block_bytes)), "id", "text").sortWithinPartitions("id", "text").mapInArrow(run, "block binary")


def shard_indexes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(shard, docs, index), stored: for each shard a row with the (id, blob, n_words) of its documents, and rows with its indexes.

    docs is read once. blob is the SHA-256 of the text, null for a null text.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(shard: int, docs: bytes | None, index: bytes | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([docs], pa.binary()), pa.array([index], pa.binary())], ["shard", "docs", "index"])

        for key, rows in cut_slices(batches, SHARD_BYTES):
            sizes, parts, held = [], [], 0
            for d, text in enumerate(rows.column(2).to_pylist()):
                h = hashes_of(text)
                sizes.append(len(h))
                for at in range(0, max(1, len(h) - width + 1) if len(h) else 0, PART_WORDS - width + 1):
                    piece = h[at : at + PART_WORDS]
                    if parts and held + len(piece) > PART_WORDS:
                        yield row(key, None, ShardIndex.of(parts).to_bytes())
                        parts, held = [], 0
                    parts.append((d, at, piece))
                    held += len(piece)
            if parts:
                yield row(key, None, ShardIndex.of(parts).to_bytes())
            header = pa.Table.from_arrays([rows.column(0), rows.column(1), pa.array(sizes, pa.int64())], ["id", "blob", "n_words"])
            yield row(key, ipc_bytes(header), None)

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), _blob(text_col).alias("blob"), text_bytes(text_col).alias("text"))
    return stored(narrow.mapInArrow(run, "shard long, docs binary, index binary"))


def search_shards(indexes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(shard, doc, spans, items): what the windows of each block hit in each index, a row for each document with a hit.

    A stated set of phrases, in blocks, meets every index; Spark broadcasts the blocks only where its own size check allows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, index, block = (batch.column(c)[k].as_py() for c in range(3))
                found = ShardIndex.from_bytes(index).find(pickle.loads(block))
                docs = sorted(found)
                spans = [[{"start": b, "end": e} for b, e in found[d][0]] for d in docs]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(spans, _SPAN), pa.array([sorted(found[d][1]) for d in docs], pa.list_(pa.string()))], ["shard", "doc", "spans", "items"])

    pairs = indexes.filter("index IS NOT NULL").select("shard", "index").crossJoin(blocks)
    return pairs.mapInArrow(run, f"shard long, doc long, spans {SPANS}, items array<string>")


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def _finish(headers: pa.Table, hits: pa.Table) -> pa.Table:
    """Rows of a shard's documents with the spans and items of all blocks and indexes together."""
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    for r in hits.to_pylist():
        spans.setdefault(r["doc"], []).extend((s["start"], s["end"]) for s in r["spans"])
        items.setdefault(r["doc"], set()).update(r["items"])
    out = []
    for header in headers.column("docs").to_pylist():
        rows = pa.ipc.open_stream(header).read_all()
        every = [[{"start": b, "end": e} for b, e in merged(spans.get(d, ()))] for d in range(len(rows))]
        names = [sorted(items.get(d, ())) for d in range(len(rows))]
        out.append(pa.Table.from_arrays([*[rows.column(c).combine_chunks() for c in ("id", "blob", "n_words")], pa.array(every, _SPAN), pa.array(names, pa.list_(pa.string()))], ["id", "blob", "n_words", "spans", "items"]))
    return pa.concat_tables(out)


def _blob(text_col: str) -> Column:
    return F.sha2(text_bytes(text_col), 256)


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    indexes = shard_indexes(docs, id_col, text_col)
    hits = search_shards(indexes, stored(benchmark_blocks(benchmark, block_bytes=block_bytes)))
    headers = indexes.filter("docs IS NOT NULL").select("shard", "docs")
    found = headers.groupBy("shard").cogroup(hits.groupBy("shard")).applyInArrow(_finish, f"id long, blob string, n_words long, spans {SPANS}, items array<string>")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, items_sha256, spans, contaminated), a row for each row.

    spans are merged [start, end) word positions of removal. Null and empty texts have no words; an empty
    benchmark finds nothing. Items that share a window count each; repeated item ids count once. Words are equal
    where their 64-bit hashes are. Texts of more than PART_WORDS words are indexed in parts that overlap, so no window is lost.
    """
    found = _found(docs, benchmark, id_col, text_col, block_bytes)
    return found.select("id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "spans", "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the contaminated ones, all columns as they are. Equal texts are judged alike, so what goes is named by the hash of its text."""
    (blob,) = fresh_names(docs, 1)
    gone = stored(_found(docs, benchmark, id_col, text_col, block_bytes).filter("contaminated").select(F.col("blob").alias(blob)).distinct())
    small = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(small, _blob(text_col) == F.col(blob), "left_anti")
