"""Masked pseudo-likelihood with a bidirectional window network and a memory of the corpus.

Tokens are words, hashed to VOCABULARY numbers. A small network predicts each word from the two before and the
two after it. It is trained in numpy where the documents lie, each task on its own windows, and parameters are
averaged between rounds. What is gathered from the corpus grows with it: every window (four context words and the
word between them) of every document, dealt out by context as sorted hash arrays, so that all windows of a context
lie in one block. A word's probability mixes the network's with the share that the word has of its context in all
other documents; a document's score is the sum of the log probabilities of its words, each given both sides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyaccord.llm.common import cut_slices, ipc_bytes, packed, text_bytes, unpacked, word_hashes

SIDE, EMBED, HIDDEN = 2, 8, 16
WORD_BITS = 12
VOCABULARY = 1 << WORD_BITS
#: A word's number is read as two digits: its class and its place in the class.
DIGIT = 1 << WORD_BITS // 2
SHAPES = {"embed": (2 * SIDE, VOCABULARY, EMBED), "w1": (2 * SIDE * EMBED, HIDDEN), "b1": (HIDDEN,), "wc": (HIDDEN, DIGIT), "bc": (DIGIT,), "wm": (DIGIT, HIDDEN, DIGIT), "bm": (DIGIT, DIGIT)}
#: Windows that are evaluated at a time.
BATCH = 4096
#: Text bytes for each block of contexts and for each training task; both follow the corpus, whatever its partitions.
BLOCK_BYTES = 32_000_000
#: Parts of the corpus; a training round goes over one of them.
ROUNDS = 3
_CONTEXT_BITS = 2 * SIDE * WORD_BITS
_MASK = np.uint64((1 << _CONTEXT_BITS) - 1)
#: Odd, so multiplying by it modulo 2^48 is a shuffle of all contexts; with its inverse.
_SPREAD = 0x9E3779B97F4B
_GATHER = pow(_SPREAD, -1, 1 << _CONTEXT_BITS)


def word_numbers(text: bytes) -> np.ndarray:
    """The number 1 to VOCABULARY - 1 of each word `[^\\x20\\x09-\\x0D]+` of a text, by a hash of its bytes."""
    return (1 + (word_hashes(text) >> np.uint64(33)) % np.uint64(VOCABULARY - 1)).astype(np.uint16)


def windows(words: np.ndarray) -> np.ndarray:
    """The code of each word's window: the shuffled context (0 beyond either end) over the word."""
    a = np.concatenate((np.zeros(SIDE, np.uint64), words.astype(np.uint64), np.zeros(SIDE, np.uint64)))
    n, context = len(words), np.zeros(len(words), np.uint64)
    for k in (*range(SIDE), *range(SIDE + 1, 2 * SIDE + 1)):
        context = context << np.uint64(WORD_BITS) | a[k : k + n]
    return (context * np.uint64(_SPREAD) & _MASK) << np.uint64(WORD_BITS) | words.astype(np.uint64)


def split_codes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The four context words (a row for each place) and the word of each code."""
    context = (codes >> np.uint64(WORD_BITS)) * np.uint64(_GATHER) & _MASK
    places = np.stack([(context >> np.uint64(WORD_BITS * (2 * SIDE - 1 - k))) & np.uint64(VOCABULARY - 1) for k in range(2 * SIDE)])
    return places.astype(np.int64), (codes & np.uint64(VOCABULARY - 1)).astype(np.int64)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.lit(None).cast("string").alias("lang"), text_bytes(text_col).alias("text"))


def _pieces(docs: DataFrame, text_col: str) -> int:
    """One for each BLOCK_BYTES of text, at least 1."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    return max(1, -(-total // BLOCK_BYTES))


def gather_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """(block, slice, codes, docs, n, ids), dealt out by block.

    A row holds the windows of a slice of documents that belong to a block: sorted codes, the documents in the
    slice, and how often each has the window. One more row for each slice holds the ids of its documents and
    their numbers of words. Without `blocks` there is one for each BLOCK_BYTES of text.
    """
    blocks = blocks or _pieces(docs, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in cut_slices(batches):
            codes, sizes = [], []
            for text in rows.column(2).to_pylist():
                words = word_numbers(text or b"")
                sizes.append(len(words))
                codes.append(windows(words))
            every, doc = np.concatenate(codes), np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
            codes.clear()
            order = np.argsort(every, kind="stable")
            every, doc = every[order], doc[order]
            new = np.flatnonzero(np.concatenate(([True], (every[1:] != every[:-1]) | (doc[1:] != doc[:-1])))) if len(every) else np.empty(0, np.int64)
            n = np.diff(np.append(new, len(every))).astype(np.uint32)
            every, doc = every[new], doc[new]
            cuts = np.searchsorted(every >> np.uint64(WORD_BITS), _block_starts(blocks))
            ids = pa.Table.from_arrays([rows.column(0).combine_chunks(), pa.array(sizes, pa.int64())], ["id", "n_tokens"])
            yield _window_rows([(key % blocks, key, None, None, None, ipc_bytes(ids))])
            for b, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], len(every)])):
                if hi > lo:
                    yield _window_rows([(b, key, packed(np.diff(every[lo:hi], prepend=np.uint64(0))), packed(doc[lo:hi]), packed(n[lo:hi]), None)])

    dealt = _narrow(docs, id_col, text_col).mapInArrow(run, "block int, slice long, codes binary, docs binary, n binary, ids binary")
    return dealt.repartition(blocks, "block").sortWithinPartitions("block", "slice")


def _block_starts(blocks: int) -> np.ndarray:
    """The least shuffled context of each block; blocks are equal ranges of contexts."""
    return np.array([-(-(b << _CONTEXT_BITS) // blocks) for b in range(blocks)], np.uint64)


def _window_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["block", "slice", "codes", "docs", "n", "ids"])


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    rows = (r for b in batches for r in b.to_pylist())
    for _, group in groupby(rows, key=lambda r: r["block"]):
        yield list(group)


def _merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct codes of a block with their counts over all documents, and the codes of each row."""
    parts = [np.cumsum(unpacked(r["codes"], np.uint64)) for r in rows]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), parts
    n = np.concatenate([unpacked(r["n"], np.uint32) for r in rows])
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    every, upto = every[order], np.concatenate(([0], np.cumsum(n[order], dtype=np.int64)))
    new = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[new], np.diff(upto[np.append(new, len(every))]), parts


class WindowNetwork:
    """Embeddings of four places, one hidden layer, a softmax over classes and one over the places in a class."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {k: (rng.normal(0, 1 / np.sqrt(s[-2]), s) if k in ("w1", "wc", "wm") else rng.normal(0, 0.3, s) if k == "embed" else np.zeros(s)).astype(np.float32) for k, s in SHAPES.items()}

    def start_from(self, counts: np.ndarray) -> None:
        """Begin with the shares of the words, whatever the context."""
        share = np.log(counts.reshape(DIGIT, DIGIT) + 0.1)
        total = np.log(np.exp(share).sum(axis=1))
        self.p["bm"], self.p["bc"] = (share - total[:, None]).astype(np.float32), (total - np.log(np.exp(total).sum())).astype(np.float32)
        for k in ("wc", "wm"):
            self.p[k] *= 0.1

    def _forward(self, places: np.ndarray, word: np.ndarray) -> tuple:
        """word must be sorted by class. The exponentials of both softmaxes, their sums, and the log probabilities."""
        flat = (places + np.arange(2 * SIDE)[:, None] * VOCABULARY).T.ravel()
        x = self.p["embed"].reshape(-1, EMBED).take(flat, axis=0).reshape(len(word), -1)
        h = np.tanh(x @ self.p["w1"] + self.p["b1"])
        kind, place = word // DIGIT, word % DIGIT
        zc = h @ self.p["wc"] + self.p["bc"]
        zm = self.p["bm"].take(kind, axis=0)
        cuts = np.searchsorted(kind, np.arange(DIGIT + 1))
        for c in np.unique(kind):
            zm[cuts[c] : cuts[c + 1]] += h[cuts[c] : cuts[c + 1]] @ self.p["wm"][c]
        at, out = np.arange(len(word)), []
        for z, digit, safe in zip((zc, zm), (kind, place), self.safe):
            if not safe:
                z -= z.max(axis=1, keepdims=True)
            log = z[at, digit]
            e = np.exp(z, out=z)
            total = e @ np.ones((DIGIT, 1), e.dtype)
            out.append((e, total, log - np.log(total[:, 0])))
        return x, h, kind, place, cuts, out

    @property
    def safe(self) -> tuple[bool, bool]:
        """Whether no logit of a softmax can overflow its exponential, as no hidden value lies beyond 1."""
        return tuple(bool((np.abs(self.p[w]).sum(axis=-2) + np.abs(self.p[b])).max() < 80) for w, b in (("wc", "bc"), ("wm", "bm")))

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of the word of each window, given its context."""
        result = np.empty(len(codes), np.float32)
        for at in range(0, len(codes), BATCH):
            places, word = split_codes(codes[at : at + BATCH])
            order = np.argsort(word, kind="stable")
            *_, ((_, _, a), (_, _, b)) = self._forward(places[:, order], word[order])
            result[at + order] = a + b
        return result

    def gradient(self, codes: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the weighted sum of negative log likelihoods, and that sum."""
        places, word = split_codes(codes)
        order = np.argsort(word, kind="stable")
        places, word, weight = places[:, order], word[order], weight[order].astype(self.p["w1"].dtype)[:, None]
        x, h, kind, place, cuts, ((dc, tc, lc), (dm, tm, lm)) = self._forward(places, word)
        at = np.arange(len(word))
        dc *= weight / tc
        dm *= weight / tm
        dc[at, kind] -= weight[:, 0]
        dm[at, place] -= weight[:, 0]
        dh = dc @ self.p["wc"].T
        g = {"wc": h.T @ dc, "bc": dc.sum(axis=0), "wm": np.zeros(SHAPES["wm"], h.dtype), "bm": np.zeros(SHAPES["bm"], h.dtype)}
        for c in np.unique(kind):
            part = slice(cuts[c], cuts[c + 1])
            g["wm"][c] = h[part].T @ dm[part]
            g["bm"][c] = dm[part].sum(axis=0)
            dh[part] += dm[part] @ self.p["wm"][c].T
        dh *= 1 - h * h
        g["w1"], g["b1"] = x.T @ dh, dh.sum(axis=0)
        dx = dh @ self.p["w1"].T
        g["embed"] = np.empty(SHAPES["embed"], h.dtype)
        for k in range(2 * SIDE):
            slot = (places[k][:, None] * EMBED + np.arange(EMBED)).ravel()
            g["embed"][k] = np.bincount(slot, dx[:, k * EMBED : (k + 1) * EMBED].ravel(), VOCABULARY * EMBED).reshape(VOCABULARY, EMBED)
        return g, float(-(weight[:, 0] * (lc + lm)).sum(dtype=np.float64))

    def descend(self, codes: np.ndarray, n: np.ndarray, pace: dict[str, np.ndarray], rate: float) -> None:
        """Steps over windows that occur n times, in batches; pace holds the mean squared gradient of each row of parameters so far."""
        for b in range(0, len(codes), BATCH):
            weight = n[b : b + BATCH]
            g, _ = self.gradient(codes[b : b + BATCH], weight / weight.sum())
            for k, v in g.items():
                pace[k] += np.square(v).mean(axis=-1, keepdims=True)
                self.p[k] -= v * (np.float32(rate) / np.sqrt(pace[k]))


def _flat(named: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([named[k].ravel() for k in SHAPES]).astype(np.float32)


def _named(flat: np.ndarray, shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    ends = np.cumsum([int(np.prod(s)) for s in shapes.values()])
    return {k: part.reshape(s).astype(np.float32) for (k, s), part in zip(shapes.items(), np.split(flat, ends[:-1]))}


#: One value for each row of parameters.
PACES = {k: (*s[:-1], 1) for k, s in SHAPES.items()}


def _summed(parts: DataFrame, n: int) -> np.ndarray | None:
    """The sum of the vectors of at most n tasks, in a tree: no task adds more than 32, at most 32 reach the driver."""

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("flat").to_pylist()))
        total = np.sum([np.frombuffer(f, np.float32) for _, f in rows], axis=0, dtype=np.float32)
        return pa.table({"part": pa.array([rows[0][0] % width], pa.int64()), "flat": pa.array([total.tobytes()], pa.binary())})

    while True:
        width = n = -(-n // 32)
        parts = parts.groupBy((F.col("part") % n).alias("g")).applyInArrow(add, "part long, flat binary")
        if n <= 32:
            break
    rows = sorted((r.part, bytes(r.flat)) for r in parts.collect())
    return np.sum([np.frombuffer(f, np.float32) for _, f in rows], axis=0, dtype=np.float64) if rows else None


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passes: int = 1, rate: float = 0.2) -> WindowNetwork:
    """Fits the network on the windows of all documents.

    A hash of the text deals documents out to ROUNDS parts. In a round every task goes over the windows of its
    documents of one part, from the common parameters, with steps scaled by the squared gradients so far; then the
    tasks' parameters are averaged by how many words they saw. Without a word the network stays as it began.
    """
    narrow, tasks = _narrow(docs, id_col, text_col), _pieces(docs, text_col)

    def unigrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY)
        for batch in batches:
            for text in batch.column(2).to_pylist():
                total += np.bincount(word_numbers(text or b""), minlength=VOCABULARY)
        yield _flat_row(total)

    net = WindowNetwork()
    counts = _summed(narrow.coalesce(tasks).mapInArrow(unigrams, "part long, flat binary"), tasks)
    if counts is None or not counts.sum():
        return net
    net.start_from(counts)
    pace = {k: np.full(s, 1e-6, np.float32) for k, s in PACES.items()}
    for step in range(passes * ROUNDS):
        held, speed = net.p, pace

        def run(batches: Iterable[pa.RecordBatch], held=held, speed=speed) -> Iterator[pa.RecordBatch]:
            local, own, seen = WindowNetwork(), {k: v.copy() for k, v in speed.items()}, 0
            local.p = {k: v.copy() for k, v in held.items()}
            for _, rows in cut_slices(batches):
                codes = [windows(word_numbers(t)) for t in rows.column(2).to_pylist() if t]
                if codes:
                    every, n = np.unique(np.concatenate(codes), return_counts=True)
                    codes.clear()
                    local.descend(every, n, own, rate)
                    seen += int(n.sum())
            if seen:
                yield _flat_row(np.concatenate([_flat(local.p) * np.float32(seen), _flat(own) * np.float32(seen), np.array([seen], np.float32)]))

        part = narrow.filter(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == step % ROUNDS).coalesce(tasks)
        total = _summed(part.mapInArrow(run, "part long, flat binary"), tasks)
        if total is not None:
            size = sum(int(np.prod(s)) for s in SHAPES.values())
            net.p, pace = _named(total[:size] / total[-1], SHAPES), _named(total[size:-1] / total[-1], PACES)
    return net


def _flat_row(flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "flat": pa.array([flat.astype(np.float32).tobytes()], pa.binary())})


def _own_contexts(codes: np.ndarray, docs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often each row's document has the row's context."""
    context = codes >> np.uint64(WORD_BITS)
    run = np.cumsum(np.concatenate(([0], context[1:] != context[:-1]))).astype(np.int64) if len(codes) else np.empty(0, np.int64)
    _, where = np.unique(run << 32 | docs.astype(np.int64), return_inverse=True)
    return np.bincount(where, n)[where].astype(np.int64) if len(codes) else run


def mixed(p_net: np.ndarray, n: np.ndarray, context: np.ndarray, trust: float) -> np.ndarray:
    """(trust x network + n) / (trust + context): n of the `context` times that the context stands elsewhere it holds the word."""
    return (trust * p_net + n) / (trust + context)


def score(gathered: DataFrame, net: WindowNetwork, trust: float = 1.0) -> DataFrame:
    """(id, n_tokens, pseudo_log_likelihood, mean_log_prob), a row for each gathered document.

    Null and wordless texts have 0 tokens, a sum of 0 and a null mean. A document's own windows do not count as
    memory, those of its copies do: a text that stands twice scores higher than one that stands once. Repeated
    ids keep a row each.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_block(batches):
            some = [r for r in rows if r["codes"] is not None]
            codes, total, parts = _merged(some)
            p_net = np.exp(net.log_probs(codes).astype(np.float64))
            context = codes >> np.uint64(WORD_BITS)
            new = np.concatenate(([True], context[1:] != context[:-1])) if len(codes) else np.empty(0, bool)
            run_of = np.cumsum(new) - 1
            in_context = np.bincount(run_of, total)[run_of].astype(np.int64) if len(codes) else total
            for r, part in zip(some, parts):
                at = np.searchsorted(codes, part)
                docs, n = unpacked(r["docs"], np.uint32), unpacked(r["n"], np.uint32).astype(np.int64)
                rest = in_context[at] - _own_contexts(part, docs, n)
                logs = n * np.log(mixed(p_net[at], total[at] - n, rest, trust))
                seen, where = np.unique(docs, return_inverse=True)
                yield _sum_row(r["slice"], packed(seen), packed(np.bincount(where, logs)), None)
            for r in rows:
                if r["ids"] is not None:
                    yield _sum_row(r["slice"], None, None, r["ids"])

    def finish(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        ids = [pa.ipc.open_stream(r["ids"]).read_all() for r in rows if r["ids"] is not None]
        if len(ids) != 1:
            raise RuntimeError("two slices have one key")
        sizes = ids[0].column("n_tokens").to_numpy()
        sums = np.zeros(len(sizes))
        for r in sorted((r for r in rows if r["docs"] is not None), key=lambda r: r["block"]):
            sums[unpacked(r["docs"], np.uint32)] += unpacked(r["sums"], np.float64)
        mean = [s / k if k else None for s, k in zip(sums.tolist(), sizes.tolist())]
        return pa.table({"id": ids[0].column("id"), "n_tokens": pa.array(sizes, pa.int64()), "pseudo_log_likelihood": pa.array(sums, pa.float64()), "mean_log_prob": pa.array(mean, pa.float64())})

    sums = gathered.mapInArrow(run, "slice long, block int, docs binary, sums binary, ids binary")
    return sums.groupBy("slice").applyInArrow(finish, "id long, n_tokens long, pseudo_log_likelihood double, mean_log_prob double")


def _sum_row(key: int, docs: bytes | None, sums: bytes | None, ids: bytes | None) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_pydict({"slice": pa.array([key], pa.int64()), "block": pa.array([part], pa.int32()), "docs": pa.array([docs], pa.binary()), "sums": pa.array([sums], pa.binary()), "ids": pa.array([ids], pa.binary())})
