"""Hierarchical packing of token sequences into windows of several context sizes, without padding.

Every document is cut into whole longest windows and a rest, and the rest is routed to the shortest context size
(tier) that holds it. Tiers are packed from the longest down: a rest opens a window of its tier, and the gap is
filled from shorter tiers, first with the longest rest that fits whole, then, if none does, with a cut of the shortest one
that is longer. What is cut off is routed anew. Windows of each tier are then dealt evenly to training steps.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyaccord.lineage import stored
from skyaccord.llm.common import SLICE_ROWS, text_bytes

VOCABULARY = "word_bpe_49k.json"
#: Context sizes, powers of two; and the tokens of a training step.
TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 1 << 17
#: The id that ends a document, and the bytes of an id.
END, WIDTH = 1, 4
#: Documents and token bytes that are packed together; what does not fill a shortest window is carried to the next pack of the task.
PACK_ROWS, PACK_BYTES = 4096, 16_000_000
#: Words and stretches of them that a Python worker remembers; only time and memory depend on it.
WORDS_KEPT, PARTS_KEPT = 1_200_000, 1_000_000
PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, nth long, part long"

# Latin letters that stay letters in lower case, and ASCII marks and digits without ' and < (these open contractions and special tokens).
_SIMPLE = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-įı-ɏ]+|[!-&(-;=-@\[-`{-~]+)+")
_PART = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ɏ]+|[!-&(-;=-@\[-`{-~]+")
_LETTERS = re.compile(r"[a-zÀ-ÖØ-öø-įı-ɏ]+")
# The printable letter that stands for each byte in a byte-level vocabulary: its own, or one from 256 on in order.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _OWN)}


class WordIds:
    """Token ids of texts through their words: white space and the borders of letters and ASCII marks always part tokens, so each distinct stretch is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Ids are remembered in 16 bits where they fit.
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {b"": b""}

    def _encode(self, parts: list[bytes]) -> None:
        """Lower-case letters go straight to the model, in the byte letters of its vocabulary, as normalising and parting would leave them as they are."""
        rest, tokenize, code, known = [], self.tokenizer.model.tokenize, self.code, self.parts
        for part in parts:
            if part.isalpha():
                text = part.decode()
            elif _LETTERS.fullmatch(text := part.decode()):
                text = text.lower().encode().decode("latin-1").translate(_BYTE_LETTERS)
            else:
                rest.append(part)
                continue
            known[part] = array(code, [t.id for t in tokenize(text)]).tobytes()
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for part, got in zip(some, self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)):
                known[part] = array(code, got.ids).tobytes()

    def _learn(self, unknown: Iterable[bytes]) -> None:
        if len(self.parts) > PARTS_KEPT:
            self.parts = {b"": b""}
        words, known, new = self.words, self.parts, set()
        plain: list[tuple[bytes, bytes, bytes]] = []
        mixed: list[tuple[bytes, list[bytes]]] = []
        for w in unknown:
            low = w.lower()  # ASCII letters only
            core = low.rstrip(b".,;:!?")
            if core.isalpha():
                tail = low[len(core) :]
                if core in known and tail in known:
                    words[w] = known[core] + known[tail]
                    continue
                new.update((core, tail))
                plain.append((w, core, tail))
            else:
                text = low.decode()
                parts = [p.encode() for p in _PART.findall(text)] if _SIMPLE.fullmatch(text) else [w]
                new.update(parts)
                mixed.append((w, parts))
        self._encode([p for p in new if p not in known])
        for w, core, tail in plain:
            words[w] = known[core] + known[tail]
        for w, parts in mixed:
            words[w] = b"".join([known[p] for p in parts])

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text, 32 bits little-endian each, with the id that ends it."""
        # Words are parted at ASCII white space. Upper-case ASCII letters are made lower unless a mark that composes with them may follow.
        every = [(t if b"\xcc" in t or b"\xcd" in t else t.lower()).split() for t in (t or b"" for t in texts)]
        distinct = set(chain.from_iterable(every))
        if len(self.words) > WORDS_KEPT:
            self.words = {}
        self._learn(distinct.difference(self.words))
        ids, last = self.words.__getitem__, array(self.code, [END]).tobytes()
        kind = np.uint16 if self.code == "H" else np.uint32
        return [np.frombuffer(b"".join([*map(ids, w), last]), kind).astype("<u4").tobytes() for w in every]


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One encoder for each file in a Python worker."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


class Pool:
    """Rests by length; a bitmap of the lengths in stock finds the nearest one on either side."""

    def __init__(self, longest: int):
        self.by_length: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
        self.bits = 0
        self.total = 0

    def put(self, length: int, doc: int, start: int) -> None:
        self.by_length[length].append((doc, start))
        self.bits |= 1 << length
        self.total += length

    def take(self, length: int) -> tuple[int, int]:
        stock = self.by_length[length]
        got = stock.pop()
        if not stock:
            self.bits &= ~(1 << length)
        self.total -= length
        return got

    def at_most(self, length: int) -> int:
        """The longest rest of at most this length; 0 if there is none."""
        return max(0, (self.bits & ((2 << length) - 1)).bit_length() - 1)

    def over(self, low: int, high: int) -> int:
        """The shortest rest longer than low and at most high; 0 if there is none."""
        bits = (self.bits & ((2 << high) - 1)) >> (low + 1)
        return low + 1 + (bits & -bits).bit_length() - 1 if bits else 0


def pack_rests(rests: Iterable[tuple[int, int, int]], tiers: Sequence[int] = TIERS) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """(windows, left over) of rests (length, doc, start), each at most as long as the longest tier.

    A window is its tier and its pieces (doc, start, length), which fill it exactly. What is left over is shorter than the
    shortest tier in all, and comes as rests.
    """
    pool, windows = Pool(tiers[-1]), []
    for length, doc, start in rests:
        pool.put(length, doc, start)
    for k in range(len(tiers) - 1, -1, -1):
        tier, below = tiers[k], tiers[k - 1] if k else 0
        while own := pool.over(below, tier):
            if pool.total < tier:
                if not k:
                    break
                # Too little is left to fill this window: half of it is a window of the next tier.
                doc, start = pool.take(own)
                windows.append((below, [(doc, start, below)]))
                pool.put(own - below, doc, start + below)
                continue
            own = pool.at_most(tier)
            doc, start = pool.take(own)
            window, gap = [(doc, start, own)], tier - own
            while gap:
                if fits := pool.at_most(gap):
                    doc, start = pool.take(fits)
                    window.append((doc, start, fits))
                    gap -= fits
                    continue
                longer = pool.over(gap, tier)
                doc, start = pool.take(longer)
                window.append((doc, start, gap))
                pool.put(longer - gap, doc, start + gap)
                gap = 0
            windows.append((tier, window))
    left = [(n, doc, start) for n, stock in enumerate(pool.by_length) for doc, start in stock]
    return windows, left


def last_windows(rests: Iterable[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows of falling powers of two that hold what a task has left, so that none of it is padded."""
    todo = list(rests)
    total = sum(n for n, _, _ in todo)
    out = []
    for bit in range(total.bit_length() - 1, -1, -1):
        if not total >> bit & 1:
            continue
        window, gap = [], 1 << bit
        while gap:
            n, doc, start = todo.pop()
            used = min(n, gap)
            window.append((doc, start, used))
            gap -= used
            if used < n:
                todo.append((n - used, doc, start + used))
        out.append((1 << bit, window))
    return out


class Packer:
    """The windows of one task: numbers of windows and the rows of their pieces."""

    def __init__(self, part: int, tiers: Sequence[int], with_ids: bool):
        self.part, self.tiers, self.with_ids = part, tuple(tiers), with_ids
        self.windows = 0
        self.of_tier: dict[int, int] = {}
        self.docs: dict[int, tuple[int | None, bytes]] = {}  # number -> (id, token bytes)
        self.rests: list[tuple[int, int, int]] = []
        self.seen = self.held = 0
        self.rows: list[tuple] = []

    def _emit(self, tier: int, pieces: list[tuple[int, int, int]]) -> None:
        nth, offset = self.of_tier.get(tier, 0), 0
        for doc, start, length in pieces:
            name, ids = self.docs[doc]
            part = ids[start * WIDTH : (start + length) * WIDTH]
            row = (name, start, length, zlib.crc32(part), len(ids) // WIDTH, self.part << 32 | self.windows, offset, tier, nth, self.part)
            self.rows.append((*row, memoryview(part).cast("I").tolist()) if self.with_ids else row)
            offset += length
        self.windows += 1
        self.of_tier[tier] = nth + 1

    def add(self, name: int | None, ids: bytes) -> None:
        doc, n, longest = self.seen, len(ids) // WIDTH, self.tiers[-1]
        self.seen += 1
        self.docs[doc] = (name, ids)
        at = 0
        while n - at >= longest:
            self._emit(longest, [(doc, at, longest)])
            at += longest
        if at < n:
            self.rests.append((n - at, doc, at))
            self.held += len(ids)
        else:
            del self.docs[doc]

    def full(self) -> bool:
        return len(self.rests) >= PACK_ROWS or self.held >= PACK_BYTES

    def pack(self, last: bool = False) -> None:
        windows, self.rests = pack_rests(self.rests, self.tiers)
        for tier, pieces in windows:
            self._emit(tier, pieces)
        if last:
            for tier, pieces in last_windows(self.rests):
                self._emit(tier, pieces)
            self.rests = []
        self.docs = {doc: self.docs[doc] for _, doc, _ in self.rests}
        self.held = sum(len(ids) for _, ids in self.docs.values())

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def pack_tiers(docs: DataFrame, vocabulary: str, tiers: Sequence[int] = TIERS, step_tokens: int = STEP_TOKENS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step), a row for each piece; ids too if wanted.

    vocabulary: the path of a tokenizer file, or a name that the installed public tokenizers know. A document is its
    ids and one that ends it. Every id lies in exactly one piece. tier is the length of the piece's sequence, which its
    pieces fill without a gap: one of `tiers` (rising powers of two), or for the last few sequences of a task a smaller
    power of two, so nothing is padded. step numbers training steps of about step_tokens: each gets its even share of
    the sequences of every tier, so steps agree in tokens and in work to about one sequence of each tier.

    A null or empty text has only the ending id. Null ids stay null, repeated rows are packed as often as they occur, an
    empty table gives an empty result. Texts are tokenised once where they lie, and packed with what the same task read
    (at most PACK_ROWS documents or PACK_BYTES of ids at a time); no text or id is shuffled. A very long text costs its
    task memory for the text and its ids.
    """
    if any(t & (t - 1) or (k and t != 2 * tiers[k - 1]) for k, t in enumerate(tiers)):
        raise ValueError("context sizes must be powers of two, each twice the one before")
    wide = [("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int64()), ("nth", pa.int64()), ("part", pa.int64())]
    schema = pa.schema(wide + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, words = Packer(TaskContext.get().partitionId(), tiers, with_ids), encoder(_found(vocabulary))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for name, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist())):
                    packer.add(name, ids)
                    if packer.full():
                        packer.pack()
                if packer.rows:
                    yield packer.batch(schema)
        packer.pack(last=True)
        if packer.rows:
            yield packer.batch(schema)

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_bytes(text_col).alias("text"))
    pieces = stored(narrow.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else "")))
    counts = stored(pieces.groupBy("part", "tier").agg((F.max("nth") + 1).alias("n"), F.sum("length").alias("tokens")))  # a row for each task and tier
    tokens = counts.agg(F.sum("tokens")).first()[0] or 0
    steps = max(1, -(-tokens // step_tokens))
    before = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "tier", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"), F.sum("n").over(Window.partitionBy("tier")).alias("__all"))
    step = F.expr(f"((__base + nth) * {steps}L) DIV __all")
    own = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier"]
    return pieces.join(bases, ["part", "tier"]).select(*own, step.alias("step"), *(["ids"] if with_ids else []))


def _found(vocabulary: str) -> str:
    if os.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)
