"""What the corpus operators share: Arrow mapping, slices of documents, names and column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyaccord.lineage import stored

#: Rows that a Python worker holds as objects at a time; only memory depends on it.
SLICE_ROWS = 256
#: A key of more than one in HOT_SHARE rows, and of more than HOT_ROWS, is joined apart.
HOT_SHARE, HOT_ROWS = 10_000, 1_000
#: Text bytes of a slice of documents; a longer text is a slice of its own.
SLICE_BYTES = 32_000_000


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], schema: str) -> DataFrame:
    """mapInArrow over slices of at most SLICE_ROWS rows; fn returns the output columns in order of the schema."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield pa.RecordBatch.from_pydict(fn(batch.slice(at, SLICE_ROWS)))

    return df.mapInArrow(run, schema)


def fresh_names(df: DataFrame, n: int) -> list[str]:
    """Names that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    free = (name for k in range(len(taken) + n) if (name := f"__own_{k}") not in taken)
    return [next(free) for _ in range(n)]


def text_bytes(name: str) -> Column:
    """A text column as its UTF-8 bytes; null stays null."""
    return F.col(f"`{name}`").cast("binary")


def id_crc32(name: str) -> Column:
    """crc32 of an id as text; a null id counts as the empty text (0)."""
    return F.crc32(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).cast("binary"))


def cut_slices(batches: Iterable[pa.RecordBatch], slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Table]]:
    """(key, rows) of slices of about slice_bytes of text; column 2 is the text.

    The key follows from the task, the place in it and the content, so reading the same table again gives the same keys.
    """
    task, held, size, place = TaskContext.get().partitionId(), [], 0, 0

    def cut() -> tuple[int, pa.Table]:
        rows = pa.Table.from_batches(held)
        content = xxhash.xxh64(f"{task}:{place}:")
        for text in rows.column(2).to_pylist():
            content.update(f"{-1 if text is None else len(text)}:".encode())
            content.update(text or b"")
        return int(np.uint64(content.intdigest()).view(np.int64)), rows

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            held.append(part)
            size += sum(len(t) for t in part.column(2).to_pylist() if t)
            if size >= slice_bytes:
                yield cut()
                held, size, place = [], 0, place + 1
    if held:
        yield cut()


def packed(values: np.ndarray) -> bytes:
    """Compressed byte by byte: equal bytes of sorted or small numbers lie together."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def ipc_bytes(rows: pa.Table, level: int = 6) -> bytes:
    """A table as one compressed value; pa.ipc.open_stream reads it."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


#: Text bytes that are split into words at a time; bytes of a word from which on it is hashed by itself.
PIECE, LONG_WORD = 1 << 20, 128
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BREAK = re.compile(rb"[\x20\x09-\x0D]")
_BYTE_HASH = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = 0xD6E8FEB86659FD93
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2^64, at least n of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base, np.uint64))))
    return _powers[0], _powers[1]


def _piece_hashes(piece: bytes) -> np.ndarray:
    b = np.frombuffer(piece, np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[b], [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _powers_to(len(b) + 1)
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_HASH[b] * power[: len(b)])))
    h = (upto[end] - upto[start]) * inverse[start]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    # Long words can be built whose polynomials agree modulo 2^64 for every step: they have a hash without that structure.
    for k in np.flatnonzero(end - start >= LONG_WORD):
        h[k] = xxhash.xxh64_intdigest(piece[start[k] : end[k]], 42)
    return h


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word `[^\\x20\\x09-\\x0D]+` of a text, all at once: differences of a running polynomial over the bytes, and XXH64 for long words."""
    parts, at = [], 0
    while at < len(text):
        cut = _BREAK.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        parts.append(_piece_hashes(text[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def join_counted(rows: DataFrame, group: DataFrame, key: str) -> DataFrame:
    """rows with the values of their key's row in group, whose column n counts the rows of the key. Both are read twice.

    Keys of more than one in HOT_SHARE rows are at most HOT_SHARE: their values are broadcast, and no task gets all their rows.
    """
    group = stored(group)
    total = group.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") > max(total // HOT_SHARE, HOT_ROWS)
    hot = stored(group.filter(is_hot).drop("n"))
    rest = rows.join(group.filter(~is_hot).drop("n"), key)
    if not hot.limit(1).count():
        return rest
    return rest.unionByName(rows.join(F.broadcast(hot), key))
