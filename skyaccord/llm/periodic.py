"""Periodic runs of words in every text, and texts with the repeats of each run taken out.

The first phase of a suffix sorter by groups (Baier) is run over the words of the stretches that can hold a run,
once under an order of the words and once under its reverse. It leaves each suffix in the group of its longest
Lyndon prefix, so the groups' context lengths are the Lyndon array. Every run has a period that is a Lyndon word
in one of the two orders; each such root is extended to both sides by longest common extensions.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyaccord.llm.common import SLICE_ROWS, text_bytes

RUNS = "array<struct<start: long, length: long, period: long>>"
SCHEMA = f"id long, n_words long, runs {RUNS}, collapsed string"
#: Text bytes of the documents that are worked on together.
BATCH_BYTES = 4_000_000


def lyndon_lengths(ranks: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place, words ordered by rank; rank 0 separates sequences and comes first and last.

    Groups are taken from the highest down. When a group is taken its suffixes are final: each leaves the list of open
    places, and the open place before it (its `prev`) is followed by exactly this context. Places that are followed
    equally often move on together, into a new group just above their old one, with the context lengthened as often.
    """
    n, top = len(ranks), int(ranks.max())
    by_rank = np.argsort(ranks, kind="stable")
    bounds = np.searchsorted(ranks[by_rank], np.arange(top + 2)).tolist()
    by_rank = by_rank.tolist()
    members: list = [by_rank[bounds[r] : bounds[r + 1]] for r in range(top + 1)]
    group = ranks.tolist()
    context = [1] * (top + 2)
    lower, upper = list(range(-1, top + 1)), list(range(1, top + 3))  # group top + 1 only ends the list
    members.append([])
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    before.append(n - 1)
    g = top
    while g > 0:
        own, length = members[g], context[g]
        followed: list[int] = []
        times: list[int] = []
        last = -1
        for i in own:
            if group[i] != g:
                continue  # it moved on
            j, k = before[i], after[i]
            after[j] = k
            before[k] = j
            if j == last:
                times[-1] += 1
            elif group[j]:
                followed.append(j)
                times.append(1)
                last = j
        if len(followed) == 1:
            moves = ((times[0], group[followed[0]], followed),)
        elif followed:
            sets: dict[tuple[int, int], list[int]] = {}
            for t, j in zip(times, followed):
                sets.setdefault((t, group[j]), []).append(j)
            moves = [(t, old, js) for (t, old), js in sorted(sets.items(), key=lambda x: -x[0][0])]  # the most often followed first, so that it ends up highest
        else:
            moves = ()
        for t, old, js in moves:
            new, above = len(members), upper[old]
            members.append(js)
            context.append(context[old] + t * length)
            lower.append(old)
            upper.append(above)
            lower[above] = upper[old] = new
            for j in js:
                group[j] = new
        members[g] = None
        g = lower[g]
    return np.asarray(context)[np.asarray(group)]


def block_ranks(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """Numbers of all blocks of 1, 2, 4... words, equal exactly for equal blocks, while any two are equal."""
    levels, size = [words.astype(np.int64)], 1
    while 2 * size <= longest:
        r = levels[-1]
        key = r[:-size] * (int(r.max()) + 1) + r[size:]
        kinds, block = np.unique(key, return_inverse=True)
        if len(kinds) == len(key):
            break
        levels.append(np.concatenate((block, len(kinds) + np.arange(size))))
        size *= 2
    return levels


def common_extension(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """Equal words from places a and b on (step 1) or back (step -1)."""
    n, off = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        x, y = (a + off, b + off) if step > 0 else (a - off - size + 1, b - off - size + 1)
        inside = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < n)
        equal = inside & (levels[k][np.where(inside, x, 0)] == levels[k][np.where(inside, y, 0)])
        off += equal * size
    return off


def _stretches(words: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches that can hold a run of `least` words or more, each in one text.

    With k = least // 2 words, windows at the start and at the end of a run stand in their text twice, and of those
    between at most k - 1 in a row do not. (Windows that only share a hash add places to look at.)
    """
    k = max(1, least // 2)
    none = np.zeros(0, np.int64)
    if len(words) < k:
        return none, none
    m = len(words) - k + 1
    key = text[:m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(k):
        key = key * np.uint64(0xD6E8FEB86659FD93) + words[j : j + m].astype(np.uint64) + np.uint64(1)
    whole = text[:m] == text[k - 1 :]
    ordered = np.sort(key)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return none, none
    nearest = np.minimum(np.searchsorted(again, key), len(again) - 1)
    twice = np.flatnonzero(whole & (again[nearest] == key))
    if not len(twice):
        return none, none
    cut = np.flatnonzero((np.diff(twice) > k) | (np.diff(text[twice]) != 0))
    start, end = twice[np.concatenate(([0], cut + 1))], twice[np.concatenate((cut, [len(twice) - 1]))] + k
    long = end - start >= least
    return start[long], end[long]


def find_runs(words: np.ndarray, text: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows (start, length, period), starts in words, sorted by start and period: all runs of at least `least` words and two periods.

    words: numbers of the words of several texts on end; text: the number of each word's text, rising.
    """
    start, end = _stretches(words, text, least)
    if not len(start):
        return np.zeros((0, 3), np.int64)
    size = end - start
    # The stretches on end, with a separator before each and after the last.
    at = np.concatenate(([0], np.cumsum(size + 1)))
    place = np.repeat(start - at[:-1] - 1, size + 1) + np.arange(at[-1])
    is_word = np.ones(at[-1] + 1, bool)
    is_word[at] = False
    place = np.append(place, 0)
    found, kind = np.unique(words[place[is_word]], return_inverse=True)
    ranks = np.zeros(len(place), np.int64)
    ranks[is_word] = kind + 1
    distinct = ranks + len(at)
    distinct[at] = np.arange(len(at))  # separators equal nothing
    levels = block_ranks(distinct, int(size.max()))
    i = np.flatnonzero(is_word)
    candidates = []
    for order in (ranks, np.where(is_word, len(found) + 1 - ranks, 0)):
        candidates.append(i * len(place) + lyndon_lengths(order)[i])
    i, p = np.divmod(np.unique(np.concatenate(candidates)), len(place))
    right = common_extension(levels, i, i + p, 1)
    left = common_extension(levels, i - 1, i + p - 1, -1)
    length = left + p + right
    ok = length >= np.maximum(least, 2 * p)
    return np.unique(np.stack((place[(i - left)[ok]], length[ok], p[ok]), axis=1), axis=0)


def _worked(ids: list, texts: list, least: int, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None) -> pa.RecordBatch:
    every: list[list[bytes]] = [(t or b"").split() for t in texts]  # bytes are split at the six ASCII spaces only
    if rewrite:
        every = [rewrite(d, w) for d, w in zip(ids, every)]
    number = defaultdict(count().__next__).__getitem__
    sizes = np.fromiter(map(len, every), np.int64, len(every))
    words = np.fromiter(map(number, chain.from_iterable(every)), np.int64, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(every)), sizes)
    runs = find_runs(words, text, least)
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(drop[:-1]) == 0
    owner = text[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    offsets = np.searchsorted(owner, np.arange(len(every) + 1)).astype(np.int32)
    fields = [runs[:, 0] - first[owner], runs[:, 1], runs[:, 2]] if len(runs) else [np.zeros(0, np.int64)] * 3
    structs = pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], ["start", "length", "period"])
    touched = np.diff(offsets) > 0
    out = []
    for k, w in enumerate(every):
        if touched[k]:
            w = [w[x] for x in np.flatnonzero(kept[first[k] : first[k] + len(w)])]
        out.append(b" ".join(w))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), structs), pa.array(out, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(id, n_words, runs, collapsed), a row for each row of docs.

    A run is a stretch of consecutive words with smallest period q and at least max(least, 2q) words that no neighbour
    lengthens. runs are in order of start, then period. collapsed joins by one space the words that no run holds after
    its first q words. rewrite may change the words (UTF-8) of a document, by its id, before they are searched.

    Null and empty texts and texts of white space have no words, no runs and an empty collapsed text. A null id stays
    null. Repeated rows are worked on each for itself, an empty table gives an empty result. A text is one task's work,
    in memory that grows with its words alone; nothing is shuffled.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list = []
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids.append(d)
                    texts.append(t)
                    held += len(t or b"")
                    if held >= BATCH_BYTES or len(ids) >= 4 * SLICE_ROWS:
                        yield _worked(ids, texts, least, rewrite)
                        ids, texts, held = [], [], 0
        if ids:
            yield _worked(ids, texts, least, rewrite)

    return docs.select(F.col(f"`{id_col}`").cast("long"), text_bytes(text_col)).mapInArrow(run, SCHEMA)


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document by crc32 of its id turned periodic from some word on; the others as they are (so that the query meets runs of all lengths)."""
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def digests(found: DataFrame) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli of the longest run, runs_sha256, collapsed_sha256); ties go to the smallest start, then period."""
    best = F.reduce("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda a, r: F.when(a.isNull() | (r["length"] > a["length"]), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = found.select("id", F.size("runs").cast("long").alias("n_runs"), best.alias("__best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("__best.length"), F.col("__best.period")
    return out.select("id", "n_runs", F.col("__best.start").alias("start"), length.alias("length"), period.alias("period"), F.expr("(1000 * __best.length) DIV __best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
