"""Near-duplicate groups of texts by the Jaccard similarity of their word shingles.

Candidates are named first by op1's method: the texts' SimHash fingerprints meet under whole segments and their
one-wildcard variants, and every pair within three bits is linked. Texts at similarity 0.8 mostly lie at 4 to 11 bits,
beyond any such index, so MinHash keys name the rest: 192 minima in 32 bands of 6, of which two texts at 0.8 share one
with probability 0.9999. Linked texts, directly or through others, are brought together and every pair of them is
decided by its shingles themselves. A group of very many shingles is dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyaccord.lineage import stored
from skyaccord.llm.common import SLICE_ROWS, map_rows, text_bytes
from skyaccord.llm.simhash import connected, drop_by_groups, shingle_hashes, simhash, similarity_edges, small

WIDTH, LEAST = 5, 0.8
#: Differing bits of two fingerprints that make their texts candidates.
NEAR_BITS = 3
BANDS, BAND_ROWS = 32, 6
#: Shingles of a block; a task compares two blocks at a time.
BLOCK_SHINGLES = 200_000

_RNG = np.random.default_rng(5)
_TIMES, _PLUS, _MIX = (_RNG.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64) | np.uint64(1) for _ in range(3))


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a single 0 for a text without a word."""
    return _distinct(shingle_hashes(text, width))


def _distinct(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes, np.uint64)) if hashes else np.zeros(1, np.uint64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys for each set, a row each."""
    flat, starts = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    least = np.stack([np.minimum.reduceat(flat * t + p, starts) for t, p in zip(_TIMES, _PLUS)], axis=1)
    return (least * _MIX).reshape(-1, BANDS, BAND_ROWS).sum(axis=2, dtype=np.uint64).view(np.int64)


def linked(sets: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """Label of each set: the least index that is reachable over pairs of at least that similarity."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    labels = np.arange(n)
    owner = np.repeat(np.arange(n), sizes)
    _, shingle, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[shingle] > 1
    owner, shingle = owner[shared], shingle[shared]
    holders = owner[np.argsort(shingle, kind="stable")]
    ends = np.cumsum(np.where(times > 1, times, 0))
    cuts = np.searchsorted(owner, np.arange(n + 1))
    for i in range(n):
        mine = shingle[cuts[i] : cuts[i + 1]]
        if not len(mine):
            continue
        count = times[mine]
        at = np.arange(count.sum()) + np.repeat(ends[mine] - np.cumsum(count), count)
        both = np.bincount(holders[at], minlength=n)
        near = both + 1e-9 >= least * (sizes[i] + sizes - both)
        near[i] = True
        met = np.unique(labels[near])
        if len(met) > 1:
            labels[np.isin(labels, met)] = met[0]
            if not labels.any():
                break
    return labels


def _edges_of_cells(least: float):
    """Edges from rows (root, cell, text_hash, hashes) that come in order of root and cell; a cell may span batches."""

    def edges(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        labels = linked(sets, least) if len(sets) > 1 else np.zeros(len(sets), np.int64)
        moved = np.flatnonzero(labels != np.arange(len(ids)))
        names = np.array(ids, np.int64)
        return pa.RecordBatch.from_pydict({"a": pa.array(names[labels[moved]]), "b": pa.array(names[moved])})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []
        for part in (batch.slice(at, SLICE_ROWS) for batch in batches for at in range(0, batch.num_rows, SLICE_ROWS)):
            for root, cell, text_hash, hashes in zip(*(c.to_pylist() for c in part.columns)):
                if (root, cell) != now:
                    yield edges(ids, sets)
                    now, ids, sets = (root, cell), [], []
                ids.append(text_hash)
                sets.append(np.frombuffer(hashes, np.uint64))
        yield edges(ids, sets)

    return run


def _stars(index: DataFrame) -> DataFrame:
    """Edges (a, b) from the least text of each key of (text_hash, key) to the others."""
    heads = index.select("text_hash", F.first("text_hash").over(Window.partitionBy("key").orderBy("text_hash")).alias("head"))  # a running frame: nothing of a key is held
    return heads.filter("text_hash <> head").select(F.col("head").alias("a"), F.col("text_hash").alias("b"))


def signature_links(prints: DataFrame, bits: int = NEAR_BITS) -> DataFrame:
    """Edges (a, b) that connect all texts of (text_hash, fingerprint) whose fingerprints differ in at most `bits` bits.

    Texts of one fingerprint form a star; fingerprints meet by op1's keys, and what links them links the heads of their stars.
    """
    heads = stored(prints.groupBy("fingerprint").agg(F.min("text_hash").alias("head")))
    edges = similarity_edges(heads.select("fingerprint"), bits)
    for end in ("a", "b"):
        edges = edges.join(heads.select(F.col("fingerprint").alias(end), F.col("head").alias(f"{end}_head")), end)
    return _stars(prints.select("text_hash", F.col("fingerprint").alias("key"))).unionByName(edges.select(F.col("a_head").alias("a"), F.col("b_head").alias("b")))


def similar_texts(docs: DataFrame, text_col: str = "text", width: int = WIDTH, least: float = LEAST, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(node, root): hashes of texts that have a similar one, and one of them for each connected group."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), text_bytes(text_col).alias("text"))

    def keys(batch: pa.RecordBatch) -> dict:
        every = [shingle_hashes(t, width) for t in batch.column(1).to_pylist()]
        sets = [_distinct(hashes) for hashes in every]
        return {"text_hash": batch.column(0), "size": pa.array([len(s) for s in sets], pa.int64()), "fingerprint": pa.array([simhash(hashes) for hashes in every], pa.int64()), "keys": pa.array(list(band_keys(sets)), pa.list_(pa.int64()))}

    def hashes(batch: pa.RecordBatch) -> dict:
        return {"text_hash": batch.column(0), "hashes": pa.array([shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())}

    prints = stored(map_rows(texts, keys, "text_hash long, size long, fingerprint long, keys array<long>").dropDuplicates(["text_hash"]))
    index = prints.select("text_hash", F.explode("keys").alias("key"))
    stars = stored(signature_links(prints.select("text_hash", "fingerprint")).unionByName(_stars(index)).distinct())
    members = stored(connected(stars).join(prints.select(F.col("text_hash").alias("node"), "size"), "node"))
    blocks = members.groupBy("root").agg(F.ceil(F.sum("size") / F.lit(block)).alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = members.join(blocks, "root").select(F.col("node").alias("text_hash"), "root", mine.alias("mine"), "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cells = stored(dealt.select("text_hash", "root", (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).alias("cell")))
    wanted = texts.join(small(stored(members.select(F.col("node").alias("text_hash")))), "text_hash", "left_semi")
    sets = map_rows(wanted, hashes, "text_hash long, hashes binary").dropDuplicates(["text_hash"])
    runs = cells.join(sets, "text_hash").repartition(parts, "root", "cell").sortWithinPartitions("root", "cell", "text_hash").select("root", "cell", "text_hash", "hashes")
    return connected(runs.mapInArrow(_edges_of_cells(least), "a long, b long").distinct())


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, text_hash, component_id), one row for each row of docs.

    component_id is the least id that is reachable over texts of at least that Jaccard similarity (distinct shingles
    of `width` words; a shorter text is one shingle). Null, empty and wordless texts are alike. Null ids stay null
    and take no part in the minimum. An empty table gives an empty result. Other columns are not looked at.
    """
    rows = stored(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash")))
    distinct = rows.groupBy("text_hash").agg(F.min("id").alias("least"))
    roots = similar_texts(docs, text_col, width, least, block)
    joined = stored(distinct.join(roots.withColumnRenamed("node", "text_hash"), "text_hash", "left").select("text_hash", "least", F.coalesce("root", "text_hash").alias("root")))
    component = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    group = joined.select("text_hash", "root").join(component, "root").select("text_hash", "component_id")
    return rows.join(group, "text_hash").select("id", "text_hash", "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """docs without all but one document (the one with the least id) of each group of similar texts; same columns."""
    return drop_by_groups(docs, similar_groups(docs, id_col, text_col, width, least), id_col, text_col)
