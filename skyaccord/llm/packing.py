"""Conflict-constrained best-fit packing of documents into fixed-size bins.

Documents are dealt by a hash into packs of bounded size; every pack is packed by one task. Open bins are
kept in order of their residual space and carry bitmaps of the sources and duplicate clusters they hold.
A piece goes to the tightest bin it fits, found by successor search from its own length, that holds neither
its source nor its cluster.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyaccord.lineage import checkpointed

SCHEMA = "id long, piece long, start long, length long, bin_id long, bin_offset long, bin_used long"


def best_fit(pieces: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for pieces (length, source, cluster) in the order given; null source or cluster never conflicts.

    A piece of full capacity, or of length 0 (which needs no room), opens a bin or takes the tightest as any other does.
    """
    sources: dict = {}
    clusters: dict = {}
    held: dict[int, list[int]] = {}  # bin -> bitmaps of sources and clusters
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    placed: list[tuple[int, int]] = []
    for length, source, cluster in pieces:
        s = 0 if source is None else 1 << sources.setdefault(source, len(sources))
        c = 0 if cluster is None else 1 << clusters.setdefault(cluster, len(clusters))
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins) and (held[open_bins[at][1]][0] & s or held[open_bins[at][1]][1] & c):
            at += 1
        if at < len(open_bins):
            residual, k = open_bins.pop(at)
        else:
            residual, k = capacity, len(held)
            held[k] = [0, 0]
        held[k][0] |= s
        held[k][1] |= c
        placed.append((k, capacity - residual))
        insort(open_bins, (residual - length, k))
    return placed


def pack(docs: DataFrame, capacity: int = 8192, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", per_pack: int = 2048, cluster_col: str | None = None) -> DataFrame:
    """(id, piece, start, length, bin_id, bin_offset, bin_used): every byte of every document, in one place.

    Lengths are UTF-8 bytes. A text longer than capacity is cut into pieces of capacity bytes, which fill bins
    of their own, and a rest; the rests and all shorter texts are packed in order of falling length. No bin
    holds two pieces of one source or of one duplicate cluster: the documents that share a value of cluster_col (such
    as component_id of near_duplicates), or without that column those with equal texts. Of pieces of one length the
    least id is placed first, and of bins equally tight the first opened is taken. Null and empty texts have one
    piece of length 0; null sources and clusters never conflict. Repeated rows are packed as often as they occur. An empty table
    gives an empty result. bin_used is the filled length of the bin.
    """
    source = F.col(f"`{source_col}`").cast("string") if source_col in docs.columns else F.lit(None).cast("string")
    cluster = F.col(f"`{cluster_col}`").cast("string") if cluster_col else F.sha2(F.col(f"`{text_col}`").cast("binary"), 256)
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), source.alias("source"), cluster.alias("cluster"), F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("size"))
    rows = checkpointed(narrow.withColumn("salt", F.monotonically_increasing_id()))
    packs = max(1, -(-rows.count() // per_pack))
    # The salt spreads a row that is repeated very often.
    dealt = rows.withColumn("pack", F.pmod(F.xxhash64("id", "salt"), F.lit(packs))).repartition(min(packs, 100_000), "pack").sortWithinPartitions("pack", "id", "salt")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if carry and carry[-1][0] != row[0]:
                    yield _packed(carry, capacity)
                    carry = []
                carry.append(row)
        if carry:
            yield _packed(carry, capacity)

    return dealt.select("pack", "id", "source", "cluster", "size").mapInArrow(run, SCHEMA)


def _packed(rows: list[tuple], capacity: int) -> pa.RecordBatch:
    """One pack: full pieces first, each in a bin of its own, then the rests by falling length."""
    whole, rests = [], []
    for number, doc, source, cluster, size in rows:
        full = (size - 1) // capacity if size else 0  # the last piece, full or not, is the rest
        whole += [(doc, k, k * capacity) for k in range(full)]
        rests.append((size - full * capacity, source, cluster, doc, full, full * capacity))
    rests.sort(key=lambda r: -r[0])
    bins = best_fit([r[:3] for r in rests], capacity)
    used: dict[int, int] = {}
    for (k, _), r in zip(bins, rests):
        used[k] = used.get(k, 0) + r[0]
    base, first = number << 32, len(used)
    out = [(doc, k, start, capacity, base + first + i, 0, capacity) for i, (doc, k, start) in enumerate(whole)]
    out += [(r[3], r[4], r[5], r[0], base + k, offset, used[k]) for (k, offset), r in zip(bins, rests)]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_pydict({n: pa.array(column, pa.int64()) for n, column in zip(names, zip(*out))})
