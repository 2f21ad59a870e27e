"""SimHash near-duplicate groups by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Fingerprints that differ in at most three bits
agree in one segment up to a single bit, so each fingerprint is indexed under both whole segments and under
every segment with one bit left out (2 + 64 keys). Equal keys meet in one partition and are verified there;
what leaves a key is a spanning star of its linked members, never all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyaccord.lineage import checkpointed, stored
from skyaccord.llm.common import fresh_names, join_counted, map_rows, text_bytes

BITS, SEGMENTS, SEGMENT_BITS = 64, 2, 32
#: Members of one key that one task compares; a fuller key is dealt out as pairs of blocks.
MAX_RUN = 8192
#: Rows of a helper table up to which it is broadcast (a few dozen bytes each).
BROADCAST_ROWS = 100_000


def shingle_hashes(text: bytes | None, width: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of the word shingles, repeats included; the whole sequence if it is shorter, nothing without a word."""
    words = text.lower().split() if text else []  # bytes: A-Z and the ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-width])).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]


def simhash(hashes: list[int]) -> int:
    """Each bit is 1 if it is set in over half of the hashes; 0 for none. As a signed 64-bit integer."""
    if not hashes:
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at : at + 65_536], np.uint64).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fingerprint long, text_hash long), one row per row; null text counts as empty (fingerprint 0)."""

    def fn(batch: pa.RecordBatch) -> dict:
        prints = [simhash(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()]
        return {"id": batch.column(0), "fingerprint": pa.array(prints, pa.int64()), "text_hash": batch.column(2)}

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_bytes(text_col).alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"))
    return map_rows(narrow, fn, "id long, fingerprint long, text_hash long")


def _segment(fp: Column, s: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT_BITS * s).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def _variant_keys(value: Column, s: int) -> Column:
    """The whole segment and its one-wildcard variants; the high half of a key tells segment and wildcard."""
    whole = value + F.lit((s * 64 + 32) << 32)
    wild = [value.bitwiseAND(F.lit(((1 << SEGMENT_BITS) - 1) ^ (1 << b))) + F.lit((s * 64 + b) << 32) for b in range(SEGMENT_BITS)]
    return F.array(whole, *wild)


def _linked(prints: np.ndarray, side: np.ndarray | None, bits: int) -> np.ndarray:
    """Label of each member: the least index that is reachable over links of at most `bits` bits (across sides, if given)."""
    n = len(prints)
    labels = np.arange(n)
    while True:
        new = labels.copy()
        for at in range(0, n, 512):
            near = np.bitwise_count(prints[at : at + 512, None] ^ prints[None, :]) <= bits
            if side is not None:
                near &= side[at : at + 512, None] != side[None, :]
            new[at : at + 512] = np.minimum(new[at : at + 512], np.where(near, labels[None, :], n).min(axis=1))
        while (new[new] != new).any():
            new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _run_edges(key: int, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star (root, member) for every linked part of one key's members."""
    s, wildcard = divmod(int(key) >> 32, 64)
    side = None
    if wildcard < 32:  # members that agree in the wildcard bit meet under their whole segment
        side = (prints >> np.uint64(SEGMENT_BITS * s + wildcard)) & np.uint64(1)
        if side.all() or not side.any():
            return prints[:0], prints[:0]
    labels = _linked(prints, side, bits)
    moved = labels != np.arange(len(prints))
    return prints[labels[moved]], prints[moved]


def _edges_of_sorted(bits: int):
    """Edges from rows (key, cell, fp) that come in order of key, cell, fp; a run may span batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]

        def edges(key, cell, fp, last: bool):
            new = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
            starts = np.concatenate(([0], new)) if len(key) else new
            ends = np.append(starts[1:], len(key)) if len(key) else new
            if not last and len(starts):
                keep = starts[-1]
                starts, ends = starts[:-1], ends[:-1]
            else:
                keep = len(key)
            a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            two = starts[ends - starts == 2]
            x, y = fp[two], fp[two + 1]
            close = (np.bitwise_count(x ^ y) <= bits) & (x != y)
            a.append(x[close])
            b.append(y[close])
            for i, j in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
                u, v = _run_edges(key[i], fp[i:j], bits)
                a.append(u)
                b.append(v)
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
            out = pa.RecordBatch.from_pydict({"a": pa.array(pairs[0].view(np.int64)), "b": pa.array(pairs[1].view(np.int64))})
            return out, [key[keep:], cell[keep:], fp[keep:]]

        for batch in batches:
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            out, carry = edges(*(np.concatenate(x) for x in zip(carry, now)), False)
            yield out
        yield edges(*carry, True)[0]

    return run


def similarity_edges(prints: DataFrame, bits: int = 3, max_run: int = MAX_RUN) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fingerprint) that differ in at most `bits` bits."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments with one wildcard find at most 3 differing bits")
    fp = F.col("fingerprint")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = prints.select("fingerprint", F.explode(F.concat(*[_variant_keys(_segment(fp, s), s) for s in range(SEGMENTS)])).alias("key"))
    # Keys fuller than max_run hold a segment that is itself in more than half as many fingerprints.
    segments = prints.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), _segment(fp, s).alias("value")) for s in range(SEGMENTS)])).alias("x"))
    full = segments.groupBy("x.s", "x.value").agg(F.count("*").alias("n")).filter(F.col("n") > max_run // 2)
    keys = F.when(F.col("s") == 0, _variant_keys(F.col("value"), 0)).otherwise(_variant_keys(F.col("value"), 1))
    full = checkpointed(full.select("n", F.explode(keys).alias("key")).groupBy("key").agg(F.ceil(F.sum("n") * 2 / F.lit(max_run)).alias("blocks")))
    n_full = full.count()
    if n_full:
        side = F.broadcast(full) if n_full <= BROADCAST_ROWS else full
        block = F.pmod(F.xxhash64("fingerprint"), F.col("blocks"))
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        index = index.join(side, "key", "left").select("fingerprint", "key", "blocks", other.alias("other"))
        cell = F.when(F.col("blocks").isNull(), 0).otherwise(F.least(block, F.col("other")) * F.col("blocks") + F.greatest(block, F.col("other")))
        index = index.select("fingerprint", "key", cell.cast("long").alias("cell"))
    else:
        index = index.select("fingerprint", "key", F.lit(0).cast("long").alias("cell"))
    runs = index.repartition(parts, "key", "cell").sortWithinPartitions("key", "cell", "fingerprint").select("key", "cell", "fingerprint")
    return runs.mapInArrow(_edges_of_sorted(bits), "a long, b long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): root is one node for each connected part. Minimum labels with pointer jumping.

    Every round is a grouped minimum (summed before its shuffle) that is stored in the shared folder.
    """
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("peer")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("peer"))))
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("peer")).alias("root")))
    while True:
        told = both.join(labels.select(F.col("node").alias("peer"), "root"), "peer").groupBy("node").agg(F.min("root").alias("near"))
        step = labels.join(told, "node").select("node", "root", F.least("root", "near").alias("new"))
        jump = step.join(labels.select(F.col("node").alias("new"), F.col("root").alias("far")), "new")
        nxt = stored(jump.select("node", F.least("new", "far").alias("root"), (F.least("new", "far") < F.col("root")).alias("moved")))
        moved = nxt.filter("moved").limit(1).count()
        labels = nxt.select("node", "root")
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3, width: int = 3, max_run: int = MAX_RUN) -> DataFrame:
    """(id, fingerprint, text_hash, component_id), one row for each row of docs.

    component_id is the least id that is reachable over fingerprints at `bits` or fewer differing bits. Null or
    wordless texts have fingerprint 0 and link like any other; rows with equal ids and texts share all values;
    null ids stay null and take no part in the minimum (a group of only null ids gets null). An empty table
    gives an empty result. Other columns are not looked at.
    """
    rows = checkpointed(fingerprints(docs, id_col, text_col, width))
    distinct = checkpointed(rows.groupBy("fingerprint").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    roots = connected(similarity_edges(distinct.select("fingerprint"), bits, max_run))
    joined = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    group = joined.join(least, "root").select("fingerprint", "n", "component_id")
    return join_counted(rows, group, "fingerprint").select("id", "fingerprint", "text_hash", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3, width: int = 3) -> DataFrame:
    """docs without all but one document (the one with the least id) of each near-duplicate group; same columns.

    Of several texts under that id the one with the least hash stays, and rows that repeat an id and its text
    stay once. Rows with null ids are never dropped: nothing names them.
    """
    return drop_by_groups(docs, near_duplicates(docs, id_col, text_col, bits, width), id_col, text_col)


def drop_by_groups(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """drop_near_duplicates for given groups (id, text_hash, component_id), one row for each row of docs."""
    groups = stored(groups)
    named = groups.filter("id IS NOT NULL").groupBy("id", "text_hash").agg(F.count("*").alias("n"), F.min("component_id").alias("component_id"))
    keepers = named.filter("id = component_id").groupBy("id").agg(F.min(F.struct("text_hash", "n")).alias("k")).select("id", "k.text_hash", "k.n")
    i, t = fresh_names(docs, 2)
    gone = named.select("id", "text_hash").join(keepers, ["id", "text_hash"], "left_anti")
    again = keepers.filter("n > 1")
    gone, again = (stored(df.select(F.col("id").alias(i), F.col("text_hash").alias(t))) for df in (gone, again))
    key = [F.col(f"`{id_col}`").cast("long") == F.col(i), F.xxhash64(F.col(f"`{text_col}`")) == F.col(t)]
    kept = docs.join(small(gone), key, "left_anti")
    if again.limit(1).count():
        again = small(again)
        once = kept.join(again, key, "inner").dropDuplicates([i, t]).drop(i, t)
        kept = kept.join(again, key, "left_anti").unionByName(once)
    return kept


def small(df: DataFrame) -> DataFrame:
    """Broadcast if its counted rows are few; else Spark chooses."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
