"""The trie of shared conversation prefixes, with counts over its subtrees.

Conversations are sorted as sequences of turns over range partitions. In each partition the edges between sorted
neighbours, as deep as their longest common prefix, are taken by falling depth into a union-find: what an edge merges
is one node at that depth, and the unbranched nodes above a part are written when the part is merged. Nodes on
the way to a partition's first or last sequence may go on in its neighbours: they stay open. Each partition is
contracted to those two paths, which carry the sums of all that was closed below them, and the paths of all partitions are
merged by the same union-find.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyaccord.lineage import checkpointed, stored

#: Hex digits that stand for a turn: the first half of a SHA-256 of role and text.
TURN = 32
#: Ids of one row of text on the way to a digest.
IDS_AT_ONCE = 1024
NO_ONE = 1 << 63
EMPTY = hashlib.sha256(b"").hexdigest()

_KINDS = NODE, PATH, ENDS = 0, 1, 2
_LOCAL = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("side", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("key", pa.string()), ("chars", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))])
_LOCAL_DDL = "kind int, part long, side int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, key string, chars array<long>, sums array<long>"
_OPEN = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("side", pa.int32()), ("number", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("owners", pa.list_(pa.int64())), ("numbers", pa.list_(pa.int64()))])
_OPEN_DDL = "kind int, part long, side int, number long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, owners array<long>, numbers array<long>"


def common_turns(a: str, b: str) -> int:
    """Turns that two sequences of hex keys begin with alike."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // TURN
    low, high = 0, most // TURN  # a prefix of low turns is common, one of high is not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * TURN : middle * TURN] == b[low * TURN : middle * TURN]:
            low = middle
        else:
            high = middle
    return low


class Forest:
    """Union-find over sorted sequences. Sums are [members, least member, children, leaves, saved]."""

    def __init__(self, keys: list[str], chars: list[list[int]], sums: list[dict[int, list[int]]], whole: bool):
        """sums: what each sequence brings to the node at a depth of its own. whole: there are no sequences but these, so every node is closed."""
        self.keys, self.chars, self.whole = keys, chars, whole
        n = len(keys)
        self.root = list(range(n))
        self.first, self.last = list(range(n)), list(range(n))  # of a part, at its root
        self.depth = [len(k) // TURN for k in keys]
        self.brought = sums
        self.state = [[0, NO_ONE, 0, 0, 0] for _ in range(n)]
        self.waiting: list[list[int]] = [[] for _ in range(n)]  # nodes whose parent is the part's next node
        self.nodes: list[list] = []  # [least member, depth, parent's, members, children, leaves, saved, first, last, side of an open parent]
        self.open: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})  # depth -> sums, on the paths to the first and to the last sequence
        if not n:
            return
        edges: dict[int, list[int]] = {}
        for i in range(n - 1):
            edges.setdefault(common_turns(keys[i], keys[i + 1]), []).append(i)
        for depth in sorted(edges, reverse=True):
            for i in edges[depth]:
                self._merge(self._find(i), self._find(i + 1), depth)
        self._raise(self._find(0), -1)

    def _find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def _merge(self, a: int, b: int, depth: int) -> None:
        for c in (a, b):
            self._raise(c, depth)
        if self.last[a] - self.first[a] < self.last[b] - self.first[b]:
            a, b = b, a
        self.root[b] = a
        self.first[a], self.last[a] = min(self.first[a], self.first[b]), max(self.last[a], self.last[b])
        self._add(self.state[a], self.state[b])
        self.waiting[a] += self.waiting[b]
        for k, sums in self.brought[b].items():
            if k in self.brought[a]:
                self._add(self.brought[a][k], sums)
            else:
                self.brought[a][k] = sums
        self.state[b] = self.waiting[b] = self.brought[b] = None

    @staticmethod
    def _add(into: list[int], sums: list[int]) -> None:
        into[0] += sums[0]
        into[1] = min(into[1], sums[1])
        into[2] += sums[2]
        into[3] += sums[3]
        into[4] += sums[4]

    def _raise(self, c: int, depth: int) -> None:
        """Ends the part's nodes deeper than depth: writes the closed ones, keeps the sums of the open ones."""
        first, last = self.first[c], self.last[c]
        side = None if self.whole else 0 if first == 0 else 1 if last == len(self.keys) - 1 else None
        state = self.state[c]
        for k in range(self.depth[c], depth, -1):
            if brought := self.brought[c].pop(k, None):
                self._add(state, brought)
            if side is not None:
                self.open[side][k] = state
                for w in self.waiting[c]:
                    self.nodes[w][9] = side
                state, self.waiting[c] = [0, NO_ONE, 0, 0, 0], []
                continue
            members, least, children, leaves, saved = state
            leaves = leaves if children else 1
            saved += (members - 1) * self.chars[first][k - 1] if k else 0
            for w in self.waiting[c]:
                self.nodes[w][2] = least
            self.waiting[c] = [len(self.nodes)]
            self.nodes.append([least, k, None, members, children, leaves, saved, first, last, None])
            state = [members, least, 1, leaves, saved]
        self.state[c], self.depth[c] = state, depth


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes, paths and ends of one partition of sorted (part, conv_id, key, chars)."""
    part, ids, keys, chars = None, [], [], []
    for batch in batches:
        if batch.num_rows:
            part = batch.column(0)[0].as_py()
            ids += batch.column(1).to_pylist()
            keys += batch.column(2).to_pylist()
            chars += batch.column(3).to_pylist()
    if not ids:
        return
    depths = [len(k) // TURN for k in keys]
    forest = Forest(keys, chars, [{d: [1, c, 0, 0, 0]} for d, c in zip(depths, ids)], False)

    def ending(first: int, depth: int) -> tuple[int, int]:
        """The sequences of just this depth come first in their node."""
        end = first
        while end < len(depths) and depths[end] == depth and keys[end] == keys[first]:
            end += 1
        return first, end

    def rows() -> Iterator[tuple]:
        for least, depth, parent, members, children, leaves, saved, first, _, side in forest.nodes:
            low, high = ending(first, depth)
            digest = hashlib.sha256(",".join(map(str, ids[low:high])).encode()).hexdigest() if high > low else EMPTY
            yield (NODE, part, side, least, depth, parent, members, children, leaves, saved, digest, None, None, None)
        at = 0
        open_ends = []
        for side, place in ((0, 0), (1, len(keys) - 1)):
            sums = forest.open[side]
            if not sums and side:
                continue  # the last sequence is the first's, too
            flat = [x for k in range(depths[place] + 1) for x in sums.get(k, (0, NO_ONE, 0, 0, 0))]
            yield (PATH, part, side, None, depths[place], None, None, None, None, None, None, keys[place], chars[place], [min(x, NO_ONE - 1) for x in flat])
            open_ends += [(side, k, keys[place][: k * TURN]) for k in sums]
        # Sequences that end at an open node: all equal to a prefix of the first or the last one.
        wanted = {key: (side, k) for side, k, key in open_ends}
        while at < len(keys):
            _, end = ending(at, depths[at])
            if keys[at] in wanted:
                side, k = wanted[keys[at]]
                for n in range(at, end, IDS_AT_ONCE):
                    yield (ENDS, part, side, n, k, None, None, None, None, None, ",".join(map(str, ids[n : min(end, n + IDS_AT_ONCE)])), None, None, None)
            at = end

    yield from _batches(rows(), _LOCAL)


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open nodes with their sums, and for each path (part, side) the least members and the numbers of its nodes by depth."""
    paths = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
    sums = [{k: list(s[5 * k : 5 * k + 5]) for k in range(len(s) // 5)} for *_, s in paths]
    forest = Forest([p[2] for p in paths], [p[3] for p in paths], sums, True)
    owners = [[None] * (len(p[2]) // TURN + 1) for p in paths]
    numbers = [[None] * len(o) for o in owners]
    for number, node in enumerate(forest.nodes):
        for k in range(node[7], node[8] + 1):
            owners[k][node[1]], numbers[k][node[1]] = node[0], number

    def rows() -> Iterator[tuple]:
        for number, (least, depth, parent, members, children, leaves, saved, *_) in enumerate(forest.nodes):
            yield (NODE, None, None, number, least, depth, parent, members, children, leaves, saved, None, None)
        for (part, side, *_), o, n in zip(paths, owners, numbers):
            yield (PATH, part, side, None, None, None, None, None, None, None, None, o, n)

    yield from _batches(rows(), _OPEN)


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, digest) from sorted (number, text): the texts of a number on end, comma-joined, in one running digest."""
    schema, now, running = pa.schema([("number", pa.int64()), ("digest", pa.string())]), None, None
    for batch in batches:
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if number != now:
                if running:
                    yield from _batches([(now, running.hexdigest())], schema)
                now, running = number, hashlib.sha256(text.encode())
            else:
                running.update(b"," + text.encode())
    if running:
        yield from _batches([(now, running.hexdigest())], schema)


def turn_lists(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns (turn, key, chars) in order, a null turn first; texts stay behind, a digest stands for role and text."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, TURN)
    rows = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), key.alias("key"), F.char_length(text).cast("long").alias("chars")).alias("t"))
    return rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def spliced(lists: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """turn_lists with the first h turns of conversation c - c % group, if there is one, in the place of c's own first h; h = crc32(decimal c) % (most + 1)."""
    lists = stored(lists)
    heads = lists.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("__base"), F.slice("turns", 1, most).alias("__head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    both = lists.withColumn("__h", h).join(heads, F.col("conv_id") - F.col("conv_id") % group == F.col("__base"), "left")
    own = F.when(F.size("turns") > F.col("__h"), F.slice("turns", F.col("__h") + 1, F.greatest(F.size("turns") - F.col("__h"), F.lit(1)))).otherwise(F.slice("turns", 1, 0))
    head = F.coalesce(F.slice("__head", F.lit(1), F.col("__h")), F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(head, own).alias("turns"))


def prefix_trie(lists: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each distinct prefix.

    lists: (conv_id, turns) as turn_lists makes them. A node is a sequence of d turns that some conversation begins
    with; d = 0 is the root. conv_id is the least member, parent_conv_id the parent's. n_children and n_leaves (nodes
    without children in the subtree, itself included), saved_tokens: over the subtree, (members - 1) times the code
    points of the node's last text. ends_sha256: of the ids of the members that end here, ascending, comma-joined.

    Rows with a null conversation id belong to no conversation. Null roles and texts count as empty, null turns come
    first, and turns that agree in number are ordered by the digest of role and text. Conversations without
    turns end at the root. Repeated rows are turns of their own. An empty table gives an empty result.

    Equal conversations lie next to each other in id order and may fill any number of partitions. A task holds one
    range partition of sequences (32 bytes a turn); what is merged in one task are two paths for each partition, whose
    number is a setting. Ids that end at one open node are hashed in one stream, as the digest demands, without being held.
    """
    key = F.array_join(F.transform("turns", lambda t: t["key"]), "")
    sequences = lists.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The range borders come from a sample, so the partitions are fixed once before anything follows from them.
    ranged = checkpointed(sequences.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id().cast("long")))
    local = stored(ranged.select("part", "conv_id", "key", "chars").mapInArrow(_local, _LOCAL_DDL))
    paths = local.filter(F.col("kind") == PATH).select("part", "side", "key", "chars", "sums")
    merged = stored(paths.repartition(1).sortWithinPartitions("part", "side").mapInArrow(_merged, _OPEN_DDL))
    known = merged.filter(F.col("kind") == PATH).select(F.col("part").alias("__part"), F.col("side").alias("__side"), "owners", "numbers")
    counts = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    closed = local.filter(F.col("kind") == NODE)
    inner = closed.filter("side IS NULL").select("conv_id", "depth", "parent_conv_id", *counts, F.col("ends").alias("ends_sha256"))
    on = (F.col("part") == F.col("__part")) & (F.col("side") == F.col("__side"))
    # A part and side have the nodes of one partition, however many partitions share their parent.
    edge = closed.filter("side IS NOT NULL").join(known, on).select("conv_id", "depth", F.element_at("owners", F.col("depth").cast("int")).alias("parent_conv_id"), *counts, F.col("ends").alias("ends_sha256"))
    texts = local.filter(F.col("kind") == ENDS).join(known, on).select(F.element_at("numbers", (F.col("depth") + 1).cast("int")).alias("number"), "part", F.col("conv_id").alias("at"), "ends")
    digests = texts.repartition("number").sortWithinPartitions("number", "part", "at").select("number", "ends").mapInArrow(_digested, "number long, digest string")
    opened = merged.filter(F.col("kind") == NODE).join(digests.withColumnRenamed("number", "__number"), F.col("number") == F.col("__number"), "left").select("conv_id", "depth", "parent_conv_id", *counts, F.coalesce("digest", F.lit(EMPTY)).alias("ends_sha256"))
    return inner.unionByName(edge).unionByName(opened)
