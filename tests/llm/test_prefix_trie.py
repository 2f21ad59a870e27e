"""The prefix trie against brute force over all prefixes, at several partitionings, and for odd input."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyaccord.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_lists(rows):
    """{conv: [(role, text)...]}; ties of a turn by the digest of role and text."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            found[conv].append((turn is not None, turn or 0, digest, role, text))
    return {c: [(t[3], t[4]) for t in sorted(turns)] for c, turns in found.items()}


def brute_spliced(lists):
    out = {}
    for c, own in lists.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = lists.get(base, [])[:h] + own[h:]
    return out


def brute_trie(lists):
    members = defaultdict(list)
    for c, turns in lists.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    parents = {node[:-1] for node in members if node}
    n_children = defaultdict(int)
    for node in members:
        if node:
            n_children[node[:-1]] += 1
    out = []
    for node, held in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in held if len(lists[c]) == len(node)))
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below[node] if m)
        leaves = sum(m not in parents for m in below[node])
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), n_children[node], leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=5), min_size=1, max_size=14), st.integers(1, 5))
def test_contracted_parts_merge_to_the_whole_forest(sequences, cut):
    """The two steps without Spark: parts of `cut` sequences each, their nodes and the merged paths, against one whole forest."""
    keyed = sorted(("".join(f"{x:032x}" for x in s), c) for c, s in enumerate(sequences))

    def batch(part):
        cols = [[p for p, _ in part], [c for _, (_, c) in part], [k for _, (k, _) in part], [[1 + int(k[i * 32 + 31]) for i in range(len(k) // 32)] for _, (k, _) in part]]
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3], pa.list_(pa.int64()))], ["part", "conv_id", "key", "chars"])

    def nodes(size):
        local = []
        for p, at in enumerate(range(0, len(keyed), size)):
            for b in prefix_trie._local([batch([(p, row) for row in keyed[at : at + size]])]):
                local += b.to_pylist()
        import pyarrow as pa

        paths = sorted(((r["part"], r["side"], r["key"], r["chars"], r["sums"]) for r in local if r["kind"] == prefix_trie.PATH), key=lambda r: r[:2])
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*paths), (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())))], ["part", "side", "key", "chars", "sums"])
        opened = [r for b in prefix_trie._merged([made]) for r in b.to_pylist()]
        owners = {(r["part"], r["side"]): r["owners"] for r in opened if r["kind"] == prefix_trie.PATH}
        out = []
        for r in [r for r in local + opened if r["kind"] == prefix_trie.NODE]:
            parent = r["parent_conv_id"] if r["side"] is None else owners[r["part"], r["side"]][r["depth"] - 1]
            out.append((r["conv_id"], r["depth"], parent, r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]))
        return sorted(out, key=str)

    lists = {c: [("", "x" * (1 + x) if x else "x") for x in s] for c, s in enumerate(sequences)}
    assert nodes(cut) == nodes(100) == [r[:7] for r in brute_trie(lists)]


@pytest.fixture(scope="module")
def made():
    rows = []
    for c in range(-30, 330):
        for t in range(c % 7):
            rows.append((c, t if t % 3 else None, "user" if t % 2 else None, f"text {(c // 40) * (t > 1)} é" if (c + t) % 11 else None))
    rows += [(1000 + k, t, "user", f"copy {t}") for k in range(200) for t in range(3)]  # many equal conversations
    rows += [(5000, t, "user", f"long {t // 2}") for t in range(300)] + [(5001, t, "user", f"long {t // 2}") for t in range(250)]
    rows += [(None, 0, "user", "nobody's"), (7000, 1, "a", "tie"), (7000, 1, "b", "tie"), (7000, 1, "b", "tie")]
    return rows


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_trie_against_brute_force(spark, made, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        conversations = spark.createDataFrame(made, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "chars", "part", "turns", "depth")})
        lists = prefix_trie.turn_lists(conversations)
        assert collected(prefix_trie.prefix_trie(lists)) == brute_trie(brute_lists(made))
        assert collected(prefix_trie.prefix_trie(prefix_trie.spliced(lists))) == brute_trie(brute_spliced(brute_lists(made)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(queries.op13_prefix_trie(spark, sf)) == brute_trie(brute_spliced(brute_lists(rows)))


def test_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    cursor = con.execute(queries.oracle_sql()["op13_prefix_trie"])
    names = [d[0] for d in cursor.description]
    assert collected(queries.op13_prefix_trie(spark, sf)) == sorted((tuple(row[names.index(c)] for c in COLUMNS) for row in cursor.fetchall()), key=str)


def test_empty_table_and_turnless(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(prefix_trie.turn_lists(none)).count() == 0
    one = spark.createDataFrame([(1, None, None, None)], SCHEMA)
    got = collected(prefix_trie.prefix_trie(prefix_trie.turn_lists(one).withColumn("turns", F.slice("turns", 1, 0))))
    assert got == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
