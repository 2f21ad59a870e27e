"""Periodic runs against brute force, and their defined results for odd input."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyaccord.llm import periodic, queries
from tests.llm.test_llm_operators import LONG, ODD, SCHEMA, SF


def brute_runs(w, least=12):
    """Every stretch with period p, for every p; a stretch counts with its smallest period."""
    n, found = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            size = j + p - i
            if size >= max(least, 2 * p) and not any(p % q == 0 and i >= s and j + p <= s + m for s, m, q in found):
                found[i, size, p] = True
            i = j
    return sorted(found)


def brute_lyndon(a):
    """The next smaller suffix ends the longest Lyndon word."""
    out = []
    for i in range(len(a)):
        j = i + 1
        while j < len(a) and a[j:] >= a[i:]:
            j += 1
        out.append(j - i)
    return out


def brute_rewritten(doc, w):
    h, n = zlib.crc32(str(doc).encode()), len(w)
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def brute_row(doc, text):
    w = brute_rewritten(doc, (text or "").encode().split())
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    drop = {x for s, m, p in runs for x in range(s + p, s + m)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()
    return (doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(b" ".join(x for i, x in enumerate(w) if i not in drop)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=24), min_size=1, max_size=4))
def test_group_contexts_are_the_lyndon_array(sequences):
    ranks = np.array([0] + [x for s in sequences for x in [*s, 0]])
    got = periodic.lyndon_lengths(ranks).tolist()
    at = 1
    for s in sequences:
        assert got[at : at + len(s)] == brute_lyndon(s)
        at += len(s) + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=14), st.integers(1, 5), st.lists(st.integers(0, 2), max_size=5)), min_size=1, max_size=4), st.sampled_from([2, 3, 5, 12]))
def test_runs_are_those_of_brute_force(parts, least):
    texts = [unit * times + rest for unit, times, rest in parts]
    words = np.array([x for t in texts for x in t], np.int64)
    text = np.array([k for k, t in enumerate(texts) for _ in t], np.int64)
    wanted, base = [], 0
    for t in texts:
        wanted += [(s + base, m, p) for s, m, p in brute_runs(t, least)]
        base += len(t)
    assert [tuple(r) for r in periodic.find_runs(words, text, least).tolist()] == wanted


def test_query_against_brute_force(spark):
    got = {r[0]: tuple(r) for r in queries.op12_periodic(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    some = 0
    for r in rows:
        if len((r.text or "").split()) <= 1500:
            assert got[r.doc_id] == brute_row(r.doc_id, r.text)
            some += got[r.doc_id][1] > 0
    assert some > 5


def test_odd_input(spark):
    frame = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "runs", "collapsed", "n_words", "start")})
    got = sorted((tuple(r) for r in periodic.periodic_runs(frame).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(ODD)
    by_id = {r[0]: r for r in got}
    assert by_id[1][1:] == by_id[2][1:] == by_id[3][1:] == (0, [], "")
    n = len(LONG.split())
    assert by_id[7][1] == n and [tuple(x) for x in by_id[7][2]] == [(0, n, 1)] and by_id[7][3] == "wort"
    assert by_id[None][3] == "no id at all" and sum(r[0] == 6 for r in got) == 2


def test_empty_table(spark):
    out = periodic.digests(periodic.periodic_runs(spark.createDataFrame([], SCHEMA)))
    assert out.count() == 0 and out.columns[0] == "id"


@pytest.mark.parametrize("words,wanted", [("a b " * 6, "a b"), ("x " + "a b c " * 4 + "a d", "x a b c d"), ("a b " * 5, ("a b " * 5).strip())])
def test_repeats_go(spark, words, wanted):
    frame = spark.createDataFrame([(1, words)], "doc_id long, text string")
    assert periodic.periodic_runs(frame).first().collapsed == wanted
