"""Near-duplicate groups by shingle similarity against brute force over all pairs."""

import itertools
import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from skyaccord.llm import similar  # noqa: E402
from tests.llm.test_llm_operators import ODD, SCHEMA, SF, brute_fingerprint  # noqa: E402


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def brute_groups(texts):
    """Least index of each text's group."""
    sets, labels = [brute_set(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and labels[i] != labels[j]:
            a, b = sorted((labels[i], labels[j]))
            labels = [a if x == b else x for x in labels]
    return labels


def test_stage_takes_shingle_similarity_and_not_three_bits(spark):
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in rng.integers(0, 5000, 200)]
    near = [f"n{k}" if k in (40, 90, 140) else w for k, w in enumerate(base)]  # 15 of 196 shingles differ: similarity 181/211
    far = base[:150] + [f"v{k}" for k in range(50)]
    texts = [" ".join(x) for x in (base, near, far)]
    assert bin(int(brute_fingerprint(texts[0])) ^ int(brute_fingerprint(texts[1]))).count("1") > 3
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()} == {0, 2}


@pytest.mark.parametrize("block", [similar.BLOCK_SHINGLES, 400])
def test_groups_equal_brute_force(spark, block):
    rng = np.random.default_rng(2)
    given = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    for _ in range(4):  # clusters whose texts lie around the limit and are linked in chains
        words = [f"w{k}" for k in rng.integers(0, 900, 120)]
        for _ in range(15):
            words = [w if rng.random() > 0.012 else f"x{rng.integers(0, 900)}" for w in words]
            given.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r.id: r.component_id for r in similar.similar_groups(docs, block=block).collect()}
    assert [got[i] for i in range(len(given))] == brute_groups(given)


def test_exactly_the_limit_is_similar():
    sets = [np.arange(1, 10, dtype=np.uint64), np.arange(2, 11, dtype=np.uint64), np.arange(4, 13, dtype=np.uint64)]
    assert similar.linked(sets, 0.8).tolist() == [0, 0, 2]  # 8 of 10; 7 of 11
    assert similar.linked([np.arange(4, dtype=np.uint64), np.arange(5, dtype=np.uint64)]).tolist() == [0, 0]  # 4 of 5


def test_odd_input(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    rows = similar.similar_groups(odd).collect()
    assert len(rows) == len(ODD)
    got = {r.id: r.component_id for r in rows}
    assert got[1] == got[2] == got[3] == 1 and got[5] == got[6] == 5 and got[4] == 4 and got[7] == 7 and got[None] is None
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in similar.drop_similar(odd).collect())
    assert kept == [(False, 1), (False, 4), (False, 5), (False, 7), (False, 8), (False, 9), (True, 0)]
    assert similar.drop_similar(odd.limit(0)).count() == 0


def test_fingerprints_within_three_bits_are_candidates(spark):
    """The links of op1's index connect all texts within three bits, with equal fingerprints too."""
    rng = random.Random(3)
    prints = []
    for _ in range(12):
        base = rng.getrandbits(64)
        prints += [base, base]
        for _ in range(12):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 3, 4, 5))))
            prints.append(base)
    labels = list(range(len(prints)))
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3 and labels[i] != labels[j]:
            a, b = sorted((labels[i], labels[j]))
            labels = [a if x == b else x for x in labels]
    rows = [(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)]
    links = similar.signature_links(spark.createDataFrame(rows, "text_hash long, fingerprint long"))
    root = {r.node: r.root for r in similar.connected(links).collect()}
    assert [root.get(k, k) for k in range(len(prints))] == labels
