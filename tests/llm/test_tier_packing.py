"""Token packing into several context sizes: exact ids, exact cover, full windows, balanced steps."""

import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyaccord.llm import queries, tier_packing
from tests.llm.test_llm_operators import ODD, SCHEMA, SF

os.environ["TOKENIZERS_PARALLELISM"] = "false"
NAMES = ["\x1c", "\x1f", "\x85", " ", " ", " ", "　", "​", "﻿", "̱", "́", "'", "<|endoftext|>", "<|startoftext|>", "<", "İ", "Σ", "ſ", "K", "½", "٣", "漢", "😀"]
SPACES = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(tier_packing.VOCABULARY))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, tier_packing.END]


@pytest.fixture(scope="module")
def words():
    return tier_packing.WordIds(tier_packing._found(tier_packing.VOCABULARY))


def ids_of(words, text):
    return np.frombuffer(words.encode([text.encode()])[0], "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=6), st.sampled_from(NAMES), st.sampled_from(SPACES), st.sampled_from(["It's", "we'll", "HX", "ẖx", "H̱", "a.b,c", "42.5%", "Ünder", "x_y", "[A]", "don't."])), max_size=12))
def test_ids_by_words_are_those_of_the_whole_text(plain, words, parts):
    text = "".join(parts).replace("\ud800", "")
    assert ids_of(words, text) == plain(text)


def test_every_white_space_and_mark(plain, words):
    for c in range(0x3100):
        if not 0xD800 <= c < 0xE000:
            for text in (f"ab{chr(c)}cd", f"H{chr(c)}. X{chr(c)} y", f"{chr(c)}{chr(c)}"):
                assert ids_of(words, text) == plain(text), hex(c)


def test_every_letter_of_the_direct_way(plain, words):
    for c in range(0x24F + 1):
        if chr(c).isalpha():
            for text in (chr(c), f"a{chr(c)}b {chr(c).upper()}X{chr(c)}", f"{chr(c)}."):
                assert ids_of(words, text) == plain(text), hex(c)


def test_small_stores_change_nothing(plain, monkeypatch, spark):
    monkeypatch.setattr(tier_packing, "WORDS_KEPT", 10)
    monkeypatch.setattr(tier_packing, "PARTS_KEPT", 5)
    small = tier_packing.WordIds(tier_packing._found(tier_packing.VOCABULARY))
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(30).collect()]
    for k in range(0, 30, 5):
        for got, t in zip(small.encode([t.encode() for t in texts[k : k + 5]]), texts[k : k + 5]):
            assert np.frombuffer(got, "<u4").tolist() == plain(t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_windows_are_full_and_hold_every_token_once(lengths):
    tiers = (8, 16, 32, 64)
    windows, left = tier_packing.pack_rests([(n, k, 100) for k, n in enumerate(lengths)], tiers)
    assert sum(n for n, _, _ in left) < tiers[0]
    windows += tier_packing.last_windows(left)
    seen = defaultdict(list)
    for tier, pieces in windows:
        assert tier & (tier - 1) == 0 and sum(n for _, _, n in pieces) == tier
        for doc, start, n in pieces:
            seen[doc].append((start, n))
    for k, n in enumerate(lengths):
        at = 100
        for start, m in sorted(seen[k]):
            assert start == at and m > 0
            at += m
        assert at == 100 + n


def checked(rows, texts, plain):
    """Every id in one piece, sequences gapless, lengths powers of two; texts: {id: [text...]}."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.id].append(r)
        sequences[r.sequence_id].append(r)
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == held[0].tier and at & (at - 1) == 0 and at <= 2048 and len({r.step for r in held}) == 1
    assert set(pieces) == set(texts)
    for doc, found in texts.items():
        if len(found) == 1:
            ids, at = np.array(plain(found[0]), "<u4"), 0
            for r in sorted(pieces[doc], key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
        else:
            assert sum(r.length for r in pieces[doc]) == sum(len(plain(t)) for t in found)
    return sequences


def test_query(spark, plain):
    rows = queries.op11_tier_packing(spark, SF).withColumnRenamed("doc_id", "id").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sequences = checked(rows, {d.doc_id: [d.text] for d in docs}, plain)
    assert sum(len(s) == 0 or s[0].tier < 256 for s in sequences.values()) <= 8  # one task
    assert {s[0].tier for s in sequences.values()} >= {512, 1024, 2048}  # the shortest rests fill gaps of these


def test_steps_have_even_shares(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    rows = tier_packing.pack_tiers(docs, tier_packing.VOCABULARY, step_tokens=20_000).collect()
    steps, all_steps = defaultdict(set), {r.step for r in rows}
    for r in rows:
        steps[r.tier, r.step].add(r.sequence_id)
    assert len(all_steps) > 3
    for tier in {r.tier for r in rows}:
        n = [len(steps[tier, s]) for s in all_steps]
        assert max(n) - min(n) <= 1


def test_ids_on_request(spark, plain):
    docs = spark.createDataFrame([(1, "Hello there, world")], "doc_id long, text string")
    rows = tier_packing.pack_tiers(docs, tier_packing.VOCABULARY, with_ids=True).collect()
    assert [i for r in sorted(rows, key=lambda r: r.start) for i in r.ids] == plain("Hello there, world")


def test_odd_input(spark, plain):
    frame = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "start", "length", "tier", "step", "part", "nth", "ids")})
    rows = tier_packing.pack_tiers(frame, tier_packing.VOCABULARY).collect()
    texts = defaultdict(list)
    for doc, text, *_ in ODD:
        texts[doc].append(text)
    checked(rows, texts, plain)


def test_empty_table_and_wrong_sizes(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert tier_packing.pack_tiers(none, tier_packing.VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        tier_packing.pack_tiers(none, tier_packing.VOCABULARY, tiers=(100, 200))
