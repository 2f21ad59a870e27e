"""The pipeline against its stages' plain rules, and the queries against their SQL."""

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from skyaccord.llm import decontam, quality_fm, queries, secrets  # noqa: E402
from tests.llm.test_llm_operators import brute_contamination, check_packing  # noqa: E402
from tests.llm.test_similar import brute_groups  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_rules(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == docs.columns
            kept[name] = {r.doc_id: r for r in after.collect()}
            now = kept[name]
        if k == 0:
            fm = quality_fm.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(now) == {r.id for r in quality_fm.score(docs, fm).collect() if r.score >= 0.3}
        elif k == 1:
            ordered = sorted(before.values(), key=lambda r: r.doc_id)
            groups = brute_groups([r.text for r in ordered])  # five words, similarity 0.8; the least id stays
            assert set(now) == {ordered[i].doc_id for i in set(groups)} and len(now) < len(before)
        elif k == 2:
            items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want = set()
            for r in before.values():
                n, hit, _ = brute_contamination(r.text, items)
                if not (hit > 0 and 20 * hit >= n):
                    want.add(r.doc_id)
            assert set(now) == want
        elif k == 3:
            assert set(now) == set(before)
            for i, r in before.items():
                assert (now[i].text == r.text) == (not secrets.find_spans(r.text))
        else:
            check_packing(after.withColumnRenamed("doc_id", "id").collect(), {i: len(r.text.encode()) for i, r in before.items()}, 8192)
        docs = after


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns[0] == "doc_id"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    got = queries.queries()[name](spark, SF).select(*names).collect()
    assert sorted(repr(tuple(r)) for r in got) == want


def test_every_operator_has_one_query():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert decontam.WINDOW == 13


def test_secret_sql_agrees_on_odd_texts():
    import pandas as pd

    texts = [
        None, "", "paſsword=abcdefgh toKEN: \"abc\" Password=1234567", "é\U0001f600token=token=token=abcdef, api_key: 'a' apikey=zzzzzz",
        "AKIA" + "A" * 16 + " AKIA12 " + "ab" * 12 + "x" + "0" * 23, "-----BEGIN RSA PRIVATE KEY----- AA　\x85\x1d\x0b==\n-----END RSA PRIVATE KEY-----x",
        "-----BEGIN PRIVATE KEY-----A​A-----END PRIVATE KEY-----", "secret:token=abc secret=password:abcdefgh", "a" * 24 + "g" + "b" * 30, "passwordpassword=======",
        "passwordpassword=======", "secret = \"" + "q" * 50_000 + "\"",
    ]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    got = sorted(con.execute(queries.oracle_sql()["op9_secrets"]).fetchall())
    for row, text in zip(got, texts, strict=True):
        spans = secrets.find_spans(text)
        counts = tuple(sum(s[0] == k for s in spans) for k in secrets.KINDS[:3])
        assert row[1:] == (*counts, secrets.brute_sha256(spans), ",".join(f"{k}:{s}:{e}" for k, s, e in spans))
