"""The stages one by one against brute force, and the registered queries against their SQL."""

import glob
import os

import duckdb
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline as cp
from quarryframe.llm import queries as qs
from quarryframe.llm.decontaminate import LeakConfig, normal_text
from tests.llm import helpers as hp

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = {r.doc_id: r.text for r in docs.collect()}
    items = [normal_text(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (_, stage) in enumerate(cp.STAGES):
        docs = cp.materialize(stage(spark, docs, SF), "test-stage")
        if k < 4:
            assert set(docs.columns) == set(cp.COLUMNS)
            now = {r.doc_id: r.text for r in docs.collect()}
        if k == 0:
            base = {i for i, t in held.items() if (q := hp.quality_base(t))[0] >= 50 and 2 * q[4] <= q[0]}
            assert set(now) <= base and len(now) > 0.8 * len(base)
        elif k == 1:
            want = hp.line_dedup(list(held.items()))
            assert now == {i: t for i, (n, gone, t) in want.items() if gone < n}
        elif k == 2:
            component, _ = hp.near_components(list(held.items()), 5, 80)
            assert now == {i: t for i, t in held.items() if component[i] == i}
        elif k == 3:
            rate = LeakConfig().rate
            leaked = {i for i, t in held.items() if any(x in (n := normal_text(t)) or (any(p in n for p in (x[:20], x[-20:])) and hp.edit_distance_inside(x, n) <= int(rate * len(x))) for x in items)}
            assert set(now) == set(held) - leaked
        else:
            model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            rows = docs.collect()
            assert {r.doc_id: r.ids for r in rows} == {i: model.encode(t) for i, t in held.items()} and all(r.round_trip for r in rows)
        held = now


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES], ids=[n for n, _ in cp.STAGES])
def test_stages_on_odd_and_no_rows(spark, odd_docs, no_docs, stage):
    last = stage is cp.STAGES[-1][1]
    none = stage(spark, no_docs, SF)
    assert none.collect() == [] and (last or none.columns == list(cp.COLUMNS))
    rows = stage(spark, odd_docs, SF).collect()
    ids = [r["doc_id"] for r in rows]
    if stage is cp.quality_stage:
        assert {0, 1, 2, 7, 8}.isdisjoint(ids)  # fewer words than the rules ask for
    elif stage is cp.near_stage:
        assert sorted(ids, key=str) == sorted([0, 1, 2, None, 3, 3, 4, 6, 7, 8], key=str)  # 5 is a copy of 4
        assert [r["text"] for r in rows if r["doc_id"] == 0] == [None]
    else:
        assert sorted(ids, key=str) == sorted((r["doc_id"] for r in odd_docs.collect()), key=str)


def test_no_text_goes_with_another_rows_copy(spark):
    docs = [(3, hp.prose(1, 90)), (5, hp.prose(1, 90)), (5, hp.prose(2, 90)), (6, hp.prose(1, 90)), (7, hp.prose(3, 90))]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in cp.near_stage(spark, frame, SF).collect()]
    assert {t for _, t in kept} == {t for _, t in docs} and sorted(i for i, _ in kept) == [3, 5, 5, 7]


@pytest.mark.parametrize("name", sorted(qs.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    got, want = qs.QUERIES[name](spark, SF), con.sql(qs.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", ["op3_language_id", "op4_toxicity", "op6_repeated_passages", "op10_decontamination"])
def test_queries_carry_ids(spark, name):
    assert dict(qs.QUERIES[name](spark, SF).dtypes)["doc_id"] == "bigint"
