"""The text queries on the smallest test tables against plain Python."""

import os

import pytest

from tidemark.llm import problems
from tidemark.llm.look import same_look, words

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def test_p7(spark, docs):
    grams = {}
    for r in spark.read.parquet(f"{DATA}/eval_items.parquet").collect():
        w = words(r["text"] or "")
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k:k + 13]), set()).add(r["item_id"])
    want = set()
    for d, t in docs.items():
        w = words(t or "")
        for k in range(len(w) - 12):
            want |= {(d, i) for i in grams.get(tuple(w[k:k + 13]), ())}
    rows = problems.p7_found(spark, DATA)
    assert rows.dtypes == [("doc_id", "bigint"), ("item_id", "bigint")]
    assert sorted(map(tuple, rows.collect())) == sorted(want)
    items = {r["item_id"]: r["docs"] for r in problems.p7_items(spark, DATA).collect()}
    assert len(items) == 246 and sum(items.values()) == len(want)


def test_p8(spark, docs):
    forms = {}
    for d, t in docs.items():
        if t:
            forms.setdefault(same_look(t), []).append(d)
    want = {(min(a, b), max(a, b)) for ds in forms.values() for a in ds for b in ds if docs[a] != docs[b]}
    rows = problems.p8_found(spark, DATA)
    assert rows.dtypes == [("doc_id_a", "bigint"), ("doc_id_b", "bigint")] and sorted(map(tuple, rows.collect())) == sorted(want)
    assert {r["doc_id"]: r["form"] for r in problems.p8_forms(spark, DATA).collect()} == {d: t and same_look(t) for d, t in docs.items()}


def test_p6(spark, docs):
    rows = problems.p6_ids(spark, DATA)
    assert rows.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = {r["doc_id"]: r["ids"] for r in rows.collect()}
    assert got.keys() == docs.keys() and all((got[d] == []) == (not t) for d, t in docs.items())
    totals = problems.p6_totals(spark, DATA).collect()
    assert sum(r["tokens"] for r in totals) == sum(map(len, got.values())) and sum(r["docs"] for r in totals) == len(docs)
