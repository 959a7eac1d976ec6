from tidemark.llm.look import same_look
from tidemark.llm.lookalike import confusable_tokens, consistent_text, lookalike_classes, lookalike_pairs

SCHEMA = "doc_id long, text string, look string, n long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], SCHEMA)


def brute(texts):
    return {(i, j) for i, a in texts for j, b in texts if i < j and a and b and a != b and same_look(a) == same_look(b)}


def test_pairs_against_brute_force(spark):
    forms = ["paypal", "рaypal", "pаypal", "ｐaypal", "pay​pal"]
    texts = [(i, forms[i % 5] + " x" * (i % 3)) for i in range(60)] + [(100, None), (101, ""), (102, "​"), (103, "﻿"), (104, "é" * 50_000), (105, "é" * 50_000), (106, "E")]
    for block in (1000, 4):
        got = [tuple(r) for r in lookalike_pairs(frame(spark, texts + texts[:7]), block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(texts)


def test_hot_text_with_one_double(spark):
    texts = [(i, "merge") for i in range(500)] + [(1000, "mergе")] + [(2000 + i, f"own {i}") for i in range(50)]
    got = {tuple(r) for r in lookalike_pairs(frame(spark, texts), block=50).collect()}
    assert got == {(i, 1000) for i in range(500)}


def test_empty_table_and_forms(spark):
    assert lookalike_pairs(frame(spark, [])).count() == 0
    rows = consistent_text(frame(spark, [(1, None), (2, ""), (3, "ＯＫ")])).orderBy("doc_id").collect()
    assert [r["form"] for r in rows] == [None, "", "OK"] and rows[0]["look"] == "clash"


def test_classes_say_what_the_pairs_say(spark):
    forms = ["paypal", "рaypal", "pаypal", "ｐaypal", "pay​pal"]
    texts = [(i, forms[i % 5] + " x" * (i % 3)) for i in range(60)] + [(100, None), (101, ""), (106, "E"), (107, "same"), (108, "same")] + [(200 + i, "merge") for i in range(300)] + [(999, "mergе")]
    pairs, want = brute(texts), {}
    for a, b in pairs:
        for x in (a, b):
            want[x] = want.get(x, 0) + 1
    got = {r["doc_id"]: r for r in lookalike_classes(frame(spark, texts + texts[:9])).collect()}
    assert {d: r["links"] for d, r in got.items()} == want
    assert all(got[a]["class_id"] == got[b]["class_id"] <= a for a, b in pairs) and got[999]["texts"] == 2 and lookalike_classes(frame(spark, [])).count() == 0


def test_confusable_tokens(spark):
    rows = confusable_tokens(frame(spark, [(1, "pаypal pаypal ok"), (2, "сор, привет pаypal"), (3, None), (4, "")]))
    assert {(r["token"], r["kind"], r["form"], r["n"]) for r in rows.collect()} == {("pаypal", "mixed", "paypal", 3), ("сор", "whole", "cop", 1)}
