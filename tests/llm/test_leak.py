import random

import pytest

from tidemark.llm.leak import MASKS, PLANE, SPAN, leak_hits, leaks
from tidemark.llm.look import words

DOCS = "doc_id long, text string, item_id long, run_words long"
ITEMS = "item_id long, text string, doc_id long"


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 7, 7) for i, t in docs], DOCS)
    e = spark.createDataFrame([(i, t, 7) for i, t in items], ITEMS)
    return {(r["doc_id"], r["item_id"]): (r["run_words"], r["windows"], r["changes"]) for r in leaks(d, e, **options).collect()}


def longest(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def made(seed):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(100 + i, " ".join(random.choices(vocabulary, k=random.choice([5, 13, 20, 40])))) for i in range(12)]
    items += [(200, items[3][1]), (201, None), (202, ""), (203, items[4][1].upper())]
    docs = []
    for i in range(80):
        t = random.choices(vocabulary, k=random.randrange(0, 60))
        for _ in range(random.randrange(3)):
            part = words(random.choice(items[:12])[1])
            a = random.randrange(len(part))
            part = part[a:a + random.randrange(8, 30)]
            if random.random() < .3 and len(part) > 2:
                part[random.randrange(len(part))] = "changed"
            at = random.randrange(len(t) + 1)
            t[at:at] = part
        docs.append((i, random.choice([" ", "\n+ ", "_", " ​-"]).join(t)))
    return docs + [(900, None), (901, ""), (902, "​")], items


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"masks": PLANE})])
def test_exact_runs_against_brute_force(spark, seed, options):
    docs, items = made(seed)
    want = {}
    for d, t in docs:
        for i, e in items:
            n = longest(words(t or ""), words(e or ""))
            if n >= SPAN:
                want[d, i] = n
    got = run(spark, docs + docs[:5], items + items[:2], **options)
    assert {k: v[0] for k, v in got.items() if v[0] >= SPAN} == want
    assert all(v[0] == 0 or v[0] >= SPAN for v in got.values()) and all(v[2] == (0 if v[0] else 1) for v in got.values())


def test_windows_with_one_change_are_found(spark):
    docs, items = made(3)
    got = run(spark, docs, items)
    for d, t in docs:
        for i, e in items:
            a, b = words(t or ""), words(e or "")
            near = sum(sum(x != y for x, y in zip(a[p:p + SPAN], b[q:q + SPAN])) <= 1 for p in range(len(a) - SPAN + 1) for q in range(len(b) - SPAN + 1))
            assert got.get((d, i), (0, 0, 0))[1] == near


@pytest.mark.parametrize("changes,least", [(2, 1.0), (3, 0.15), (4, 0.0)])
def test_recall_for_changed_words(spark, changes, least):
    """A window of 13 words with so many others: two are always found by the plane's masks, more by chance."""
    random.seed(changes)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(SPAN))) for i in range(300)]
    docs = []
    for i, text in items:
        ws = text.split()
        for at in random.sample(range(SPAN), changes):
            ws[at] = f"other{at}"
        docs.append((i, " ".join(["before", *ws, "after"])))
    got = run(spark, docs, items, changed=changes, masks=PLANE)
    assert all(d == i and v[2] == changes for (d, i), v in got.items())
    assert len(got) / 300 >= least
    print(changes, len(got) / 300)


def test_extent_goes_on_across_changes(spark):
    ws = [f"w{i}" for i in range(60)]
    changed = [("x" if i in (14, 30, 31) else w) for i, w in enumerate(ws)]
    d = spark.createDataFrame([(1, "a b c " + " ".join(changed) + " d")], "doc_id long, text string")
    e = spark.createDataFrame([(7, " ".join(ws))], "item_id long, text string")
    r = leaks(d, e, changed=2, masks=PLANE).first()
    assert (r["run_words"], r["extent"], r["changes"]) == (28, 60, 0)


def test_phrase_that_all_items_share(spark):
    phrase = " ".join(f"s{i}" for i in range(15))
    items = [(i, f"{phrase} own{i}") for i in range(200)]
    d = spark.createDataFrame([(i, f"intro {phrase} end {i}") for i in range(150)], "doc_id long, text string")
    hits = leak_hits(d, spark.createDataFrame(items, "item_id long, text string"))
    assert hits.count() == 200 * 150 * 3 and hits.select("doc_id", "item_id").distinct().count() == 200 * 150


def test_changed_form_of_a_passage(spark):
    item = "The büffer of relay must Seal its ledger before any noisy Worker drains file nine Тест"
    doc = "+The_büffer OF\n+ｒelay must se­al its lеdger; before any noisy worker drains ﬁle nine ТЕСТ -- end"
    assert run(spark, [(1, doc), (2, doc.replace("any", "any more"))], [(5, item)])[1, 5][0] == 16
    assert (2, 5) not in {k for k, v in run(spark, [(2, doc.replace("any", "any more"))], [(5, item)]).items() if v[0]}


def test_hot_passage_in_a_very_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    docs = [(1, "x " * 300_000 + passage + " y" * 300_000), (2, (passage + " ") * 2000)] + [(i, passage) for i in range(10, 200)]
    got = run(spark, docs, [(1, passage), (2, passage)])
    assert set(got) == {(d, i) for d, _ in docs for i in (1, 2)} and all(v[0] == 14 for v in got.values())


def test_empty_sides_and_masks(spark):
    assert run(spark, [], [(1, "a " * 20)]) == {} == run(spark, [(1, "a " * 20)], [])
    assert all(any(p not in m for m in MASKS) for p in range(SPAN))
    with pytest.raises(ValueError):
        run(spark, [], [], span=5)
