import itertools
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.functions.assignment import assign, assign_patterns, weighted
from tidemark.operators.difference import diff_copies

SCHEMA = "k string, a string, b int, c binary, extra string, __k string"


def frame(spark, rows):
    return spark.createDataFrame([(k, a, b, c, "x", "y") for k, a, b, c in rows], SCHEMA)


def test_assignment_is_least():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = rng.integers(0, 5, 2).tolist()
        cost = rng.integers(0, 4, (n, m))
        pairs = assign(cost)
        assert len(pairs) == min(n, m) and len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})
        small, large = (n, m) if n <= m else (m, n)
        c = cost if n <= m else cost.T
        best = min((sum(c[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small)), default=0)
        assert sum(cost[i, j] for i, j in pairs) == best


def brute(left, right):
    """Rows of the result by key: least number of differing fields over all pairings."""
    total = {}
    for key in {r[0] for r in left} | {r[0] for r in right}:
        a = list((Counter(r[1:] for r in left if r[0] == key) - Counter(r[1:] for r in right if r[0] == key)).elements())
        b = list((Counter(r[1:] for r in right if r[0] == key) - Counter(r[1:] for r in left if r[0] == key)).elements())
        if len(a) > len(b):
            a, b = b, a
        if a or b:
            cost = min(sum(sum(x != y for x, y in zip(a[i], b[p[i]])) for i in range(len(a))) for p in itertools.permutations(range(len(b)), len(a)))
            total[key] = (len(a), len(b) - len(a), cost)
    return total


def summed(rows):
    got = {}
    for r in rows:
        pairs, single, cost = got.get(r["k"], (0, 0, 0))
        if r["kind"] == "changed":
            assert r["diff"] == [f for f in ("a", "b", "c") if r["l"][f] != r["r"][f]] and r["diff"]
            got[r["k"]] = (pairs + 1, single, cost + len(r["diff"]))
        else:
            assert (r["l"] is None) == (r["kind"] == "only_right") and (r["r"] is None) == (r["kind"] == "only_left")
            got[r["k"]] = (pairs, single + 1, cost)
    return got


def test_against_all_pairings(spark):
    random.seed(3)
    draw = lambda: (random.choice(["p", "q", "r", None, ""]), random.choice(["", "x", None]), random.choice([1, 2, None]), random.choice([b"", b"\x00", None]))
    left, right = [draw() for _ in range(24)], [draw() for _ in range(22)]
    got = summed(diff_copies(frame(spark, left), frame(spark, right), "k", ["a", "b", "c"]).collect())
    assert got == brute(left, right)


def test_many_leftovers_lose_no_row(spark):
    random.seed(4)
    left = [("hot", str(i % 50), i % 3, bytes([i % 7])) for i in range(300)] + [("cold", "a", 1, b"")]
    right = [("hot", str(i % 60), i % 4, bytes([i % 5])) for i in range(280)] + [("cold", "b", 1, b"")]
    rows = diff_copies(frame(spark, left), frame(spark, right), "k", ["a", "b", "c"], exact_limit=20).collect()
    plain = lambda s: tuple(bytes(x) if isinstance(x, bytearray) else x for x in s)
    hot = [r for r in rows if r["k"] == "hot"]
    a, b = Counter(r[1:] for r in left if r[0] == "hot"), Counter(r[1:] for r in right if r[0] == "hot")
    assert Counter(plain(r["l"]) for r in hot if r["l"]) == a - b
    assert Counter(plain(r["r"]) for r in hot if r["r"]) == b - a
    assert all(len(r["diff"]) < 3 for r in hot if r["kind"] == "changed")
    assert [(r["kind"], r["diff"]) for r in rows if r["k"] == "cold"] == [("changed", ["a"])]


@pytest.mark.parametrize("left,right,want", [([], [], []), ([("k", "a", 1, b"")], [], [("k", "only_left")]), ([], [(None, None, None, None)] * 2, [(None, "only_right")] * 2)])
def test_empty_sides(spark, left, right, want):
    rows = diff_copies(frame(spark, left), frame(spark, right), "k", ["a", "b", "c"]).collect()
    assert [(r["k"], r["kind"]) for r in rows] == want


def test_equal_copies_in_other_order(spark):
    rows = [(str(i % 5), "v", i, b"z") for i in range(40)]
    assert diff_copies(frame(spark, rows), frame(spark, rows[::-1]), "k", ["a", "b", "c"]).count() == 0


def test_no_fields(spark):
    with pytest.raises(ValueError):
        diff_copies(frame(spark, []), frame(spark, []), "k", [])


def test_patterns_cost_what_their_rows_cost():
    rng = np.random.default_rng(2)
    for _ in range(300):
        fields = int(rng.integers(1, 5))
        n, m, top = *rng.integers(0, 7, 2).tolist(), int(rng.integers(1, 5))
        left, right = (np.unique(rng.integers(-1, top, (k, fields)), axis=0) for k in (n, m))
        n_left, n_right = rng.integers(1, 6, len(left)), rng.integers(1, 6, len(right))
        cost = ((left[:, None] != right[None]) | (left[:, None] < 0)).sum(2)
        got = assign_patterns(left, n_left, right, n_right)
        used_l, used_r = np.zeros(len(left), int), np.zeros(len(right), int)
        for i, j, k in got:
            used_l[i] += k
            used_r[j] += k
        assert (used_l <= n_left).all() and (used_r <= n_right).all() and used_l.sum() == min(n_left.sum(), n_right.sum()) * (len(left) > 0 < len(right))
        rows = np.repeat(np.repeat(cost, n_left, 0), n_right, 1)
        least, even = assign(rows), assign(weighted(rows, min(rows.shape), fields))
        assert sum(cost[i, j] * k for i, j, k in got) == sum(rows[i, j] for i, j in least) == sum(rows[i, j] for i, j in even)
        assert sum(cost[i, j] ** 2 * k for i, j, k in got) == sum(rows[i, j] ** 2 for i, j in even)


@pytest.mark.parametrize("n", [128, 129])
def test_rows_that_agree_in_nothing_meet_at_any_size(spark, n):
    left = [("hot", "x", 1, b"l")] + [("hot", "l", i, b"same") for i in range(10, n // 2 + 9)]
    right = [("hot", "y", 2, b"r")] + [("hot", "r", i, b"same") for i in range(10, n // 2 + 9)] + [("hot", "y", 3, b"r")] * (n % 2)
    rows = diff_copies(frame(spark, left), frame(spark, right), "k", ["a", "b", "c"]).collect()
    assert Counter((r["kind"], len(r["diff"])) for r in rows) == Counter({("changed", 1): n // 2 - 1, ("changed", 3): 1, **({("only_right", 3): 1} if n % 2 else {})})


def test_many_leftovers_cost_the_least(spark):
    random.seed(5)
    draw = lambda n: [(k, random.choice(["p", "q", "r", None]), random.choice([1, 2, 3, None]), random.choice([b"", b"\x00", bytes([i % 90])])) for k in ("h", None) for i in range(n)]
    left, right = draw(150), draw(130)
    exact = summed(diff_copies(frame(spark, left), frame(spark, right), "k", ["a", "b", "c"], exact_limit=1000).collect())
    assert summed(diff_copies(frame(spark, left), frame(spark, right), "k", ["a", "b", "c"], exact_limit=20).collect()) == exact


def test_one_row_a_hundred_thousand_times(spark):
    left = spark.range(100_000).selectExpr("'hot' as k", "'same' as a", "1 as b", "binary('') as c").unionByName(frame(spark, [("hot", "z", 2, b"q")]).select("k", "a", "b", "c"))
    right = frame(spark, [("hot", "same", 2, b"")] * 3)
    rows = diff_copies(left, right, "k", ["a", "b", "c"])
    assert {(r["kind"], tuple(r["diff"])): r["count"] for r in rows.groupBy("kind", "diff").count().collect()} == {("changed", ("b",)): 3, ("only_left", ("a", "b", "c")): 99_998}
