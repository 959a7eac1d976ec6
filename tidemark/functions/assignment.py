"""Minimum-cost assignment: on a matrix of small integer costs, and on counted patterns of fields."""

from __future__ import annotations

import heapq
from itertools import combinations

import numpy as np


def weighted(differing, pairs: int, fields: int):
    """Cost of a pair by its differing fields: the total decides, then the sum of squares, so that few pairs differ in much."""
    return differing * (pairs * fields * fields + 1) + differing * differing


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, min(rows, columns) of them.

    Shortest augmenting paths with potentials; each step is one vector operation over the columns, the
    whole takes rows^2 of them. Among equal totals the result is fixed by the order of rows and columns.
    """
    n, m = cost.shape
    if n == 0 or m == 0:
        return []
    if n > m:
        return sorted((i, j) for j, i in assign(cost.T))
    cost = cost.astype(np.float64)
    row_pot, col_pot = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        best = np.full(m, np.inf)
        came = np.full(m, -1)
        done = np.zeros(m, bool)
        row, base, last = start, 0.0, -1
        visited_rows = [start]
        reach_row = {start: 0.0}
        while True:
            reduced = base + cost[row] - row_pot[row] - col_pot
            better = ~done & (reduced < best)
            best[better] = reduced[better]
            came[better] = last
            last = int(np.where(done, np.inf, best).argmin())
            base = best[last]
            done[last] = True
            if owner[last] < 0:
                break
            row = int(owner[last])
            reach_row[row] = base
            visited_rows.append(row)
        for r in visited_rows:
            row_pot[r] += base - reach_row[r]
        col_pot[done] -= base - best[done]
        j = last
        while j >= 0:
            k = int(came[j])
            owner[j] = start if k < 0 else owner[k]
            j = k
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0)


def assign_patterns(left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray) -> list[tuple[int, int, int]]:
    """Triples (left pattern, right pattern, times) of least ``weighted`` cost in total.

    A pattern is a row of tokens by field, -1 where the field agrees with nothing on the other side, and
    stands for as many rows as counted; min(rows left, rows right) are paired. Each set of agreeing fields
    and their tokens is a hub between the patterns that have them, so the network grows with the patterns,
    not with their pairs. Shortest paths come in few lengths, as the last pair costs no more than all fields
    do; for each length a maximum flow over the tight arcs is added.
    """
    n, m, fields = len(left), len(right), left.shape[1]
    if n == 0 or m == 0:
        return []
    most, source, sink, nodes = int(min(n_left.sum(), n_right.sum())), n + m, n + m + 1, n + m + 2
    parts = [(np.full(n, source), np.arange(n), n_left, 0), (n + np.arange(m), np.full(m, sink), n_right, 0)]
    first_hub = nodes
    for size in range(fields, -1, -1):
        for agree in map(list, combinations(range(fields), size)):
            i, j = np.flatnonzero((left[:, agree] >= 0).all(1)), np.flatnonzero((right[:, agree] >= 0).all(1))
            if len(i) == 0 or len(j) == 0:
                continue
            code = np.unique(np.concatenate([left[i][:, agree], right[j][:, agree]]), axis=0, return_inverse=True)[1].ravel() if size else np.zeros(len(i) + len(j), np.int64)
            a, b = code[: len(i)], code[len(i) :]
            shared = np.intersect1d(a, b)
            keep_a, keep_b = np.isin(a, shared), np.isin(b, shared)
            parts.append((i[keep_a], nodes + np.searchsorted(shared, a[keep_a]), np.full(keep_a.sum(), most), weighted(fields - size, most, fields)))
            parts.append((nodes + np.searchsorted(shared, b[keep_b]), n + j[keep_b], np.full(keep_b.sum(), most), 0))
            nodes += len(shared)
    # arc 2e leads from tail to head, arc 2e + 1 back
    tails, heads = (np.concatenate([p[x] for p in parts]) for x in (0, 1))
    caps, costs = np.concatenate([p[2] for p in parts]), np.concatenate([np.full(len(p[0]), p[3]) for p in parts])
    flow = _least_cost_flow(np.stack([tails, heads], 1).ravel(), np.stack([heads, tails], 1).ravel(), np.stack([caps, 0 * caps], 1).ravel(), np.stack([costs, -costs], 1).ravel(), nodes, source, sink)
    into, out = {}, {}
    for e in np.flatnonzero(flow):
        v, w = int(tails[e]), int(heads[e])
        if w >= first_hub:
            into.setdefault(w, []).append([v, int(flow[e])])
        elif v >= first_hub:
            out.setdefault(v, []).append([w - n, int(flow[e])])
    found = []
    for hub, givers in into.items():
        takers = iter(out[hub])
        j, room = next(takers)
        for i, much in givers:
            while much:
                if not room:
                    j, room = next(takers)
                step = min(much, room)
                found.append((i, j, step))
                much, room = much - step, room - step
    return found


def _least_cost_flow(tail: np.ndarray, head: np.ndarray, cap: np.ndarray, cost: np.ndarray, nodes: int, source: int, sink: int) -> np.ndarray:
    """Flow by forward arc of a maximum flow of least cost; arc e ^ 1 is the reverse of arc e."""
    order = np.argsort(tail, kind="stable")
    start = np.searchsorted(tail[order], np.arange(nodes + 1)).tolist()
    arc, tail, head, room, cost = order.tolist(), tail.tolist(), head.tolist(), cap.tolist(), cost.tolist()
    height = [0] * nodes
    while True:
        # lengths of shortest paths over reduced costs; nodes of one length wait in one list
        far = [-1] * nodes
        waiting, lengths = {0: [source]}, [0]
        while lengths and far[sink] < 0:
            d = heapq.heappop(lengths)
            todo = waiting[d]
            for v in todo:
                if far[v] >= 0:
                    continue
                far[v] = d
                for x in range(start[v], start[v + 1]):
                    e = arc[x]
                    if room[e] and far[w := head[e]] < 0:
                        at = d + cost[e] + height[v] - height[w]
                        if at not in waiting:
                            waiting[at] = []
                            heapq.heappush(lengths, at)
                        waiting[at].append(w)
        if far[sink] < 0:
            break
        for v in range(nodes):
            height[v] += far[v] if 0 <= far[v] < far[sink] else far[sink]
        # a maximum flow over the tight arcs: breadth-first levels, then a blocking flow
        while True:
            level = [-1] * nodes
            level[source], line = 0, [source]
            for v in line:
                for x in range(start[v], start[v + 1]):
                    e = arc[x]
                    if room[e] and level[w := head[e]] < 0 and cost[e] + height[v] == height[w]:
                        level[w] = level[v] + 1
                        line.append(w)
            if level[sink] < 0:
                break
            at, path, v = start[:nodes], [], source
            while True:
                if v == sink:
                    much = min(room[e] for e in path)
                    for e in path:
                        room[e] -= much
                        room[e ^ 1] += much
                    cut = next(x for x, e in enumerate(path) if not room[e])
                    v = tail[path[cut]]
                    del path[cut:]
                while at[v] < start[v + 1]:
                    e = arc[at[v]]
                    if room[e] and level[w := head[e]] == level[v] + 1 and cost[e] + height[v] == height[w]:
                        break
                    at[v] += 1
                else:
                    if v == source:
                        break
                    v = tail[path.pop()]
                    at[v] += 1
                    continue
                path.append(e)
                v = w
    return np.array(room[1::2])
