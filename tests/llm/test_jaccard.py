import random
import re

import numpy as np
import pytest

from stackwise.llm import jaccard as J
from stackwise.llm import textscan as TS
from stackwise.llm.components import components

from .conftest import SPACES, lower


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = SPACES.findall(lower(t))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(ids[a]), find(ids[b])))
                parent[q] = p
    least = {}
    for i in ids:
        least[find(i)] = min(least.get(find(i), i), i)
    return {i: (len(sets[i]), least[find(i)]) for i in ids}


@pytest.mark.parametrize("k,percent,cell", [(4, 85, 256), (5, 80, 5), (2, 60, 256)])
def test_components_equal_brute_force(make_docs, corpus, monkeypatch, k, percent, cell):
    monkeypatch.setattr(J, "CELL_ROWS", cell)  # many small cells give the same links
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(make_docs(corpus), words=k, percent=percent).collect()}
    assert got == brute(corpus, k, percent)


def test_repeated_and_null_ids_and_empty_table(make_docs, spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, ""), (7, None), (None, None), (9, "x y")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(make_docs(rows)).collect()), key=str)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (7, 0, 7), (7, 0, 7), (None, 0, None), (9, 1, 9)], key=str)
    assert J.jaccard_components(make_docs([])).count() == 0


def test_cell_product_keeps_every_component():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[:rng.integers(240, 300)], rng.integers(0, 1 << 60, 5, dtype=np.uint64)])) for _ in range(60)]
    links = {(i, j) for i in range(60) for j in range(i + 1, 60)
             if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}

    def parts(edges):
        p = list(range(60))
        for a, b in edges:
            x, y = p[a], p[b]
            p = [x if v == y else v for v in p]
        return {frozenset(i for i in range(60) if p[i] == v) for v in set(p)}

    got = J.linked_pairs(sets, np.zeros(60), 85)
    assert len(got) < len(links) and set(map(lambda e: tuple(sorted(e)), got)) <= links and parts(got) == parts(links)
    side = np.array([1] * 30 + [2] * 30)
    assert parts(J.linked_pairs(sets, side, 85)) == parts({e for e in links if e[0] < 30 <= e[1]})


def test_profiles_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n, m, k = rng.integers(1, 400, 3)
        base = rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2)
        x, y = (np.unique(np.concatenate([base, rng.integers(0, 1 << 63, v, dtype=np.uint64) * np.uint64(2)])) for v in (n, m * 5))
        assert J.least_difference(J._profile(x), J._profile(y)) <= len(np.setxor1d(x, y))
    assert J.least_difference(J._profile(x), J._profile(x)) == 0


def test_star_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 50)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


def test_words_of_all_separators_and_long_words():
    texts = ["a\tb\x0bc\x0c d\re", "", "ÀÉ x", "q" * 3_000_000 + " tail", " x y"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    s, e, h, first = TS.scan_words(np.frombuffer(b"".join(raw), np.uint8), off, TS.SPACES)
    data = b"".join(raw)
    got = [[data[s[j]:e[j]].decode() for j in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    again = TS.scan_words(np.frombuffer(b"tail Tail", np.uint8), np.array([0, 9]), TS.SPACES)[2]
    assert again[0] == again[1] == h[first[3] + 1]
