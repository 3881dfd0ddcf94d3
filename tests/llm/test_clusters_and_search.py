"""Bit-plane clustering, lexical search and exact top-k search against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from costproof.llm import bitplane_clustering as BC
from costproof.llm import cover_trees, lexical_search, vector_search

VECTORS = "vec_id long, embedding array<float>, label int, id long, cell int, v string, planes string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 3, 9, 9, "x", "y") for i, v in rows], VECTORS)


def embedded(seed, n, dim=64, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32) * 0.2
    x[n - copies :] = x[0]
    return [(i, row.tolist()) for i, row in enumerate(x)]


# ---------------------------------------------------------------- clusters


@pytest.mark.parametrize("values", [[[0, 0], [-1, 1]], [[5, -8], [7, -1]], [[-(1 << 29), 3], [(1 << 29) - 1, -4]]])
def test_planes_give_numbers_products_and_squares_back(values):
    v = np.array(values)
    planes = BC.pack(v)
    assert BC.unpack(planes)[:, : v.shape[1]].tolist() == v.tolist()
    assert BC.unpack(BC.widened(planes, planes.shape[1] + 3))[:, : v.shape[1]].tolist() == v.tolist()
    assert BC.products(planes, BC.pack(v[:1])).tolist() == (v @ v[:1].T).tolist()
    assert BC.squares(planes).tolist() == (v * v).sum(axis=1).tolist()


def plain_clusters(rows, k, rounds):
    points = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    digest = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centers = [v for _, v in sorted(points, key=lambda p: (digest(p[0]), p[1]))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(centers)), key=lambda c: (apart(v, centers[c]), c))
    for _ in range(rounds):
        label = [near(v) for _, v in points]
        for c in range(len(centers)):
            mine = [v for (_, v), own in zip(points, label) if own == c]
            if mine:
                centers[c] = [sum(col) // len(mine) for col in zip(*mine)]
    return sorted((i, near(v), apart(v, centers[near(v)]), centers[near(v)]) for i, v in points)


def test_clusters_equal_the_plain_rounds(spark):
    rows = embedded(1, 150, copies=40) + [(7, [0.5] * 64), (7, [0.5] * 64)]
    odd = [(900, None), (901, []), (902, [0.1] * 63), (903, [None] + [0.1] * 63), (904, [float("nan")] + [0.1] * 63),
           (905, [float("-inf")] + [0.1] * 63), (906, [3e38] * 64)]
    got = BC.cluster(vectors(spark, rows + odd)).collect()
    want = plain_clusters(rows, 16, 3)
    assert sorted((r["vec_id"], r["cluster"], r["distance"], r["centroid"]) for r in got) == want
    assert {r["inertia"] for r in got} == {sum(w[2] for w in want)}
    for r in got:
        assert r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"])


def test_clusters_of_few_none_and_unnamed_vectors(spark):
    rows = embedded(2, 5) + [(None, [1.0] * 64)]
    got = BC.cluster(vectors(spark, rows)).collect()
    assert len(got) == 6 and len({r["cluster"] for r in got}) == 6 and {r["inertia"] for r in got} == {0}
    assert BC.cluster(vectors(spark, [(1, None)])).collect() == []
    assert BC.cluster(vectors(spark, rows), k=2).where("vec_id IS NULL").count() == 1


# ---------------------------------------------------------------- lexical search

TEXTS = "doc_id long, text string, item string, terms string, n long"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORDS.findall(lower)


def plain_search(docs, items, k):
    held = [(i, words(t)) for i, t in docs if words(t)]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    out = []
    for item, text in items:
        scored = []
        for doc, w in held:
            m, score = 50 + (50 * len(w) * n_docs) // n_terms, 0
            for term in set(words(text)):
                df, tf = sum(term in x for _, x in held), w.count(term)
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                score += weight * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.5)) % 60}" for _ in range(400)] + ["Ünï", "Ä9", "né"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 4, 30, 200))))) for i in range(120)]
    docs += [(i, docs[3][1]) for i in range(200, 260)] + [(None, docs[3][1]), (5, docs[3][1].upper())]
    docs += [(300, None), (301, ""), (302, "!?\x00 \t"), (303, "W1," * 40000), (304, "x" * 3_000_000)]
    items = [(f"i{j}", " ".join(rng.choice(vocabulary) for _ in range(12))) for j in range(8)]
    return docs, items + [("none", None), ("empty", " ,. "), (None, "w1 né"), ("i0", "w1 W2 w2"), ("absent", "zzz")]


def test_search_equals_scoring_every_document(spark, monkeypatch):
    docs, items = corpus(3)
    d = spark.createDataFrame([(i, t, "q", "q", 1) for i, t in docs], TEXTS)
    q = spark.createDataFrame(items, "item_id string, text string")
    key = lambda rows: sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows), key=str)
    want = plain_search(docs, items, 10)
    assert key(lexical_search.search(d, q, k=10).collect()) == want
    # Several shards of items, and several trees and blocks in a task, give the same.
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 60)
    monkeypatch.setattr(lexical_search, "GROUP_TERMS", 9)
    monkeypatch.setattr(lexical_search, "CELLS", 400)
    assert key(lexical_search.search(d, q, k=10).collect()) == want
    assert lexical_search.search(d.limit(0), q).collect() == [] == lexical_search.search(d, q.limit(0)).collect()


@pytest.mark.parametrize("leaf", [1, 3, 50])
def test_tree_bounds_hold_and_no_document_is_lost(leaf):
    rng = np.random.default_rng(leaf)
    tf = rng.poisson(0.4, size=(300, 40)).astype(np.int32)
    tf[100:180] = tf[100]
    m = rng.integers(50, 400, 300)
    tree = lexical_search.Tree(tf, m, np.arange(300), np.zeros(300, bool), leaf)
    assert sorted(tree.ids.tolist()) == list(range(300))
    for node, (lo, hi) in enumerate(tree.spans):
        assert (tree.most[node] == tree.tf[lo:hi].max(axis=0)).all() and tree.least_m[node] == tree.m[lo:hi].min()
    columns, weights = np.array([1, 5, 17, 39]), np.array([3, 900, 20, 1])
    best = lexical_search.Best(20)
    tree.search(columns, weights, best)
    scores = lexical_search.parts(tf[:, columns], m) @ weights
    want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if s > 0)[:20]
    assert [(-s, i) for s, i in zip(best.scores.tolist(), best.ids.tolist())] == want


# ---------------------------------------------------------------- exact top-k


def plain_top(rows, asks, k):
    points = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows)]
    out = []
    for n, i, v in points:
        if i is not None and asks(i):
            scored = [(-sum(a * b for a, b in zip(v, u)), j is None, j or 0, j) for p, j, u in points if p != n and len(u) == len(v)]
            out += [(i, rank, j, -s) for rank, (s, _, _, j) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk, block", [(8192, 16384), (40, 5)])
def test_top_k_equals_all_products(spark, chunk, block):
    rows = embedded(5, 260, dim=12, copies=90) + [(i, [0.1 * i] * 3) for i in range(20)] + [(30, [9.0] * 3), (30, [9.0] * 3)]
    rows += [(None, [2.0] * 3), (40, []), (41, []), (60, [1e6, 2.0, -1e6])]
    odd = [(70, None), (80, [None, 1.0, 1.0]), (90, [float("nan")] * 3), (100, [float("inf")] * 3), (110, [3e38] * 3)]
    df = vectors(spark, rows + odd)
    got = vector_search.search(df, F.col("vec_id") % 10 == 0, k=5, chunk=chunk, block=block).collect()
    key = sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got), key=str)
    assert key == plain_top(rows, lambda i: i % 10 == 0, 5)


def test_top_k_of_none_and_of_one(spark):
    assert vector_search.search(vectors(spark, []), F.col("vec_id") >= 0).collect() == []
    assert vector_search.search(vectors(spark, [(1, [1.0, 2.0])]), F.col("vec_id") >= 0).collect() == []


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_cover_tree_covers_separates_and_prunes_only_losers(spread, monkeypatch):
    monkeypatch.setattr(cover_trees, "TOGETHER", 1)
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(12, 8)) * 200
    points = np.round(middles[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 100 * spread).astype(np.int64)
    tree = cover_trees.build(points, np.arange(900), np.arange(900), np.zeros(900, bool))
    assert sorted(tree.rows.tolist()) == list(range(900))
    for node in range(len(tree.lo)):
        members = tree.points[tree.lo[node] : tree.hi[node]]
        assert np.linalg.norm(members - tree.center[node], axis=1).max() <= tree.radius[node] + 1e-6
        kids = range(tree.child_lo[node], tree.child_hi[node])
        if len(kids):
            assert (tree.center[kids[0]] == tree.center[node]).all()
            assert [tree.lo[c] for c in kids] + [tree.hi[node]] == [tree.lo[node]] + [tree.hi[c] for c in kids]
            reach = tree.radius[node] / cover_trees.BASE
            assert all(np.linalg.norm(tree.center[a] - tree.center[b]) > reach * 0.999 for a in kids for b in kids if a < b)
    queries = cover_trees.restricted(tree, tree.rows % 9 == 0)
    seen = []

    class Counting(cover_trees.Found):
        def add(self, queries, lo, hi, tree, at):
            seen.append((hi - lo) * len(at))
            super().add(queries, lo, hi, tree, at)

    found = Counting(len(queries.points), 4)
    cover_trees.search(queries, tree, found)
    for q in range(len(queries.points)):
        scores = points @ queries.points[q]
        want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != queries.rows[q])[:4]
        assert [(-s, i) for s, i in zip(found.best[q][0].tolist(), found.best[q][1].tolist())] == want
    if spread < 0.1:  # tight groups: most pairs are never looked at
        assert sum(seen) < 0.5 * len(queries.points) * 900
