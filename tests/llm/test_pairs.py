import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlark.llm import bucketjoin, embeddings, ngramjoin


def groups(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(rows):
    """rows: (doc_id, text), by doc_id without nulls."""
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    links = [0] * len(rows)
    edges = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                edges.append((i, j))
    root = groups(len(rows), edges)
    return [(rows[i][0], links[i], rows[root[i]][0]) for i in range(len(rows))]


def test_ngram_join(docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = ngramjoin.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.n_links, r.component_id) for r in got) == brute(rows)


def test_repeated_and_null_ids(spark):
    """Rows are documents, whatever their ids: links are as many as with ids of their own."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    near = lambda t, k: t + f" tail{k}"
    rows = [(5, a), (5, near(a, 1)), (7, b), (7, near(b, 1)), (9, c), (9, near(c, 1)), (11, d), (11, near(d, 1))]
    got = ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_links, r.component_id) for r in got) == [(i, 1, i) for i in (5, 5, 7, 7, 9, 9, 11, 11)]
    assert sorted(r.doc_id for r in got if r.kept) == [5, 7, 9, 11]
    rows = [(None, a), (None, near(a, 1)), (3, near(a, 2)), (None, b), (None, b), (-(2**63), c), (2**63 - 1, near(c, 1)), (-1, d), (1, near(d, 1)), (1, near(d, 1))]
    got = ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, 2, 3), (None, 2, 3), (3, 2, 3), (None, 1, None), (None, 1, None), (-(2**63), 1, -(2**63)), (2**63 - 1, 1, -(2**63)), (-1, 2, -1), (1, 2, -1), (1, 2, -1)]
    assert sorted(map(str, ((r.doc_id, r.n_links, r.component_id) for r in got))) == sorted(map(str, want))


def test_hot_group_in_tiles(spark, monkeypatch):
    """A group of near copies larger than a tile, and many exact copies: all links are counted, in several tiles."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words[:100], f"own{i}", *words[100:]])) for i in range(90)] + [(100 + i, " ".join(words)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(bucketjoin, "TILE", 16)
    got = ngramjoin.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert [r.doc_id for r in got if r.kept] == [0]


def test_odd_documents(odd_docs, no_docs):
    rows = {}
    for r in ngramjoin.near_duplicates(odd_docs).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert len(rows[5]) == 2 and {r.n_links for r in rows[5]} == {2} and rows[5][0].component_id == 1 and rows[1][0].kept
    assert rows[2][0].component_id == rows[3][0].component_id == rows[4][0].component_id == 2
    assert rows[8][0].component_id == 6 and len(rows[None]) == 2
    assert ngramjoin.near_duplicates(no_docs).count() == 0


def test_bands_reach_their_recall():
    b, r = ngramjoin.bands_rows()
    assert b * r <= 128 and 1 - (1 - 0.8**r) ** b >= 0.999


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30)), min_size=2, max_size=12))
def test_jaccard_matrix(sets):
    m = ngramjoin.linked([np.array(sorted(s), dtype=np.uint64).tobytes() for s in sets])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and (a or b):
                assert m[i, j] == (len(a & b) * 10 >= 8 * len(a | b))


def test_components(spark):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 160)]
    key = lambda i: i.to_bytes(2, "big")
    rows = spark.createDataFrame([(key(a), key(b)) for a, b in edges], "key binary, root binary")
    got = {bytes(x.key): bytes(x.component) for x in bucketjoin.components(rows).collect()}
    root = groups(200, edges)
    used = {x for e in edges if e[0] != e[1] for x in e}
    assert {i: got.get(key(i), key(i)) for i in used} == {i: key(root[i]) for i in used}
    assert bucketjoin.components(rows.limit(0)).count() == 0


@pytest.mark.parametrize("single", [True, False])
def test_recall_at_the_registered_setting(spark, single):
    """Planted pairs at cosines just above the threshold, among unrelated vectors and a hot group, none below it."""
    r = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(r.normal(size=(2500, 64)))
    other = r.normal(size=base.shape)
    other = unit(other - (other * base).sum(1, keepdims=True) * base)
    cos = np.concatenate([np.full(1250, 0.9005), r.uniform(0.9005, 0.92, 750), np.full(500, 0.8995)])
    near = cos[:, None] * base + np.sqrt(1 - cos**2)[:, None] * other
    x = np.concatenate([base, near]).astype("<f4" if single else "<f8")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{'float' if single else 'double'}>").repartition(4)
    got = {v.vec_id: v.n_links for v in embeddings.near_duplicates(df).collect()}
    x = x.astype(np.float64)
    true = x @ x.T >= 0.9 * np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
    np.fill_diagonal(true, False)
    assert all(got[i] <= true[i].sum() for i in range(len(x))) and all(got[i] == 0 for i in range(2000, 2500))
    assert sum(got.values()) >= 0.93 * true.sum() and true.sum() == 4000


@pytest.fixture
def vectors():
    r = np.random.default_rng(5)
    base = r.normal(size=(300, 32))
    near = base[:40] + 0.1 * r.normal(size=(40, 32))
    hot = base[0] + 0.12 * r.normal(size=(60, 32))
    return np.concatenate([base, near, hot, base[50:60]])


def test_embeddings(spark, vectors, monkeypatch):
    monkeypatch.setattr(bucketjoin, "TILE", 16)
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    true = x @ x.T >= 0.9
    np.fill_diagonal(true, False)
    df = spark.createDataFrame([(i, v.tolist(), 1, "c") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int, id string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, recall=0.99).collect()}
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= true.sum(1)).all() and links.sum() >= 0.97 * true.sum()
    root = groups(len(x), list(zip(*np.nonzero(true), strict=True)))
    assert np.mean([got[i].component_id == root[i] for i in range(len(x))]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1e-300, 0.0]), (12, [1e300, 1e298]), (None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, recall=0.999).collect()]
    assert len(got) == len(rows)
    for r in got:
        if r[0] in (1, 2, 9, 11, 12):
            assert r[1] == 5 and r[2] == 1 and r[3] == (r[0] == 1)
        elif r[0] is not None:
            assert r[1:] == (0, r[0], True)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
