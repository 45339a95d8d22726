"""Neighbours and clusters against brute force on planted vectors."""

import numpy as np
import pytest

from sparkloom.llm import mixture as MX
from sparkloom.llm import neighbours as N
from sparkloom.llm.components import connected_components
from sparkloom.llm.mixture import describe, similarity_clusters
from sparkloom.llm.neighbours import Table, fit_tables, neighbours
from sparkloom.llm.vectors import unit

DDL = "item_id bigint, embedding array<float>, rep string, vec string"


def planted(seed=0, dim=16):
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=dim) for _ in range(150)]
    for _ in range(8):
        c = rng.normal(size=dim)
        x += [c + 0.15 * rng.normal(size=dim) for _ in range(rng.integers(2, 9))]
    x += [x[0]] * 8  # a vector of many items
    return np.array(x, np.float32)


def frame(spark, x, dirty=True):
    rows = [(i, v.tolist(), "r", "v") for i, v in enumerate(x)]
    if dirty:
        rows += [(9001, None, "", ""), (9002, [], "", ""), (9003, [0.0] * x.shape[1], "", ""), (9004, [float("nan")] * x.shape[1], "", ""), (9005, [1.0, 2.0], "", ""), (None, x[0].tolist(), "", "")]
        rows += rows[:20]
    return spark.createDataFrame(rows, DDL)


def cosines(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return u @ u.T


def test_neighbours_recall_and_order(spark):
    x = planted()
    s = np.round(cosines(x), 9)
    np.fill_diagonal(s, -9)
    got = {}
    for r in neighbours(frame(spark, x), k=5).collect():
        got.setdefault(r.item_id, {})[r.place] = (r.neighbour_id, r.cosine)
    want = {i: sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:5] for i in range(len(x))}
    hit = sum(len(set(want[i]) & {n for n, _ in got[i].values()}) for i in want)
    assert set(got) == set(want) and hit >= 0.97 * 5 * len(x)
    shared = {0, *range(len(x) - 8, len(x))}
    assert [got[0][p][0] for p in range(1, 6)] == sorted(shared - {0})[:5]  # ties go to the smaller id
    assert all(i not in {n for n, _ in g.values()} for i, g in got.items())


def test_neighbours_of_few_or_no_vectors(spark):
    assert neighbours(frame(spark, planted()).limit(0)).collect() == []
    few = neighbours(frame(spark, planted()[:3], dirty=False), k=5).collect()
    assert sorted((r.item_id, r.neighbour_id) for r in few) == [(i, j) for i in range(3) for j in range(3) if i != j]


def test_exact_search_loses_nothing(spark, monkeypatch):
    x = planted(4)
    s = np.round(cosines(x), 9)
    np.fill_diagonal(s, -9)
    monkeypatch.setattr(N, "CELL", 20)
    got = {(r.item_id, r.place): r.neighbour_id for r in neighbours(frame(spark, x), k=5, exact=True).collect()}
    assert got == {(i, p + 1): j for i in range(len(x)) for p, j in enumerate(sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:5])}


def sf_vectors():
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.1/embeddings_b2.parquet")["embedding"].to_pylist()
    x = np.array([v for v in rows if v and len(v) == 64 and None not in v], np.float32)
    return unit(np.unique(x[np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)], axis=0))


def test_cells_are_boxes_that_hold_their_vectors():
    x = sf_vectors()
    t = Table(x, 90_000, 5, 3, 0.9)
    cell, p = t.cells(x.astype(np.float32)), x.astype(np.float32) @ t.a
    assert (p >= t.lo[cell]).all() and (p <= t.hi[cell]).all() and len(t) > 50
    assert (t.borders(x[:50].astype(np.float32))[np.arange(50), cell[:50]] == 0).all()


@pytest.mark.parametrize("count", [90_000, 1_000_000, 10_000_000])
def test_queries_visit_the_cells_of_their_neighbours(count):
    """Tables as fine as for that many vectors; a query knows its last neighbour's distance."""
    x = sf_vectors()
    rng = np.random.default_rng(0)
    fit, q = rng.permutation(len(x))[:6000], rng.choice(len(x), 500, replace=False)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -9
    true = np.argsort(-s, axis=1)[:, :5]
    reach = 2 - 2 * np.take_along_axis(s, true, 1).min(axis=1)
    seen, share = np.zeros(true.shape, bool), 0.0
    for t in fit_tables(x[fit], count, 5, 7):
        visited = t.borders(x[q].astype(np.float32)) / (t.bounded * t.share) <= reach[:, None]
        cell = t.cells(x.astype(np.float32))
        seen |= np.take_along_axis(visited, cell[true], 1)
        share += visited[:, cell].mean()
    assert seen.mean() > 0.95 and share < 0.5, (seen.mean(), share)


@pytest.mark.parametrize(("count", "most"), [(90_000, 0.3), (1_000_000, 0.18), (10_000_000, 0.14)])
def test_work_of_a_query_falls_with_more_vectors(count, most):
    """Tables as fine as for that many vectors; boxes looked at 0.21, 0.20 and 0.20 of all here, two tables together."""
    x = sf_vectors()
    rng = np.random.default_rng(0)
    fit, q = rng.permutation(len(x))[:6000], rng.choice(len(x), 500, replace=False)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -9
    true = np.argsort(-s, axis=1)[:, :5]
    seen, share = np.zeros(true.shape, bool), 0.0
    for t in (N.Pair(x[fit], count, 5, 7 + i, 1 - (1 - N.RECALL) ** 0.5) for i in range(N.TABLES)):
        cell, z = t.cells(x.astype(np.float32)), t.project(x[q].astype(np.float32)).T
        visited = z[:, cell // t.m] + z[:, t.m + cell % t.m] >= t.wanted(np.take_along_axis(s, true, 1).min(axis=1))[:, None]
        seen |= np.take_along_axis(visited, true, 1)
        share += visited.mean()
    assert seen.mean() > 0.94 and share < most, (seen.mean(), share)


def test_pairs_of_hashes_find_neighbours_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "PAIR_CELL", 20)
    x = sf_vectors()[:3000].astype(np.float32)
    s = np.round(cosines(x), 9)
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, axis=1, kind="stable")[:, :5]
    got = {(r.item_id, r.neighbour_id) for r in neighbours(frame(spark, x, dirty=False), k=5).collect()}
    assert len(got) == 5 * len(x) and sum((i, j) in got for i, row in enumerate(want.tolist()) for j in row) >= 0.97 * 5 * len(x)


def brute_clusters(x, least, size):
    s = cosines(x) >= least
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([label[s[i]].min() for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    return {(int(r), i) for i, r in enumerate(label) if (label == r).sum() >= size}


def test_clusters_match_brute_force(spark):
    x = planted(3)
    c = similarity_clusters(frame(spark, x))
    got = {(r.first_item_id, r.item_id) for r in c.labels.collect()}
    assert got == brute_clusters(x, 0.85, 4) and got
    by = {r.first_item_id: r for r in describe(c).collect()}
    for f, r in by.items():
        members = {i for a, i in got if a == f}
        assert r.n_items == len(members) and set(r.typical_item_ids) <= members and len(r.typical_item_ids) == 3


def test_weak_links_across_several_components(spark):
    rng = np.random.default_rng(5)
    base = unit(0.5 * rng.normal(size=(12, 64))[rng.integers(12, size=3600)] + rng.normal(size=(3600, 64)))
    p = base[:1000]
    o = rng.normal(size=p.shape)
    o = unit(o - (o * p).sum(axis=1, keepdims=True) * p)
    t = rng.uniform(0.851, 0.889, (len(p), 1))
    x = np.concatenate([base, t * p + np.sqrt(1 - t * t) * o]).astype(np.float32)
    c = similarity_clusters(frame(spark, x, dirty=False), least_size=2)
    assert c.n_components > 1
    got = {(r.first_item_id, r.item_id) for r in c.labels.collect()}
    assert got == brute_clusters(x, 0.85, 2) and len(got) >= 2000


def test_crowded_components_are_divided(spark, monkeypatch):
    monkeypatch.setattr(MX, "CROWDED", 150)
    monkeypatch.setattr(MX, "ROWS_PER_COMPONENT", 60)
    monkeypatch.setattr(MX, "BLOCK", 64)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 16))[rng.integers(60, size=900)]
    x = np.concatenate([base + 0.25 * rng.normal(size=base.shape), rng.normal(size=(300, 16))]).astype(np.float32)
    c = similarity_clusters(frame(spark, x, dirty=False))
    assert c.n_components > 10 and c.n_components not in (5, 10, 20)  # what the ladder of undivided mixtures offers
    want = brute_clusters(x, 0.85, 4)
    assert {(r.first_item_id, r.item_id) for r in c.labels.collect()} == want and want
    assert {(r.first_item_id, r.item_id) for r in similarity_clusters(frame(spark, x, dirty=False), exact=True).labels.collect()} == want


def test_clusters_of_an_empty_table(spark):
    c = similarity_clusters(frame(spark, planted()).limit(0))
    assert c.labels.collect() == []


def test_components_of_long_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3), (41, 0), (1, 0)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(42), 0), **dict.fromkeys(range(100, 130), 100)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame(links, "a bigint, b bigint"), most_rounds=1)
