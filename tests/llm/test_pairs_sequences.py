"""Sequences and pairs against brute force, with hot users, ties, nulls and repeats."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import pairs as PR
from sparkloom.llm import sequences as SQ
from sparkloom.llm.pairs import fit_null, pair_counts, upper_tail
from sparkloom.llm.sequences import frequent_sequences

DDL = "user_id string, parent_asin string, timestamp_ms bigint, n int, u string, item string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DDL)


def make(seed, users=60, items=8):
    rng = random.Random(seed)
    rows = []
    for u in range(users):
        for _ in range(rng.randint(1, 14)):
            rows.append((f"u{u}", f"i{rng.randint(0, items - 1)}", rng.randint(1, 25)))
    rows += [("hot", f"i{rng.randint(0, items - 1)}", rng.randint(1, 400)) for _ in range(600)]
    rows += rows[:40] + [(None, "i1", 3), ("", "i1", 3), ("u1", None, 3), ("u1", "", 3), ("u2", "i1", None), ("u2", "i1", 0)]
    rng.shuffle(rows)
    return rows


def brute_sequences(rows, length, need_users, share):
    by = defaultdict(set)
    for u, i, t in rows:
        if u and i and t and t > 0:
            by[u].add((t, i))
    need = max(need_users, int(np.ceil(share * len(by) - 1e-9)))
    counts = Counter()
    for events in by.values():
        times = defaultdict(list)
        for t, i in sorted(events):
            times[i].append(t)
        for p in itertools.permutations(times, length):
            at = 0
            for i in p:
                at = next((t for t in times[i] if t > at), None)
                if at is None:
                    break
            else:
                counts[p] += 1
    return {p: n for p, n in counts.items() if n >= need}


@pytest.mark.parametrize(("seed", "length"), [(1, 3), (2, 3), (3, 2), (4, 4)])
def test_sequences_match_brute_force(spark, monkeypatch, seed, length):
    monkeypatch.setattr(SQ, "HOT_ROWS", 100)  # the hot user takes the reduced way
    rows = make(seed)
    got = {tuple(r)[:length]: r.n_users for r in frequent_sequences(frame(spark, rows), length=length, min_users=3, min_share=0.06).collect()}
    assert got == brute_sequences(rows, length, 3, 0.06) and got


def test_sequences_of_empty_or_rare_rows(spark):
    assert frequent_sequences(frame(spark, [])).collect() == []
    assert frequent_sequences(frame(spark, [("u", "a", 1), ("u", "b", 1), ("u", "c", 1)])).collect() == []


def brute_pairs(rows, min_count, min_ratio):
    by = defaultdict(set)
    for u, i, _ in rows:
        if u and i:
            by[u].add(i)
    n = Counter(i for b in by.values() for i in b)
    both = Counter(p for b in by.values() for p in itertools.combinations(sorted(b), 2))
    return {p: c for p, c in both.items() if c >= min_count and c * len(by) / (n[p[0]] * n[p[1]]) >= min_ratio}


@pytest.mark.parametrize(("block", "min_count"), [(512, 5), (4, 5), (16, 1)])
def test_pairs_match_brute_force(spark, monkeypatch, block, min_count):
    monkeypatch.setattr(PR, "BLOCK", block)  # small blocks: large baskets are divided and the largest masked
    rng = random.Random(5)
    rows = [(f"u{u}", f"i{rng.randint(0, 60)}", 1) for u in range(80) for _ in range(rng.randint(1, 9))]
    rows += [(f"h{h}", f"i{k}", 1) for h in range(3) for k in range(61) if rng.random() < 0.8]
    rows += [(f"u{u}", i, 1) for u in range(0, 60, 4) for i in ("i1", "i2", "z")] + rows[:30] + [(None, "i1", 1), ("", "i2", 1), ("u1", None, 1), ("u1", "", 1)]
    got = {(r.asin_a, r.asin_b): r.n_ab for r in pair_counts(frame(spark, rows), min_count, 1.2).collect()}
    assert got == brute_pairs(rows, min_count, 1.2) and got


def test_classes_of_degrees_are_bounded_and_near():
    d = np.arange(1, 200_000)
    c = PR.degree_class(d)
    assert (np.diff(c) >= 0).all() and (c[:256] == d[:256]).all() and len(np.unique(c)) < 256 + 10 * 64 + 2
    for k in (300, 5000, 150_000):
        own = d[c == PR.degree_class(np.array([k]))[0]]
        assert own.max() <= own.min() * 2 ** (1 / 64) + 1


@pytest.mark.parametrize("couples", [1, 7, 1 << 20])
def test_extensions_in_parts(monkeypatch, couples):
    monkeypatch.setattr(SQ, "COUPLES", couples)
    first, n, code, t = np.array([0, 3]), np.array([3, 2]), np.array([1, 2, 3, 1, 2]), np.array([5, 6, 7, 1, 9])
    got = list(SQ.extend(np.array([0, 1, 0]), np.array([0, 0, 1]), np.array([5, 1, 6]), first, n, code, t))
    assert sorted(zip(*(np.concatenate(x).tolist() for x in zip(*got)))) == [(0, 2, 6), (0, 3, 7), (1, 2, 9), (2, 3, 7)]


def test_pairs_of_an_empty_table(spark):
    df = pair_counts(frame(spark, []))
    assert df.collect() == [] and "q_value" in df.columns


def test_null_reproduces_degrees_and_tail():
    degrees, n_items = np.array([2.0, 5.0, 10.0]), np.array([20.0, 8.0, 2.0])
    sizes, n_of = np.array([2.0, 5.0]), np.array([25.0, 10.0])
    x, y = fit_null(degrees, n_items, sizes, n_of)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose((p * n_of).sum(axis=1), degrees, rtol=1e-6) and np.allclose((p * n_items[:, None]).sum(axis=0), sizes, rtol=1e-6)
    q, m = np.array([[0.1, 0.4]]), np.array([30.0, 20.0])
    rng = np.random.default_rng(0)
    del rng
    pmf = np.array([1.0])
    for prob, k in zip(q[0], m):
        for _ in range(int(k)):
            pmf = np.convolve(pmf, [1 - prob, prob])
    for n in (14, 18, 22, 26):
        exact = -np.log10(pmf[n:].sum())
        assert abs(upper_tail(np.array([float(n)]), q, m)[0] - exact) < 0.02 * exact + 0.02
