"""Codes of vectors: Elkan's rounds against Lloyd's with all distances."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from parcelflow.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, vector string, parts int"


def lloyd(rows, rounds=6):
    """(vec_id, label) and code and error of each row, and the codebooks' digest, with Python's integers."""
    rows = sorted(((i, [int(np.floor(4096 * x)) for x in v], label) for i, v, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(rows[0][1]) // 8
    cut = [[v[p * dims : (p + 1) * dims] for p in range(8)] for _, v, _ in rows]
    books = [[c[p] for c in cut[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda: [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(8)] for c in cut]
    for _ in range(rounds):
        found = nearest()
        for p in range(8):
            members = defaultdict(list)
            for c, f in zip(cut, found, strict=True):
                members[f[p][1]].append(c[p])
            for k, m in members.items():
                books[p][k] = [sum(x) // len(m) for x in zip(*m, strict=True)]
    found = nearest()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, label, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, _, label), f in zip(rows, found, strict=True)], digest


def check(found, rows):
    want, digest = lloyd(rows)
    errors = defaultdict(int)
    for _, label, _, error in want:
        errors[label] += error
    assert sorted(map(tuple, found), key=str) == sorted(((i, code, error, errors[label], digest) for i, label, code, error in want), key=str)


def test_codes_are_those_of_all_distances(spark):
    rng = np.random.default_rng(3)
    # Small whole numbers give ties; groups give bounds that prune; far components don't fit in two bytes.
    tied = [(i, rng.integers(-2, 3, 16).astype(float).tolist(), i % 3) for i in range(300)]
    grouped = [(i, (rng.normal(size=32) * 0.02 + (i % 7)).tolist(), None if i % 5 == 0 else i % 2) for i in range(300)]
    far = [(i, (rng.normal(size=8) * 10.0 ** (i % 5)).tolist(), 1) for i in range(60)]
    few = [(i, [float(i)] * 8, 1) for i in range(5)]
    for made in (tied, grouped, far, few):
        docs = spark.createDataFrame([(*r, "x", 0) for r in made], SCHEMA).repartition(3)
        check(vector_codes.compressed(docs).collect(), made)
        check(vector_codes.compressed(docs, few_labels=0).collect(), made)


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(i // 2 if i < 20 else None, rng.normal(size=8).tolist(), None) for i in range(24)] + [(3, [0.0] * 8, 5)] * 3
    bad = [(30, None, 1), (31, [], 1), (32, [1.0, None] * 4, 1), (33, [float("nan")] * 8, 1), (34, [float("inf")] * 8, 1), (35, [1.0] * 16, 1)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in good + bad], SCHEMA)
    check(vector_codes.compressed(docs).collect(), good)
    for none in (docs.where("false"), docs.where("vec_id = 30")):
        assert vector_codes.compressed(none).collect() == []
    # A length that eight doesn't divide is filled up with zeros; huge components are set to the limit.
    short = [(i, rng.normal(size=11).tolist(), 1) for i in range(40)]
    check(vector_codes.compressed(spark.createDataFrame([(*r, "x", 0) for r in short], SCHEMA)).collect(), [(i, v + [0.0] * 5, n) for i, v, n in short])
    huge = spark.createDataFrame([(i, [1e300 * (-1) ** i, 0.0] * 4, 1, "x", 0) for i in range(20)], SCHEMA)
    assert {r.error for r in vector_codes.compressed(huge).collect()} == {0}


def test_long_vectors(spark):
    rng = np.random.default_rng(5)
    made = [(i, rng.normal(size=4096).tolist(), i % 2) for i in range(40)]
    check(vector_codes.compressed(spark.createDataFrame([(*r, "x", 0) for r in made], SCHEMA)).collect(), made)


def test_bounds_spare_most_distances(spark):
    rng = np.random.default_rng(6)
    made = [(i, (rng.normal(size=16) * 0.01 + (i % 16)).tolist(), 1, "x", 0) for i in range(2000)]
    _, books, looked = vector_codes.fit_and_assign(vector_codes.whole_numbers(spark.createDataFrame(made, SCHEMA)))
    assert looked[0] <= 2000 * 8 * 16 * 1.1 and sum(looked[1:]) <= 0.15 * 6 * 2000 * 8 * 16
    assert books.shape == (8, 16, 2)


@pytest.mark.parametrize("top", [1, 2**31, 2**62 - 1])
def test_roots_are_exact(top):
    rng = np.random.default_rng(7)
    roots = rng.integers(0, int(top**0.5) + 1, 1000)
    x = np.unique(np.clip(np.concatenate([roots**2 + d for d in (-1, 0, 1)]), 0, top))
    low, high = vector_codes._floor_root(x), vector_codes._ceil_root(x)
    assert (low * low <= x).all() and ((low + 1) ** 2 > x).all() and (high * high >= x).all() and ((high == 0) | ((high - 1) ** 2 < x)).all()
