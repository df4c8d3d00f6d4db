"""Groups of near-duplicate vectors against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from parcelflow.llm import vector_groups

SCHEMA = "vec_id long, embedding array<double>, label int, id long, weight string, cell int"


def brute(rows, cosine=0.93):
    """(vec_id, n_links, component_id, kept) of rows (vec_id, vector, label) by comparing all pairs of a label."""
    usable = [i is not None and label is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, label in rows]
    n, up = [0] * len(rows), list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    unit = [np.array(r[1]) / np.abs(r[1]).max() if u else None for r, u in zip(rows, usable, strict=True)]
    for a, (_, va, la) in enumerate(rows):
        for b in range(a):
            _, vb, lb = rows[b]
            if usable[a] and usable[b] and la == lb and len(va) == len(vb) and unit[a] @ unit[b] / (np.linalg.norm(unit[a]) * np.linalg.norm(unit[b])) >= cosine:
                n[a] += 1
                n[b] += 1
                up[root(a)] = root(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if usable[k]:
            least[root(k)] = min(i, least.get(root(k), i))
    out = []
    for k, (i, _, _) in enumerate(rows):
        first = least[root(k)] if usable[k] else i
        out.append((i, n[k], first, i is None or i == first))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "w", 2) for r in rows], SCHEMA)


def made(rng, n, dims, spread):
    """Groups around a few directions, so that many cosines lie near 0.93."""
    centres = rng.normal(size=(6, dims))
    return [(i, (centres[i % 6] / np.linalg.norm(centres[i % 6]) + rng.normal(size=dims) * spread * rng.uniform(0.2, 1.4) / dims**0.5).tolist(), int(i % 3)) for i in range(n)]


def test_groups_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(1)
    for dims, spread in ((64, 0.3), (64, 0.2), (16, 0.3), (7, 0.3), (2, 0.5), (100, 0.25)):
        rows = made(rng, 500, dims, spread)
        assert sorted((tuple(r) for r in vector_groups.vector_groups(frame(spark, rows).repartition(3)).collect()), key=str) == brute(rows)


def test_links_don_t_depend_on_cells_and_parts(spark):
    rng = np.random.default_rng(2)
    rows = made(rng, 700, 32, 0.28)
    want = [(i, n) for i, n, _, _ in brute(rows)]
    classes = spark.createDataFrame([(i, v, label, 1) for i, v, label in rows], "id long, vector array<double>, label long, weight long").selectExpr("id", "label", "size(vector) width", "weight", "vector")
    for grid, part, few in ((1, 40, 10_000), (3, 25, 0), (8, 4096, 10_000), (None, 60, 0)):
        found = vector_groups.found_links(classes, 0.93, part, few, grid).groupBy("id").sum("n").collect()
        n = dict(map(tuple, found))
        assert sorted(((i, n.get(i, 0)) for i, _, _ in rows), key=str) == want


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v, 1), (1, v, 1), (1, [-x for x in v], 1), (2, v, 2), (3, v, None), (4, None, 1), (5, [], 1), (6, [0.0] * 4, 1), (7, [1.0, None, 3.0, 4.0], 1), (8, [float("nan")] * 4, 1)]
    rows += [(9, [float("inf")] * 4, 1), (10, [x * 1e200 for x in v], 1), (11, [x * 1e-200 for x in v], 1), (None, v, 1), (12, [*v, 0.0], 1), (13, [1.0, 2.0, 3.0, 4.5], 1), (14, [-x * 7 for x in v], 1)]
    rows += [(20 + i, v, 3) for i in range(200)] + [(500, [1.0, 2.0, 3.0, 4.2], 3)]
    assert sorted((tuple(r) for r in vector_groups.vector_groups(frame(spark, rows)).collect()), key=str) == brute(rows)
    assert vector_groups.vector_groups(frame(spark, rows).where("false")).collect() == []


def test_long_and_single_precision_vectors(spark):
    rng = np.random.default_rng(3)
    for dims in (1, 3000):
        rows = [(i, v, n) for i, v, n in made(rng, 60, dims, 0.3)]
        assert sorted((tuple(r) for r in vector_groups.vector_groups(frame(spark, rows)).collect()), key=str) == brute(rows)
    rows = [(i, np.array(v, np.float32).astype(float).tolist(), n) for i, v, n in made(rng, 200, 64, 0.3)]
    single = frame(spark, rows).withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert sorted((tuple(r) for r in vector_groups.vector_groups(single).collect()), key=str) == brute(rows)


def test_tight_groups_give_rows_not_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (np.ones(64) + rng.normal(size=64) * 0.01).tolist(), 1) for i in range(1500)]
    classes = spark.createDataFrame([(i, v, label, 1) for i, v, label in rows], "id long, vector array<double>, label long, weight long").selectExpr("id", "label", "size(vector) width", "weight", "vector")
    found = vector_groups.found_links(classes, 0.93, part=500)
    blocks = vector_groups.blocks_of(64)
    assert found.count() <= 1500 * blocks * 2 * 3
    assert {tuple(r) for r in found.groupBy("id").sum("n").collect()} == {(i, 1499) for i in range(1500)}
