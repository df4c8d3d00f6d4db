"""Components, and near duplicates in groups of every kind, against brute force."""

import random

import pytest

from parcelflow.llm import common, components, near_duplicates

from .test_operators import brute_components


def roots(edges):
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {x: root(x) for x in up}


def test_components_take_few_rounds_whatever_the_shape(spark, monkeypatch):
    rng, written, kept = random.Random(1), [], common.kept
    monkeypatch.setattr(components, "kept", lambda df: written.append(1) or kept(df))
    shuffled = rng.sample(range(3000), 3000)
    shapes = {
        "chain": [(k, k + 1) for k in range(3000)],
        "shuffled chain": list(zip(shuffled, shuffled[1:], strict=False)),
        "star": [(2999, k) for k in range(2999)],
        "random": [(rng.randrange(2000), rng.randrange(2000)) for _ in range(1500)],
    }
    for name, edges in shapes.items():
        written.clear()
        found = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert found == roots([e for e in edges if e[0] != e[1]]) and len(written) <= 40, (name, len(written))


@pytest.mark.parametrize("few", [0, 50, components.FEW])
def test_few_edges_take_one_task_and_more_edges_join_what_is_labelled(spark, monkeypatch, few):
    rng, written, kept = random.Random(2), [], common.kept
    monkeypatch.setattr(components, "kept", lambda df: written.append(1) or kept(df))
    monkeypatch.setattr(components, "FEW", few)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1080)] * 2
    more = [(rng.randrange(1100), rng.randrange(1300)) for _ in range(90)] + [(5, 5)]
    df = lambda rows: spark.createDataFrame(rows, "a long, b long")
    labels = components.components(df(edges))
    assert few < len(edges) or len(written) <= 3  # the edges, their roots and the labels; rounds take six and more each
    assert {r.id: r.component for r in labels.collect()} == roots([e for e in edges if e[0] != e[1]])
    for rows in (more, [], [(1, 1)]):
        found = components.extended(labels, df(rows)).collect()
        assert {r.id: r.component for r in found} == roots([e for e in edges + rows if e[0] != e[1]]) and len({r.id for r in found}) == len(found)
    assert components.components(df([])).count() == components.extended(components.components(df([])), df([])).count() == 0


def crowd(seed, many):
    """Near copies of one text, texts that share a passage, almost equal ones among them, and others."""
    rng = random.Random(seed)
    passage, base = [f"p{rng.randrange(10**6)}" for _ in range(60)], [f"w{rng.randrange(500)}" for _ in range(120)]
    made = []
    for i in range(many):
        kind = rng.random()
        if kind < 0.3:
            words = [w if rng.random() > 0.004 * rng.randrange(9) else f"c{rng.randrange(10**6)}" for w in base]
        elif kind < 0.7:
            words = passage + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([5, 20, 60, 200]))]
        elif kind < 0.85:
            words = passage + [f"v{j}" for j in range(rng.randrange(8, 14))]
        else:
            words = [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40))]
        made.append((i, " ".join(words)))
    return made + [(1000 + k, " ".join(f"r{j}" for j in range(k, k + 100))) for k in range(60)] + [(2000, made[0][1]), (2000, made[-1][1]), (None, made[0][1])]


@pytest.mark.parametrize("limits", [{}, {"SMALL_KEY": 2, "PIVOTS": 1, "CLUSTER_CLASSES": 3}])
def test_crowded_keys_and_clusters(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(near_duplicates, name, value)
    made = crowd(7, 200)
    want = brute_components(made)
    found = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert {i: found[i] for i in want} == want


def test_long_words_made_to_collide_differ():
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    one, other = near_duplicates.shingle_sets([a, b])
    assert len(a) == 2048 and one[0] != other[0]
    assert near_duplicates.shingle_sets([a, b], seed=1)[0][0] != near_duplicates.shingle_sets([a, b], seed=1)[1][0]


def test_one_row_of_each_group_stays(spark):
    text, near = " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(59))
    made = [(None, text, "a"), (None, text, "a"), (None, text, "b"), (5, near, "c"), (7, "other text", "d"), (7, "other text", "d"), (None, "alone", None), (None, "alone", "x"), (9, None, None), (9, None, None)]
    kept = near_duplicates.keep_one_of_each(spark.createDataFrame(made, "doc_id long, text string, source string"), 80).collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept if r.doc_id) == sorted(str(x) for x in [(5, near), (7, "other text"), (9, None), (9, None)])
    assert [r.text for r in kept if r.doc_id is None] == ["alone"]


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app-1"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
