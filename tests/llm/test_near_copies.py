"""Near copies between 0.8 and 0.85, which operator 2 leaves apart and the pipeline's stage joins."""

import random

import pytest

from parcelflow.llm import near_duplicates

from .test_operators import shingles


def pairs():
    """Pairs (2 * k, 2 * k + 1) with two words changed: similarities (n - 10) / (n + 10) for n of 84 to 123 shingles."""
    rng, made = random.Random(8), []
    for k in range(320):
        words = [f"w{rng.randrange(10**9)}" for _ in range(84 + k % 40 + 4)]
        other = list(words)
        other[20], other[60] = "changed", f"x{k}"
        made += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    return made


def test_the_stage_joins_pairs_from_0_8(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    made = pairs()
    sets = [shingles(t) for _, t in made]
    alike = {2 * k: (len(a & b), len(a | b)) for k, (a, b) in enumerate(zip(sets[::2], sets[1::2], strict=True))}
    between = [k for k, (both, either) in alike.items() if 80 * either <= 100 * both < 85 * either]
    assert len(between) >= 200 and any(100 * both == 80 * either for both, either in alike.values())
    docs = spark.createDataFrame(made, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert left == {i for i, _ in made if i % 2 == 0 or 100 * alike[i - 1][0] < 80 * alike[i - 1][1]}
    op2 = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs).collect()}
    assert all(op2[k + 1] == k + 1 for k in between)


def test_chunks_follow_from_the_similarity():
    assert [near_duplicates.chunks_for(p) for p in (80, 85)] == [15, 12]
    with pytest.raises(ValueError):
        near_duplicates.near_duplicates(None, 79)
