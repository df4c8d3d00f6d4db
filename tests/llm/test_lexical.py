"""Ranked search against scoring every document, and the index's order and bounds."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from parcelflow.llm import lexical

DOCS, ITEMS = "doc_id long, text string, term string, n int, place long, item long", "item_id long, text string, item long, rank int"


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower))


def brute(docs, items, k=10):
    docs = [(i, c) for i, t in docs if (c := terms(t))]
    n, total, df = len(docs), sum(c.total() for _, c in docs), Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        asked = {t: times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t, times in terms(text).items() if t in df}
        scored = []
        for i, c in docs:
            m = 100 - 75 + (75 * c.total() * n) // total
            score = sum(w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, w in asked.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    frames = spark.createDataFrame([(*d, "t", 1, 2, 3) for d in docs], DOCS), spark.createDataFrame([(*i, 4, 5) for i in items], ITEMS)
    return sorted((tuple(r) for r in lexical.ranked(*frames, **more).collect()), key=str)


def test_odd_rows(spark):
    long = " ".join(f"word{i % 5003}" for i in range(60_000))
    docs = [(3, "A b c"), (1, "a B c"), (2, "a b c"), (None, "a b c"), (2, "a b c"), (4, None), (5, ""), (6, " .,\n"), (7, long), (8, "Übung Ünung É é日本 x\x00y z\x7fz"), (9, "a" * 10_000), (10, "K k K")]
    items = [(1, "a a b"), (1, "a a b"), (None, "C word77"), (2, None), (3, ""), (4, "...!"), (5, "nowhere"), (6, "Übung übung É 日本"), (7, long), (8, "a" * 10_000), (9, "k"), (10, "x y z")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, k=2) == brute(docs, items, 2)
    for d, i in (([], items), (docs, []), ([], []), ([(1, None)], items)):
        assert found(spark, d, i) == []


def test_many_ties_over_several_clusters(spark):
    rng = random.Random(1)
    docs = [(rng.randrange(10**6), rng.choice(["red apple", "green apple pie", "apple", "red"])) for _ in range(3000)]
    items = [(k, t) for k, t in enumerate(["apple", "red apple", "pie green", "pie pie apple red"])]
    assert found(spark, docs, items) == brute(docs, items)


def test_documents_of_the_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(spark, docs, items) == brute(docs, items)


def topics(n, rng):
    """Documents of eight vocabularies that hardly overlap, in random order."""
    return [" ".join(f"t{k % 8}w{int(rng.paretovariate(0.8)) % 300}" for _ in range(30)) + f" common{rng.randrange(40)}" for k in rng.sample(range(n), n)]


def test_bisection_brings_like_documents_together(spark):
    rng = random.Random(2)
    texts = topics(2048, rng)
    names: dict[bytes, int] = {}
    sets = [list(lexical.counted(t)) for t in texts]
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    term = np.array([names.setdefault(t, len(names)) for s in sets for t in s])
    order, edges, _ = lexical.bisected(doc, term, len(texts), 3, 8)
    assert sorted(order.tolist()) == list(range(2048)) and edges == list(range(0, 2049, 256))
    topic = np.array([int(t[1]) for t in texts])
    purity = np.mean([np.bincount(topic[order[a:b]]).max() / (b - a) for a, b in zip(edges, edges[1:], strict=False)])
    assert purity >= 0.8
    tree = lexical.Tree(sets, 3)
    shards = tree.shards([list(lexical.counted(t)) for t in topics(2048, random.Random(3))])
    assert np.bincount(shards, minlength=8).min() >= 100


def test_search_stops_before_it_has_seen_all_clusters(spark):
    rng = random.Random(4)
    docs = list(enumerate(topics(12_000, rng)))
    items = [(k, " ".join(f"t{k % 8}w{w}" for w in rng.sample(range(40), 4))) for k in range(16)]
    index = lexical.Index(spark.createDataFrame(docs, "doc_id long, text string"))
    result, visits = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in result.collect()), key=str) == brute(docs, items)
    assert sum(visits) <= 0.6 * index.clusters.count() * len(items)
    posted = index.clusters.select(F.explode("counts").alias("n")).agg(F.sum("n")).first()[0]
    assert posted == sum(len(terms(t)) for _, t in docs) and index.clusters.select(F.sum(F.size("docs"))).first()[0] == len(docs)
    index.forget()
