"""Bounded samples of rows that hashes don't tell apart, and columns of any name through every stage of the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

from parcelflow.llm import language_id, mixing, near_duplicates, quality
from parcelflow.llm.common import DRAWS, draw, last_draws

from .test_operators import GOOD


def sentences(words, n, seed):
    rng = random.Random(seed)
    return [(" ".join(rng.choice(words) for _ in range(60)) + ".")[:200].ljust(200, "e") for _ in range(n)]


EN = "the small house stands near a river and people walk by it daily with their friends".split()
DE = "das kleine Haus steht nahe dem Fluss und Leute gehen täglich mit ihren Freunden vorbei".split()


def test_languages_are_learned_from_rows_without_ids_and_of_one_length(spark):
    made = [(None, t, "en") for t in sentences(EN, 3000, 1)] + [(None, t, "de") for t in sentences(DE, 3000, 2)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    found = language_id.language_report(docs)
    assert {(r.lang_pred, r.n) for r in found.groupBy("lang_pred").agg(F.count("*").alias("n")).collect()} == {("en", 3000), ("de", 3000)}


def test_samples_are_bounded_and_miss_no_group(spark):
    equal = spark.createDataFrame([(None, "the same text", "en")] * 5000 + [(k, f"text {k}", "de") for k in range(5000)] + [(1, "one", "fr")], "doc_id long, text string, lang string")
    rows = equal.select("lang", draw("doc_id", "text").alias("draw"))
    last = last_draws(rows, "lang", {"en": 5000, "de": 5000, "fr": 1}, 40)
    assert set(last) == {"en", "de", "fr"} and all(0 <= x < DRAWS for x in last.values())
    picked = [r for r in rows.collect() if r.draw <= last[r.lang]]
    assert sum(r.lang == "de" for r in picked) == 40 and len({r.draw for r in picked if r.lang == "en"}) == 1
    assert last_draws(rows, "lang", {}, 40) == {}
    assert set(language_id.fit(equal).langs) == {"en", "de", "fr"}


def test_quality_is_learned_from_rows_without_ids_and_of_one_length(spark):
    junk = [" ".join(random.Random(k).choice(["BUY", "$$$", "|", "NOW", "###"]) for _ in range(40))[:100].ljust(100, "!") for k in range(600)]
    good = [(GOOD * 2)[:60].capitalize() + t[:39].ljust(39, "a") + "." for t in sentences(EN, 2400, 3)]
    docs = spark.createDataFrame([(None, t, k) for k, ts in ((0, junk), (1, good)) for t in ts], "doc_id long, text string, kind int")
    kept = quality.keep_clean(docs).groupBy("kind").count().collect()
    assert dict(map(tuple, kept)).get(1, 0) >= 2350 and dict(map(tuple, kept)).get(0, 0) <= 30


def test_columns_of_any_name_pass_every_stage(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    names = ["doc_id", "text", "lang", "source", "n_chars", "a.b", "own row", "row hash", "row", "own_id", "copies", "back`tick"]
    made = [(k % 50, f"{GOOD} Number {k % 50} of many, told again and again by {k % 50} people.", "en", "a", 9, k % 2, 1, 2, 3, 4, 5, {"x": k % 3}) for k in range(150)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, c5 int, c6 int, c7 int, c8 int, c9 int, c10 int, c11 map<string,int>").toDF(*names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == names and out.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 150
    kept = near_duplicates.keep_one_of_each(docs, 80).select("doc_id", "`a.b`").collect()
    assert len(kept) == len({r.doc_id for r in kept})


def test_the_mix_is_the_same_again_for_rows_that_differ_in_other_columns(spark):
    made = [(k % 4, "a b c", "s" if k % 4 else "t", k) for k in range(400)]
    taken = [sorted(map(tuple, mixing.mix(spark.createDataFrame(m, "doc_id long, text string, source string, other long").repartition(n)).collect())) for m, n in ((made, 1), (made[::-1], 3))]
    assert taken[0] == taken[1]
