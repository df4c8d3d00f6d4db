"""Language identification turns away what no taught language is."""

import random

import numpy as np
from pyspark.sql import functions as F

from parcelflow.llm import language_id


def test_untaught_languages_and_random_letters_are_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(4)
    letters = spark.createDataFrame([(-1 - i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(40 * 2 ** (i % 7))), None) for i in range(210)], docs.schema)
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    for untaught in ("de", "en", "es", "fr"):
        taught = docs.withColumn("lang", F.when(F.col("lang") != untaught, F.col("lang"))).union(letters)
        found = {r.doc_id: r.rejected for r in language_id.language_report(taught).collect()}
        assert np.mean([found[i] for i in found if i < 0]) >= 0.95
        assert np.mean([found[i] for i in lang if lang[i] == untaught]) >= 0.9
        assert np.mean([found[i] for i in lang if lang[i] != untaught]) <= 0.02


def test_short_texts_of_a_taught_language_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").where("n_chars >= 400")
    model = language_id.fit(docs.where("doc_id % 2 = 0"))
    texts = [r.text for r in docs.where("doc_id % 2 = 1").select("text").collect()]
    for length in (10, 20, 40, 100, 300):
        assert np.mean(model.predict([t[:length] for t in texts])[2]) <= 0.05, length
