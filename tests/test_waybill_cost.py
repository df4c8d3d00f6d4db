"""What waybill expressions evaluate once, and that cheap tests before dear ones change nothing."""

import re

from pyspark.sql import functions as F

from parcelflow.functions import addresses, labels


def test_capitals_are_made_once(spark):
    rows = spark.createDataFrame([("x",)], "t string")
    text = lambda c: rows.select(c.alias("made"))._jdf.queryExecution().analyzed().toString()
    for made in (labels.layout(F.col("t")), labels.service(F.col("t"), labels.layout(F.lit("x"))), addresses.country(F.col("t"))):
        assert text(made).count("upper(t") == 1


def test_countries_and_titles_are_those_of_the_patterns_alone(spark):
    texts = ["india", "Hong  kong", "(ca)", "REPUBLIC OF X", "INDIANA", "united\tarab", "New\nZealand", "straße oman", "", None, "ıNDIA", "saudiarabia", "x usa y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [next((n for p, n in addresses.COUNTRY_PATTERNS.items() if t and re.search("(?ai)" + p, t)), None) for t in texts]
    assert [r[0] for r in rows.select(addresses.country(F.col("t"))).collect()] == want
    words = spark.createDataFrame([("o'NEIL straße ǆ x 12ab",)], "t string")
    assert words.select(addresses.title(F.col("t"))).first()[0] == "O'Neil Straße ǅ X 12Ab"
