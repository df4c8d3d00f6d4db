"""Waybill texts are read in one pass each, and as Spark's patterns read them."""

from pyspark.sql import functions as F

from parcelflow.functions import addresses, labels
from parcelflow.operators import waybill_reader, waybills
from parcelflow.plans import aramex

ODD = ["", "a", "12 KG", "é12", "12é", "½12", "_12", "x\r\n12\r\n", "12\n", "12\x85", "\n12 y", "ſtreet 12", "İ 12 Rd", "UNIT٣ 12", "+91 9876543210", "(613) 555-0100 x", "1\r12"]


def test_records_are_one_pass_over_texts(spark, sf_dir):
    plan = aramex.tx_aramex_generic(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambdafunction" not in plan
    dealt = plan[plan.index("RoundRobinPartitioning") :]
    assert "KIND ATTN" in plan and "KIND ATTN" not in dealt  # texts are made after rows have been dealt


def test_patterns_mean_what_they_mean_to_spark(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string")
    patterns = [r"\b12\b", "12$", "(?m)^12$", "(?i)^STREET", ".12", "(?s).12", r"\d+$", r"(?im)^\s*[0-9.]+.*$", addresses.STREETS, addresses.METADATA, addresses.ENDING_PHONE, labels.PHONE]
    for p in patterns:
        said = [r[0] for r in rows.select(F.col("t").rlike(p)).collect()]
        hits = [waybill_reader._java(p).search(t) for t in ODD]
        assert [h is not None for h, t in zip(hits, ODD) if "½" not in t] == [s for s, t in zip(said, ODD) if "½" not in t], p
    assert waybill_reader.read("½12.50 KG")["actual_weight"] == 12.5
    phones = [list(r[0]) for r in rows.select(labels.phones(F.col("t"))).collect()]
    assert [waybill_reader._phones(t) for t in ODD] == phones


def test_ends_of_contents_are_kept(spark):
    """A line of contents loses blanks at its ends, not zeros or ones."""
    text = "FEDEX\nDESC1:THINGS OF MONACO 98000 \nDESC2: 1.2 M OF ROPE"
    assert waybills.records(spark.createDataFrame([(text,)], "text string")).first().contents == "THINGS OF MONACO 98000; 1.2 M OF ROPE"


def test_texts_that_are_no_utf8_are_read(spark):
    found = waybills.records(spark.sql("SELECT CAST(X'2A33373239343238393736302A2045585020FF' AS STRING) AS text")).first()
    assert (found.carrier, found.carrier_tracking_number) == ("Aramex", "37294289760")
