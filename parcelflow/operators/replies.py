"""An extractor's replies to fields of a record, and what patterns read where there is no reply to use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.messages import without_fence
from .waybills import DEFAULTS, FIELDS

# What counts as no value, and fields that an extractor isn't asked for.
NOTHING = ("", "null", "N/A", "n/a")
NOT_ASKED = ("dimensions", "invoice_number")
ASKED = tuple(f for f in FIELDS if f not in NOT_ASKED)


def _value(record: Column, name: str) -> Column:
    """A field of a variant in its type; a text or number of another type is brought into it, what can't be is null."""
    text = F.try_variant_get(record, f"$.{name}", "string")
    if FIELDS[name] == "string":
        # An object or list stays as its JSON.
        text = F.coalesce(text, F.to_json(F.try_variant_get(record, f"$.{name}", "variant")))
        return F.when(~text.isin(*NOTHING), F.trim(text))
    digits = F.regexp_replace(F.when(~text.isin(*NOTHING), text), r"[^0-9.\-]", "")
    told = F.regexp_extract(digits, r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", 0)
    number = F.coalesce(F.when(~text.rlike("[A-Za-z,]"), F.try_variant_get(record, f"$.{name}", "double")), F.nullif(told, F.lit("")).try_cast("double"))
    return F.floor(number + 0.5).try_cast("int") if FIELDS[name] == "int" else number


def reply_fields(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """replies with `answer`, a struct of the ASKED fields: null if the reply is missing or no JSON.

    A fence of a code block is taken off; of a list the first element counts; what is no object gives the blank record,
    as do fields that are absent, null or a word for nothing.
    """
    read = replies.withColumn("read", F.try_parse_json(without_fence(F.col(reply))))
    kind = F.schema_of_variant("read")
    first = F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get("read", "$[0]", "variant")).otherwise(F.col("read"))
    read = read.withColumn("record", first)
    whole = F.startswith(F.schema_of_variant("record"), F.lit("OBJECT"))
    fields = [F.coalesce(F.when(whole, _value(F.col("record"), f)), F.lit(DEFAULTS.get(f))).cast(FIELDS[f]).alias(f) for f in ASKED]
    return read.withColumn("answer", F.when(F.col("read").isNotNull(), F.struct(*fields))).drop("read", "record")


def answered(patterns: DataFrame, replies: DataFrame, key: str = "id", reply: str = "reply") -> DataFrame:
    """patterns(key, fields of a record, ...) with the fields of the replies(key, reply), record by record: those of a
    reply that could be read, else those that patterns gave. from_reply tells which."""
    told = reply_fields(replies.select(key, reply), reply).select(key, "answer")
    own = [f for f in ASKED if f in patterns.columns]
    joined = patterns.join(told, key, "left")
    chosen = {f: F.when(F.col("answer").isNotNull(), F.col(f"answer.{f}")).otherwise(F.col(f)) for f in own}
    return joined.withColumns({**chosen, "from_reply": F.col("answer").isNotNull()}).drop("answer")
