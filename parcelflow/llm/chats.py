"""Operator 7 [native]: chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once, with that speaker as the assistant and the
others as named users; the mask says which characters are the assistant's own words and so are trained on. A turn is

    <|system|>text<|end|>        <|user:NAME|>text<|end|>        <|assistant|>text<|end|>

and its mask, if it is the assistant's, covers text<|end|>. In texts and names ``<|`` becomes ``< |``, so no text can
open a turn. Every role but ``system`` is a participant.

Turns are rendered in the order of turn, then of a checksum of role and text, then of these. Every rendering is that of
the whole dialogue. One of more than PART turns lies in several rows, its consecutive pieces of PART turns each, so that
no row and no task holds an unbounded dialogue: the texts of parts 0, 1, 2, ... joined are the whole (``whole`` does so
for those who have the memory). Masks count from the beginning of their part, ``n_parts`` says how many there are.

Places are counted in levels (ranges of turns, turns and checksums, equal rows), so that one hot conversation or turn
number is spread over tasks.

Defined results. A null text is an empty one. A null or blank role speaks as a user without a name and is no
participant. A null turn counts as turn 0, before others of that turn. Rows without conv_id form one conversation whose
conv_id is null. Rows that repeat are rendered each. Very long texts are rendered whole, in their turn's row. A
conversation without participants gives no rows; an empty table gives none; columns besides the four are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = 256
END = "<|end|>"


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _placed(conversations: DataFrame, part: int) -> DataFrame:
    """conv_id, part, place, role ('' if none) and text of each turn, and n_parts of its conversation."""
    role = F.coalesce(F.trim(F.col("role").cast("string")), F.lit(""))
    turn = F.col("turn").cast("long")
    conv = F.struct(F.col("conv_id").cast("long").alias("id")).alias("conv")  # equal to itself, also around a null
    turns = conversations.select(conv, F.coalesce(turn, F.lit(0)).alias("turn"), turn.isNotNull().alias("numbered"), role.alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    mark = F.md5(F.concat("role", F.lit("\n"), "text")).alias("mark")
    rows = turns.groupBy("conv", "turn", "numbered", "role", "text").agg(F.count("*").alias("copies")).select("*", F.floor(F.col("turn") / part).alias("range"), mark, F.substring(mark, 1, 2).alias("lot"))

    def running(own: list[str], order: list[str]) -> Column:
        window = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(window), F.lit(0))

    lots = rows.groupBy("conv", "range", "turn", "numbered", "lot").agg(F.sum("copies").alias("n"))
    ranges = lots.groupBy("conv", "range").agg(F.sum("n").alias("n"))
    whole = ranges.groupBy("conv").agg(F.sum("n").alias("turns"))
    starts = ranges.select("conv", "range", running(["conv"], ["range"]).alias("range_start"))
    lot = ["conv", "range", "turn", "numbered", "lot"]
    within = lots.select(*lot, running(["conv", "range"], lot[2:]).alias("lot_start"))
    own = rows.withColumn("n", F.col("copies")).withColumn("own_start", running(lot, ["mark", "role", "text"]))
    both = own.join(within, lot).join(starts, ["conv", "range"]).join(whole, "conv")
    first = F.expr("range_start + lot_start + own_start")
    placed = both.select("conv.id", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("place"), "role", "text", F.ceil(F.col("turns") / part).alias("n_parts"))
    placed = placed.withColumnRenamed("id", "conv_id")
    return placed.withColumn("part", F.floor(F.col("place") / part).cast("long"))


def rotated(conversations: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, speaker, part, n_parts, n_turns, text, mask ("begin-end,..." in characters, end excluded) and n_masked."""
    turns = _placed(conversations, part)
    parts = turns.groupBy("conv_id", "part").agg(F.first("n_parts").alias("n_parts"), F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    role = F.trim(F.col("role").cast("string"))
    speakers = conversations.select(F.col("conv_id").cast("long").alias("of"), role.alias("speaker")).where("speaker <> '' and speaker <> 'system'").distinct()
    both = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")

    def said(x: Column) -> Column:
        head = F.when(x["role"] == F.col("speaker"), F.lit("<|assistant|>")).when(x["role"] == "system", F.lit("<|system|>")).when(x["role"] == "", F.lit("<|user|>")).otherwise(F.concat(F.lit("<|user:"), _plain(x["role"]), F.lit("|>")))
        body = F.concat(_plain(x["text"]), F.lit(END))
        return F.struct(head.alias("head"), body.alias("body"), (x["role"] == F.col("speaker")).alias("own"))

    pieces = both.withColumn("said", F.transform("turns", said))

    def step(held: Column, x: Column) -> Column:
        begin = held["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        span = F.concat_ws("-", begin.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(x["own"], F.concat(held["spans"], F.array(span))).otherwise(held["spans"]).alias("spans"), (held["masked"] + F.when(x["own"], end - begin).otherwise(0)).alias("masked"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).alias("masked"))
    marked = pieces.withColumn("marks", F.aggregate("said", start, step))
    return marked.select("conv_id", "speaker", "part", "n_parts", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("said", lambda x: F.concat(x["head"], x["body"])), "").alias("text"), F.array_join("marks.spans", ",").alias("mask"), F.col("marks.masked").cast("long").alias("n_masked"))


def whole(rendered: DataFrame) -> DataFrame:
    """conv_id, speaker, text and mask of each whole dialogue, from the rows of rotated: in one row, whatever its length."""
    parts = F.array_sort(F.collect_list(F.struct("part", "text", "mask", F.length("text").cast("long").alias("size"))))
    rows = rendered.groupBy("conv_id", "speaker").agg(parts.alias("parts"))
    moved = lambda spans, by: F.transform(F.filter(F.split(spans, ","), lambda s: s != ""), lambda s: F.array_join(F.transform(F.split(s, "-"), lambda x: (x.cast("long") + by).cast("string")), "-"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))
    joined = F.aggregate("parts", start, lambda held, p: F.struct((held["at"] + p["size"]).alias("at"), F.concat(held["spans"], moved(p["mask"], held["at"])).alias("spans")))
    return rows.select("conv_id", "speaker", F.array_join("parts.text", "").alias("text"), F.array_join(joined["spans"], ",").alias("mask"))


def rotated_sql(part: int = PART, conversations: str = "conversations") -> str:
    """rotated in DuckDB's SQL."""
    return f"""
WITH turns AS (
  SELECT conv_id, coalesce(turn, 0) AS turn, turn IS NOT NULL AS numbered, coalesce(trim(role), '') AS role, coalesce(text, '') AS text
  FROM {conversations}),
placed AS (
  SELECT conv_id, role, text, count(*) OVER (PARTITION BY conv_id) AS turns,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, numbered, md5(role || chr(10) || text), role, text) - 1 AS place
  FROM turns),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> '' AND role <> 'system'),
said AS (
  SELECT t.conv_id, s.speaker, (place // {part})::BIGINT AS part, ((turns + {part - 1}) // {part})::BIGINT AS n_parts, place, t.role = s.speaker AS own,
         CASE WHEN t.role = s.speaker THEN '<|assistant|>' WHEN t.role = 'system' THEN '<|system|>' WHEN t.role = '' THEN '<|user|>'
              ELSE '<|user:' || replace(t.role, '<|', '< |') || '|>' END AS head,
         replace(text, '<|', '< |') || '{END}' AS body
  FROM placed t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
ended AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto
  FROM said)
SELECT conv_id, speaker, part, n_parts, count(*)::BIGINT AS n_turns, string_agg(head || body, '' ORDER BY place) AS text,
       coalesce(string_agg((upto - length(body))::BIGINT || '-' || upto::BIGINT, ',' ORDER BY place) FILTER (own), '') AS mask,
       coalesce(sum(length(body)) FILTER (own), 0)::BIGINT AS n_masked
FROM ended GROUP BY conv_id, speaker, part, n_parts"""
