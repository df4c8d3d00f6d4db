"""Operator 4 [native]: mixing sources to target weights by systematic sampling.

1. A document's size is its number of words. Sources by code point, null last, get the weights in turn; the whole size
   is shared out by weight, a source's target stops at MOST times its size, and the excess is shared again by weight
   until no target is above its stop. Sources are filled in the order of stop / weight, so one pass over prefix sums of
   the (few) sources finds who is stopped.
2. Every document of a source expects target / size copies. Documents are ordered by size, then by a hash, so the copies
   of each size come near their share; a random offset (a hash of seed and source) is added to the prefix sum of expected
   copies, and a document is emitted once for each whole number that its stretch of the sum crosses.

The prefix sum has three levels: over the sizes of a source, over the first two hex digits of the hash within a size,
and over the rows of such a bin. Only counts meet by source; a source with a third of all rows is spread over its bins.

Defined results. A null text has size 0. Null sources form one source, the last. A source without words has the target
0 and gives no copies; an empty table gives no rows. Rows that repeat are ranked one after the other. Columns other than
doc_id, text and source are carried along untouched, whatever their names. As a target is at most MOST times its source,
no document is taken more than MOST times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fields, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix"
_KEY = ["no_source", "source"]
_BIN = [*_KEY, "size", "digits"]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """no_source, source, source_size, target of sizes(no_source, source, source_size): one row for each source."""
    by_name, everything = Window.orderBy("no_source", "source"), Window.partitionBy()
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    filled = Window.orderBy(F.col("stop") / F.col("weight"), "no_source", "source").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("weight", weight).withColumn("stop", F.lit(most) * F.col("source_size"))
    summed = ranked.select("*", F.sum("source_size").over(everything).alias("total"), F.sum("weight").over(everything).alias("weights"), F.coalesce(F.sum("stop").over(filled), F.lit(0)).alias("stopped"), F.coalesce(F.sum("weight").over(filled), F.lit(0)).alias("gone"))
    # With all sources before it stopped, would this one still go over? Once one doesn't, none after it does.
    share = (F.col("weight") * (F.col("total") - F.col("stopped"))).cast("double") / (F.col("weights") - F.col("gone")).cast("double")
    first = summed.withColumn("share", share).withColumn("over", F.col("share") > F.col("stop"))
    # The level of those that aren't stopped is that of the first of them.
    level = F.min(F.when(~F.col("over"), F.struct("stopped", "gone"))).over(everything)
    free = first.withColumn("level", level)
    rest = (F.col("weight") * (F.col("total") - F.col("level.stopped"))).cast("double") / (F.col("weights") - F.col("level.gone")).cast("double")
    return free.select(*_KEY, "source_size", F.when(F.col("over"), F.col("stop").cast("double")).otherwise(rest).alias("target"))


def _offset(seed: str) -> Column:
    """In (0, 1): from the first 32 bits of a hash of the seed and the source."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.when(F.col("no_source") == 1, F.lit("null")).otherwise(F.concat(F.lit("="), "source"))))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(2**32)


def _hash(docs: DataFrame, carried: list[Column]) -> Column:
    """Of a row's carried columns but the text; what holds a map is hashed as JSON."""
    plain = [c if "map<" not in kind else F.to_json(F.struct(c)) for c, (name, kind) in zip(carried, docs.select(*carried).dtypes, strict=True) if name != "text"]
    return F.xxhash64(*plain) if plain else F.lit(0)


def mixed(docs: DataFrame, carried: list[Column], weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The carried columns of each row of docs as the struct row, with size, source_size, target and copies."""
    source = docs["source"].cast("string")
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(docs["doc_id"].cast("string"), F.lit("null"))))
    text = docs["text"].cast("string")
    rows = docs.select(F.struct(*carried).alias("row"), docs["source"].isNull().cast("int").alias("no_source"), F.coalesce(source, F.lit("")).alias("source"), word_count(text).alias("size"), order.alias("order"), F.xxhash64(text).alias("tie"), _hash(docs, carried).alias("rest")).withColumn("digits", F.substring("order", 1, 2))
    counted = rows.groupBy(*_BIN).agg(F.count("*").alias("held"))
    of_size = counted.groupBy(*_KEY, "size").agg(F.sum("held").alias("of_size"))
    of_source = of_size.groupBy(*_KEY).agg(F.sum(F.col("size") * F.col("of_size")).alias("source_size"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    smaller = F.coalesce(F.sum("of_size").over(upto(Window.partitionBy(*_KEY).orderBy("size"))), F.lit(0))
    sizes = of_size.withColumn("smaller", smaller).drop("of_size").join(targets(of_source, weights, most), _KEY)
    earlier = F.coalesce(F.sum("held").over(upto(Window.partitionBy(*_KEY, "size").orderBy("digits"))), F.lit(0))
    begun = counted.withColumn("earlier", earlier).drop("held").join(sizes, [*_KEY, "size"]).withColumn("begin", F.col("smaller") + F.col("earlier"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(*_BIN).orderBy("order", "tie", "rest")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    here = F.col("begin") + F.col("place")
    crossed = lambda n: F.floor(n.cast("double") * F.col("rate") + F.col("offset"))
    joined = placed.join(begun, _BIN).withColumn("rate", rate).withColumn("offset", _offset(seed))
    return joined.select("row", "size", "source_size", "target", (crossed(here) - crossed(here - 1)).alias("copies"))


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and copies of each row of docs."""
    found = mixed(docs, [docs["doc_id"]], weights, most, seed)
    return found.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with their columns."""
    taken = mixed(docs, fields(docs), weights, most, seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def mix_sql(weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, documents: str = "documents") -> str:
    """mix_report in DuckDB's SQL."""
    return f"""
WITH rows AS (
  SELECT doc_id, (source IS NULL)::INT AS no_source, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{seed}|' || coalesce(doc_id::VARCHAR, 'null')) AS ordered
  FROM {documents}),
sized AS (SELECT no_source, source, sum(size)::BIGINT AS source_size FROM rows GROUP BY ALL),
ranked AS (
  SELECT *, {most} * source_size AS stop,
         [{", ".join(map(str, weights))}][((row_number() OVER (ORDER BY no_source, source) - 1) % {len(weights)} + 1)::INT]::BIGINT AS weight
  FROM sized),
summed AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS weights,
         coalesce(sum(stop) OVER w, 0)::BIGINT AS stopped, coalesce(sum(weight) OVER w, 0)::BIGINT AS gone
  FROM ranked
  WINDOW w AS (ORDER BY stop::DOUBLE / weight, no_source, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tried AS (SELECT *, (weight * (total - stopped))::DOUBLE / (weights - gone)::DOUBLE > stop AS is_over FROM summed),
levelled AS (SELECT *, min(stopped) FILTER (NOT is_over) OVER () AS s, min(gone) FILTER (NOT is_over) OVER () AS g FROM tried),
aimed AS (
  SELECT no_source, source, source_size,
         CASE WHEN is_over THEN stop::DOUBLE ELSE (weight * (total - s))::DOUBLE / (weights - g)::DOUBLE END AS target,
         (('0x' || substr(md5('{seed}|' || CASE WHEN no_source = 1 THEN 'null' ELSE '=' || source END), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0 AS start
  FROM levelled),
placed AS (SELECT *, row_number() OVER (PARTITION BY no_source, source ORDER BY size, ordered) AS place FROM rows),
taken AS (
  SELECT doc_id, size, source_size, target,
         (floor(place::DOUBLE * rate + start) - floor((place - 1)::DOUBLE * rate + start))::BIGINT AS copies
  FROM placed JOIN (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS rate FROM aimed) USING (no_source, source))
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM taken"""
