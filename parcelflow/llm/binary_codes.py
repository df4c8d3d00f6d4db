"""Operator 5: exact top-k search of binary codes by incremental multi-index hashing.

1. A vector becomes a code of 64 bits: bit i is set where component i is above zero (components beyond 64 are folded by
   exclusive or, so the code always has 64 bits).
2. Codes are cut into segments, about 64 / log2(rows) of them, and keyed by each segment's value. A query unfolds its
   segments into all values that differ in r bits, for r = 0, 1, 2 and so on; an equi-join by key finds the codes. A code
   is taken where it first shows: at the least radius and, of those, the first segment. So no pair comes twice.
3. After radius r every code within segments * (r + 1) - 1 bits has been seen, because in one segment at least it differs
   by r or less. Queries whose kth verified distance is within that are done and leave; the rest go on to r + 1.

Of equal codes only the k + 1 smallest ids can be among the k nearest of any query, so only those are indexed, and equal
queries are searched once; both follow from the order by distance and vec_id and lose nothing. Values that occur are a
table of 2 ** 18 bits at most where segments have up to 16 bits, and probes for other values aren't sent.

Defined results. Vectors that are null, empty or hold a null or NaN give no code and take no part, nor do rows without
vec_id. A query is never its own candidate. Of rows that repeat a vec_id the greatest vector counts. A table with k
candidates or fewer gives all. Very long vectors are folded like others. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget, kept

BITS = 64
#: Segments at least and at most, and the widest one whose values are listed.
FEWEST, MOST, LISTED = 3, 8, 16


def segments(rows: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment for so many rows."""
    many = min(MOST, max(FEWEST, round(BITS / math.log2(max(2, rows)))))
    edges = [round(k * BITS / many) for k in range(many + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def codes(vectors: DataFrame) -> DataFrame:
    """id and code (long) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), vector.alias("vector")).where("id is not null and vector is not null and size(vector) > 0").where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)))
    bit = F.expr(f"aggregate(sequence(0, size(vector) - 1), 0L, (c, i) -> c ^ if(vector[i] > 0, shiftleft(1L, i % {BITS}), 0L))")
    return rows.groupBy("id").agg(F.max("vector").alias("vector")).select("id", bit.alias("code"))


@cache
def _flips(width: int, radius: int) -> np.ndarray:
    """All values of so many bits with radius bits set."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(width), radius)], dtype=np.int64)


def _probe_batches(cuts: list[tuple[int, int]], radius: int, listed: list[np.ndarray] | None):
    def run(batches):
        """code and the keys whose segment differs from its own in radius bits, if such values occur."""
        for batch in batches:
            for code in batch.column(0).to_pylist():
                for number, (first, width) in enumerate(cuts):
                    values = _flips(width, radius) ^ ((code >> first) & ((1 << width) - 1))
                    if listed is not None:
                        values = values[listed[number][values]]
                    for at in range(0, len(values), 1 << 16):
                        keys = (values[at : at + (1 << 16)] << 4) | number
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), code)), pa.array(keys)], names=["q", "key"])

    return run


def _joined(batches):
    """Batches of a useful size."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= 1 << 16:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _value(code: str, first: int, width: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1))


def _first_shown(cuts: list[tuple[int, int]], radius: int) -> Column:
    """Whether a pair of codes q and code shows at this radius and segment first."""
    number, fits = F.col("key").bitwiseAND(F.lit(15)), F.lit(True)
    for k, (first, width) in enumerate(cuts):
        apart = F.bit_count(_value("q", first, width).bitwiseXOR(_value("code", first, width)))
        fits &= F.when(F.lit(k) < number, apart > radius).otherwise(apart >= radius)
    return fits


def nearest_codes(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest codes of the rows whose vec_id is divisible by every."""
    every_row = cut(codes(vectors))
    place = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    rows = every_row.withColumn("place", place).where(F.col("place") <= k + 1).select("id", "code")
    n = every_row.count()
    cuts, need = segments(n), min(k + 1, n)
    keys = F.array(*(F.shiftleft(_value("code", first, width), 4).bitwiseOR(F.lit(s)) for s, (first, width) in enumerate(cuts)))
    index = cut(rows.select("id", "code", F.explode(keys).alias("key")))
    listed = None
    if max(width for _, width in cuts) <= LISTED:
        listed = [np.zeros(1 << width, bool) for _, width in cuts]
        for r in index.select("key").distinct().collect():  # at most segments * 2 ** width values
            listed[r.key & 15][r.key >> 4] = True
    queries = every_row.where(F.col("id") % every == 0)
    asked = kept(queries.select(F.col("code").alias("q")).distinct())
    done, best = [], None
    for radius in range(max(width for _, width in cuts) + 1):
        probed = asked.repartition("q").mapInArrow(lambda b, radius=radius: _joined(_probe_batches(cuts, radius, listed)(b)), "q long, key long")
        found = index.hint("merge").join(probed, "key").where(_first_shown(cuts, radius)).select("q", "id", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).alias("distance"))
        both = found if best is None else best.select("q", "id", "distance").union(found)
        ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where(F.col("rank") <= need)
        last, best = best, kept(ranked)
        far = best.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        covered = far.where((F.col("n") >= need) & (F.col("far") <= len(cuts) * (radius + 1) - 1)).select("q")
        done.append(kept(best.hint("merge").join(covered, "q", "left_semi").select("q", "id", "distance")))
        before, asked = asked, kept(asked.hint("merge").join(covered, "q", "left_anti"))
        rest = kept(best.hint("merge").join(asked, "q", "left_semi"))
        forget(before, best, *([last] if last is not None else []))
        best = rest
        if asked.isEmpty():
            break
    nearest = done[0]
    for more in done[1:]:
        nearest = nearest.union(more)
    nearest = nearest.union(best.select("q", "id", "distance"))  # those of tables without enough rows
    own = nearest.select("q", F.col("id").alias("vec_id"), F.col("distance").cast("long").alias("distance"))
    pairs = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).hint("merge").join(own, "q").where("query_id <> vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def nearest_codes_sql(k: int = 20, every: int = 20, embeddings: str = "embeddings") -> str:
    """nearest_codes in DuckDB's SQL."""
    half = lambda at: f"list_sum(list_transform(range({at}, {at + 32}), lambda i: CASE WHEN (len(list_filter(range(i + 1, len(embedding) + 1, {BITS}), lambda j: embedding[j] > 0)) % 2) = 1 THEN (1::BIGINT << (i - {at})::INT) ELSE 0 END))::BIGINT"
    return f"""
WITH vectors AS (
  SELECT vec_id AS id, max(embedding) AS embedding FROM {embeddings}
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 GROUP BY 1),
rows AS (SELECT id, {half(0)} AS low, {half(32)} AS high FROM vectors),
pairs AS (
  SELECT q.id AS query_id, r.id AS vec_id, (bit_count(xor(q.low, r.low)) + bit_count(xor(q.high, r.high)))::BIGINT AS distance
  FROM rows q JOIN rows r ON q.id <> r.id WHERE q.id % {every} = 0)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, distance FROM pairs
WINDOW w AS (PARTITION BY query_id ORDER BY distance, vec_id)
QUALIFY row_number() OVER w <= {k}"""
