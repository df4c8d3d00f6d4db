"""Operator 3: approximate nearest neighbours by cross-polytope hashing.

1. A unit vector is padded to a power of two and turned by fast pseudo-rotations (three rounds of random signs and a
   Hadamard transform); each assigns it to the nearest signed axis. In each of some tables the axes of a few rotations
   together are its bucket: TABLES tables whatever the number of rows, so the index grows with them alone; two axes, and
   one more for each factor of STEP rows.
2. A query looks into the buckets of each table in the order of how much farther their axes are than its own. How many
   is set so that a bounded sample of SAMPLE queries, held against every row, finds AIM of its true neighbours: the
   larger the table, the nearer they are and the smaller the share of it that is looked at. Every row is in the index.
3. A bucket is a list of ids for each block of rows. Lists and probes are joined by key; only ids are moved so far. Then
   blocks of rows and of queries meet, each with its lists, which are read as a stream: pairs are reranked by their exact
   inner product in double precision, repeats from several tables dropped. No bucket is capped.
4. Buckets follow directions. Vectors whose lengths differ by factors of two have tables of their own, so large inner
   products of far directions aren't missed; a group of SMALL vectors or fewer is one bucket that all queries look into.
   A query with fewer than k candidates is compared with every row, in blocks.

Of equal vectors only the k + 1 smallest ids can be among the k nearest of any query, so only those are indexed. Sums
are taken over each pair alone, so equal vectors get equal scores and ties go to the smaller vec_id. Where a sum exceeds
double precision it is taken on scaled vectors and is infinite, with the right sign.

Defined results. Vectors that are null, of another length than most, zero, or hold a null or non-finite component take
no part, nor do rows without vec_id. Of rows that repeat a vec_id the greatest vector counts. A table with k
rows or fewer gives all candidates. Other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

TABLES, STEP = 32, 1 << 24
#: Queries of the sample, the share of their neighbours that must be found there, and probes of a table at most.
SAMPLE, AIM, PROBES = 64, 0.94, 1024
SMALL = 256
#: Rows and queries of a block at most; where there are few, they are dealt to some blocks all the same.
BLOCK, QUERY_BLOCK, SOME = 32_768, 2048, 8


def shape_for(rows: int) -> tuple[int, int]:
    """How many tables so many rows have, and how many axes a bucket."""
    return TABLES, 2 + int(np.log(max(1, rows)) // np.log(STEP))


@cache
def _signs(dims: int) -> np.ndarray:
    return np.random.default_rng(20240301).choice(np.array([-1.0, 1.0], np.float32), (64 * 4, 3, dims))


@cache
def _turned_axes(dims: int, number: int) -> np.ndarray:
    return _turned(np.eye(dims, dtype=np.float32), number)


def rotate(x: np.ndarray, number: int) -> np.ndarray:
    """Rows of x (dims a power of two) under one pseudo-rotation, scaled to unit length.

    With few dimensions the turned axes, kept as a matrix, give the same with fewer passes.
    """
    return x @ _turned_axes(x.shape[1], number) if x.shape[1] <= 256 else _turned(x, number)


def _turned(x: np.ndarray, number: int) -> np.ndarray:
    n, dims = x.shape
    for signs in _signs(dims)[number]:
        x = x * signs
        half = 1
        while half < dims:
            pairs = x.reshape(n, dims // (2 * half), 2, half)
            x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], 2).reshape(n, dims)
            half *= 2
    return x / np.float32(dims**1.5)


def _padded(x: np.ndarray) -> np.ndarray:
    unit = x / np.abs(x).max(1, keepdims=True)
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
    return np.pad(unit, ((0, 0), (0, max(2, 1 << (x.shape[1] - 1).bit_length()) - x.shape[1])))


def bands(x: np.ndarray) -> np.ndarray:
    """The nearest power of two of each row's length, whatever its size."""
    most = np.abs(x).max(1)
    return np.rint(np.log2(most) + np.log2(np.linalg.norm(x / most[:, None], axis=1))).astype(np.int32)


def cells(x: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """(rows, tables): the bucket of each row in each table, from the nearest signed axes of so many rotations."""
    x, found, (tables, turns) = _padded(x), [], shape
    for t in range(tables):
        cell = np.zeros(len(x), np.int64)
        for k in range(turns):
            y = rotate(x, t * turns + k)
            best = np.abs(y).argmax(1)
            cell = cell * (2 * y.shape[1]) + best + np.where(y[np.arange(len(y)), best] < 0, y.shape[1], 0)
        found.append(cell)
    return np.stack(found, 1)


def probes(x: np.ndarray, shape: tuple[int, int], many: int) -> np.ndarray:
    """(rows, tables, at most many): the buckets of each table from the nearest on."""
    x, found, (tables, turns) = _padded(x), [], shape
    for t in range(tables):
        worse = cell = None
        for k in range(turns):
            y = rotate(x, t * turns + k)
            both = np.concatenate([y, -y], 1)
            far = (both.max(1, keepdims=True) - both) ** 2
            axis = np.argsort(far, axis=1, kind="stable")
            far = np.take_along_axis(far, axis, 1)
            if cell is None:
                worse, cell = far[:, :many], axis[:, :many].astype(np.int64)
                continue
            # Of two ascending lists the (i, j)th sum has (i + 1) * (j + 1) - 1 others that are no greater.
            i, j = np.nonzero(np.outer(np.arange(1, worse.shape[1] + 1), np.arange(1, far.shape[1] + 1)) <= many)
            worse, cell = worse[:, i] + far[:, j], cell[:, i] * both.shape[1] + axis[:, j]
            order = np.argsort(worse, axis=1, kind="stable")[:, :many]
            worse, cell = np.take_along_axis(worse, order, 1), np.take_along_axis(cell, order, 1)
        found.append(cell)
    return np.stack(found, 1)


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)


def _lists(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    flat, width = x.reshape(len(x), -1), x[0].size if len(x) else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(flat.ravel()))


def _band_batches(batches):
    for batch in batches:
        if len(batch):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bands(_matrix(batch.column(1))))], names=["id", "vector", "band"])


def _keys(band, cell: np.ndarray, shape: tuple[int, int], dims: int) -> np.ndarray:
    """One number for a band, a table (second axis of cell) and a bucket."""
    tables, size = shape[0], (2 * max(2, 1 << (dims - 1).bit_length())) ** shape[1]
    at = np.arange(tables).reshape((1, tables) + (1,) * (cell.ndim - 2))
    return ((np.asarray(band, np.int64).reshape((-1,) + (1,) * (cell.ndim - 1)) + 2048) * tables + at) * size + cell


def _rows_keyed(large: set[int], shape: tuple[int, int]):
    def run(batches):
        """id and its keys: those of its buckets, or that of its whole band if the band is small."""
        for batch in batches:
            if len(batch):
                x, band = _matrix(batch.column(1)), batch.column(2).to_numpy()
                keys = _keys(band, cells(x, shape), shape, x.shape[1])
                lists = [k if b in large else k[:0] for k, b in zip(keys, band.tolist(), strict=True)]
                lists = [k if len(k) else np.array([-1 - 2048 - b]) for k, b in zip(lists, band.tolist(), strict=True)]
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))], names=["id", "keys"])

    return run


def _queries_keyed(large: set[int], small: set[int], shape: tuple[int, int], many: int):
    def run(batches):
        """query and the keys it looks into: so many buckets of each table of each large band, and all small bands."""
        for batch in batches:
            for first in range(0, len(batch), 64):
                part = batch.slice(first, 64)
                x = _matrix(part.column(1))
                cell = probes(x, shape, many)
                keys = [_keys(np.full(len(x), b), cell, shape, x.shape[1]).reshape(len(x), -1) for b in sorted(large)]
                keys += [np.full((len(x), 1), -1 - 2048 - b) for b in sorted(small)]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(np.concatenate(keys, 1))], names=["query_id", "keys"])

    return run


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q and x, summed alike wherever a pair stands."""
    with np.errstate(over="ignore", invalid="ignore"):
        score = (q * x).sum(1)
        odd = ~np.isfinite(score)
        if odd.any():
            most = [np.abs(y[odd]).max(1) for y in (q, x)]
            scaled = ((q[odd] / most[0][:, None]) * (x[odd] / most[1][:, None])).sum(1)
            score[odd] = np.where(scaled == 0, 0.0, scaled * most[0] * most[1])
    return score


def _best_of(queries: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """Of pairs, the best k of each query; a pair that repeats counts once."""
    order = np.lexsort((ids, -score, queries))
    queries, ids, score = queries[order], ids[order], score[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (queries[1:] != queries[:-1]) | (ids[1:] != ids[:-1])
    queries, ids, score = queries[fresh], ids[fresh], score[fresh]
    begin = np.flatnonzero(np.concatenate([[True], queries[1:] != queries[:-1]])[: len(queries)])
    place = np.arange(len(queries)) - np.repeat(begin, np.diff(np.append(begin, len(queries))))
    return queries[place < k], ids[place < k], score[place < k]


_FOUND = "query_id long, vec_id long, score double"


def _table(queries, ids, score) -> pa.Table:
    return pa.table({"query_id": pa.array(queries, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})


class _Block:
    """Rows and queries of one pair of blocks, and the best of the pairs that it was given."""

    def __init__(self, key: tuple, k: int):
        self.key, self.k, self.parts = key, k, ([], [])
        self.ids = None
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def add(self, asked: int, table: pa.Table) -> None:
        self.parts[asked].append((table.column("id").to_numpy(), _matrix(table.column("vector").combine_chunks())))

    def rerank(self, queries: np.ndarray, ids: np.ndarray) -> None:
        if self.ids is None:
            both = [[np.concatenate(c) for c in zip(*p, strict=True)] for p in self.parts]
            order = [np.argsort(x[0]) for x in both]
            self.ids, self.vectors = ([x[k][o] for x, o in zip(both, order, strict=True)] for k in (0, 1))
        own = queries != ids
        q_at, at = (np.searchsorted(known, x[own]) for known, x in zip(self.ids[::-1], (queries, ids), strict=True))
        pairs = np.unique(q_at * len(self.ids[0]) + at)
        for first in range(0, len(pairs), 1 << 16):
            q_at, at = np.divmod(pairs[first : first + (1 << 16)], len(self.ids[0]))
            score = exact_scores(self.vectors[1][q_at], self.vectors[0][at])
            found = (self.ids[1][q_at], self.ids[0][at], score)
            self.best = _best_of(*(np.concatenate(c) for c in zip(self.best, found, strict=True)), self.k)


def _rerank(k: int):
    def run(batches):
        """Of batches sorted by block and kind (0 row, 1 query, 2 pairs): the best k of each query in each block."""
        block = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            key = np.stack([table.column(c).to_numpy() for c in ("row_block", "query_block", "kind")], 1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                own, kind, part = tuple(key[a, :2].tolist()), int(key[a, 2]), table.slice(a, b - a)
                if block is None or block.key != own:
                    if block is not None:
                        yield from _table(*block.best).to_batches()
                    block = _Block(own, k)
                if kind < 2:
                    block.add(kind, part)
                else:
                    lists = part.column("ids").combine_chunks()
                    many = np.diff(lists.offsets.to_numpy())
                    block.rerank(np.repeat(part.column("id").to_numpy(), many), lists.flatten().to_numpy())
        if block is not None:
            yield from _table(*block.best).to_batches()

    return run


def _compare(k: int):
    def run(vectors: pa.Table) -> pa.Table:
        """The best k of each query among all rows of a block."""
        asked = vectors.column("kind").to_numpy() == 1
        ids, x = vectors.column("id").to_numpy(), _matrix(vectors.column("vector").combine_chunks())
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i in np.flatnonzero(asked).tolist():
            use = ~asked & (ids != ids[i])
            out.append(_best_of(np.full(use.sum(), ids[i]), ids[use], exact_scores(x[i : i + 1], x[use]), k))
        return _table(*(np.concatenate(c) for c in zip(*out, strict=True)))

    return run


def _deal(n: int):
    return F.expr(f"cast(pmod(xxhash64(id, 7), {n}) as int)")


def _each_of(n: int):
    return F.explode(F.expr(f"sequence(0, {n - 1})"))


def _blocks(rows: DataFrame, queries: DataFrame, blocks: tuple[int, int]) -> DataFrame:
    """row_block, query_block, kind, id and vector: each row in all query blocks, each query in all row blocks."""
    left = rows.select(_deal(blocks[0]).alias("row_block"), "id", "vector").select("row_block", _each_of(blocks[1]).alias("query_block"), F.lit(0).alias("kind"), "id", "vector")
    right = queries.select(_deal(blocks[1]).alias("query_block"), "id", "vector").select(_each_of(blocks[0]).alias("row_block"), "query_block", F.lit(1).alias("kind"), "id", "vector")
    return left.union(right)


def _best(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k)


def usable(vectors: DataFrame) -> DataFrame:
    """id, vector (doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector")).where("id is not null and vector is not null and size(vector) > 0")
    sound = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0))
    width = sound.groupBy(F.size("vector").alias("width")).count().agg(F.max_by("width", F.struct("count", -F.col("width")))).first()[0]
    return sound.where(F.size("vector") == F.lit(width)).groupBy("id").agg(F.max("vector").alias("vector"))


def _probes_needed(rows: DataFrame, queries: DataFrame, k: int, shape: tuple[int, int], small: set[int]) -> int:
    """How many probes of each table find AIM of the k nearest of a sample of queries, held against every row."""
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()  # SAMPLE rows
    q_ids, q = np.array([r.id for r in sample]), np.array([r.vector for r in sample])

    def scored(batches):
        for batch in batches:
            if len(batch):
                ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
                for i in range(len(q)):
                    queries, found, score = _best_of(np.full(len(ids), q_ids[i]), ids, exact_scores(q[i : i + 1], x), k + 1)
                    yield pa.RecordBatch.from_pandas(_table(queries, found, score).to_pandas(), preserve_index=False)

    near = _best(rows.select("id", "vector").mapInArrow(scored, _FOUND).where("query_id <> vec_id"), k)
    true = near.join(rows.select(F.col("id").alias("vec_id"), "vector", "band"), "vec_id").select("query_id", "vector", "band").collect()  # SAMPLE * k rows
    if not true:
        return 1
    of = np.searchsorted(np.sort(q_ids), [r.query_id for r in true])
    order, cell = probes(q[np.argsort(q_ids)], shape, PROBES), cells(np.array([r.vector for r in true]), shape)
    rank = np.full(len(true), PROBES - 1)
    for t in range(shape[0]):  # table by table, so that little is held
        hit = order[of, t] == cell[:, t, None]
        rank = np.minimum(rank, np.where(hit.any(1), hit.argmax(1), PROBES - 1))
    rank[[r.band in small for r in true]] = 0
    return int(np.quantile(rank, AIM, method="higher")) + 1


def _counts(rows: DataFrame, queries: DataFrame) -> tuple[int, int]:
    """How many blocks the rows and the queries are dealt to."""
    n, asked = rows.count(), queries.count()
    return max(-(-n // BLOCK), min(SOME, -(-n // 1024)), 1), max(-(-asked // QUERY_BLOCK), min(SOME // 2, -(-asked // 128)), 1)


def candidates(rows: DataFrame, queries: DataFrame, k: int, blocks: tuple[int, int]) -> DataFrame:
    """row_block, query_block, id (of a query) and ids to rerank for it, from rows(id, vector, band) and queries(id, vector)."""
    sizes = {r.band: r.n for r in rows.groupBy("band").agg(F.count("*").alias("n")).collect()}  # a row for each exponent
    small = {b for b, n in sizes.items() if n <= SMALL}
    large, shape = set(sizes) - small, shape_for(sum(sizes.values()))
    many = _probes_needed(rows, queries, k, shape, small) if large else 1
    index = rows.select("id", "vector", "band").mapInArrow(_rows_keyed(large, shape), "id long, keys array<long>")
    lists = index.select(_deal(blocks[0]).alias("row_block"), "id", F.explode("keys").alias("key")).groupBy("key", "row_block").agg(F.collect_list("id").alias("ids"))  # BLOCK ids at most
    asked = queries.select("id", "vector").mapInArrow(_queries_keyed(large, small, shape, many), "query_id long, keys array<long>").select(F.col("query_id").alias("id"), F.explode("keys").alias("key"))
    return lists.join(asked, "key").select("row_block", _deal(blocks[1]).alias("query_block"), "id", "ids")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of the rows whose vec_id is divisible by every."""
    all_rows = cut(usable(vectors))
    queries = all_rows.where(F.col("id") % every == 0)
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    rows = cut(all_rows.withColumn("place", place).where(F.col("place") <= k + 1).select("id", "vector").mapInArrow(_band_batches, "id long, vector array<double>, band int"))
    blocks, keys = _counts(rows, queries), ["row_block", "query_block"]
    held = _blocks(rows, queries, blocks).withColumn("ids", F.lit(None).cast("array<long>"))
    pairs = candidates(rows, queries, k, blocks).select(*keys, F.lit(2).alias("kind"), "id", F.lit(None).cast("array<double>").alias("vector"), "ids")
    found = held.union(pairs).repartition(*keys).sortWithinPartitions(*keys, "kind", "id").mapInArrow(_rerank(k), _FOUND)
    best = cut(_best(found, k))
    least = min(k, rows.count() - 1)
    filled = best.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    short = cut(queries.join(filled, "id", "left_anti"))
    if least > 0 and not short.isEmpty():
        whole = _blocks(rows, short, _counts(rows, short)).groupBy(*keys).applyInArrow(_compare(k), _FOUND)
        best = best.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").select("query_id", "vec_id", "score", "rank").unionByName(_best(whole, k))
    return best.select("query_id", "rank", "vec_id", "score")
