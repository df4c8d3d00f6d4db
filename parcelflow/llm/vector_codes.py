"""Operator 11: compression of vectors to codes, by product quantisation whose codebooks are fitted with Elkan's Lloyd.

1. A component becomes the integer floor(4096 * x); a vector is cut into PARTS equal parts. Each part position has a
   codebook of up to ENTRIES entries, at first those parts of the vectors with the smallest ids.
2. A row's state holds, for each part, its entry, an upper bound of the distance to it and a lower bound of the distance
   to every entry. Bounds are integers, rounded to the safe side: upper ones up, lower ones down.
3. A round moves the bounds by how far entries have moved, and passes an entry over where the triangle inequality proves
   it strictly farther: 2 * upper < distance between the entries, or upper < its lower bound. What is left is decided by
   exact squared distances, so ties go to the lower index as they would without bounds.
4. State is written in each round (and the one before deleted); new entries are sums over (part, entry), pre-aggregated
   in tasks, of which the driver sees PARTS * ENTRIES rows.

Whatever is skipped, the result equals Lloyd's with all distances. States and sums are tables in the shared folder, so a
lost executor costs the round at hand.

Defined results. Vectors that are null, empty or hold a null or non-finite component, or have another length than most
(of equally common ones the shortest), are dropped; repeated rows count and are returned one by one. A null vec_id comes
after all others, and equal ones are ordered by their vectors. A length that PARTS doesn't divide is filled up with
zeros. Fewer than ENTRIES rows start as many entries; no rows give no result. Integers beyond what keeps squared
distances within 63 bits (for 64 dimensions about 1.9e8, a component of 46,000) are set to that limit. Null labels are
one label. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, kept

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Sums of up to so many labels are broadcast; those of more are joined by a shuffle.
FEW_LABELS = 20_000
#: Rows that are compared at once.
_SLICE = 4096
_STATE = "vec_id long, label long, parts binary, entries binary, upper binary, lower binary, looked long"


def _floor_root(x: np.ndarray) -> np.ndarray:
    """Integer square roots of whole numbers below 2 ** 62."""
    root = np.sqrt(x.astype(np.float64)).astype(np.int64)
    root -= root * root > x
    root += (root + 1) * (root + 1) <= x
    return root


def _ceil_root(x: np.ndarray) -> np.ndarray:
    root = _floor_root(x)
    return root + (root * root < x)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    far = x - y
    return np.einsum("...k,...k->...", far, far)


def assign(x: np.ndarray, book: np.ndarray, entries: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Assign parts x (n, dims) to entries of a codebook; entries (n), upper (n) and lower (n, entries) are updated.

    Bounds hold for book as it is. Returns how many distances were calculated.
    """
    between = _squares(book[:, None], book[None])
    apart = _floor_root(between)
    np.fill_diagonal(apart, np.iinfo(np.int64).max)
    rows = np.flatnonzero(2 * upper >= apart.min(1)[entries])
    own = entries[rows]
    # Those whose bound may be loose get an exact one; most then need no other distance.
    square = _squares(x[rows], book[own])
    upper[rows], lower[rows, own] = _ceil_root(square), _floor_root(square)
    need = (lower[rows] <= upper[rows, None]) & (apart[own] <= 2 * upper[rows, None])
    need[np.arange(len(rows)), own] = False
    i, c = np.nonzero(need)
    if len(i):
        found = _squares(x[rows[i]], book[c])
        lower[rows[i], c] = _floor_root(found)
        table = np.full(need.shape, np.iinfo(np.int64).max)
        table[np.arange(len(rows)), own] = square
        table[i, c] = found
        entries[rows] = table.argmin(1)  # the first of equal ones
        upper[rows] = _ceil_root(table.min(1))
    return len(rows) + len(i)


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and vector (integers, a multiple of PARTS of them) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = rows.where("vector is not null and size(vector) > 0").where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    width = sound.groupBy(F.size("vector").alias("width")).count().agg(F.max_by("width", F.struct("count", -F.col("width")))).first()[0]
    if width is None:
        return sound.withColumn("vector", F.col("vector").cast("array<long>"))
    most, filled = isqrt(2**61 // width), -width % PARTS
    number = lambda x: F.greatest(F.least(F.floor(F.least(F.greatest(x, F.lit(-1e15)), F.lit(1e15)) * SCALE), F.lit(most)), F.lit(-most))
    return sound.where(F.size("vector") == F.lit(width)).withColumn("vector", F.concat(F.transform("vector", number), F.array_repeat(F.lit(0).cast("long"), filled)))


def _start(books: np.ndarray):
    """States whose bounds say nothing yet; parts are kept in as few bytes as hold them."""
    parts, entries = books.shape[:2]

    def run(batches):
        for batch in batches:
            n = len(batch)
            x = np.asarray(batch.column("vector").flatten(), np.int64).reshape(n, -1)
            kinds = [k for k in (np.int16, np.int32, np.int64) if not n or np.abs(x).max() <= np.iinfo(k).max]
            blank = [np.zeros((n, parts), np.uint8), np.full((n, parts), np.iinfo(np.uint32).max, np.uint32), np.zeros((n, parts, entries), np.uint32)]
            columns = [batch.column("vec_id"), batch.column("label"), _bytes(x.astype(kinds[0])), *map(_bytes, blank), pa.array(np.zeros(n, np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "parts", "entries", "upper", "lower", "looked"])

    return run


def _bytes(x: np.ndarray) -> pa.Array:
    """One binary value for each row of x."""
    raw = np.ascontiguousarray(x)
    width = raw[0].nbytes if len(raw) else 0
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1) * width).astype(np.int32)), pa.py_buffer(raw.tobytes())])


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    """The values of a binary column, all of one length, as longs."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64).reshape(len(column), -1)


def _parts(column: pa.Array, parts: int, dims: int) -> np.ndarray:
    """(rows, parts, dims) of a binary column, whose rows may have integers of different sizes."""
    raw, out = column.to_pylist(), np.zeros((len(column), parts * dims), np.int64)
    sizes = np.array([len(r) for r in raw], np.int64) // (parts * dims)
    for kind in (np.int16, np.int32, np.int64):
        own = np.flatnonzero(sizes == np.dtype(kind).itemsize)
        if len(own):
            out[own] = np.frombuffer(b"".join(raw[i] for i in own.tolist()), kind).reshape(len(own), -1)
    return out.reshape(-1, parts, dims)


def _round(books: np.ndarray, moved: np.ndarray):
    """The states' next round: bounds moved by how far the entries have, parts assigned to books."""
    parts, entries, dims = books.shape
    top = np.iinfo(np.uint32).max

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), _SLICE):
                batch = whole.slice(at, _SLICE)
                n = len(batch)
                x = _parts(batch.column("parts"), parts, dims)
                own = _numbers(batch.column("entries"), np.uint8)
                upper = _numbers(batch.column("upper"), np.uint32)
                lower = _numbers(batch.column("lower"), np.uint32).reshape(n, parts, entries)
                upper = np.where(upper == top, 1 << 61, upper + moved[np.arange(parts), own])  # the largest value says nothing
                lower = np.maximum(lower - moved, 0)
                looked = sum(assign(x[:, p], books[p], own[:, p], upper[:, p], lower[:, p]) for p in range(parts))
                spent = np.zeros(n, np.int64)
                spent[0] = looked
                columns = [*(batch.column(c) for c in ("vec_id", "label", "parts")), _bytes(own.astype(np.uint8)), _bytes(np.minimum(upper, top).astype(np.uint32)), _bytes(np.minimum(lower, top).astype(np.uint32)), pa.array(spent)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def _sums(books: np.ndarray):
    """A row for each part and entry of a task's states: how many parts and the sum of each component."""
    parts, entries, dims = books.shape

    def run(batches):
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, dims), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x, own = _parts(batch.column(0), parts, dims), _numbers(batch.column(1), np.uint8)
            for p in range(parts):
                np.add.at(total[p], own[:, p], x[:, p])
                count[p] += np.bincount(own[:, p], minlength=entries)
        p, e = np.nonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * dims), pa.array(total[p, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), lists], names=["part", "entry", "n", "total"])

    return run


def _moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries after a round: their parts' floor(sum / count); unused ones stay."""
    sums = state.select("parts", "entries").mapInArrow(_sums(books), "part int, entry int, n long, total array<long>")
    each = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[d]).alias(f"t{d}") for d in range(books.shape[2])))
    new = books.copy()
    for r in each.collect():  # PARTS * ENTRIES rows at most
        new[r.part, r.entry] = [r[f"t{d}"] // r.n for d in range(books.shape[2])]
    return new


def fit_and_assign(rows: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame | None, np.ndarray, list[int]]:
    """States of rows(vec_id, label, vector) after so many rounds and a last assignment, the codebooks (part, entry,
    component), and how many distances each assignment calculated. The states are to be forgotten by the caller."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    if not first:
        return None, np.zeros((PARTS, 0, 0), np.int64), []
    books = np.array([r.vector for r in first], np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy()
    state, moved, looked = kept(rows.mapInArrow(_start(books), _STATE)), np.zeros(books.shape[:2], np.int64), []
    for k in range(rounds + 1):
        before, state = state, kept(state.mapInArrow(_round(books, moved), _STATE))
        forget(before)
        looked.append(state.agg(F.sum("looked")).first()[0])
        if k < rounds:
            new = _moved_books(state, books)
            moved, books = _ceil_root(_squares(new, books)), new
    return state, books, looked


def _coded(books: np.ndarray):
    parts, _, dims = books.shape

    def run(batches):
        """vec_id, label, code and error of each state."""
        for batch in batches:
            if not len(batch):
                continue
            x, own = _parts(batch.column("parts"), parts, dims), _numbers(batch.column("entries"), np.uint8)
            error = _squares(x, books[np.arange(parts), own]).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([bytes(c).hex() for c in own.astype(np.uint8)]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def compressed(vectors: DataFrame, few_labels: int = FEW_LABELS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the vectors that take part."""
    state, books, _ = fit_and_assign(whole_numbers(vectors))
    if state is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    codes = kept(state.mapInArrow(_coded(books), "vec_id long, label long, code string, error long"))
    forget(state)
    sums = kept(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    by_label = F.broadcast(sums) if sums.count() <= few_labels else sums
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def compressed_sql(embeddings: str = "embeddings", rounds: int = ROUNDS) -> str:
    """compressed in DuckDB's SQL, all distances calculated, for vectors of one length that PARTS divides."""
    nearest = lambda book: f"""
  SELECT x.row, x.part, arg_min(b.entry, (list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry)) AS entry,
    min(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS far
  FROM parts x JOIN {book} b ON x.part = b.part GROUP BY 1, 2"""  # noqa: E731
    steps = ""
    for k in range(rounds):
        steps += f"""
near{k} AS MATERIALIZED ({nearest(f"book{k}")}),
mean{k} AS (
  SELECT part, entry, list(value ORDER BY d) AS v FROM (
    SELECT n.part, n.entry, d, (sum(x.v[d]) - ((sum(x.v[d]) % count(*)) + count(*)) % count(*))::HUGEINT // count(*) AS value
    FROM near{k} n JOIN parts x ON n.row = x.row AND n.part = x.part, range(1, len(x.v) + 1) t(d) GROUP BY 1, 2, 3) GROUP BY 1, 2),
book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v::BIGINT[], b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON b.part = m.part AND b.entry = m.entry),"""
    return f"""
WITH rows AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS row, vec_id, label, v FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM {embeddings}
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
parts AS MATERIALIZED (SELECT row, p AS part, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM rows, range({PARTS}) t(p)),
book0 AS MATERIALIZED (SELECT part, (row - 1) AS entry, v FROM parts WHERE row <= {ENTRIES}),{steps}
last AS MATERIALIZED ({nearest(f"book{rounds}")}),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}),
coded AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM last GROUP BY 1)
SELECT r.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY r.label))::BIGINT AS label_error, codebooks_sha256
FROM rows r JOIN coded c ON r.row = c.row, digest"""
