"""Operator 12: near-duplicate vectors of equal label, by a pigeonhole join of subspaces.

1. Equal vectors of a label form a class, which counts for all its rows from here on.
2. Unit vectors are filled up to a power of two and turned by three rounds of random signs and a Hadamard transform, so
   distances spread over all components. They are split into blocks of BLOCK_DIMS components (more where there would be
   more than MOST_BLOCKS). Cosine c means a squared distance of 2 - 2c; each block has its equal share as budget, as all
   have as many components. Of a pair within 2 - 2c at least one block is within its budget.
3. Each block is joined by range: space is cut into cells as wide as the range's diameter along some components. A
   vector lies in its own cell and visits those with a greater number that its ball touches, so that any pair within the
   budget meets in one cell once. How many components the cells use follows from a bounded sample of the vectors; it
   changes the time only.
4. A cell's vectors meet in parts of bounded size; two parts meet as wholes only where a cell has more than one. In a
   task vectors are sorted into leaves of a k-d tree, and only leaves whose boxes are within the range are looked at.
   A candidate counts in the first block whose budget it keeps, so each pair is verified once, by its exact cosine.
5. A task returns for each vector how many it is linked with and one vector of the same component, never the pairs. Sums
   give n_links; the components of those edges are the groups.

Nothing depends on the order or the number of tasks: turned vectors and block distances are elementwise sums, equal
wherever they are taken. Vectors are identified with their two 64-bit hashes when rows are counted by class.

Defined results. Vectors that are null, empty, zero or hold a null or non-finite component, rows with a null label, and
vectors of different lengths link with nothing. Rows without vec_id link with nothing and get a null component and kept
= true. Rows that repeat a vec_id are vectors of their own; equal ones link. Very long vectors have wider blocks and
smaller parts. No rows give none. Other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .common import forget, kept
from .components import components

BLOCK_DIMS, MOST_BLOCKS = 8, 16
#: Added to budgets, which are compared with rounded sums.
SLACK = 1e-9
#: Vectors of a part at most, and numbers in them.
PART, PART_NUMBERS = 4096, 1 << 18
#: Vectors of the sample that decides about cells; a copy of a vector costs as much as so many comparisons.
SAMPLE, ROW_COST = 4096, 3000
#: Of large cells up to so many are broadcast.
FEW_CELLS = 10_000
LEAF, _AT_ONCE = 128, 1 << 15
_KEYS = ["label", "width", "block", "cell", "i", "j"]
_FOUND = "id long, n long, other long"


def padded(width: int) -> int:
    return max(BLOCK_DIMS, 1 << (width - 1).bit_length())


def blocks_of(width: int) -> int:
    return min(MOST_BLOCKS, padded(width) // BLOCK_DIMS)


@cache
def _signs(dims: int) -> np.ndarray:
    return np.random.default_rng(20240812).choice(np.array([-1.0, 1.0]), (3, dims))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, so that their squares neither overflow nor vanish."""
    x = vectors.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def turned(x: np.ndarray) -> np.ndarray:
    """Unit vectors of the rows of x (scaled), turned; each number is a sum of its own row in a fixed order."""
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    n, dims = len(unit), padded(unit.shape[1])
    y = np.pad(unit, ((0, 0), (0, dims - unit.shape[1])))
    for signs in _signs(dims):
        y = y * signs
        half = 1
        while half < dims:
            pairs = y.reshape(n, dims // (2 * half), 2, half)
            y = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], 2).reshape(n, dims)
            half *= 2
    return y / dims**1.5


def cells(y: np.ndarray, block: int, blocks: int, grid: int, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each row of turned vectors in a block, by so many of its components; then row and cell of each visit."""
    radius = (budget + 2 * SLACK) ** 0.5
    wide, base = 2 * radius, 2 * int(np.ceil(1 / (2 * radius))) + 5
    dims = y.shape[1] // blocks
    part = y[:, block * dims : block * dims + grid] / wide
    own = np.floor(part)
    above = part - own >= 0.5  # the ball's diameter is a cell's width, so it reaches one neighbour at most
    gap = np.where(above, own + 1 - part, part - own) * wide
    step, scale = np.where(above, 1, -1), base ** np.arange(grid - 1, -1, -1, dtype=np.int64)
    number = ((own.astype(np.int64) + base // 2) * scale).sum(1)
    rows, visited = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for mask in range(1, 1 << grid):
        bits = np.array([mask >> k & 1 for k in range(grid)])
        other = number + (step * bits * scale).sum(1)
        reach = np.flatnonzero((gap**2 @ bits <= radius**2) & (other > number))
        rows.append(reach)
        visited.append(other[reach])
    return number, np.concatenate(rows), np.concatenate(visited)


def _by_width(batch: pa.RecordBatch):
    """Row numbers and the matrix of the vectors of each length."""
    column = batch.column("vector")
    widths, flat = np.diff(column.offsets.to_numpy()), None
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        flat = column if len(rows) == len(batch) else column.take(pa.array(rows))
        yield rows, np.asarray(flat.flatten()).reshape(len(rows), width)


def _keyed(cosine: float, grid: int):
    def run(batches):
        """Of each vector: a list of numbers for the blocks and cells it lies in or visits (kind 1)."""
        for batch in batches:
            for rows, vectors in _by_width(batch):
                y, blocks = turned(scaled(vectors)), blocks_of(vectors.shape[1])
                row, block, cell, kind = [], [], [], []
                for b in range(blocks):
                    own, visitor, visited = cells(y, b, blocks, min(grid, y.shape[1] // blocks), (2 - 2 * cosine) / blocks)
                    row += [np.arange(len(rows)), visitor]
                    cell += [own, visited]
                    block.append(np.full(len(own) + len(visited), b))
                    kind.append(np.concatenate([np.zeros(len(own), bool), np.ones(len(visited), bool)]))
                row, cell, block, kind = map(np.concatenate, (row, cell, block, kind))
                order = np.argsort(row, kind="stable")
                at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(rows)))]).astype(np.int32)
                places = pa.StructArray.from_arrays([pa.array(block[order].astype(np.int32)), pa.array(cell[order]), pa.array(kind[order])], names=["block", "cell", "visits"])
                whole = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*whole.columns, pa.ListArray.from_arrays(pa.array(at), places)], names=[*batch.schema.names, "places"])

    return run


def grid_for(classes: DataFrame, rows: int, cosine: float) -> int:
    """How many components of a block its cells use: what costs least by a sample of the classes."""
    sample = classes.select("label", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    many = rows / max(1, len(sample))
    costs: dict[int, float] = {}
    by_group: dict[tuple, list] = {}
    for r in sample:
        by_group.setdefault((r.label, len(r.vector)), []).append(r.vector)
    for (_, width), vectors in by_group.items():
        y, blocks = turned(scaled(np.array(vectors))), blocks_of(width)
        for grid in range(1, BLOCK_DIMS + 1):
            own, visitor, visited = cells(y, 0, blocks, min(grid, y.shape[1] // blocks), (2 - 2 * cosine) / blocks)
            number, home = np.unique(own, return_inverse=True)
            home = np.bincount(home)
            at = np.searchsorted(number, visited)
            hit = at < len(number)
            hit[hit] = number[at[hit]] == visited[hit]
            visits = np.bincount(at[hit], minlength=len(number))
            compared = (home * (home / 2 + visits)).sum() * many**2
            costs[grid] = costs.get(grid, 0) + blocks * (compared + ROW_COST * many * (len(own) + len(visited) + (home * (home * many // PART)).sum()))
    return min(costs, key=lambda g: (costs[g], g), default=1)


class _Leaves:
    """Vectors sorted by a k-d tree of one block."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray, block: int):
        x = scaled(vectors)
        y, blocks = turned(x), blocks_of(vectors.shape[1])
        own = y.reshape(len(y), blocks, -1)[:, block]
        order, leaves, todo = [], [], [np.arange(len(y))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                leaves.append(len(rows))
                order.append(rows)
                continue
            part = own[rows]
            split = part[:, (part.max(0) - part.min(0)).argmax()].argsort(kind="stable")
            todo += [rows[split[len(split) // 2 :]], rows[split[: len(split) // 2]]]
        order = np.concatenate(order)
        self.ids, self.weights, self.x, self.y = ids[order], weights[order], x[order], y[order].reshape(len(y), blocks, -1)
        self.length, self.own = np.sqrt(np.einsum("ij,ij->i", self.x, self.x)), own[order]
        self.at = np.concatenate([[0], np.cumsum(leaves)])
        self.low, self.high = np.minimum.reduceat(self.own, self.at[:-1]), np.maximum.reduceat(self.own, self.at[:-1])
        self.square = np.einsum("ij,ij->i", self.own, self.own)


def linked(a: _Leaves, b: _Leaves, block: int, cosine: float):
    """Row numbers in a and in b of the pairs that count in this block; where a is b, with the first below the second."""
    budget = (2 - 2 * cosine) / a.y.shape[1] + SLACK
    for leaf in range(len(a.at) - 1):
        gap = np.maximum(0, np.maximum(a.low[leaf] - b.high, b.low - a.high[leaf]))
        near = np.flatnonzero(np.einsum("ij,ij->i", gap, gap) <= budget)
        near = near[near >= leaf] if a is b else near
        if not len(near):
            continue
        i = np.arange(a.at[leaf], a.at[leaf + 1])
        j = np.concatenate([np.arange(b.at[k], b.at[k + 1]) for k in near.tolist()])
        far = a.square[i][:, None] + b.square[j] - 2 * (a.own[i] @ b.own[j].T)
        p, q = np.nonzero(far <= budget + 1e-9)
        p, q = i[p], j[q]
        if a is b:
            p, q = p[p < q], q[p < q]
        for at in range(0, len(p), _AT_ONCE):
            m, n = p[at : at + _AT_ONCE], q[at : at + _AT_ONCE]
            for k in range(block + 1):
                apart = a.y[m, k] - b.y[n, k]
                within = (apart * apart).sum(1) <= budget
                keep = within if k == block else ~within  # an earlier block has counted it
                m, n = m[keep], n[keep]
            close = np.einsum("ij,ij->i", a.x[m], b.x[n]) / (a.length[m] * b.length[n]) >= cosine
            if close.any():
                yield m[close], n[close]


class _Cell:
    """Counts and components of the vectors that meet in a part of a cell, or in two."""

    def __init__(self, key: tuple, cosine: float):
        self.key, self.cosine, self.rows, self.held = key, cosine, [], None

    def add(self, table: pa.Table):
        self.rows.append(table)

    def close(self):
        """After the last row of kind 0: compare those of one part with each other."""
        if self.held is not None or not self.rows:
            return
        self.held = self._leaves(pa.concat_tables(self.rows))
        n = len(self.held.ids)
        self.n, self.root = np.zeros(n, np.int64), np.arange(n)
        if self.key[4] == self.key[5]:
            for i, j in linked(self.held, self.held, self.key[2], self.cosine):
                np.add.at(self.n, i, self.held.weights[j])
                np.add.at(self.n, j, self.held.weights[i])
                self._join(i, j)

    def _leaves(self, table: pa.Table) -> _Leaves:
        vectors = table.column("vector").combine_chunks()
        return _Leaves(table.column("id").to_numpy(), table.column("weight").to_numpy(), np.asarray(vectors.flatten()).reshape(len(table), -1), self.key[2])

    def _join(self, i: np.ndarray, j: np.ndarray):
        while True:
            a, b = self.root[i], self.root[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low < high
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            np.minimum.at(self.root, high[apart], low[apart])
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def meet(self, table: pa.Table):
        """Rows of kind 1 against those held; yields what is found of them."""
        self.close()
        if self.held is None:
            return
        other, known = self._leaves(table), len(self.held.ids)
        n, self.root = np.zeros(len(other.ids), np.int64), np.concatenate([self.root, np.arange(known, known + len(other.ids))])
        for j, i in linked(other, self.held, self.key[2], self.cosine):
            np.add.at(self.n, i, other.weights[j])
            np.add.at(n, j, self.held.weights[i])
            self._join(i, known + j)
        some = np.flatnonzero(n)
        yield _report(other.ids[some], n[some], self.held.ids[self.root[known:][some]])  # roots are the first ones
        self.root = self.root[:known]

    def last(self):
        self.close()
        if self.held is not None:
            some = np.flatnonzero((self.n > 0) | (self.root != np.arange(len(self.root))))
            yield _report(self.held.ids[some], self.n[some], self.held.ids[self.root[some]])


def _report(ids: np.ndarray, n: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(other)], names=["id", "n", "other"])


def _compared(cosine: float):
    def run(batches):
        """Of rows sorted by cell, parts and kind: what is found of each vector in each."""
        cell = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            key = np.stack([table.column(c).to_numpy() for c in [*_KEYS, "kind"]], 1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:], strict=False):
                own = tuple(key[a, :-1].tolist())
                if cell is None or cell.key != own:
                    if cell is not None:
                        yield from cell.last()
                    cell = _Cell(own, cosine)
                if key[a, -1] == 0:
                    cell.add(table.slice(a, b - a))
                else:
                    for at in range(a, b, PART):
                        yield from cell.meet(table.slice(at, min(PART, b - at)))
        if cell is not None:
            yield from cell.last()

    return run


def _vector(vectors: DataFrame) -> Column:
    kind = vectors.schema["embedding"].dataType
    return vectors["embedding"].cast(kind if kind in (ArrayType(FloatType()), ArrayType(DoubleType())) else "array<double>")


def _may_link(vectors: DataFrame) -> Column:
    """Whether a row has an id, a label and a sound vector; never null."""
    finite = F.forall(_vector(vectors), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = finite & F.exists(_vector(vectors), lambda x: x != 0)
    return F.coalesce(vectors["vec_id"].isNotNull() & vectors["label"].isNotNull() & sound, F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector, width and two hashes of the rows that may link."""
    rows = vectors.where(_may_link(vectors)).select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("long").alias("label"), _vector(vectors).alias("vector"))
    return rows.select("*", F.size("vector").alias("width"), F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))


def found_links(classes: DataFrame, cosine: float, part: int = PART, few_cells: int = FEW_CELLS, grid: int | None = None) -> DataFrame:
    """id, n and other of classes(id, label, width, weight, vector), several rows of an id: n sums to its links."""
    grid = grid or grid_for(classes, classes.count(), cosine)
    places = "places array<struct<block int, cell long, visits boolean>>"
    fields = {f.name: f.dataType.simpleString() for f in classes.schema}
    at = ["label", "width", "block", "cell"]

    def placed(columns: list[str]) -> DataFrame:
        keyed = classes.select(*columns).mapInArrow(_keyed(cosine, grid), ", ".join([*(f"`{c}` {fields[c]}" for c in columns), places]))
        return keyed.select(*(c for c in columns if c != "vector" or len(columns) > 3), F.inline("places"))

    most = F.greatest(F.lit(1), F.least(F.lit(part), F.greatest(F.lit(256), (F.lit(PART_NUMBERS) / F.col("width")).cast("long"))))
    large = kept(placed(["label", "width", "vector"]).where("not visits").groupBy(*at).agg(F.count("*").alias("homes")).where(F.col("homes") > most).select(*at, F.ceil(F.col("homes") / most).cast("int").alias("parts")))
    rows = placed(["id", "label", "width", "weight", "vector"])
    rows = rows.join(F.broadcast(large) if large.count() <= few_cells else large, at, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.select("*", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.explode(F.expr("sequence(0, parts - 1)")).alias("k"))
    i, j = F.when(F.col("visits"), F.col("k")).otherwise(F.least("part", "k")), F.when(F.col("visits"), F.col("k")).otherwise(F.greatest("part", "k"))
    kind = (F.col("visits") | (F.col("part") > F.col("k"))).cast("int")
    met = rows.select("label", "width", "block", "cell", i.alias("i"), j.alias("j"), kind.alias("kind"), "id", "weight", "vector")
    return met.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "kind").mapInArrow(_compared(cosine), _FOUND)


def vector_groups(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    of, rows = ["label", "width", "h1", "h2"], usable(vectors)
    grouped = rows.groupBy(*of).agg(F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    classes = kept(grouped.withColumn("id", F.monotonically_increasing_id()))
    found = kept(found_links(classes.select("id", "label", "width", "weight", "vector"), cosine))
    joined = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    known = classes.select(*of, "id", "weight", "least").join(links, "id", "left").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    known = kept(known)
    first = known.where("n is not null").groupBy("component").agg(F.min("least").alias("first"))
    known = known.join(first, "component", "left").select(*of, (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("first", "least").alias("component_id"))
    linked_rows = rows.select("vec_id", *of).join(known, of).select("vec_id", "n_links", "component_id")
    own = vectors["vec_id"].cast("long")
    rest = vectors.where(~_may_link(vectors)).select(own.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), own.alias("component_id"))
    forget(found)
    return linked_rows.unionByName(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def vector_groups_sql(embeddings: str = "embeddings", cosine: float = 0.93) -> str:
    """vector_groups in DuckDB's SQL, all pairs of a label compared."""
    return f"""
WITH RECURSIVE numbered AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, embedding::DOUBLE[] AS v FROM {embeddings}),
sound AS MATERIALIZED (
  SELECT * FROM numbered WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.row AS a, b.row AS b FROM sound a JOIN sound b ON a.label = b.label AND len(a.v) = len(b.v) AND a.row <> b.row
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= {cosine} END),
reach AS (SELECT row AS a, row AS b FROM sound UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT r.a AS row, min(n.vec_id) AS component_id FROM reach r JOIN numbered n ON r.b = n.row GROUP BY 1),
counts AS (SELECT a AS row, count(*) AS n FROM links GROUP BY 1)
SELECT n.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(l.component_id, n.vec_id) AS component_id,
  coalesce(n.vec_id = coalesce(l.component_id, n.vec_id), TRUE) AS kept
FROM numbered n LEFT JOIN least l ON n.row = l.row LEFT JOIN counts c ON n.row = c.row"""
