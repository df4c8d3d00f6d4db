"""Connected components of a distributed edge list, and groups of rows within sorted partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, kept

#: So many edges, at most, are joined by one task, as rounds over what is left of them would cost more than they do.
FEW = 1 << 15


class Forest:
    """Which of n things hang together; a root is the least of its tree."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _few_roots(batches):
    """id and up, the least id that can be reached, of the ends of all edges(a, b) together."""
    tables = [pa.Table.from_batches([batch]) for batch in batches if len(batch)]
    if tables:
        ends = [pa.concat_tables(tables).column(c).to_numpy() for c in ("a", "b")]
        ids, place = np.unique(np.concatenate(ends), return_inverse=True)
        forest = Forest(len(ids))
        for x, y in zip(place[: len(ends[0])].tolist(), place[len(ends[0]) :].tolist(), strict=True):
            forest.join(x, y)
        up = ids[[forest.root(x) for x in range(len(ids))]]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(up)], names=["id", "up"])


def _roots(parents: DataFrame) -> DataFrame:
    """(id, up) of each row of parents(id, up), with up the root of its tree; parents is forgotten.

    The first pass takes one step, which is enough for flat trees; each pass after it takes three at once, so a tree of
    depth d needs about log4(d) passes.
    """
    steps = 1
    while True:
        far, up = parents, "up"
        for k in range(1, steps + 1):
            hop = parents.select(F.col("id").alias(f"id{k}"), F.col("up").alias(f"up{k}"))
            far, before, up = far.join(hop, F.col(up) == F.col(f"id{k}")), up, f"up{k}"
        jumped = kept(far.select("id", F.col(up).alias("up"), (F.col(before) != F.col(up)).alias("moving")))
        forget(parents)
        if jumped.where("moving").isEmpty():
            return jumped
        parents, steps = jumped, 3


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ends of edges(a, b): component is the smallest id that can be reached.

    Each round hangs every id under the smallest id beside it, follows the trees that arise to their roots, and rewrites
    the edges to roots. Every id that is no root then is gone. A root that got no child has a neighbour that went under
    a smaller id, so it goes itself in the round after: two rounds halve the ids at least, whatever the shape, and a
    chain in order of its ids takes one round. Labels and edges stay distributed; each round is kept in the shared
    folder and the one before deleted. Once no more than FEW edges are left, one task joins them: a bound that doesn't
    grow with the input.
    """
    edges, labels = kept(edges.where("a <> b").select("a", "b")), None
    while (many := edges.count()) or labels is None:
        if many <= FEW:
            roots = kept(edges.coalesce(1).mapInArrow(_few_roots, "id long, up long"))
        else:
            both = edges.select("a", "b").union(edges.select("b", "a"))
            roots = _roots(kept(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("up"))))
        if labels is None:
            labels = kept(roots.select("id", F.col("up").alias("component")))
        else:
            old, at = labels, roots.select(F.col("id").alias("at"), "up")
            labels = kept(old.join(at, F.col("component") == F.col("at"), "left").select("id", F.coalesce("up", "component").alias("component")))
            forget(old)
        if many <= FEW:
            forget(roots)
            break
        a, b = (roots.select(F.col("id").alias(c), F.col("up").alias(f"{c}_up")) for c in ("a", "b"))
        moved, old = edges.join(a, "a").join(b, "b").where("a_up <> b_up"), edges
        edges = kept(moved.select(F.col("a_up").alias("a"), F.col("b_up").alias("b")))
        forget(old, roots)
    forget(edges)
    return labels


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels(id, component), as components gives them, after edges(a, b) more; only what these join is looked at."""
    at = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"{c}_at"))
    moved = edges.join(at("a"), "a", "left").join(at("b"), "b", "left")
    more = components(moved.select(F.coalesce("a_at", "a").alias("a"), F.coalesce("b_at", "b").alias("b")))
    ups = more.select(F.col("id").alias("at"), F.col("component").alias("up"))
    # Ends that had no label come with more, those that had one by their component.
    out = kept(labels.join(ups, F.col("component") == F.col("at"), "full").select(F.coalesce("id", "at").alias("id"), F.coalesce("up", "component").alias("component")))
    forget(more)
    return out


def grouped(batches, keys: list[str]):
    """Tables of the rows with equal keys, from record batches in which such rows follow each other."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        change = None
        for k in keys:
            column = table.column(k).combine_chunks()
            differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
            change = differs if change is None else pc.or_(change, differs)
        edges = [0, *(i + 1 for i, x in enumerate(change.to_pylist()) if x), len(table)]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(table.column(k)[a].as_py() for k in keys)
            if held and key != last:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            last = key
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held).combine_chunks()
