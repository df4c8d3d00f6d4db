"""Operator 13: ranked lexical search over an index that recursive graph bisection has put in order.

1. Documents get an order in which like ones are near. A bounded sample is bisected: its halves exchange the documents
   that lower the cost of the terms' gaps most, and halves are halved again. Every document then goes down that tree by
   the same cost. Within a shard, blocks of documents are bisected on by all their terms, into clusters.
2. The index has a row for each cluster: its documents and, for each term, the postings and the greatest impact
   (10**9 * tf) div (1000 * tf + 8 * m) in the cluster. It covers every document and term and knows no queries.
3. An item's bound in a cluster is the sum of its terms' weights times those impacts; no document there scores more.
   Items visit clusters in the order of their bounds, some more in each round. An item stops when no cluster is left
   whose bound reaches the score of its kth document; clusters with an equal bound are visited, as a document there
   may have a smaller doc_id. So the result is exact, whatever the order is.
4. In a visit only the item's own postings are read; of each cluster and item the k best go on, by score and doc_id.

Frequencies, lengths and numbers of documents are counted over all documents. Only counts and the bounded sample reach
the driver; clusters, bounds, visits and results are distributed.

Defined results. Null and empty texts and texts without terms are no documents, and such items have no result. Rows that
repeat a doc_id or an item_id each stand for themselves. Null doc_ids come last among equal scores. Very long texts are
counted whole (the sample takes TERMS_EACH terms of each document). No documents or items give no rows. Other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, kept

#: Documents of a cluster, and documents and postings that are bisected in one task at most.
CLUSTER, BLOCK, BLOCK_POSTINGS = 256, 4096, 1 << 22
#: The sample: documents, terms of each, and terms that it knows; depth of its tree at most.
SAMPLE, TERMS_EACH, VOCABULARY, DEPTH = 4096, 512, 1 << 15, 7
#: Exchanges of each halving.
TURNS = 4
#: Clusters that an item visits in the first round, and how many times more in each after it; items of a request.
FIRST, MORE, ITEMS = 8, 8, 256
#: A term in regular expressions, and the bytes of terms: A-Z lower-cased, all but terms to blanks.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def counted(text: str | None) -> Counter:
    return Counter((text or "").encode("utf-8", "replace").translate(_BYTES).split())


# Bisection


def _cost(degree: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bits of the gaps of a term that so many of n documents hold."""
    return degree * np.log2(n / (degree + 1))


def bisected(doc: np.ndarray, term: np.ndarray, n: int, levels: int, turns: int = TURNS):
    """The order of n documents, given as entries (doc, term), that so many halvings give; each level's edges and, of
    its halves, how many documents hold each term (node, term)."""
    order, terms, edges, degrees = np.arange(n), int(term.max(initial=-1)) + 1, [0, n], []
    for _ in range(levels):
        middles = [(a + b) // 2 for a, b in zip(edges, edges[1:], strict=False)]
        node, nodes = np.zeros(n, np.int64), len(middles)
        sizes = np.array([(m - a, b - m) for a, m, b in zip(edges, middles, edges[1:], strict=False)], np.float64)
        left, right = np.maximum(sizes[:, :1], 1), np.maximum(sizes[:, 1:], 1)
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            node[order[a:b]] = k
        key = node[doc] * terms + term
        for turn in range(turns + 1):
            side = np.zeros(n, bool)
            for m, b in zip(middles, edges[1:], strict=False):
                side[order[m:b]] = True
            of = side[doc]
            low, high = (np.bincount(key[s], minlength=nodes * terms).reshape(nodes, terms).astype(np.float64) for s in (~of, of))
            if turn == turns:
                break
            now = _cost(low, left) + _cost(high, right)
            gain = np.where(of, (now - _cost(low + 1, left) - _cost(np.maximum(high - 1, 0), right)).ravel()[key], (now - _cost(np.maximum(low - 1, 0), left) - _cost(high + 1, right)).ravel()[key])
            gain, moved = np.bincount(doc, weights=gain, minlength=n), 0
            for a, m, b in zip(edges, middles, edges[1:], strict=False):
                x, y = order[a:m], order[m:b]
                x, y = x[np.argsort(-gain[x], kind="stable")], y[np.argsort(-gain[y], kind="stable")]
                both = min(len(x), len(y))
                swaps = int((np.cumsum(gain[x[:both]] + gain[y[:both]] <= 0) == 0).sum())
                x[:swaps], y[:swaps] = y[:swaps].copy(), x[:swaps].copy()
                order[a:m], order[m:b] = x, y
                moved += swaps
            if not moved:
                break
        degrees.append((low, high, left, right))
        edges = sorted({*edges, *middles})
        if len(edges) - 1 != 2 * nodes:  # halves that hold nothing: too few documents for more levels
            break
    return order, edges, degrees


class Tree:
    """Where a document goes: for each inner node what each known term speaks for its left half, and a limit."""

    def __init__(self, documents: list[list[bytes]], depth: int):
        known = Counter(t for d in documents for t in d)
        self.terms = {t: k for k, (t, n) in enumerate(sorted(known.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY]) if n > 1}
        doc, term = self.entries(documents)
        _, _, degrees = bisected(doc, term, len(documents), depth, 2 * TURNS)
        self.depth, self.weights, self.limits = len(degrees), [], np.zeros((1 << len(degrees)) - 1)
        for low, high, left, right in degrees:
            self.weights.append((_cost(low, left) + _cost(high + 1, right) - _cost(low + 1, left) - _cost(high, right)).astype(np.float32))
        node = np.zeros(len(documents), np.int64)
        for level in range(self.depth):
            score = self._score(level, node, doc, term)
            for k in range(1 << level):
                own = score[node == k]
                self.limits[(1 << level) - 1 + k] = np.median(own) if len(own) else 0
            node = self._down(level, node, score)

    def entries(self, documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        found = [[k for t in d if (k := self.terms.get(t)) is not None] for d in documents]
        return np.repeat(np.arange(len(found)), np.array([len(f) for f in found], np.int64)), np.array([k for f in found for k in f], np.int64)

    def _score(self, level: int, node: np.ndarray, doc: np.ndarray, term: np.ndarray) -> np.ndarray:
        w = self.weights[level]
        flat = node[doc] * w.shape[1] + term
        return np.bincount(doc, weights=w.ravel()[flat], minlength=len(node))

    def _down(self, level: int, node: np.ndarray, score: np.ndarray) -> np.ndarray:
        return 2 * node + (score <= self.limits[(1 << level) - 1 + node])

    def shards(self, documents: list[list[bytes]]) -> np.ndarray:
        node = np.zeros(len(documents), np.int64)
        if not self.depth:
            return node
        doc, term = self.entries(documents)
        for level in range(self.depth):
            node = self._down(level, node, self._score(level, node, doc, term))
        return node


def tree_for(docs: DataFrame, rows: int) -> Tree:
    """The tree of a sample, as deep as gives shards of about BLOCK documents, DEPTH at most."""
    depth = min(DEPTH, max(0, ceil(log2(max(1, rows) / BLOCK))))
    if not depth:
        return Tree([], 0)
    place = F.xxhash64("doc_id")
    last = docs.select(place.alias("place")).orderBy("place").limit(SAMPLE).agg(F.max("place")).first()[0]
    sample = docs.where(place <= F.lit(last)).select(F.col("text").cast("string").alias("text"))

    def some_terms(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(counted(t), key=hash_of)[:TERMS_EACH] for t in batch.column(0).to_pylist()], pa.list_(pa.binary()))], names=["terms"])

    return Tree([list(r.terms) for r in sample.mapInArrow(some_terms, "terms array<binary>").limit(SAMPLE).collect()], depth)


def hash_of(term: bytes) -> int:
    return int.from_bytes(term[-8:].rjust(8, b"\0"), "little") * 0x9E3779B97F4A7C15 % (1 << 64)


# Index


def _small(values: np.ndarray) -> bytes:
    """Counts in as few bytes as hold the greatest, which is one, two or four; the length tells which."""
    top = values.max(initial=0)
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes()


def _large(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, {0: np.uint8, 1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // max(1, n)]).astype(np.int64)


def _forward(tree):
    def run(batches):
        """Of each document with terms: its shard, number of terms, distinct ones (joined by blanks) and their counts."""
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                found = [counted(t) for t in part.column("text").to_pylist()]
                use = [k for k, c in enumerate(found) if c]
                if not use:
                    continue
                found = [found[k] for k in use]
                own = part.take(pa.array(use))
                columns = [own.column("doc_id"), own.column("place"), pa.array(tree.value.shards([list(c) for c in found])), pa.array([c.total() for c in found]), pa.array([len(c) for c in found])]
                columns += [pa.array([b" ".join(c) for c in found], pa.binary()), pa.array([_small(np.fromiter(c.values(), np.int64, len(c))) for c in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "place", "shard", "n", "distinct", "terms", "tfs"])

    return run


def _impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _norms(lengths: list[int], documents: int, total: int) -> np.ndarray:
    return np.array([25 + (75 * n * documents) // total for n in lengths], np.int64)


_INDEX = "cluster long, docs array<long>, lengths array<long>, terms array<binary>, counts array<int>, tops array<long>, places binary, tfs binary"


def _clusters(documents: int, total: int):
    """Rows of the index from documents in the order of their shards."""

    def block(rows: list[dict], number: int):
        ids: dict[bytes, int] = {}
        term = np.array([ids.setdefault(t, len(ids)) for r in rows for t in r["terms"].split(b" ")], np.int64)
        sizes = np.array([r["distinct"] for r in rows])
        doc, tf = np.repeat(np.arange(len(rows)), sizes), np.concatenate([_large(r["tfs"], r["distinct"]) for r in rows])
        shared = np.bincount(term, minlength=len(ids)) > 1
        renamed, use = np.cumsum(shared) - 1, shared[term]
        order, edges, _ = bisected(doc[use], renamed[term[use]], len(rows), max(0, ceil(log2(len(rows) / CLUSTER))))
        norms, names = _norms([r["n"] for r in rows], documents, total), pa.array(list(ids), pa.binary())
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        of = np.searchsorted(edges, place, "right") - 1
        sort = np.lexsort((place[doc], term, of[doc]))
        doc, term, tf = doc[sort], term[sort], tf[sort]
        top, ends = _impacts(tf, norms[doc]), np.searchsorted(of[doc], np.arange(len(edges)))
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            own = slice(ends[k], ends[k + 1])
            first = np.flatnonzero(np.diff(term[own], prepend=-1))
            held = [rows[i] for i in order[a:b]]
            values = [number + k, [r["doc_id"] for r in held], [r["n"] for r in held], names.take(pa.array(term[own][first])), np.diff(np.append(first, own.stop - own.start)).astype(np.int32), np.maximum.reduceat(top[own], first), (place[doc[own]] - a).astype(np.uint16).tobytes(), _small(tf[own])]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            columns = [_one(v, t) for v, t in zip(values, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "docs", "lengths", "terms", "counts", "tops", "places", "tfs"])

    def run(batches):
        task, number, held, postings = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) >= BLOCK or postings + r["distinct"] > BLOCK_POSTINGS):
                    for found in block(held, task + number):
                        number += 1
                        yield found
                    held, postings = [], 0
                held.append(r)
                postings += r["distinct"]
        if held:
            yield from block(held, task + number)

    return run


def _one(value, kind: pa.DataType) -> pa.Array:
    """A column of one row."""
    if pa.types.is_list(kind):
        flat = value if isinstance(value, pa.Array) else pa.array(value, kind.value_type)
        return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
    return pa.array([value], kind)


class Index:
    """Clusters of documents(doc_id, text) and what is counted over all of them. forget() deletes it."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        tree = spark.sparkContext.broadcast(tree_for(docs, docs.count()))  # VOCABULARY * 2 ** DEPTH numbers at most
        text = F.col("text").cast("string")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text, "doc_id").alias("place"))
        forward = kept(rows.mapInArrow(_forward(tree), "doc_id long, place long, shard long, n long, distinct long, terms binary, tfs binary"))
        counts = forward.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        self.documents, self.total = counts.documents, counts.total
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-self.documents // BLOCK))
        dealt = forward.repartitionByRange(parts, "shard", "place").sortWithinPartitions("shard", "place", "doc_id")
        self.clusters = kept(dealt.mapInArrow(_clusters(self.documents, self.total), _INDEX))
        forget(forward)

    def forget(self):
        forget(self.clusters)


# Search


def _item_terms(batches):
    """item and each of its terms with how often it has it."""
    for batch in batches:
        item, term, times = [], [], []
        for i, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = counted(text)
            item += [i] * len(found)
            term += found
            times += found.values()
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(term, pa.binary()), pa.array(times, pa.int64())], names=["item", "term", "times"])


def _visit(k: int):
    def run(batches):
        """The k best documents of each cluster for each item that visits it."""
        for batch in batches:
            for row in range(len(batch)):
                one = batch.slice(row, 1)
                terms = {t: n for n, t in enumerate(one.column("terms").flatten().to_pylist())}
                counts = one.column("counts").flatten().to_numpy()
                lengths, docs = one.column("lengths").flatten().to_pylist(), one.column("docs").flatten().to_pylist()
                starts = np.concatenate([[0], np.cumsum(counts)])
                places = np.frombuffer(one.column("places")[0].as_py(), np.uint16)
                tfs = _large(one.column("tfs")[0].as_py(), len(places))
                norms = _norms(lengths, one.column("documents")[0].as_py(), one.column("total")[0].as_py())
                item, doc, score = [], [], []
                for ask in one.column("asks")[0].as_py():
                    own = np.zeros(len(docs), np.int64)
                    for t, w in zip(ask["terms"], ask["weights"], strict=True):
                        if (n := terms.get(t)) is not None:
                            at = slice(starts[n], starts[n + 1])
                            own[places[at]] += w * _impacts(tfs[at], norms[places[at]])
                    some = np.flatnonzero(own)
                    if len(some) > k:
                        some = some[own[some] >= np.partition(own[some], -k)[-k]]  # ties of the kth stay
                    best = sorted(some.tolist(), key=lambda d: (-own[d], docs[d] is None, docs[d] or 0))[:k]
                    item += [ask["item"]] * len(best)
                    doc += [docs[d] for d in best]
                    score += own[best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = 10) -> tuple[DataFrame, list[int]]:
    """item_id, rank, doc_id and score of the k best documents of each of items(item_id, text), and how many visits of
    clusters each round took."""
    numbered = kept(items.select(F.col("item_id"), F.col("text").cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id()))
    asked = kept(numbered.select("item", "text").mapInArrow(_item_terms, "item long, term binary, times long"))
    entries = index.clusters.select("cluster", F.inline(F.arrays_zip("terms", "counts", "tops"))).toDF("cluster", "term", "n", "top")
    found = kept(entries.join(asked.select("term").distinct(), "term"))
    weight = F.floor(F.lit(1000) * F.log((2 * F.lit(index.documents) + 2) / (2 * F.col("df") + 1)))
    weighed = kept(asked.join(found.groupBy("term").agg(F.sum("n").alias("df")), "term").select("item", "term", (F.col("times") * weight).cast("long").alias("weight")).where("weight > 0"))
    bounds = kept(weighed.join(found.select("term", "cluster", "top"), "term").groupBy("item", "cluster").agg(F.sum(F.col("weight") * F.col("top")).alias("bound")).where("bound > 0"))
    asks = kept(weighed.groupBy("item").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights")))  # an item's own terms
    best, last, visits, many = None, None, [], FIRST
    while True:
        left = bounds
        if best is not None:
            kth = best.where(F.col("rank") == k).select("item", F.col("score").alias("kth"))
            left = left.join(kth, "item", "left").where("kth is null or bound >= kth").drop("kth")
            seen = last.select("item", F.col("bound").alias("to_bound"), F.col("cluster").alias("to_cluster"))
            left = left.join(seen, "item").where("bound < to_bound or bound = to_bound and cluster > to_cluster").drop("to_bound", "to_cluster")
        order = Window.partitionBy("item").orderBy(F.desc("bound"), "cluster")
        now = kept(left.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= many))
        visits.append(now.count())
        if not visits[-1]:
            forget(now)
            break
        asking = now.join(asks, "item").groupBy("cluster", F.pmod(F.xxhash64("item"), F.lit(-(-numbered.count() // ITEMS))).alias("share")).agg(F.collect_list(F.struct("item", "terms", "weights")).alias("asks"))
        requests = kept(asking.select("cluster", "asks"))
        rows = index.clusters.select("cluster", "docs", "lengths", "terms", "counts", "places", "tfs").join(requests, "cluster").withColumns({"documents": F.lit(index.documents), "total": F.lit(index.total)})
        more = rows.mapInArrow(_visit(k), "item long, doc_id long, score long")
        before, best = best, kept(_best(more if best is None else more.unionByName(best.select("item", "doc_id", "score")), k))
        frontier = kept(now.groupBy("item").agg(F.max_by(F.struct("bound", "cluster"), "turn").alias("at")).select("item", "at.*"))
        forget(now, requests, *(x for x in (before, last) if x is not None))
        last, many = frontier, many * MORE
    forget(found, weighed, bounds, asks, asked, *([last] if last is not None else []))
    if best is None:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long"), visits
    return best.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"), visits


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents of each item."""
    index = Index(docs)
    found, _ = search(index, items, k)
    index.forget()
    return found


def ranked_sql(k: int = 10) -> str:
    """ranked in DuckDB's SQL, every document scored."""
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH doc_words AS (SELECT row, doc_id, unnest(words) AS term FROM (SELECT row_number() OVER () AS row, doc_id, {words} AS words FROM documents)),
tf AS MATERIALIZED (SELECT row, doc_id, term, count(*) AS tf FROM doc_words GROUP BY 1, 2, 3),
doc AS MATERIALIZED (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
whole AS (SELECT count(*) AS nd, sum(n)::BIGINT AS total FROM doc),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
item AS (SELECT item, item_id, term, count(*) AS times FROM (
  SELECT item, item_id, unnest(words) AS term FROM (SELECT row_number() OVER () AS item, item_id, {words} AS words FROM benchmark)) GROUP BY 1, 2, 3),
scored AS (
  SELECT i.item, i.item_id, t.row, t.doc_id,
    sum(i.times * floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (25 + (75 * d.n * nd) // total))))::BIGINT AS score
  FROM item i JOIN df USING (term) JOIN tf t USING (term) JOIN doc d ON t.row = d.row, whole GROUP BY 1, 2, 3, 4)
SELECT item_id, (row_number() OVER w)::INT AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW w AS (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER w <= {k}"""
