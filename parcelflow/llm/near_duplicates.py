"""Operator 2: near-duplicate documents by MinHash signatures and a multi-index Hamming join.

1. Each document's set of five-word shingles is hashed to 64 bits; texts with equal sets form one class.
2. A class gets HASHES minima of b = 16 bits. Its signature is cut into chunks. Two signatures that differ in at most
   radius = 2 * chunks - 1 minima have, by the pigeonhole principle, a chunk with at most one error. So each chunk gives
   a key for every position that may be wrong (the position left out), and equal keys find all such pairs.
3. A key with up to SMALL_KEY members gives all its pairs. In a larger one each member is first held against a few
   pivots only, which joins true groups in linear work. Where members of a key still hang apart, they are keyed anew:
   signatures within the radius agree in HASHES - radius minima at least, so they share one of the radius + 1 rarest
   minima of each. What a frequent passage brings together falls apart there. Of the keys that remain, only members
   that hang apart and whose set sizes allow a link are compared, in blocks.
4. Classes linked that way form clusters. Small clusters' full sets meet once. In a large one classes are described by
   their differences from what most of them have in common. Those that differ little link at once; others share some
   of their rarest differences with all that they link to and are joined by those, so no cluster is compared all with
   all. Only pairs that pass on the full sets link documents. Components of these links are the result.

The number of chunks follows from the similarity asked for, so that a pair just at it differs in more minima than the
radius with probability LOST at most: at 0.85, where a minimum differs with probability 0.15, 12 chunks and more than 23
of 64 with 8.8e-6; at 0.80, 15 chunks and more than 29 with 1.2e-6. That is the share of links that the signatures can
lose, and a document with several links loses its component more rarely still. Full sets are compared by hashes of 64
bits that are independent of those that classes and signatures come from.

Defined results. Null and empty texts, and texts without words, have an empty set and stand alone. Fewer than five
words form one shingle. Rows with a null doc_id get a null component and kept = true. Rows that repeat a doc_id count
as one document that has each of their texts. Very long texts are hashed in pieces that end at white space. Columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut, fields, forget, kept
from .components import Forest, components, extended, grouped
from .token_files import slices

HASHES = 64
#: The share of links at the similarity asked for that signatures may lose; and the least similarity in percent.
LOST, LEAST_PERCENT = 1e-5, 80
#: Keys with up to so many members give all their pairs; members of larger ones are held against so many pivots first.
SMALL_KEY, PIVOTS = 8, 2
#: Members of a key that hang apart are compared in blocks of so many, first by so many bits of each minimum.
KEY_BLOCK, PLANES = 2048, 6
#: Classes of a large cluster are held against others of a difference so many times.
STAR_TURNS = 3
#: Clusters of up to so many classes, with so many shingles in all, meet whole.
CLUSTER_CLASSES, CLUSTER_SHINGLES = 256, 2_000_000
_WORDS_AT_ONCE = 4 << 20
#: Words of more bytes are hashed one by one: sums of powers modulo 2 ** 64 can be made to collide for long ones.
_LONG_WORD = 64
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_BASE = _BASES[0]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@cache
def _byte_values(seed: int) -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64) * _BASES[seed])


@cache
def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    base = _BASES[seed]
    inverse = np.uint64(pow(int(base), -1, 2**64))
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, b)])) for b in (base, inverse))


def _words(raw: bytes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of lower-cased bytes."""
    buffer = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~_SPACE[buffer], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edges[::2], edges[1::2]
    size = 1 << max(16, len(buffer).bit_length())
    power, inverse = _powers(size, seed)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_byte_values(seed)[buffer] * power[: len(buffer)], dtype=np.uint64)])
    hashes = _mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64))
    for i in np.flatnonzero(end - first > _LONG_WORD).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(raw[first[i] : end[i]], digest_size=8, salt=bytes([seed])).digest(), "little")
    return hashes, first


def word_hashes(raw: bytes, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """As _words, over pieces that end at white space, so that memory doesn't follow the longest text."""
    if len(raw) <= 2 * _WORDS_AT_ONCE:
        return _words(raw, seed)
    found, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _WORDS_AT_ONCE)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        hashes, first = _words(raw[at:end], seed)
        found.append((hashes, first + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def shingle_sets(texts: list[str | None], width: int = 5, seed: int = 0) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode("utf-8", "replace").translate(_LOWER) for t in texts]
    ends = np.cumsum([len(x) + 1 for x in raw])
    words, first = word_hashes(b" ".join(raw), seed)
    counts = np.diff(np.searchsorted(first, np.concatenate([[0], ends])))
    at = np.concatenate([[0], np.cumsum(counts)])
    whole = np.zeros(0, np.uint64)
    if len(words) >= width:
        last = len(words) - width + 1
        whole = words[:last] * np.uint64(3)
        for k in range(1, width):
            whole = _mix(whole) + words[k : last + k]
        whole = _mix(whole)
    sets = []
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        if b - a >= width:
            sets.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for w in words[a:b]:
                short = _mix(np.array([short + w]))[0]
            sets.append(np.array([short], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


@cache
def _hash_parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    draw = rng.integers(1, 2**63, (2, HASHES), dtype=np.int64).astype(np.uint64)
    return draw[0] << np.uint64(1) | np.uint64(1), draw[1]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima, 16 bits each, of each set; zeros for empty sets."""
    out = np.zeros((len(sets), HASHES), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for k, (a, b) in enumerate(zip(*_hash_parameters(), strict=True)):
            least = np.minimum.reduceat((flat ^ b) * a, at)
            out[full, k] = _mix(least) >> np.uint64(48)
    return out


def _print(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sketch_batches(batches):
    with np.errstate(over="ignore"):
        for batch in batches:
            for a, b in slices(batch.column(2)):
                sets = shingle_sets(batch.column(2).slice(a, b - a).to_pylist())
                marks = [m.tobytes() for m in signatures(sets)]
                own = [batch.column(k).slice(a, b - a) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array([_print(s) for s in sets], pa.binary()), pa.array(marks, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "set_print", "signature"])


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_print (equal for equal sets, null for empty ones) and signature of each row."""
    return _texts(docs).mapInArrow(_sketch_batches, "doc_id long, text_hash long, n_shingles long, set_print binary, signature binary")


@cache
def chunks_for(percent: int) -> int:
    """The least number of chunks whose radius loses LOST of the pairs at the similarity of percent, or fewer."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"chunks are for a similarity of {LEAST_PERCENT} to 100 percent")
    wrong = 1 - percent / 100
    beyond = lambda least: sum(math.comb(HASHES, k) * wrong**k * (1 - wrong) ** (HASHES - k) for k in range(least, HASHES + 1))
    return next(n for n in range(1, HASHES // 2 + 1) if beyond(2 * n) <= LOST)


def _chunks(many: int) -> list[tuple[int, int]]:
    edges = [round(k * HASHES / many) for k in range(many + 1)]
    return list(zip(edges, edges[1:], strict=False))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), HASHES)


def _key_batches(chunks: int):
    def run(batches):
        """The keys of each signature: a chunk, the position in it that may be wrong, and the other minima."""
        with np.errstate(over="ignore"):
            for batch in batches:
                marks = _matrix(batch.column(1)).astype(np.uint64)
                keys = []
                for c, (a, b) in enumerate(_chunks(chunks)):
                    for wrong in range(a, b):
                        key = np.full(len(marks), 1 + c * HASHES + wrong, np.uint64)
                        for k in range(a, b):
                            if k != wrong:
                                key = _mix(key * _BASE + marks[:, k])
                        keys.append(key)
                flat = np.stack(keys, 1).astype(np.int64, copy=False).ravel() if len(marks) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(marks) + 1, dtype=np.int32) * HASHES), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "keys"])

    return run


def _near_batches(radius: int):
    def run(batches):
        """Pairs whose signatures differ in at most radius minima, and in how many."""
        for batch in batches:
            apart = (_matrix(batch.column(2)) != _matrix(batch.column(3))).sum(1)
            near = pa.array(apart <= radius)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(near) for k in (0, 1)), pa.array(apart.astype(np.int32)).filter(near)], names=["a", "b", "apart"])

    return run


_NEAR = "a long, b long, apart int"


def _ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _paired(rows: DataFrame) -> DataFrame:
    """Pairs to look at of rows(key, n, id): all of small keys; of large ones each id with a few pivots.

    A key's pivot is the member with the least hash, so an id's keys share few pivots; it keeps those with which it
    shares most keys.
    """
    small = rows.where(F.col("n") <= SMALL_KEY).groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids")).select("ids").distinct()
    unfolded = small.select(F.posexplode("ids").alias("at", "a"), "ids").select("a", F.explode(F.expr("slice(ids, at + 2, size(ids))")).alias("b"))
    large = rows.where(F.col("n") > SMALL_KEY)
    pivots = large.groupBy("key").agg(F.min_by("id", F.xxhash64("id")).alias("pivot"))
    shared = large.join(pivots, "key").where("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("keys"))
    ranked = shared.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("keys"), "pivot")))
    return unfolded.union(ranked.where(F.col("rank") <= PIVOTS).select(*_ordered("id", "pivot")))


def _near(pairs: DataFrame, marks: DataFrame, radius: int) -> DataFrame:
    """a, b, apart of the pairs(a, b) whose signatures are within the radius."""
    side = lambda c: marks.select(F.col("id").alias(c), F.col("signature").alias(f"mark_{c}"))
    return pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "mark_a", "mark_b").mapInArrow(_near_batches(radius), _NEAR)


def _hanging_apart(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """key, id and label of the rows(key, n, id) of large keys whose members have more than one label."""
    large = rows.where(F.col("n") > SMALL_KEY).select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))
    apart = large.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return large.join(apart.select("key"), "key", "left_semi")


def _minima_batches(batches):
    """Each minimum of a signature with its position."""
    for batch in batches:
        flat = (_matrix(batch.column(1)).astype(np.int64) + (np.arange(HASHES, dtype=np.int64) << 16)).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * HASHES), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "minima"])


def _rarest_minima(marks: DataFrame, radius: int) -> DataFrame:
    """key, n, id: each id's radius + 1 rarest minima that others of marks(id, signature) have among theirs as well."""
    minima = kept(marks.select("id", "signature").mapInArrow(_minima_batches, "id long, minima array<long>").select("id", F.explode("minima").alias("key")))
    held = minima.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    # Minima that no other id has come first and find nothing, so they only count.
    lists = minima.join(held, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("held", "key"))).alias("minima"))
    rarest = kept(lists.select("id", F.explode(F.slice("minima", F.lit(1), F.greatest(F.lit(0), F.size("minima") + (radius + 1 - HASHES)))).alias("x")).select("id", "x.key"))
    shared = rarest.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    found = kept(rarest.join(shared, "key").select("key", "n", "id"))
    forget(minima, rarest)
    return found


def _planes(marks: np.ndarray) -> list[np.ndarray]:
    """The lowest bits of all minima of each row, one word of HASHES bits for each of PLANES bits."""
    return [np.packbits((marks >> k & 1).astype(np.uint8), axis=1).view(np.uint64)[:, 0] for k in range(PLANES)]


def _across(radius: int):
    def run(rest: pa.Table, every: pa.Table) -> pa.Table:
        """Pairs within the radius of rest and every row, enough of them to join all labels that such pairs join."""
        found = []
        if len(rest) and len(every):
            (ids, labels, marks), (all_ids, all_labels, all_marks) = ((t.column("id").to_numpy(), t.column("label").to_numpy(), _matrix(t.column("signature").combine_chunks())) for t in (rest, every))
            names, joint = np.unique(np.concatenate([labels, all_labels]), return_inverse=True)
            of, all_of, forest = joint[: len(ids)], joint[len(ids) :], Forest(len(names))
            planes, all_planes = _planes(marks), _planes(all_marks)
            for first in range(0, len(ids), 64):
                part = slice(first, first + 64)
                wrong = planes[0][part, None] ^ all_planes[0]
                for p, q in zip(planes[1:], all_planes[1:], strict=True):
                    wrong |= p[part, None] ^ q
                i, j = np.nonzero((np.bitwise_count(wrong) <= radius) & (labels[part, None] != all_labels))
                apart = (marks[i + first] != all_marks[j]).sum(1)
                for x, y, d in zip((i + first)[apart <= radius].tolist(), j[apart <= radius].tolist(), apart[apart <= radius].tolist(), strict=True):
                    if forest.join(of[x], all_of[y]):
                        found.append((min(ids[x], all_ids[y]), max(ids[x], all_ids[y]), d))
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64()), "apart": pa.array([x[2] for x in found], pa.int32())})

    return run


def _compared(apart: DataFrame, marks: DataFrame, radius: int, percent: int) -> DataFrame:
    """Near pairs of apart(key, id, label) with different labels, of sizes that allow a link; in blocks.

    The label that most of a key's members have doesn't meet itself. A size's band reaches from one power of the inverse
    similarity to the next, so rows meet those of their own band and of the two beside it.
    """
    rows = apart.join(marks, "id").withColumn("band", F.floor(F.log("size") / math.log(100 / percent) - 1e-9) if percent < 100 else F.col("size"))
    most = apart.groupBy("key", "label").agg(F.count("*").alias("held")).groupBy("key").agg(F.max_by("label", F.struct("held", "label")).alias("most"))
    rest = rows.join(most, "key").where("label <> most").drop("most").withColumn("band", F.explode(F.expr("array(band - 1, band, band + 1)")))
    return _in_blocks(rest, rows, ["key", "band"], ["id", "label", "signature"], _across(radius), _NEAR)


def _in_blocks(rest: DataFrame, rows: DataFrame, keys: list[str], columns: list[str], meet, schema: str) -> DataFrame:
    """What meet gives for the rest and all rows of each key, dealt to blocks of KEY_BLOCK on both sides."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / KEY_BLOCK).cast("int").alias("blocks"))
    rests = rest.groupBy(*keys).agg(F.ceil(F.count("*") / KEY_BLOCK).cast("int").alias("rest_blocks"))
    both = kept(sizes.join(rests, keys))
    deal = lambda n: F.expr(f"cast(pmod(xxhash64(id, 7), {n}) as int)")
    each_of = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    at = [*keys, "block", "rest_block"]
    left = rest.join(both, keys).withColumn("rest_block", deal("rest_blocks")).withColumn("block", each_of("blocks")).select(*at, *columns)
    right = rows.join(both, keys).withColumn("block", deal("blocks")).withColumn("rest_block", each_of("rest_blocks")).select(*(F.col(c).alias(c) for c in at + columns))
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(meet, schema)


def signature_clusters(classes: DataFrame, chunks: int, percent: int) -> DataFrame:
    """id and component of the classes(id, signature, size) that pairs within the radius join."""
    radius, marks = 2 * chunks - 1, classes.select("id", "signature")
    keyed = marks.mapInArrow(_key_batches(chunks), "id long, keys array<long>").select("id", F.explode("keys").alias("key"))
    shared = kept(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("n > 1 and a < b"))
    many = kept(keyed.join(shared.where("n > 2").select("key", "n"), "key").select("key", "n", "id"))
    labels = components(_near(shared.where("n = 2").select("a", "b").union(_paired(many)), marks, radius))
    apart = kept(_hanging_apart(many, labels).select("id").distinct())
    forget(shared, many)
    if apart.isEmpty():
        return labels
    rare = _rarest_minima(marks.join(apart, "id", "left_semi"), radius)
    labels = extended(labels, _near(_paired(rare), marks, radius))
    left = kept(_hanging_apart(rare, labels))
    return labels if left.isEmpty() else extended(labels, _compared(left, classes, radius, percent))


def _linked(percent: int, a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _set_batches(batches):
    """The shingles of rows(cluster, id, large, set_print, text) whose text has the class's set, by the second hash."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for a, b in slices(batch.column(4)):
                texts, prints = (batch.column(k).slice(a, b - a).to_pylist() for k in (4, 3))
                own = pa.array([_print(s) == p for s, p in zip(shingle_sets(texts), prints, strict=True)], pa.bool_())
                sets = pa.array([s.tobytes() for s in shingle_sets(texts, seed=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([x.filter(own) for x in (*(batch.column(k).slice(a, b - a) for k in (0, 1, 2)), sets)], names=["cluster", "id", "large", "shingles"])


def _overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, from the shingles that several of them hold."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = counts > 1
    rank = np.cumsum(several) - 1
    use = several[column]
    owner, column = owner[use], rank[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(several.sum()), columns):
        a, b = np.searchsorted(column, [first, first + columns])
        held = np.zeros((len(sets), columns), np.float32)
        held[owner[a:b], column[a:b] - first] = 1
        out += held @ held.T
    return out


def _cluster_links(percent: int):
    def links(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """A spanning forest of the pairs with 100 * intersection >= percent * union."""
        if len(ids) == 2:
            return [(ids[0], ids[1])] if _linked(percent, *sets) else []
        shared = np.rint(_overlaps(sets)).astype(np.int64)
        sizes = np.array([len(s) for s in sets])
        linked = np.triu(100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared), 1)
        forest = Forest(len(ids))
        return [(ids[i], ids[j]) for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True) if forest.join(i, j)]

    def run(batches):
        for table in grouped(batches, ["cluster"]):
            sets = dict(zip(table.column("id").to_pylist(), table.column("shingles").to_pylist(), strict=True))
            if len(sets) > 1:
                found = links(list(sets), [np.frombuffer(x, np.uint64) for x in sets.values()])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _unpacked(batches):
    """cluster, id and each number of a binary column of them."""
    for batch in batches:
        for at in range(len(batch)):
            numbers = np.frombuffer(batch.column(2)[at].as_py(), np.int64)
            for first in range(0, len(numbers), 1 << 16):
                part = numbers[first : first + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), batch.column(k)[at].as_py())) for k in (0, 1)] + [pa.array(part)], names=["cluster", "id", "token"])


def _difference_batches(batches):
    """The shingles that only one of a set and its cluster's common set has."""
    for batch in batches:
        sets, common = (batch.column(k).to_pylist() for k in (2, 3))
        apart = [np.setxor1d(np.frombuffer(x, np.uint64), np.frombuffer(y or b"", np.uint64), assume_unique=True) for x, y in zip(sets, common, strict=True)]
        sizes = [pa.array([n // 8 for n in map(len, sets)], pa.int64()), pa.array([len(x) for x in apart], pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sizes, pa.array([x.tobytes() for x in apart], pa.binary())], names=["cluster", "id", "size", "d", "apart"])


def _joined_lists(column: str):
    def run(frame):
        import pandas as pd

        joined = np.unique(frame[column].to_numpy()).astype(np.int64)
        return pd.DataFrame({"cluster": [frame["cluster"].iloc[0]], "common": [joined.tobytes()]})

    return run


def _checked(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) that link, from rows(id, weight, apart): see _large_links."""

    def run(batches):
        for batch in batches:
            (x, y), need = (batch.column(k).to_pylist() for k in (2, 3)), batch.column(4).to_pylist()
            shared = [len(np.intersect1d(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), assume_unique=True)) for s, t in zip(x, y, strict=True)]
            linked = pa.array([2 * (100 + percent) * n >= least for n, least in zip(shared, need, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(linked) for k in (0, 1)], names=["a", "b"])

    side = lambda c: rows.select(F.col("id").alias(c), F.col("weight").alias(f"weight_{c}"), F.col("apart").alias(f"apart_{c}"))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "apart_a", "apart_b", (F.col("weight_a") + F.col("weight_b")).alias("need")).mapInArrow(run, "a long, b long")


def _shared(x: list[np.ndarray], y: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each set of x with each of y."""
    out = np.zeros((len(x), len(y)), np.float32)
    held = [np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (x, y)]
    both = np.intersect1d(*held)
    sides = []
    for sets, flat in zip((x, y), held, strict=True):
        owner, column = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(both, flat)
        use = (column < len(both)) & (both[np.minimum(column, len(both) - 1)] == flat) if len(both) else np.zeros(len(flat), bool)
        sides.append((owner[use], column[use]))
    for first in range(0, len(both), columns):
        parts = []
        for (owner, column), sets in zip(sides, (x, y), strict=True):
            use = (column >= first) & (column < first + columns)
            part = np.zeros((len(sets), columns), np.float32)
            part[owner[use], column[use] - first] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return np.rint(out)


def _linked_across(percent: int):
    def run(rest: pa.Table, every: pa.Table) -> pa.Table:
        """Links of rest and every row, enough of them to join all labels that such links join; see _large_links."""
        found = []
        if len(rest) and len(every):
            (ids, labels, weights, sets), (all_ids, all_labels, all_weights, all_sets) = ((*(t.column(c).to_numpy() for c in ("id", "label", "weight")), [np.frombuffer(x, np.uint64) for x in t.column("apart").to_pylist()]) for t in (rest, every))
            linked = (2 * (100 + percent) * _shared(sets, all_sets) >= weights[:, None] + all_weights) & (labels[:, None] != all_labels)
            names, joint = np.unique(np.concatenate([labels, all_labels]), return_inverse=True)
            forest, of, all_of = Forest(len(names)), joint[: len(ids)].tolist(), joint[len(ids) :].tolist()
            found = [(ids[i], all_ids[j]) for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True) if forest.join(of[i], all_of[j])]
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return run


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows(id, ...) with their label of labels(id, component)."""
    return rows.join(labels.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))


def _large_links(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose components are those of all links within clusters of sets(cluster, id, shingles).

    A cluster's common set holds the shingles that more than half of its classes have. A class is described by what it
    has besides or lacks of it (d shingles), which is little for near copies, and by
    weight = (100 + percent) * d - (100 - percent) * size. Two classes link exactly if their weights sum to no more than
    2 * (100 + percent) times the number of differences that they share. So a class whose weight and the least one of the
    cluster sum to 0 or less links to the class that has it. Every other class shares differences with all that it links
    to, so with each of them it has one of its rarest d - needed + 1 in common. Classes are held against a few others of
    a difference at first; then those that still hang apart are joined by it.
    """
    tokens = sets.select("cluster", "id", "shingles").mapInArrow(_unpacked, "cluster long, id long, token long")
    members = sets.groupBy("cluster").agg(F.count("*").alias("members"))
    common = tokens.groupBy("cluster", "token").agg(F.count("*").alias("held")).join(members, "cluster").where("2 * held > members")
    lists = common.select("cluster", "token").groupBy("cluster").applyInPandas(_joined_lists("token"), "cluster long, common binary")
    unlike = sets.join(lists, "cluster", "left").select("cluster", "id", "shingles", "common").mapInArrow(_difference_batches, "cluster long, id long, size long, d long, apart binary")
    rows = kept(unlike.withColumn("weight", (100 + percent) * F.col("d") - (100 - percent) * F.col("size")))
    least = rows.groupBy("cluster").agg(F.min(F.struct("weight", "id")).alias("least"))
    weighed = rows.select("cluster", "id", "d", "weight").join(least, "cluster").withColumn("rest", F.col("weight") + F.col("least.weight") > 0)
    links = kept(weighed.where(~F.col("rest") & (F.col("id") != F.col("least.id"))).select(*_ordered("id", "least.id")))
    open_ones = weighed.where("rest").groupBy("cluster").agg(F.min("weight").alias("least_rest"))
    needed = F.ceil((F.col("weight") + F.when(F.col("rest"), F.col("least.weight")).otherwise(F.col("least_rest"))) / (2.0 * (100 + percent)) - 1e-9)
    wanted = kept(weighed.join(open_ones, "cluster").select("id", "rest", (F.col("d") - needed + 1).alias("first")))
    if wanted.isEmpty():
        return links
    differences = rows.join(wanted.select("id"), "id", "left_semi").select("cluster", "id", "apart").mapInArrow(_unpacked, "cluster long, id long, token long")
    held = differences.groupBy("cluster", "token").agg(F.count("*").alias("held"))
    ranked = differences.join(held, ["cluster", "token"]).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("held", "token"))).where(F.col("held") > 1)
    rare = kept(ranked.join(wanted, "id").where(F.col("rank") <= F.col("first")).select("cluster", "token", "id", "rest"))
    labels = components(links)
    for turn in range(STAR_TURNS):
        labelled = kept(_labelled(rare, labels))
        pivots = labelled.groupBy("cluster", "token").agg(F.min_by(F.struct("id", "label"), F.xxhash64("id", F.lit(turn))).alias("pivot"))
        shared = labelled.join(pivots, ["cluster", "token"]).where("label <> pivot.label").groupBy("id", F.col("pivot.id").alias("pivot")).agg(F.count("*").alias("keys"))
        near = shared.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("keys"), "pivot"))).where(F.col("place") <= PIVOTS)
        found = kept(_checked(near.select(*_ordered("id", "pivot")), rows, percent))
        forget(labelled)
        if found.isEmpty():
            break
        links, labels = links.union(found), extended(labels, found)
    labelled = kept(_labelled(rare, labels))
    most = labelled.groupBy("cluster", "token", "label").agg(F.count("*").alias("n")).groupBy("cluster", "token").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1").select("cluster", "token", "most")
    apart = kept(labelled.join(most, ["cluster", "token"]).join(rows.select("id", "weight", "apart"), "id").withColumn("other", F.col("label") != F.col("most")))
    if apart.isEmpty():
        return links
    return links.union(_in_blocks(apart.where("other"), apart, ["cluster", "token"], ["id", "label", "weight", "apart"], _linked_across(percent), "a long, b long"))


def set_links(labels: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose components are those of all links between classes of one component of labels."""
    clusters = labels.select("id", F.col("component").alias("cluster"))
    sized = clusters.join(classes.select("id", "size", "set_print", "source"), "id")
    large = sized.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("size").alias("held")).withColumn("large", (F.col("members") > CLUSTER_CLASSES) | (F.col("held") > CLUSTER_SHINGLES) & (F.col("members") > 2))
    # Of a size that the planner doesn't know, so that texts are dealt out alike at every size of the input.
    of = cut(sized.join(large.select("cluster", "large"), "cluster"))

    wanted = of.select("cluster", "id", "large", "set_print", F.col("source.doc_id").alias("of_doc"), F.col("source.text_hash").alias("of_text"))
    found = _texts(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_text")))
    sets = kept(found.select("cluster", "id", "large", "set_print", "text").mapInArrow(_set_batches, "cluster long, id long, large boolean, shingles binary"))
    links = sets.where("not large").select("cluster", "id", "shingles").repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_cluster_links(percent), "a long, b long")
    large = sets.where("large").select("cluster", "id", "shingles").dropDuplicates(["id"])
    return links if large.isEmpty() else kept(links).union(_large_links(kept(large), percent))


def joined_classes(found: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """set_print of each class of the sketches found of docs, and its component's first row (doc_id, text_hash)."""
    known = found.where("set_print is not null")
    # Nulls last: a row without doc_id stands for its class only where no other does.
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes = kept(known.groupBy("set_print").agg(F.min(row).alias("source"), F.first("signature").alias("signature"), F.first("n_shingles").alias("size")).withColumn("id", F.monotonically_increasing_id()))
    links = set_links(signature_clusters(classes, chunks_for(percent), percent), classes, docs, percent)
    repeated = kept(known.where("doc_id is not null").groupBy("doc_id").agg(F.min("set_print").alias("low"), F.max("set_print").alias("high")).where("low < high").select("doc_id", "low"))
    if not repeated.isEmpty():  # a document with several texts joins their classes
        numbers = lambda c, at: classes.select(F.col("set_print").alias(c), F.col("id").alias(at))
        twins = known.join(repeated, "doc_id").select("low", "set_print").distinct()
        links = links.union(twins.join(numbers("low", "a"), "low").join(numbers("set_print", "b"), "set_print").select("a", "b"))
    joined = kept(components(links).join(classes.select("id", "source"), "id"))
    firsts = joined.join(joined.groupBy("component").agg(F.min("source").alias("first")), "component").select("id", "first")
    return classes.select("id", "set_print", "source").join(firsts, "id", "left").select("set_print", F.coalesce("first", "source").alias("first"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    chunks_for(percent)  # refuses what it has no chunks for before any work is done
    found = kept(sketches(docs))
    classes = joined_classes(found, docs, percent)
    component = F.coalesce("component", "doc_id")
    of_doc = found.where("doc_id is not null and set_print is not null").select("doc_id", "set_print").join(classes.select("set_print", F.col("first.doc_id").alias("component")), "set_print").groupBy("doc_id").agg(F.min("component").alias("component"))
    repeated = found.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left")
    return repeated.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of each group of near duplicates, with the columns of docs; rows without words all stay.

    The row is one with the least doc_id of its group (a null one only where no other is), and the least text hash there;
    of rows that are equal in both, the one with the least hash of all columns.
    """
    chunks_for(percent)
    found = kept(sketches(docs))
    first = joined_classes(found, docs, percent).select("first.doc_id", "first.text_hash").distinct()
    of = lambda c: F.col(c).alias(f"kept_{c}")
    rows = found.where("set_print is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"))
    chosen = kept(rows.select(of("doc_id"), of("text_hash"), "copies").join(first, F.col("kept_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("kept_text_hash") == F.col("text_hash")), "left_semi"))
    text = docs["text"].cast("string")
    packed = docs.select(F.struct(*fields(docs)).alias("row"), docs["doc_id"].cast("long").alias("own_id"), F.xxhash64(text).alias("own_hash"), F.coalesce(text.rlike(WORD_PATTERN), F.lit(False)).alias("worded"))
    with_own = lambda k: packed.join(k, F.col("own_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("own_hash") == F.col("kept_text_hash")), "left_semi")
    single, several = chosen.where("copies = 1"), chosen.where("copies > 1")
    out = packed.where("not worded").union(with_own(single)).select("row.*")
    if not several.isEmpty():
        rows = with_own(several).withColumn("all_hash", F.xxhash64(F.to_json("row")))
        least = rows.groupBy(F.col("own_id").alias("of_id"), F.col("own_hash").alias("of_hash")).agg(F.min("all_hash").alias("least"))
        one = rows.join(least, F.col("own_id").eqNullSafe(F.col("of_id")) & (F.col("own_hash") == F.col("of_hash")) & (F.col("all_hash") == F.col("least")), "left_semi")
        out = out.union(one.dropDuplicates(["own_id", "own_hash"]).select("row.*"))
    return out
