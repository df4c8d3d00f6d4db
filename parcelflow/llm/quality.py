"""Operator 9: quality classifier from weak labels.

1. LABELLERS heuristics look at each whole text; each votes for its one class, clean (1) or junk (-1), or not (0).
2. Expectation-maximisation estimates how often each labeller votes and is right, for clean and junk texts, and the share
   of clean texts. It works on the counts of vote patterns over all documents: at most 2 ** LABELLERS rows, whatever the
   corpus holds. A labeller is taken to be right more often than not, so the two classes can't change places.
3. The posterior of each pattern is a soft label. A linear scorer over hashed features (words, pairs of words, trigrams of
   character classes, and how often a word repeats the one before) learns it from a bounded sample of about SAMPLE rows,
   half of them drawn from patterns that are more likely junk. The bound is the same at every size.
4. Every document is scored by the linear scorer; those with a score of LEAST or more are kept.

Defined results. A null text, or one without words, has the score 0 and isn't kept. Very long texts are measured whole, in
pieces that join exactly. Without a row that has words to learn from every other score is 0.5. Rows that repeat get a result each; columns
other than doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_duplicates import word_hashes
from .common import draw, forget, kept, last_draws
from .token_files import slices

LABELLERS, SEEN = 9, 11
#: Hashed features: trigrams of character classes, and words and pairs of words, which weigh less.
SHAPE_DIMS, WORD_DIMS, WORD_WEIGHT = 1 << 12, 1 << 12, 0.5
DIMS = SHAPE_DIMS + WORD_DIMS + 2
SAMPLE, STEPS = 6000, 300
#: Features are shares of a text so many characters longer, so very short texts lean on the constant.
SMOOTH = 300
LEAST = 0.3
#: Features of so many texts are held at once.
AT_ONCE = 128
#: Texts are looked at in pieces of about so many bytes that end at white space.
PIECE = 1 << 20

_KINDS = np.full(256, 5, np.uint8)  # 0 space, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 other letter byte, from 6 on symbols
_KINDS[:128] = 6
for _marks, _kind in ((b" \t\n\r\v\f", 0), (range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b".,;:'-\"()", 4), (b"!", 7), (b"|", 8), (b"?", 9)):
    for _b in _marks:
        _KINDS[_b] = _kind


class _Measured:
    """Bytes of texts one after the other, and what is seen in them."""

    def __init__(self, raws: list[bytes]):
        ends = np.cumsum([len(r) + 1 for r in raws]) + 1
        self.begin, self.end = ends - [len(r) + 1 for r in raws], ends - 1
        joined = b"\n" + b"\n".join(raws) + b"\n"
        self.kinds = _KINDS[np.frombuffer(joined, np.uint8)]
        with np.errstate(over="ignore"):
            self.words, self.first = word_hashes(joined)
        self.of = np.searchsorted(self.begin, self.first, side="right") - 1

    def _per_text(self, flags: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(flags)])
        return upto[self.end] - upto[self.begin]

    def _per_word(self, flags: np.ndarray) -> np.ndarray:
        return np.bincount(self.of[flags], minlength=len(self.begin))

    def _same_text(self, back: int) -> np.ndarray:
        """Whether the word so many back is of the same text."""
        return np.concatenate([np.zeros(min(back, len(self.words)), bool), self.of[back:] == self.of[:-back]])

    def _same(self, back: int) -> np.ndarray:
        return self._same_text(back) & np.concatenate([np.zeros(min(back, len(self.words)), bool), self.words[back:] == self.words[:-back]])

    def again(self) -> np.ndarray:
        return self._per_word(self._same(1))

    def sums(self) -> np.ndarray:
        kinds, first, n = self.kinds, self.first, len(self.begin)
        if not len(first):
            return np.zeros((n, SEEN))
        space = np.flatnonzero(kinds == 0)
        last = space[np.searchsorted(space, first)] - 1  # of each word
        symbol, upper, lower = kinds >= 6, kinds == 2, (kinds == 1) | (kinds == 5)
        loud = upper[first] & upper[np.minimum(first + 1, len(kinds) - 1)]
        close = self._same(1) | self._same(2) | self._same(3)
        words = np.bincount(self.of, minlength=n)
        return np.stack([words, self.again(), self.end - self.begin, self._per_text(symbol), self._per_text(upper), self._per_text(lower), self._per_word(symbol[last]), self._per_text(kinds == 8), self._per_word(loud), self._per_word(close), self._per_word(kinds[last] == 4)], 1).astype(float)

    def features(self) -> np.ndarray:
        """Hashed feature counts of each text: words, pairs of words, and trigrams of character classes."""
        n, kinds = len(self.begin), self.kinds.astype(np.uint64)
        with np.errstate(over="ignore"):
            follow = self._same_text(1)
            pairs = _mixed(self.words[:-1] * np.uint64(3) + self.words[1:])[follow[1:]]
            shapes = np.zeros(len(kinds), np.uint64)
            shapes[1:-1] = _mixed((kinds[:-2] * np.uint64(16) + kinds[1:-1]) * np.uint64(16) + kinds[2:] + np.uint64(1 << 40))
        words = np.bincount(self.of * WORD_DIMS + _bucket(self.words, WORD_DIMS), minlength=n * WORD_DIMS).reshape(n, -1)
        words += np.bincount(self.of[1:][follow[1:]] * WORD_DIMS + _bucket(pairs, WORD_DIMS), minlength=n * WORD_DIMS).reshape(n, -1)
        shape = _bucket(shapes, SHAPE_DIMS)
        held = [np.bincount(shape[a:b], minlength=SHAPE_DIMS) for a, b in zip(self.begin.tolist(), self.end.tolist(), strict=True)]
        return np.concatenate([np.stack(held), words, self.again()[:, None]], 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _bucket(hashes: np.ndarray, dims: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - (dims.bit_length() - 1))).astype(np.int64)


def _shares(features: np.ndarray) -> np.ndarray:
    """The scorer's inputs of feature counts: roots of shares of the text, and 1."""
    shapes, words, again = features[..., :SHAPE_DIMS], features[..., SHAPE_DIMS:-1], features[..., -1:]
    size, many = shapes.sum(-1, keepdims=True) + SMOOTH, words.sum(-1, keepdims=True) + SMOOTH
    return np.concatenate([np.sqrt(shapes / size), WORD_WEIGHT * np.sqrt(words / many), np.sqrt(again / size), np.ones(again.shape)], -1)


def measures(texts: list[str | None], what: tuple[str, ...] = ("sums", "features")) -> list[np.ndarray]:
    """What is asked for of each whole text.

    A long text is measured piece by piece. All that is measured looks back by three words at most, so a piece is
    measured with the three words before it, and those alone are taken off again: the sum is that of the whole.
    """
    raws = [(t or "").encode("utf-8", "replace") for t in texts]
    short = _Measured([r if len(r) <= PIECE else b"" for r in raws])
    found = [getattr(short, w)() for w in what]
    for i, r in enumerate(raws):
        at, starts = 0, []
        while len(r) > PIECE and at < len(r):
            end = min(len(r), at + PIECE)
            while end < len(r) and r[end] not in b" \t\n\r\v\f":
                end += 1
            back = starts[0] if starts else at
            piece, known = _Measured([r[back:end]]), _Measured([r[back:at]])
            for out, w in zip(found, what, strict=True):
                out[i] += getattr(piece, w)()[0] - getattr(known, w)()[0]
            starts, at = (back + piece.first - 1).tolist()[-3:], end
    return found


def votes(sums: np.ndarray) -> np.ndarray:
    """Each labeller's vote from the measured sums of a text (rows of sums)."""
    words, again, size, symbol, upper, lower, marked, bars, loud, close, stops = (sums[:, k] for k in range(11))
    n, capitals = np.maximum(words, 1), upper / np.maximum(upper + lower, 1)
    junk = (
        again / n >= 0.10,  # words repeat the one before
        close / n >= 0.15,  # words repeat one of the three before
        symbol / np.maximum(size, 1) >= 0.05,  # symbols among the characters
        (marked / n >= 0.20) & (words >= 5),  # words that end in a symbol
        (bars / n >= 0.10) & (words >= 5),  # bars between words
        (capitals >= 0.40) & (words >= 5),  # capitals among letters
        (loud / n >= 0.40) & (words >= 5),  # words in capitals
    )
    clean = (
        (stops / n >= 0.02) & (stops / n <= 0.40),  # words that end in a sentence mark
        (capitals > 0) & (capitals <= 0.12),  # some capitals
    )
    return np.stack([-x.astype(np.int64) for x in junk] + [x.astype(np.int64) for x in clean], 1)


def pattern_of(vote: np.ndarray) -> np.ndarray:
    return ((vote + 1) * 3 ** np.arange(LABELLERS)).sum(1)


def _vote_batches(batches):
    for batch in batches:
        for a, b in slices(batch.column(0)):
            (sums,) = measures(batch.column(0).slice(a, b - a).to_pylist(), ("sums",))
            yield pa.RecordBatch.from_arrays([pa.array(pattern_of(votes(sums)), pa.int64()), pa.array(sums[:, 0].astype(np.int64)), batch.column(1).slice(a, b - a)], names=["pattern", "words", "draw"])


def estimate(counts: dict[int, int], rounds: int = 60) -> dict[int, float]:
    """The posterior of clean for each vote pattern, by expectation-maximisation over pattern counts."""
    patterns = np.array(sorted(counts), dtype=np.int64)
    if not len(patterns):
        return {}
    n = np.array([counts[p] for p in patterns.tolist()], dtype=float)
    vote = patterns[:, None] // 3 ** np.arange(LABELLERS) % 3  # 0 junk, 1 nothing, 2 clean
    # Junk has one fault of many, and most labellers see one fault only: one junk vote outweighs missing ones at first.
    bad, good = (vote == 0).sum(1), (vote == 2).sum(1)
    clean = np.where(bad > 0, 0.1, np.where(good > 0, 0.95, 0.5))
    for _ in range(rounds):
        share = np.clip((n * clean).sum() / n.sum(), 0.01, 0.99)
        logs = np.log([1 - share, share])[None, :] * np.ones((len(n), 1))
        for k in range(LABELLERS):
            chance = np.empty((2, 3))
            for c, weight in enumerate((n * (1 - clean), n * clean)):
                chance[c] = np.bincount(vote[:, k], weights=weight, minlength=3) + (0.02, 0.02, 0.02)
                chance[c] /= chance[c].sum()
            # Right more often than not: a junk vote isn't likelier for clean texts, a clean vote not for junk ones.
            if chance[1, 0] > chance[0, 0]:
                chance[:, 0] = chance[:, 0].mean()
            if chance[0, 2] > chance[1, 2]:
                chance[:, 2] = chance[:, 2].mean()
            logs += np.log(chance[:, vote[:, k]]).T
        logs -= logs.max(1, keepdims=True)
        clean = np.exp(logs[:, 1]) / np.exp(logs).sum(1)
    return dict(zip(patterns.tolist(), clean.tolist(), strict=True))


def _train(at: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic scorer of soft labels from sparse rows, by gradient descent with momentum."""
    w, speed, weight = np.zeros(DIMS), np.zeros(DIMS), weight / weight.sum()
    begin = np.cumsum([0, *map(len, at)])[:-1]
    column, value = np.concatenate(at), np.concatenate(values)
    row = np.repeat(np.arange(len(at)), [len(x) for x in at])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[column] * value, begin), -30, 30)))
        slope = np.bincount(column, weights=value * (weight * (p - y))[row], minlength=DIMS)
        speed = 0.9 * speed - 2.0 * (slope + 1e-5 * w)
        w = w + speed
    return w


def fit(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The scorer's weights, from docs(doc_id, text): patterns of all rows, features of sample rows at most, half of each
    side, those with the least hashes of id and text; of equal ones one."""
    text = F.col("text").cast("string")
    rows = docs.select(text.alias("text"), draw("doc_id", text).alias("draw"))
    seen = kept(rows.mapInArrow(_vote_batches, "pattern long, words long, draw long").where("words > 0"))
    counts = {r["pattern"]: r["n"] for r in seen.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # 3 ** LABELLERS rows at most
    if not counts:
        forget(seen)
        return np.zeros(DIMS)
    posterior = estimate(counts)
    junk_patterns = sorted(p for p in counts if posterior[p] < 0.5)
    total = {side: sum(n for p, n in counts.items() if (posterior[p] < 0.5) == side) for side in (True, False)}
    sides = seen.withColumn("junk", F.col("pattern").isin(junk_patterns) if junk_patterns else F.lit(False))
    last = last_draws(sides, "junk", {side: n for side, n in total.items() if n}, max(1, sample // 2))
    forget(seen)
    share = {p: min(1.0, sample / 2 / total[posterior[p] < 0.5]) for p in counts}
    limit = {p: last[posterior[p] < 0.5] for p in counts}
    drawn = rows.where(F.col("draw") <= F.lit(max(last.values())))

    def picked(batches):
        for batch in batches:
            for a, b in slices(batch.column(0), 1_000_000, AT_ONCE):
                texts, draws = batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()
                sums, features = measures(texts)
                patterns = pattern_of(votes(sums)).tolist()
                use = [i for i, (p, u) in enumerate(zip(patterns, draws, strict=True)) if sums[i, 0] > 0 and u <= limit.get(p, -1)]
                shares = _shares(features[use]).astype(np.float32)
                held = [np.flatnonzero(x) for x in shares]
                yield pa.RecordBatch.from_arrays([pa.array([patterns[i] for i in use], pa.int64()), pa.array([h.astype(np.int32).tobytes() for h in held], pa.binary()), pa.array([x[h].tobytes() for x, h in zip(shares, held, strict=True)], pa.binary()), pa.array([draws[i] for i in use], pa.int64())], names=["pattern", "at", "values", "draw"])

    found = drawn.mapInArrow(picked, "pattern long, at binary, values binary, draw long").dropDuplicates(["draw"])  # equal rows teach once, so the bound holds
    taught = found.drop("draw").toPandas().sort_values(["pattern", "at", "values"])
    y = np.array([posterior[p] for p in taught["pattern"].tolist()])
    weight = np.array([1 / share[p] for p in taught["pattern"].tolist()])
    # A rare side isn't lost: it weighs a quarter of the other at least.
    junk = y < 0.5
    if junk.any() and not junk.all():
        weight[junk] *= max(1.0, 0.25 * weight[~junk].sum() / weight[junk].sum())
    at = [np.frombuffer(x, np.int32) for x in taught["at"]]
    values = [np.frombuffer(x, np.float32) for x in taught["values"]]
    return _train(at, values, y, weight) if at else np.zeros(DIMS)


def scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score and kept of each row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # DIMS numbers

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), 1_000_000, AT_ONCE):
                score = score_texts(batch.column(1).slice(a, b - a).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score, pa.float64()), pa.array(score >= LEAST, pa.bool_())], names=["doc_id", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, kept boolean")


def score_texts(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    value = _shares(measures(texts, ("features",))[0]) @ weights if texts else np.zeros(0)
    worded = np.array([bool(t and t.strip(" \t\n\r\v\f")) for t in texts], bool)
    return np.where(worded, 1 / (1 + np.exp(-np.clip(value, -30, 30))), 0.0)


def quality_report(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score (of being clean, 0 to 1) and kept of each row of docs."""
    return scores(docs, fit(docs, sample))


def keep_clean(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the scorer keeps, with their columns."""
    from pyspark.sql.functions import pandas_udf

    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))

    @pandas_udf("boolean")
    def clean(text):
        import pandas as pd

        values, out = [None if t is None or t != t else t for t in text.tolist()], []
        for first in range(0, len(values), AT_ONCE):
            out.append(score_texts(values[first : first + AT_ONCE], shared.value) >= LEAST)
        return pd.Series(np.concatenate(out) if out else [], dtype=bool)

    return docs.where(clean(F.col("text").cast("string")))
