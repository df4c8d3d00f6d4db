"""Operator 6: language identification by nearest centroids of TF-IDF n-gram vectors.

1. Every text becomes a vector of hashed character 2- and 3-grams of its lower-cased letters (other characters count as
   one space): logarithmic counts times idf, scaled to length 1.
2. The classifier is fitted on a bounded sample of labelled rows: about SAMPLE rows of each language, drawn by a hash of
   doc_id and text. idf comes from the sample; each language's vectors are clustered into up to CENTROIDS centroids by
   spherical k-means. A centroid that has less than FEW of its language's rows is left out: a row or two under a wrong
   label would teach another language. This bound holds at every size; a language with fewer rows is fitted on all of
   them.
3. A text gets the language of the centroid with the largest cosine, its score. A text is rejected if it has no letter,
   or if that cosine is less than the language's limit for texts of so many letters: SLACK times the LOW quantile of the
   cosines that the language's own sample has there. Sampled rows count whole and cut to each length of CUTS, so that
   every band of lengths has rows, very short texts of a known language stay, and other scripts, languages that weren't
   taught and random letters go.

Every whole text is classified; long ones are counted in pieces that join exactly.

Defined results. Null texts and texts without letters get ``und``, score 0, rejected. Rows without lang don't teach.
Without any labelled row every text is ``und`` and rejected. Ties go to the first language by name. Rows that repeat get
a result each; columns other than doc_id, text and lang are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import draw, last_draws
from .token_files import slices

DIMS = 1 << 13
SAMPLE, CENTROIDS, ROUNDS = 400, 4, 8
#: All languages' sampled rows together, at most; with more languages each has fewer.
MOST_SAMPLED = 40_000
SLACK, LOW, FEW = 0.5, 0.05, 0.02
#: Bands of lengths begin at so many letters; sampled rows are cut to so many characters to fill them.
BANDS, CUTS = (8, 16, 32, 64, 128, 256, 512), (6, 12, 24, 48, 96, 192, 384)
#: Vectors of so many texts are held at once.
AT_ONCE = 128
#: Texts are counted in pieces of so many characters.
PIECE = 1 << 20
UNKNOWN = "und"


def _letters(points: np.ndarray) -> np.ndarray:
    """Which code points of lower-cased text are letters."""
    low = points < 128
    letter = np.where(low, (points >= 97) & (points <= 122), points >= 0xAA)
    if not low.all():
        odd = np.unique(points[~low])
        other = odd[[not chr(c).isalpha() for c in odd.tolist()]]
        if len(other):
            letter &= ~np.isin(points, other)
    return letter


def _counted(points: np.ndarray, known: int, counts: np.ndarray) -> None:
    """Add the 2- and 3-grams of points that don't lie within its first known ones."""
    p = points.astype(np.uint64) + np.uint64(1)
    two = p[:-1] * np.uint64(0x9E3779B97F4A7C15) + p[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] * np.uint64(0xFF51AFD7ED558CCD) + p[2:] * np.uint64(0x165667B19E3779F9)
    shift = np.uint64(64 - (DIMS.bit_length() - 1))
    for h, size in ((two, 2), (three, 3)):
        h = h[max(0, known - size + 1) :]
        counts += np.bincount(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> shift).astype(np.int64), minlength=DIMS)


def counts_of(text: str | None) -> tuple[np.ndarray, int]:
    """n-gram counts, and the number of letters.

    The n-grams are those of a space, the lower-cased letters with one space for each run of other characters, and a
    space. Long texts are counted in pieces; each knows the last two points before it and whether they end in a letter.
    """
    counts, n, text = np.zeros(DIMS, np.int64), 0, (text or "").lower()
    before, ends_in_letter = np.full(1, 32, np.uint32), False
    with np.errstate(over="ignore"):
        for first in range(0, len(text), PIECE):
            points = np.frombuffer(text[first : first + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
            letter = _letters(points)
            n += int(letter.sum())
            keep = letter | np.concatenate([[ends_in_letter], letter[:-1]])
            ends_in_letter = bool(letter[-1])
            last = [32] if ends_in_letter and first + PIECE >= len(text) else []
            joined = np.concatenate([before, np.where(letter, points, 32)[keep], last]).astype(np.uint32)
            if len(joined) > len(before):
                _counted(joined, len(before), counts)
            before = joined[-2:]
    return counts, n


def _logs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    found = [counts_of(t) for t in texts]
    return np.log1p(np.stack([c for c, _ in found]).astype(np.float32)), np.array([n for _, n in found])


def _band(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, n, "right")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Centroids:
    """A fitted classifier: idf, and for each centroid its language, direction and least cosine in each band."""

    idf: np.ndarray
    langs: list[str]
    rows: np.ndarray
    least: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        logs, n = _logs(texts)
        langs, scores, rejected = [], [], []
        cosine = _unit(logs * self.idf) @ self.rows.T if len(self.langs) else np.zeros((len(texts), 1))
        best = cosine.argmax(1)
        limits = self.least[best, _band(n)] if len(self.langs) else np.ones(len(texts))
        for k, letters_held, score, limit in zip(best.tolist(), n.tolist(), cosine.max(1).tolist(), limits.tolist(), strict=True):
            known = letters_held > 0 and len(self.langs) > 0
            langs.append(self.langs[k] if known else UNKNOWN)
            scores.append(min(1.0, max(0.0, score)) if known else 0.0)
            rejected.append(not known or score < limit)
        return langs, scores, rejected


def _vector_batches(batches):
    """The vectors of whole rows, and those of rows cut to each length of CUTS."""
    for batch in batches:
        for a, b in slices(batch.column(1), 500_000, AT_ONCE):
            langs, texts = (batch.column(k).slice(a, b - a).to_pylist() for k in (0, 1))
            for length in (None, *CUTS):
                use = [k for k, t in enumerate(texts) if length is None or len(t) > length]
                if use:
                    logs, n = _logs([texts[k][:length] for k in use])
                    held = [np.flatnonzero(x).astype(np.int32) for x in logs]
                    yield pa.RecordBatch.from_arrays([pa.array([langs[k] for k in use], pa.string()), pa.array([length is not None] * len(use), pa.bool_()), pa.array(n, pa.int64()), pa.array([h.tobytes() for h in held], pa.binary()), pa.array([x[h].tobytes() for x, h in zip(logs, held, strict=True)], pa.binary())], names=["lang", "cut", "n", "at", "logs"])


def _limits(n: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """The least cosine of each band; a band without rows has that of the next shorter one, or else 0."""
    limits, band = np.zeros(len(BANDS) + 1), _band(n)
    for k in range(len(limits)):
        own = cosines[band == k]
        limits[k] = SLACK * np.quantile(own, LOW) if len(own) else limits[max(0, k - 1)]
    return limits


def _clusters(x: np.ndarray, many: int) -> np.ndarray:
    """Unit centroids of the unit rows of x, from the row farthest from those chosen; none for a few odd rows."""
    chosen = _unit(x.mean(0, keepdims=True))
    seeds = [int((x @ chosen[0]).argmax())]
    for _ in range(min(many, len(x)) - 1):
        seeds.append(int((x @ x[seeds].T).max(1).argmin()))
    middle = x[seeds]
    for _ in range(ROUNDS):
        of = (x @ middle.T).argmax(1)
        middle = np.stack([x[of == k].mean(0) if (of == k).any() else middle[k] for k in range(len(middle))])
        middle = _unit(middle)
    held = np.bincount((x @ middle.T).argmax(1), minlength=len(middle))
    return middle[held >= min(FEW * len(x), held.max())]


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Centroids:
    """A classifier from labelled(doc_id, text, lang): sample rows of each language, those with the least hashes of id and
    text; of equal ones one. Fewer where there are so many languages that MOST_SAMPLED rows in all are reached."""
    text = F.col("text").cast("string")
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), text.alias("text"), draw("doc_id", text).alias("draw")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    if not sizes:
        return Centroids(np.ones(DIMS, np.float32), [], np.zeros((0, DIMS), np.float32), np.zeros((0, len(BANDS) + 1)))
    last = last_draws(rows, "lang", sizes, max(1, min(sample, MOST_SAMPLED // len(sizes))))
    limit = F.element_at(F.create_map(*(F.lit(x) for lang, n in sorted(last.items()) for x in (lang, n))), F.col("lang"))
    drawn = rows.where(F.col("draw") <= limit).dropDuplicates(["lang", "draw"])  # equal rows teach once, so the bound holds
    vectors = drawn.select("lang", "text").mapInArrow(_vector_batches, "lang string, cut boolean, n long, at binary, logs binary").where("n > 0").toPandas().sort_values(["lang", "n", "at", "logs"])
    taught = vectors[~vectors["cut"].astype(bool)]
    if not len(taught):
        return Centroids(np.ones(DIMS, np.float32), [], np.zeros((0, DIMS), np.float32), np.zeros((0, len(BANDS) + 1)))
    rows_with = np.zeros(DIMS)
    for at in taught["at"]:
        rows_with[np.frombuffer(at, np.int32)] += 1
    idf = np.log((1 + len(taught)) / (1 + rows_with)).astype(np.float32) + 1
    langs, centroids, least = [], [], []
    for name in sorted(set(taught["lang"])):
        mine = taught[taught["lang"] == name]
        x = np.zeros((len(mine), DIMS), np.float32)  # one language at a time
        for i, (at, logs) in enumerate(zip(mine["at"], mine["logs"], strict=True)):
            x[i, np.frombuffer(at, np.int32)] = np.frombuffer(logs, np.float32)
        middle = _clusters(_unit(x * idf), CENTROIDS)
        rows = vectors[vectors["lang"] == name]
        near = []
        for at, logs in zip(rows["at"], rows["logs"], strict=True):
            at = np.frombuffer(at, np.int32)
            row = np.frombuffer(logs, np.float32) * idf[at]
            near.append((middle[:, at] @ row).max() / np.linalg.norm(row))
        langs += [name] * len(middle)
        centroids.append(middle)
        least += [_limits(rows["n"].to_numpy(), np.array(near))] * len(middle)
    return Centroids(idf, langs, np.concatenate(centroids).astype(np.float32), np.array(least))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages * CENTROIDS * DIMS numbers

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), 500_000, AT_ONCE):
                langs, scores, rejected = shared.value.predict(batch.column(1).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return _texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from teaching: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected; fitted on the rows of docs that aren't held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), sample)
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that aren't rejected, with their columns."""
    from pyspark.sql.functions import pandas_udf

    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held_out(F.col("doc_id"))), sample))

    @pandas_udf("boolean")
    def rejected(text):
        import pandas as pd

        out: list[bool] = []
        values = [None if t is None or t != t else t for t in text.tolist()]
        for first in range(0, len(values), AT_ONCE):
            out += shared.value.predict(values[first : first + AT_ONCE])[2]
        return pd.Series(out, dtype=bool)

    return docs.where(~rejected(F.col("text").cast("string")))
