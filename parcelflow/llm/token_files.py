"""Operator 1: token ids in Parquet list columns that can be read selectively.

Whole texts are encoded with the tokenizers library, ordered by doc_id and written by Spark's Parquet writer as
``doc_id, n_tokens, part, offset, ids``: ids is a list column with dictionary pages, the number columns are delta
encoded (format v2), row groups have a chosen size, and the column and page indexes let a reader skip pages by doc_id.

Defined results. A null text counts as empty and holds the end id only. A null doc_id comes first. Rows that repeat
are each written; those that share a doc_id stand in the order of their texts' hashes and texts, whatever the input's
order. Very long texts are encoded whole and lie in one list. Columns other than doc_id and text are ignored, whatever their names. An empty table gives an
empty file set.
"""

from __future__ import annotations

import re
import uuid
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir

#: Characters that str.split() takes for white space and the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Ids of words are remembered up to so many words, of at most so many characters, in each Python worker.
REMEMBERED_WORDS, REMEMBERED_CHARS = 800_000, 48
#: Up to so many files, their starts (16 bytes each) are broadcast.
BROADCAST_PARTS = 1 << 20


class WordEncoder:
    """The tokenizer's ids of a text, as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its words in order.
    That lets frequent words be encoded once.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.marks = dict(zip(".,", self._encode_any([".", ","]), strict=True))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        """Words of Latin-1 letters alone: each is one unit for the tokenizer, whose last id alone ends a word."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return self._encode_any(words)
        raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _encode_any(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: set[str], found: dict[str, bytes]) -> None:
        plain, ended, other = [], [], []
        for w in words:
            if w.isalpha() and max(w) < "Ā":
                plain.append(w)
            elif w[-1] in ".," and w[:-1].isalpha() and max(w) < "Ā":
                ended.append(w)
            else:
                other.append(w)
        stems = {w[:-1] for w in ended} - words
        plain += [w for w in stems if w not in self.known and w not in found]
        for i in range(0, len(plain), 5000):
            found.update(zip(plain[i : i + 5000], self._encode_plain(plain[i : i + 5000]), strict=True))
        for w in ended:
            stem = w[:-1]
            found[w] = (found.get(stem) or self.known[stem]) + self.marks[w[-1]]
        found.update(zip(other, self._encode_any(other), strict=True))

    def _look_up(self, words: list[str]) -> list[bytes]:
        """The ids of each of these distinct words; new ones are learnt together."""
        ids = list(map(self.known.get, words))
        if None in ids:
            at = [i for i, x in enumerate(ids) if x is None]
            found = {"": b""}
            self._learn({words[i] for i in at} - {""}, found)
            for i in at:
                ids[i] = found[words[i]]
            if len(self.known) < REMEMBERED_WORDS:
                self.known.update((w, b) for w, b in found.items() if len(w) <= REMEMBERED_CHARS)
        return ids

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each text's followed by end_id, and how many each text has.

        Each distinct word of the texts is looked up once; its ids are then copied to all its places.
        """
        texts = pc.fill_null(texts, "")
        if pc.any(pc.match_substring_regex(texts, _ODD_SPACE.pattern)).as_py():
            raw = self._encode_any(texts.to_pylist())
            ends = np.array([end_id], dtype="<u4").tobytes()
            return np.frombuffer(b"".join(x + ends for x in raw), "<u4"), np.array([len(x) // 4 + 1 for x in raw], np.int64)
        lists = pc.utf8_split_whitespace(texts)
        held = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = lists.flatten().dictionary_encode()
        ids = self._look_up(distinct.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids.append(np.array([end_id], dtype="<u4").tobytes())
        sizes = np.array(list(map(len, ids)), np.int64) // 4
        first, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u4")
        # The end id stands after each text's words as a word of its own.
        place = np.insert(distinct.indices.to_numpy().astype(np.int64), np.cumsum(held), len(ids) - 1)
        many = sizes[place]
        upto = np.cumsum(many)
        at = np.repeat(first[place] - (upto - many), many) + np.arange(upto[-1] if len(upto) else 0)
        last = upto[np.cumsum(held + 1) - 1]
        return flat[at], np.diff(last, prepend=0)


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def slices(texts: pa.Array, most_chars: int = 2_000_000, most_texts: int = 1 << 30):
    """(first, end) of runs of texts that hold about most_chars bytes, and most_texts texts, at most."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], dtype="<i8" if pa.types.is_large_string(texts.type) else "<i4")[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0)
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and (held + n > most_chars or i - first >= most_texts):
            yield first, i
            first, held = i, 0
        held += n
    if first < len(texts):
        yield first, len(texts)


def _list_column(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype("<i4")))


def _encode_partition(path: str, end_id: int):
    def run(batches):
        encoder, before = word_encoder(path), 0
        for batch in batches:
            for a, b in slices(batch.column(1), 4_000_000):
                ids, counts = encoder.encode(batch.column(1).slice(a, b - a), end_id)
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts), pa.array(starts), _list_column(ids, counts)], names=["doc_id", "n_tokens", "offset", "ids"])

    return run


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int = 1, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Encode docs(doc_id, text) and write the files, in ascending doc_id order over the parts, ties by the text's hash and text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    encoded = ordered.mapInArrow(_encode_partition(tokenizer, end_id), "doc_id long, n_tokens long, offset long, ids array<int>")
    writer = encoded.withColumn("part", F.spark_partition_id()).write.mode("errorifexists")
    options = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": 1 << 20}
    # doc_id, offset and n_tokens repeat little: without a dictionary, format v2 delta encodes them.
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "offset", "n_tokens")}
    writer.options(**{k: str(v) for k, v in options.items()}).parquet(out)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the number of ids of all documents before. Columns not asked for are not read."""
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("held"))  # one row for each file
    base = parts.select(F.col("part").alias("base_part"), (F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).alias("base"))
    if parts.count() <= BROADCAST_PARTS:
        base = F.broadcast(base)  # else the ids would be shuffled for one number a file
    return files.join(base, files.part == base.base_part).withColumn("start", F.col("base") + F.col("offset")).drop("base", "base_part")


def read_tokens(spark: SparkSession, path: str, first: int, last: int, columns: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """The chosen columns of the documents with first <= doc_id <= last: row groups and pages of others are skipped."""
    return spark.read.parquet(path).where(F.col("doc_id").between(first, last)).select(*columns)


def _crc_batches(batches):
    for batch in batches:
        ids, raw = batch.column("ids"), []
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False).tobytes()
        at = (4 * ids.offsets.to_numpy().astype(np.int64)).tolist()
        view = memoryview(values)
        raw = [zlib.crc32(view[a:b]) for a, b in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(raw, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows read from the files."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_crc_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, out, tokenizer, end_id)
    return token_digest(read_token_files(spark, out))
