"""Operator 10: SentencePiece BPE encoding by backtracking, and decoding.

A sequence of pieces is the merge result of a text if and only if each adjacent pair of pieces is what merging their
joined text gives. So an encoder can take the longest matching piece (found by an Aho-Corasick automaton), check it
against the piece before it, and step back when nothing fits; a bitfield of failed positions keeps that linear.

Defined results. A null text counts as empty and gives the begin and end ids alone. Characters outside the vocabulary
become their UTF-8 byte pieces. Very long texts are encoded whole. Rows that repeat give a result each, an empty table
gives none, columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_files import slices

SPACE = "▁"
#: Ids of units and checked pairs are remembered up to so many, units of at most so many characters, in each worker.
REMEMBERED_UNITS, REMEMBERED_CHARS, REMEMBERED_PAIRS = 300_000, 48, 300_000


class PieceEncoder:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, n = self.library, self.library.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.text = {i: p for p, i in self.ids.items()}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.characters = {c for p in self.ids for c in p}
        #: Characters that stand side by side in some piece.
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or "\n" in self.characters or not self.characters <= self.ids.keys():
            raise ValueError("pieces that hold a space after another character, or line feeds, aren't supported")
        self.automaton = ahocorasick.Automaton()
        reachable = {p: i for p, i in self.ids.items() if self.merged(p) == [p]}  # others can't come out of merging
        for piece, i in reachable.items():
            self.automaton.add_word(piece, (len(piece) - 1, i))
        self.automaton.make_automaton()
        self.length = {i: len(p) for p, i in reachable.items()}
        #: The longest shorter piece that a piece begins with, or -1.
        self.shorter = {i: next((reachable[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in reachable), -1) for p, i in reachable.items()}
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: always the best-ranked adjacent pair, leftmost first."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = min((rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == np.inf:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        fits = self.fits.get(key)
        if fits is None:
            left, right = self.text[a], self.text[b]
            fits = self.merged(left + right) == [left, right]
            if len(self.fits) < REMEMBERED_PAIRS:
                self.fits[key] = fits
        return fits

    def _known_run(self, text: str) -> list[int]:
        """Ids of a run of vocabulary characters."""
        n = len(text)
        longest = [-1] * n
        for last, (before, i) in self.automaton.iter(text):
            longest[last - before] = i  # of those that begin there, the longest comes last
        failed, length, shorter, fits = bytearray(n + 1), self.length, self.shorter, self.fits.get
        ids: list[int] = []
        begun: list[int] = []  # where each piece of ids begins
        at, i, before = 0, longest[0], -1
        while at < n:
            while i >= 0:
                if not failed[at + length[i]]:
                    if before < 0:
                        break
                    fit = fits(before << 32 | i)
                    if self.compatible(before, i) if fit is None else fit:
                        break
                i = shorter[i]
            if i >= 0:
                ids.append(i)
                begun.append(at)
                at += length[i]
                before = i
                i = longest[at] if at < n else -1
            else:
                failed[at] = 1
                if not ids:
                    raise ValueError(f"no encoding of {text[:80]!r}")
                i = shorter[ids.pop()]
                at = begun.pop()
                before = ids[-1] if ids else -1
        return ids

    def unit(self, text: str) -> bytes:
        ids: list[int] = []
        if self.characters.issuperset(text):
            ids = self._known_run(text)
        else:
            run = ""
            for c in [*text, ""]:
                if c in self.characters:
                    run += c
                    continue
                ids += self._known_run(run) if run else []
                ids += [self.bytes[b] for b in c.encode("utf-8", "replace")]
                run = ""
        return struct.pack(f"<{len(ids)}I", *ids)

    _units = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def _remember(self, unit: str) -> bytes:
        ids = self.unit(unit)
        if len(self.known) < REMEMBERED_UNITS and len(unit) <= REMEMBERED_CHARS:
            self.known[unit] = ids
        return ids

    def _learn(self, unit: str) -> bytes:
        if len(unit) == 1 or unit[-2:] in self.pairs:
            return self._remember(unit)
        # No piece reaches across the last two characters: both sides stand alone, and recur more often.
        return b"".join([self.known.get(part) or self._remember(part) for part in (unit[:-1], unit[-1])])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, without begin and end.

        No piece holds a line feed, or a space after another character: what stands before them, encoded by itself,
        gives the same ids, so units that recur are looked up.
        """
        if not text:
            return b""
        get, out, feed = self.known.get, [], self.bytes[10]
        feed = struct.pack("<I", feed)
        for k, line in enumerate((SPACE + text).split("\n")):
            if k:
                out.append(feed)
            if not line:
                continue
            if "  " in line or SPACE in line[1:] or line[0] == " " or line[-1] == " " or line.startswith(SPACE + " "):
                units = self._units.findall(line.replace(" ", SPACE))
            else:
                units = line.replace(" ", " " + SPACE).split(" ")
            ids = list(map(get, units))
            if None in ids:
                ids = [self._learn(u) if x is None else x for u, x in zip(units, ids, strict=True)]
            out += ids
        return b"".join(out)

    def decode(self, raw: bytes) -> str:
        return self.library.decode(np.frombuffer(raw, dtype="<u4").tolist())


@cache
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _ends(encoder: PieceEncoder) -> tuple[bytes, bytes]:
    return tuple(np.array([i], dtype="<u4").tobytes() for i in (encoder.begin, encoder.end))


def _encoded(model: str):
    def run(batches):
        """doc_id and ids of each text, in batches of a bounded number of characters."""
        encoder = piece_encoder(model)
        begin, end = _ends(encoder)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                raw = [begin + encoder.encode(t or "") + end for t in batch.column(1).slice(a, b - a).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], names=["doc_id", "ids"])

    return run


def _decoded(model: str):
    def run(batches):
        """doc_id, ids and text; one row's ids at a time become Python's numbers."""
        library = piece_encoder(model).library
        for batch in batches:
            lists = batch.column(1)
            values, at = np.asarray(lists.values), np.asarray(lists.offsets).tolist()
            texts = [library.decode(values[a:b].tolist()).encode("utf-8", "surrogatepass") for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts).cast(pa.string())], names=["doc_id", "ids", "text"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (with begin and end) of each whole text."""
    return _texts(docs).mapInArrow(_encoded(model), "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and the text that ids stand for."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(model), "doc_id long, ids array<int>, text string")


def _digest_batches(batches):
    for batch in batches:
        lists = batch.column(1)
        raw = memoryview(np.asarray(lists.values).astype("<i4", copy=False).tobytes())
        at = (4 * np.asarray(lists.offsets).astype(np.int64)).tolist()
        ids = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
        decoded = [hashlib.sha256(t.as_buffer() or b"").hexdigest() for t in batch.column(2)]
        counts = pa.array(np.diff(at) // 4, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.string()), pa.array(decoded, pa.string()), lists], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])


def piece_digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each whole text, encoded and decoded again.

    The three steps run one after the other in one pass, so a task has one Python worker.
    """
    encoded, decoded = _encoded(model), _decoded(model)
    steps = lambda batches: _digest_batches(decoded(encoded(batches)))
    return _texts(docs).mapInArrow(steps, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")
