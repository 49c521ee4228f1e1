"""SentencePiece encoding and decoding that keeps the original byte span of every piece.

Normalisation follows the compiled character map of the model: at each place the
longest prefix the map knows is replaced, any other character is kept, and for each
normalised byte the original bytes it came from are recorded. Spaces become the
meta symbol, one is put in front. Pieces then cover the normalised text without
gaps, so their byte lengths project every piece back to the original.

The library segments the normalised text with the model's own pieces and no
normalisation of its own, so ids are exactly those it gives for the original text.

Defined cases: a null text is empty; an empty text has no pieces and decodes to the
empty text; other columns are ignored; repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from sentencepiece import sentencepiece_model_pb2

from lotwise.llm import vec

META = "▁"

ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ends_sha256 string, covered_bytes long"


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 prefixes and their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """Length of the longest known prefix of ``data[at:]`` and the place of its replacement; length 0 if none."""
        if not self.units:
            return 0, 0
        best = (0, 0)
        node = self._child(self.units[0])
        for length, byte in enumerate(data[at:], 1):
            node ^= byte
            unit = self.units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:
                best = (length, self.units[node] & 0x7FFFFFFF)
        return best

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def replacement(self, place: int) -> bytes:
        return self.texts[place : self.texts.index(b"\0", place)]


@dataclass
class Normalised:
    text: str
    starts: np.ndarray  # original byte span that each normalised byte came from
    ends: np.ndarray


@dataclass
class Rules:
    """What the model says about normalisation."""

    chars: CharMap
    dummy_prefix: bool
    trim: bool  # leading, trailing and repeated spaces are removed

    def normalise(self, text: str) -> Normalised:
        raw, meta = text.encode(), META.encode()
        out, starts, ends = bytearray(), [], []

        def put(piece: bytes, start: int, end: int) -> None:
            out.extend(piece)
            starts.extend([start] * len(piece))
            ends.extend([end] * len(piece))

        at, gap = 0, self.trim
        if self.dummy_prefix and raw:
            put(meta, 0, 0)
        while at < len(raw):
            length, place = self.chars.longest(raw, at)
            if length:
                piece = self.chars.replacement(place)
            else:
                first = raw[at]
                length = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                piece = raw[at : at + length]
            for part in re.findall(rb" |[^ ]+", piece):
                if part != b" ":
                    put(part, at, at + length)
                elif not (self.trim and gap):
                    put(meta, at, at + length)
                gap = part == b" "
            at += length
        if self.trim:
            while out.endswith(meta):
                del out[-3:], starts[-3:], ends[-3:]
        return Normalised(out.decode(), np.array(starts, np.int64), np.array(ends, np.int64))


@dataclass
class Encoded:
    ids: list[int]
    listed: str  # ids joined by commas
    starts: np.ndarray  # original byte span of each piece
    ends: np.ndarray


class Encoder:
    """One model in one Python worker."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        spec = proto.normalizer_spec
        self.rules = Rules(CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces)
        # With an empty map and no trimming only spaces change: one byte becomes three.
        self.plain = not self.rules.chars.units and not self.rules.trim and self.rules.dummy_prefix
        # The same pieces for text that is normalised already.
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.sizes = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.shown = [str(i) for i in range(len(proto.pieces))]

    def encode(self, texts: list[str]) -> Iterator[Encoded]:
        """Ids and original byte spans of whole texts."""
        sources = [None if self.plain else self.rules.normalise(t) for t in texts]
        wholes = [s.text if s else META + t.replace(" ", META) if t else "" for t, s in zip(texts, sources)]
        for text, source, whole in zip(texts, sources, wholes):
            ids = self.inner.encode(whole)
            coded = np.array(ids, np.int64)
            starts, ends = self._spans(text, source, whole, coded)
            yield Encoded(ids, ",".join([self.shown[i] for i in ids]), starts, ends)

    def _spans(self, text: str, source: Normalised | None, whole: str, ids: np.ndarray):
        sizes = self.sizes[ids]
        unknown = ids == self.inner.unk_id()
        if unknown.any():
            # An unknown piece is given as it stands in the text.
            shown = self.inner.encode(whole, out_type=str)
            sizes = np.where(unknown, [len(p.encode()) for p in shown], sizes)
        after = np.cumsum(sizes)
        if not len(ids):
            return after, after
        if source is not None:
            return source.starts[after - sizes], source.ends[after - 1]
        raw = np.frombuffer(text.encode(), np.uint8)
        normalised = np.full(len(raw) + 1, 3, np.int64)  # bytes of the front symbol and of each original byte
        normalised[1:][raw != 0x20] = 1
        at = np.repeat(np.arange(-1, len(raw)), normalised)
        return np.maximum(at[after - sizes], 0), at[after - 1] + 1

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, in runs of bounded size."""
    ids = batch.column("doc_id").to_pylist()
    for part in vec.slices(batch.column("text")):
        rows = slice(part.first, part.first + part.rows)
        yield ids[rows], [part.text(a, b) for a, b in zip(part.offsets[:-1], part.offsets[1:])]


def _run(docs: DataFrame, path: str, row, schema: str) -> DataFrame:
    """``row(tool, doc_id, encoded)`` for every document."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            for ids, texts in _texts(batch):
                rows = [row(tool, i, e) for i, e in zip(ids, tool.encode(texts))]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """ids, original byte spans and decoded text of every document (doc_id, text)."""
    return _run(docs, path, lambda tool, i, e: (i, e.ids, e.starts, e.ends, tool.decode(e.ids)), ENCODED)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The same encoding as digests, taken where the pieces are made."""
    return _run(docs, path, digest, DIGESTS)


def digest(tool: Encoder, doc_id: int | None, got: Encoded) -> tuple:
    return (
        doc_id,
        len(got.ids),
        hashlib.sha256(got.listed.encode()).hexdigest(),
        hashlib.sha256(tool.decode(got.ids).encode()).hexdigest(),
        hashlib.sha256(got.ends.astype("<i4").tobytes()).hexdigest(),
        int(got.ends[-1]) if len(got.ends) else 0,
    )
