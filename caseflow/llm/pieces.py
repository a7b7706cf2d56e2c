"""Offset-preserving SentencePiece encoding: own normalisation with alignment, pieces projected to original bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "▁".encode()
USER_DEFINED, BYTE = 4, 6  # piece types of the model format
#: Documents per batch that leaves a worker.
DOCS_PER_BATCH = 128

ENCODED = "doc_id bigint, ids array<int>, begins array<int>, ends array<int>, decoded string"


class CharacterMap:
    """The compiled character map of a model: a double-array trie of byte strings and what replaces each of them.

    Layout: the trie's size in bytes, its 32-bit units, then the replacements, each ended by a zero byte.
    """

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size:] if blob else b""

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest key that begins at ``at``, and the key's length."""
        if not self.units:
            return None
        best = None
        units = self.units
        node = self._offset(units[0])
        for k in range(at, len(text)):
            byte = text[k]
            node ^= byte
            if node >= len(units) or (units[node] & 0x800000FF) != byte:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                best = self.texts[start:self.texts.index(b"\x00", start)], k + 1 - at
        return best


def _character(byte: int) -> int:
    """Bytes of the UTF-8 character that begins with ``byte``."""
    return 1 if byte < 0xC0 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4


class OffsetEncoder:
    """Encodes with a model file as its library does, and says which original bytes each piece stands for."""

    def __init__(self, path: str | None = None, proto: bytes | None = None) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as formats

        if proto is None:
            with open(path, "rb") as file:
                proto = file.read()
        model = formats.ModelProto.FromString(proto)
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.suffix = spec.add_dummy_prefix, model.trainer_spec.treat_whitespace_as_suffix
        self.trim, self.space = spec.remove_extra_whitespaces, SPACE if spec.escape_whitespaces else b" "
        self.kept = sorted((p.piece.encode() for p in model.pieces if p.type == USER_DEFINED), key=len, reverse=True)
        self.sizes = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.unknown = model.trainer_spec.unk_id
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        # The same pieces and merges for text that is normalised already.
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.plain = not self.map.units and not self.kept and not self.trim

    def _next(self, text: bytes, at: int) -> tuple[bytes, int]:
        for symbol in self.kept:
            if text.startswith(symbol, at):
                return symbol, len(symbol)
        found = self.map.longest(text, at)
        if found:
            return found
        size = _character(text[at])
        return text[at:at + size], size

    def normalised(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and the end the original byte at which its source begins."""
        if not text:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            source = np.frombuffer(text, np.uint8)
            begins = np.maximum.accumulate(np.where((source & 0xC0) == 0x80, 0, np.arange(len(source))))
            widths = np.where(source == 0x20, len(self.space), 1)
            before, after = (self.space, b"") if self.prefix and not self.suffix else (b"", self.space if self.prefix else b"")
            align = np.concatenate([np.zeros(len(before), np.int64), np.repeat(begins, widths),
                                    np.full(len(after) + 1, len(text), np.int64)])
            return before + text.replace(b" ", self.space) + after, align
        return self._by_longest_prefix(text)

    def _by_longest_prefix(self, text: bytes) -> tuple[bytes, np.ndarray]:
        out, align, at = bytearray(), [], 0

        def put(piece: bytes) -> None:
            out.extend(piece)
            align.extend([at] * len(piece))

        if self.trim:
            while at < len(text):
                piece, size = self._next(text, at)
                if piece != b" ":
                    break
                at += size
            if at == len(text):
                return b"", np.array([at])
        if self.prefix and not self.suffix:
            put(self.space)
        spaced = self.trim
        while at < len(text):
            piece, size = self._next(text, at)
            if spaced:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece.replace(b" ", self.space))
                spaced = piece.endswith(b" ")
            at += size
            spaced = spaced and self.trim
        if self.trim:
            while out.endswith(self.space):
                del out[-len(self.space):]
                at = align[len(out)]
                del align[len(out):]
        if self.prefix and self.suffix:
            put(self.space)
        return bytes(out), np.array([*align, at], np.int64)

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(ids, begins, ends): byte places in the original text, ends exclusive.

        The bytes of a character that the model lacks are pieces of their own; the last one stands for the character.
        """
        normal, align = self.normalised(text.encode())
        if not normal:
            return [], align[:0], align[:0]
        ids = self.segmenter.encode(normal.decode())
        sizes = self.sizes[ids]
        if self.unknown in ids:
            sizes = np.array([len(x.encode()) for x in self.segmenter.encode(normal.decode(), out_type=str)], np.int64)
        ends = np.cumsum(sizes)
        return ids, align[ends - sizes], align[ends]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> OffsetEncoder:
    """One per worker and file, kept over tasks."""
    return OffsetEncoder(path)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, begins, ends, decoded) of every whole text; nothing is shuffled.

    ``begins`` and ``ends`` are places in the UTF-8 bytes of the original text.  A null text is encoded as an empty one,
    which has no pieces and decodes to nothing; a null doc_id stays null; repeated rows are encoded each; an empty table
    gives an empty result; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path)
        for batch in batches:
            for some in slices(list(range(batch.num_rows)), DOCS_PER_BATCH):
                part = batch.slice(some[0], len(some))
                coded = [of.encode(t or "") for t in part.column(1).to_pylist()]

                def lists(k: int, coded: list = coded) -> pa.Array:
                    offsets = np.r_[0, np.cumsum([len(c[0]) for c in coded])].astype(np.int32)
                    flat = np.concatenate([np.asarray(c[k], np.int32) for c in coded])
                    return pa.ListArray.from_arrays(offsets, pa.array(flat))

                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), lists(0), lists(1), lists(2),
                     pa.array([of.decode(c[0]) for c in coded], pa.string())],
                    names=["doc_id", "ids", "begins", "ends", "decoded"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, ENCODED)
