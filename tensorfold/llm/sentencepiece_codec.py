"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised by longest-prefix matches in the model's compiled character map. Every byte of the
normalised text keeps the byte offset it came from, so each piece of the segmentation, which tiles the
normalised text, projects to a span of bytes of the original. Segmentation itself is the library's, run on
our normalised text by a copy of the model whose own normaliser is switched off.

Nulls count as empty texts; an empty text has no pieces and decodes to the empty text.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

SPACE = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = buf[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def wire_fields(buf: bytes) -> Iterator[tuple[int, int, object, int, int]]:
    """(field, wire type, value, start, end) of each field of a protocol-buffer message."""
    at = 0
    while at < len(buf):
        start = at
        tag, at = _varint(buf, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(buf, at)
        elif kind == 1:
            value, at = buf[at : at + 8], at + 8
        elif kind == 2:
            size, at = _varint(buf, at)
            value, at = buf[at : at + size], at + size
        elif kind == 5:
            value, at = buf[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {kind} is not known")
        yield tag >> 3, kind, value, start, at


@dataclass
class ModelFile:
    pieces: list[str]
    types: np.ndarray
    byte_fallback: bool
    is_bpe: bool
    suffix_space: bool
    charsmap: bytes
    dummy_prefix: bool
    remove_extra: bool
    escape: bool
    bare: bytes

    @classmethod
    def parse(cls, blob: bytes) -> ModelFile:
        pieces, types, rest = [], [], []
        trainer, spec = {}, {1: b"", 2: b"", 3: 1, 4: 1, 5: 1}
        for field, _, value, start, end in wire_fields(blob):
            if field == 1:
                own = {f: v for f, _, v, _, _ in wire_fields(value)}
                pieces.append(own.get(1, b"").decode())
                types.append(own.get(3, NORMAL))
            elif field == 2:
                trainer = {f: v for f, _, v, _, _ in wire_fields(value)}
            elif field == 3:
                spec |= {f: v for f, _, v, _, _ in wire_fields(value)}
            if field != 3:
                rest.append(blob[start:end])
        # A normaliser that changes nothing: no map, no prefix, white space neither dropped nor escaped.
        bare = b"\x0a\x08identity" + b"\x18\x00\x20\x00\x28\x00"
        rest.append(b"\x1a" + bytes([len(bare)]) + bare)
        return cls(pieces, np.array(types, np.int8), bool(trainer.get(35, 0)), trainer.get(3, 1) == 2, bool(trainer.get(24, 0)), spec[2], bool(spec[3]), bool(spec[4]), bool(spec[5]), b"".join(rest))


class CharsMap:
    """The compiled character map: a double-array trie over byte strings, then their replacements."""

    def __init__(self, blob: bytes):
        self.units, self.texts = [], b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement and length of the longest key that ``data`` has at ``at``."""
        units, best, node = self.units, None, 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                best = units[node] & 0x7FFFFFFF, i + 1 - at
        if best is None:
            return None
        return self.texts[best[0] : self.texts.index(b"\0", best[0])], best[1]

    def starts(self) -> frozenset[int]:
        """The bytes a key can start with."""
        if not self.units:
            return frozenset()
        root = (self.units[0] >> 10) << ((self.units[0] & 0x200) >> 6)
        return frozenset(b for b in range(256) if (root ^ b) < len(self.units) and self.units[root ^ b] & 0x800000FF == b)


class Normalizer:
    """Normalises and keeps, for each byte of the result and its end, the offset in the source."""

    def __init__(self, model: ModelFile):
        self.m, self.map = model, CharsMap(model.charsmap)
        self.own = sorted((p.encode() for p, t in zip(model.pieces, model.types) if t == USER_DEFINED), key=len, reverse=True)
        self.simple = not self.map.units and not self.own and not model.remove_extra and model.escape
        self.space = SPACE.encode() if model.escape else b" "

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        if not text:
            return "", np.zeros(1, np.int64)
        return self._plain(text) if self.simple else self._mapped(text.encode())

    def _plain(self, text: str) -> tuple[str, np.ndarray]:
        raw = np.frombuffer(text.encode(), np.uint8)
        at = np.arange(len(raw))
        heads = np.maximum.accumulate(np.where(raw & 0xC0 == 0x80, 0, at))
        align = np.repeat(heads, np.where(raw == 32, 3, 1)) if (raw == 32).any() else heads
        prefix, suffix = self.m.dummy_prefix and not self.m.suffix_space, self.m.dummy_prefix and self.m.suffix_space
        align = np.concatenate([np.zeros(3 * prefix, np.int64), align, np.full(3 * suffix + 1, len(raw))])
        return SPACE * prefix + text.replace(" ", SPACE) + SPACE * suffix, align

    def _next(self, raw: bytes, at: int) -> tuple[bytes, int]:
        for piece in self.own:
            if raw.startswith(piece, at):
                return piece, len(piece)
        if self.map.units and (hit := self.map.longest(raw, at)):
            return hit
        size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        return raw[at : at + size], size

    def _mapped(self, raw: bytes) -> tuple[str, np.ndarray]:
        m, out, align, at = self.m, bytearray(), [], 0
        if m.remove_extra:
            while at < len(raw):
                piece, size = self._next(raw, at)
                if piece != b" ":
                    break
                at += size
            if at == len(raw):
                return "", np.full(1, at)

        def put(piece: bytes, source: int) -> None:
            piece = piece.replace(b" ", self.space)
            out.extend(piece)
            align.extend([source] * len(piece))

        if m.dummy_prefix and not m.suffix_space:
            put(b" ", at)
        after_space = m.remove_extra
        while at < len(raw):
            piece, size = self._next(raw, at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece, at)
                after_space = piece.endswith(b" ")
            at += size
            if not m.remove_extra:
                after_space = False
        if m.remove_extra:
            while out.endswith(self.space):
                at = align[len(out) - len(self.space)]
                del out[-len(self.space) :], align[-len(self.space) :]
        if m.dummy_prefix and m.suffix_space:
            put(b" ", at)
        return out.decode(), np.array([*align, at], np.int64)


@dataclass
class Encoding:
    """The ids of a text, the spans of its bytes they came from, and the ids in decimal joined by commas."""

    ids: list[int]
    begin: np.ndarray
    end: np.ndarray
    joined: str


class SentencePieceCodec:
    """Encodes to ids with byte spans and decodes again, exactly as the library does.

    In a BPE model in which no piece continues past a white-space mark, merges never cross the start of a run
    of marks; such chunks are segmented one by one and the frequent ones remembered, with the same ids. The
    memory is bounded: two generations of about ``cache_words`` chunks of up to 48 characters.
    """

    def __init__(self, path: str, cache_words: int = 80_000):
        import sentencepiece

        with open(path, "rb") as f:
            blob = f.read()
        self.model = ModelFile.parse(blob)
        if not self.model.byte_fallback:
            raise ValueError("spans need a model with byte fallback: its pieces tile the normalised text")
        self.normalize = Normalizer(self.model)
        self.original = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=self.model.bare)
        self.sizes = np.array([1 if t == BYTE else len(p.encode()) for p, t in zip(self.model.pieces, self.model.types)], np.int64)
        inner = any(SPACE in p.lstrip(SPACE) for p in self.model.pieces)
        chunked = self.model.is_bpe and not inner and not self.normalize.own and self.model.escape and not self.model.suffix_space
        lone = "" if any("\n" in p and len(p) > 1 for p in self.model.pieces) else "\n"
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+|\n").findall if chunked else None
        feed = self.bare.encode("\n") if lone else []
        self.feed = feed[0] if len(feed) == 1 else None
        #: By chunk: the ids as 32-bit integers, and in decimal.
        self.cache: tuple[dict[str, bytes], dict[str, str]] = ({}, {})
        self.older: tuple[dict[str, bytes], dict[str, str]] = ({}, {})
        self.room = cache_words

    def _segment_chunks(self, chunks: list[str]) -> list[np.ndarray]:
        """Segment chunks in one call, with line feeds between, where those are pieces by themselves."""
        if self.feed is None or "\n" in chunks:
            return [np.array(x, np.int32) for x in self.bare.encode(chunks)]
        ids, out, at = np.array(self.bare.encode("\n".join(chunks)), np.int32), [], 0
        for stop in np.flatnonzero(ids == self.feed).tolist():
            out.append(ids[at:stop])
            at = stop + 1
        return [*out, ids[at:]]

    def _segment(self, text: str) -> tuple[np.ndarray, str]:
        if self.chunks is None:
            ids = self.bare.encode(text)
            return np.array(ids, np.int32), ",".join(map(str, ids))
        words = self.chunks(text)
        if len(self.cache[0]) > self.room:
            self.older, self.cache = self.cache, ({}, {})
        (known, shown), (old, old_shown), new, once = self.cache, self.older, [], []
        for w in set(words):
            if w not in known:
                if w in old:
                    known[w], shown[w] = old[w], old_shown[w]
                else:
                    new.append(w)
        if new:
            for w, ids in zip(new, self._segment_chunks(new)):
                known[w], shown[w] = ids.tobytes(), ",".join(map(str, ids.tolist()))
                if len(w) > 48 or len(known) > 2 * self.room:
                    once.append(w)
        ids, joined = np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32), ",".join(map(shown.__getitem__, words))
        for w in once:
            del known[w], shown[w]
        return ids, joined

    def encode(self, text: str | None) -> Encoding:
        norm, align = self.normalize(text or "")
        if not norm:
            return Encoding([], np.zeros(0, np.int64), np.zeros(0, np.int64), "")
        ids, joined = self._segment(norm)
        stops = np.cumsum(self.sizes[ids])
        if stops[-1] != len(align) - 1:
            raise ValueError("the pieces don't tile the normalised text")
        end = align[stops]
        return Encoding(ids.tolist(), np.concatenate([align[:1], end[:-1]]), end, joined)

    def decode(self, ids: list[int]) -> str:
        return self.original.decode(ids) if ids else ""


@lru_cache(maxsize=2)
def codec(path: str) -> SentencePieceCodec:
    """One codec for each worker process and model."""
    return SentencePieceCodec(path)


def full_row(enc: Encoding, decode: Callable[[list[int]], str]) -> dict:
    return {"ids": enc.ids, "span_begin": enc.begin.tolist(), "span_end": enc.end.tolist(), "decoded": decode(enc.ids)}


FULL = "ids array<int>, span_begin array<bigint>, span_end array<bigint>, decoded string"


def digest_row(enc: Encoding, decode: Callable[[list[int]], str]) -> dict:
    """Digests of the ids, the decoded text and the spans: CRC-32 of all begins and then all ends as little-endian
    64-bit integers; and the bytes of the original that the spans cover together."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    spans = zlib.crc32(np.ascontiguousarray(enc.end, "<i8"), zlib.crc32(np.ascontiguousarray(enc.begin, "<i8")))
    return {"n_tokens": len(enc.ids), "ids_sha256": sha(enc.joined), "decoded_sha256": sha(decode(enc.ids)), "spans_crc32": spans, "spanned_bytes": int((enc.end - enc.begin).sum())}


DIGEST = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint, spanned_bytes bigint"


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), emit: Callable = full_row, schema: str = FULL) -> DataFrame:
    """Encode and decode the text of each row; ``keep`` names the columns that stay.

    ``emit`` turns a text's Encoding and the decoder into the added columns of ``schema``: by default ids, spans
    and the decoded text. A projection without shuffle: one row in, one row out, repeated rows included.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[text].cast("string").alias("t"))
    out = docs.select(*[docs[c] for c in keep]).limit(0)
    names = [f.split()[0] for f in schema.split(", ")]
    spec = ", ".join([f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(out.schema)] + [schema])
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    n = len(keep)

    def run(batches):
        own = codec(model_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [emit(own.encode(t), own.decode) for t in part.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *(pa.array([r[c] for r in rows], arrow.field(c).type) for c in names)], names=[*(f"k{i}" for i in range(n)), *names])

    result = kept.mapInArrow(run, spec)
    return result.select(*[result[f"k{i}"].alias(c) for i, c in enumerate(keep)], *names)


def op1_sentencepiece(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Token counts and digests of every document's ids, decoded text and spans."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, model_path or public_tokenizers.path("piece_bpe_32k.model"), emit=digest_row, schema=DIGEST)
