"""SentencePiece encoding and decoding that keeps offsets.

The normaliser is this module's own: at each position the longest prefix that the model's compiled
character map knows (a double-array trie) is replaced, any other character is copied, and for each
byte of the normalised text the source byte it came from is recorded. White space is escaped and a
dummy prefix added as the model's settings say. Every piece is a span of the normalised text, so its
source span follows from the record: ``begin = align[start of the piece]``, ``end = align[its end]``.

Segmentation is done by the library itself. Where no piece of the vocabulary has an escaped space
behind another character, merges never cross from a word into the next space, so that the text is cut
there and the ids of each chunk are kept in a bounded cache; texts that hold the escape character
itself, and models with other settings, are encoded whole. The pieces' bytes must add up to the
normalised text; a difference is an error, never a silent shift of spans.

Defined cases: a null text is empty; an empty text has no piece but the end id and decodes to an
empty string; long texts are encoded whole, never cut; repeated rows give repeated rows.
"""

import hashlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
MAX_CACHED = 120_000  #: chunks in a worker's cache, some 30 MB


class Encoded(NamedTuple):
    ids: list[int]
    begin: np.ndarray  #: source byte at which each piece begins
    end: np.ndarray  #: source byte behind each piece


class CharMap:
    """The compiled character map: trie size, trie units, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, np.uint32, size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of data[at:], and what replaces it."""
        if not self.units:
            return None
        found = None
        node = self._offset(self.units[0])
        for n in range(at, len(data)):
            node ^= data[n]
            unit = self.units[node]
            if unit & 0x800000FF != data[n]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = n + 1 - at, self.replacements[start : self.replacements.index(0, start)]
        return found


class Normalizer:
    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.space = SPACE.encode() if self.escape else b" "

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them, and for their end, the source byte."""
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            return self._identity(data)
        out, align, at = bytearray(), [], 0
        parts = []
        while at < len(data):
            hit = self.map.longest(data, at)
            n = hit[0] if hit else 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            parts.append((hit[1] if hit else data[at : at + n], at))
            at += n
        if self.squeeze:  # leading white space goes, and the end of the source moves before the trailing
            while parts and parts[0][0] in (b" ", b""):
                parts.pop(0)
        if not parts:
            return b"", np.zeros(1, np.int64)
        if self.dummy:
            out += self.space
            align += [parts[0][1]] * len(self.space)
        spaced = self.squeeze
        for part, at in parts:
            while spaced and part.startswith(b" "):
                part = part[1:]
            for b in part:
                piece = self.space if b == 0x20 else bytes([b])
                out += piece
                align += [at] * len(piece)
            if part:
                spaced = self.squeeze and part.endswith(b" ")
        end = len(data)
        while self.squeeze and out.endswith(self.space):
            del out[-len(self.space) :]
            end = align[-len(self.space)]
            del align[-len(self.space) :]
        return bytes(out), np.array([*align, end])

    def _identity(self, data: bytes) -> tuple[bytes, np.ndarray]:
        wide = len(self.space)
        norm = (self.space if self.dummy else b"") + data.replace(b" ", self.space)
        width = np.where(np.frombuffer(data, np.uint8) == 0x20, wide, 1)
        align = np.repeat(np.arange(len(data)), width)
        return norm, np.concatenate([np.zeros(wide if self.dummy else 0, np.int64), align, [len(data)]])


class PieceCodec:
    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.library.serialized_model_proto())
        spec = proto.normalizer_spec
        self.normalize = Normalizer(spec)
        kinds = {p.type for p in proto.pieces}
        self.cut = (
            not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
            and not proto.trainer_spec.treat_whitespace_as_suffix and proto.trainer_spec.byte_fallback
            and kinds <= {1, 2, 3, 6} and not any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces)
        )
        #: bytes of each piece in the normalised text: a byte piece has one, a control piece none
        self.bytes = [b"" if p.type in (3, 2) else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.encode() for p in proto.pieces]
        self.width = np.array([len(b) for b in self.bytes])
        self.end_id = self.library.eos_id()
        self.cache: dict[str, tuple[int, ...]] = {}
        self.numbers = list(range(len(self.bytes)))  # one object for each id, shared by all cached chunks

    def segment(self, text: str) -> list[int]:
        """The library's ids of the text, without an end id."""
        if not text or not self.cut or SPACE in text:
            return self.library.encode(text)
        chunks = text.split(" ")
        if "" in chunks:  # more than one space: they belong to the next chunk; trailing ones are one chunk
            joined, spaces = [], 0
            for c in chunks:
                if c:
                    joined.append(" " * spaces + c)
                    spaces = 0
                else:
                    spaces += 1
            chunks = joined + ([" " * (spaces - 1)] if spaces else [])
            if spaces == 1:
                return [*self.segment(text[:-1]), *self._lone_space()]
        cache = self.cache
        missing = list({c for c in chunks if c not in cache})
        if missing:
            shared = self.numbers.__getitem__
            new = {c: tuple(map(shared, ids)) for c, ids in zip(missing, self.library.encode(missing, num_threads=1), strict=True)}
            if len(cache) < MAX_CACHED:
                cache.update(new)
            else:  # the cache is full of what came first; the rest is not kept
                return list(chain.from_iterable([cache[c] if c in cache else new[c] for c in chunks]))
        return list(chain.from_iterable(map(cache.__getitem__, chunks)))

    def _lone_space(self) -> list[int]:
        return [self.library.piece_to_id(SPACE)]

    def encode(self, text: str | None, end: bool = True) -> Encoded:
        """Ids and source byte spans of every piece; an end id spans nothing, at the end."""
        text = text or ""
        norm, align = self.normalize(text.encode())
        ids = self.segment(text)
        stops = np.cumsum(self.width[np.array(ids, np.int32)]) if ids else np.zeros(0, np.int64)
        if (int(stops[-1]) if ids else 0) != len(norm):
            if self.library.unk_id() not in ids:
                raise ValueError("the pieces do not add up to the normalised text")
            stops = self._unknown_stops(text, norm)
        begin, stop = align[np.concatenate([[0], stops[:-1]])] if ids else stops, align[stops]
        if end:
            ids, begin, stop = [*ids, self.end_id], np.append(begin, align[-1]), np.append(stop, align[-1])
        return Encoded(ids, begin, stop)

    def _unknown_stops(self, text: str, norm: bytes) -> np.ndarray:
        """Unknown pieces are as long as the library's surface says."""
        pieces = self.library.encode(text, out_type=str)
        return np.cumsum([len(p.encode()) for p in pieces])

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_CODECS: dict[str, PieceCodec] = {}


def codec(model: str) -> PieceCodec:
    """One codec for each worker process."""
    if model not in _CODECS:
        _CODECS[model] = PieceCodec(model)
    return _CODECS[model]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, begins and ends (byte offsets) of every text of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for few in slices(batch):
                found = [own.encode(t) for t in few.column(1).to_pylist()]
                lists = [pa.array([list(map(int, x)) for x in column], pa.list_(pa.int32())) for column in zip(*found, strict=True)] if found else [pa.array([], pa.list_(pa.int32()))] * 3
                yield pa.RecordBatch.from_arrays([few.column(0), *lists], ["doc_id", "ids", "begins", "ends"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document: number of ids, digests of the ids, of the decoded text and of the spans, bytes that the spans cover.

    spans_sha256 is of begin and end of each id, in order, as 64-bit little-endian numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        names = np.array([str(i) for i in range(own.library.get_piece_size())], dtype=object)
        for batch in batches:
            rows = []
            for few in slices(batch):
                for text in few.column(1).to_pylist():
                    e = own.encode(text)
                    said = " ".join(names[e.ids])
                    rows.append((len(e.ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(own.decode(e.ids).encode()).hexdigest(), covered(e), spans_digest(e)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes", "spans_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long, spans_sha256 string")


def spans_digest(e: Encoded) -> str:
    return hashlib.sha256(np.stack([e.begin, e.end], axis=1).astype("<i8").tobytes()).hexdigest()


def covered(e: Encoded) -> int:
    """Source bytes inside the union of the spans; pieces of one source character share its bytes."""
    if not len(e.end):
        return 0
    before = np.maximum.accumulate(np.concatenate([[0], e.end[:-1]]))
    return int(np.maximum(e.end - np.maximum(e.begin, before), 0).sum())


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
