"""SentencePiece encoding and decoding that keeps the original offsets of every piece."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, bounded_batches, numbered

SPACE = "▁"
#: Characters of texts that go to the library in one call.
TOGETHER = 1 << 17


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return value, i


def proto_fields(b: bytes):
    """(field, value, start, end) of a serialized message; nested messages stay bytes."""
    i = 0
    while i < len(b):
        start = i
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, i = _varint(b, i)
            value, i = b[i : i + size], i + size
        yield key >> 3, value, start, i


def charmap_rules(charsmap: bytes) -> dict[str, str]:
    """The compiled character map as {source: replacement}: a double array over UTF-8 bytes, then the replacements, each ended by a zero."""
    if not charsmap:
        return {}
    (size,) = struct.unpack_from("<I", charsmap)
    units, texts = np.frombuffer(charsmap, "<u4", size // 4, 4), charsmap[4 + size :]
    step = lambda u: (u >> 10) << ((u & 0x200) >> 6)
    rules, todo = {}, [(step(int(units[0])), b"")]
    while todo:
        base, key = todo.pop()
        for c in range(1, 256):
            at = base ^ c
            if at < len(units) and int(units[at]) & 0x800000FF == c:
                u = int(units[at])
                below = at ^ step(u)
                if u >> 8 & 1:
                    first = int(units[below]) & 0x7FFFFFFF
                    rules[(key + bytes([c])).decode()] = texts[first : texts.index(b"\0", first)].decode()
                todo.append((below, key + bytes([c])))
    return rules


def _width(points: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each code point."""
    if not len(points) or points.max() < 0x80:
        return np.ones(len(points), np.int8)
    return np.int8(1) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)


@dataclass
class Normalizer:
    """Longest-prefix normalisation; see normalize."""

    rules: dict[str, str]
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False

    def __post_init__(self):
        self.most = max(map(len, self.rules), default=0)
        self.plain = self.dummy_prefix and self.escape and not self.squeeze and not self.suffix
        self.starts = re.compile("[" + "".join(map(re.escape, sorted({k[0] for k in self.rules}))) + "]") if self.rules else None

    def _replaced(self, text: str, points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code points, source offsets) after the character map: what lies between its sources is taken over in whole stretches."""
        out, begin, i, look = [], [], 0, 0
        while hit := self.starts.search(text, look):
            look = hit.start()
            for n in range(min(self.most, len(text) - look), 0, -1):
                if (new := self.rules.get(text[look : look + n])) is not None:
                    out += [points[i:look], np.array([ord(c) for c in new], "<u4")]
                    begin += [at[i:look], np.full(len(new), at[look], at.dtype)]
                    i = look = look + n
                    break
            else:
                look += 1
        return (np.concatenate([*out, points[i:]]), np.concatenate([*begin, at[i:]])) if out else (points, at)

    def _marked(self, text: str) -> tuple[str, np.ndarray]:
        """normalize() where nothing is replaced or squeezed: a mark in front, and marks for spaces."""
        if not text:
            return "", np.zeros(1, np.int32)
        raw = np.frombuffer(text.encode(), np.uint8)
        begin = np.arange(len(raw), dtype=np.int32)
        if len(raw) != len(text):  # all bytes of a character come from its first one
            begin = np.maximum.accumulate(np.where((raw & 0xC0) == 0x80, 0, begin))
        begin = np.repeat(begin, (raw == 32) * np.int8(2) + np.int8(1))
        return SPACE + text.replace(" ", SPACE), np.concatenate([np.zeros(3, np.int32), begin, np.array([len(raw)], np.int32)])

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, begin): begin[i] is the UTF-8 offset in text of what the normalised text's UTF-8 byte i came from, and begin[-1] its end.

        At each place the longest source of the character map that stands there is replaced; elsewhere a character stands for
        itself. Then white space is squeezed (none at the ends, single inside), a space put in front (or behind, for models
        that mark word ends) and spaces written as U+2581, as the model asks. An empty text stays empty.
        """
        if self.plain and not (self.starts and self.starts.search(text)):
            return self._marked(text)
        out = np.frombuffer(text.encode("utf-32-le"), "<u4")
        at = np.cumsum(_width(out), dtype=np.int32)
        end = int(at[-1]) if len(at) else 0
        begin = np.r_[np.int32(0), at[:-1]] if len(at) else at
        if self.starts:
            out, begin = self._replaced(text, out, begin)
        if self.squeeze and len(out):
            space = out == 32
            keep = ~space
            keep[1:] |= ~space[:-1]
            out, begin = out[keep], begin[keep]
        mark = np.uint32(ord(SPACE) if self.escape else 32)
        out = np.where(out == 32, mark, out)
        some = len(out) or (text and not self.squeeze)
        if self.dummy_prefix and not self.suffix and some:
            out, begin = np.r_[mark, out], np.r_[begin[:1] if len(out) else np.int32(0), begin]
        if self.squeeze:  # as the library does: marks at the end go, whatever they came from
            own = np.flatnonzero(out != mark)
            size = int(own[-1]) + 1 if len(own) else 0
            if size < len(out):
                end, out, begin = int(begin[size]), out[:size], begin[:size]
        if self.dummy_prefix and self.suffix and some:
            out, begin = np.r_[out, mark], np.r_[begin, np.int32(end)]
        return out.astype("<u4", copy=False).tobytes().decode("utf-32-le"), np.r_[np.repeat(begin, _width(out)), np.int32(end)]


class Pieces:
    """A model file; normalisation is done here, merging by the library on text that is already normalised."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec, trainer, kept, names = {}, {}, b"", []
        for field, value, a, b in proto_fields(raw):
            if field == 1:
                names.append({k: v for k, v, _, _ in proto_fields(value)})
            if field == 2:
                trainer = {k: v for k, v, _, _ in proto_fields(value)}
            if field == 3:
                spec = {k: v for k, v, _, _ in proto_fields(value)}
            else:
                kept += raw[a:b]
        plain = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"  # no prefix, no squeezing, no escaping
        self.merge = sentencepiece.SentencePieceProcessor(model_proto=kept + b"\x1a" + bytes([len(plain)]) + plain)
        self.normalizer = Normalizer(charmap_rules(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), bool(trainer.get(24, 0)))
        text = [p[1].decode() for p in names]
        kind = [p.get(3, 1) for p in names]
        self.size = np.array([1 if k == 6 else len(t.encode()) for t, k in zip(text, kind)], np.int64)
        self.unknown = np.array([k == 2 for k in kind])
        self.names = np.array([f"{i}," for i in range(len(text))], "S")
        n = self.normalizer
        # if no piece has a mark behind another character, no merge crosses such a place
        self.by_chunk = n.escape and not n.suffix and trainer.get(3, 1) == 2 and not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in text)
        # the library's queue is faster on chunks of about a thousand characters
        self.chunk = re.compile(f".{{1000,}}?(?=(?<=[^{SPACE}]){SPACE}|\\Z)|.+", re.S)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, begin, end) of each piece, in UTF-8 bytes of the original text; bytes of one character share its span's parts only as a whole."""
        norm, begin = self.normalizer.normalize(text)
        return self._spans(norm, begin) if norm else []

    def _spans(self, norm: str, begin: np.ndarray) -> list[tuple[int, int, int]]:
        begin = begin.tolist()
        return [(p.id, begin[p.begin], begin[p.end]) for p in self.merge.encode(norm, return_type="proto").pieces]

    def ids(self, text: str) -> list[int]:
        return self.merge.encode(self.normalizer.normalize(text)[0])

    def digest(self, text: str) -> tuple[int, str, str, int]:
        """(number of ids, sha256 of the ids as text, sha256 of the decoded text, crc32 of the pieces' ends as uint32).

        Every text is normalised with its alignment, its pieces' ends are projected through it, and its ids are decoded by the library.
        """
        return next(self.digests([text]))

    def digests(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str, int]]:
        """digest() of each text. Texts go to the library together, TOGETHER characters or a longer text at a time: each call starts a thread."""
        some, size = [], 0
        for t in texts:
            some.append(self.normalizer.normalize(t))
            size += len(t)
            if size >= TOGETHER:
                yield from self._digests(some)
                some, size = [], 0
        yield from self._digests(some)

    def _digests(self, texts: list[tuple[str, np.ndarray]]) -> Iterator[tuple[int, str, str, int]]:
        chunks = [self.chunk.findall(norm) if self.by_chunk else [] for norm, _ in texts]
        merged = iter(self.merge.encode(list(chain.from_iterable(chunks)), num_threads=1, return_type="numpy"))
        found = []
        for (norm, begin), parts in zip(texts, chunks):
            ids = ends = np.zeros(0, np.int32)
            if parts:
                flat = np.concatenate(list(islice(merged, len(parts))))
                at = np.cumsum(self.size[flat])
                if at[-1] == len(begin) - 1 and not self.unknown[flat].any():  # pieces lie end to end in the normalised text
                    ids, ends = flat, begin[at]
            if norm and not len(ends):  # unknown pieces have no size of their own
                spans = self._spans(norm, begin)
                ids, ends = np.array([s[0] for s in spans], np.int32), np.array([s[2] for s in spans])
            found.append((ids, ends))
        decoded = iter(self.library.decode([ids for ids, _ in found if len(ids)], num_threads=1))
        for ids, ends in found:
            back = next(decoded) if len(ids) else ""
            joined = self.names[ids].tobytes().translate(None, b"\0")[:-1]
            yield len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), zlib.crc32(ends.astype("<u4").tobytes())


@cache
def model(path: str) -> Pieces:
    return Pieces(path)


def _default() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, pieces): per input row an array of (id, begin, end), spans in UTF-8 bytes of the original text. Null texts count as empty: no pieces."""
    path = path or _default()
    kind = "array<struct<id:int,begin:int,end:int>>"

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        m = model(path)
        rows = [[dict(zip(("id", "begin", "end"), s)) for s in m.spans(t)] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("id", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())])))

    return df.select(F.col(f"`{id_col}`").alias("doc_id"), run(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("pieces"))


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text) from arrays of ids; null and empty arrays give an empty text."""
    path = path or _default()

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        m = model(path)
        return pa.array([m.library.decode(x) if x else "" for x in ids.to_pylist()], pa.string())

    return df.select(F.col(f"`{id_col}`").alias("doc_id"), run(F.col(f"`{ids_col}`").cast("array<int>")).alias("text"))


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32): one row per input row, whole texts, null as empty; rows and ids may repeat."""
    path = path or _default()
    bounded_batches(df)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_crc32", pa.int64())])

    def run(batches):
        m = model(path)
        for b in batches:
            out = list(m.digests(t.as_py() or "" for t in b.column(1)))
            yield batch(schema, b.column(0), *(zip(*out) if out else ([],) * 4))

    rows = df.select(numbered(id_col).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
