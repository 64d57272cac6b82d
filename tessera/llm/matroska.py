"""Matroska: EBML elements, clusters, lacing and cues, read into packet tables and written for 8-bit audio."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, bounded_batches, numbered, text_bytes

#: Element ids, marker bits included.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, FLAG_LACING = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0x9C
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469

TOP_LEVEL = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


class Malformed(ValueError):
    """The bytes are no Matroska file, or break off inside an element."""


def read_id(b: bytes, i: int) -> tuple[int, int]:
    """An element id with its marker bit, and where it ends."""
    if i >= len(b) or not b[i] >> 4:
        raise Malformed(f"no element id at byte {i}")
    n = 9 - b[i].bit_length()
    if i + n > len(b):
        raise Malformed(f"an element id breaks off at byte {i}")
    return int.from_bytes(b[i : i + n]), i + n


def read_size(b: bytes, i: int) -> tuple[int | None, int]:
    """A variable-length number without its marker bit (None if all its bits are 1: unknown), and where it ends."""
    if i >= len(b) or not b[i]:
        raise Malformed(f"no size at byte {i}")
    n = 9 - b[i].bit_length()
    if i + n > len(b):
        raise Malformed(f"a size breaks off at byte {i}")
    ones = (1 << 7 * n) - 1
    value = int.from_bytes(b[i : i + n]) & ones
    return (None if value == ones else value), i + n


def elements(b: bytes, start: int, end: int, known: set[int] | None = None, siblings: set[int] | None = None) -> Iterator[tuple[int, int, int]]:
    """(id, begin, end) of the data of each element in b[start:end].

    An element of unknown size ends before the next id in siblings, for a cluster, or with its parent.
    """
    i = start
    while i < end:
        at = i
        ident, i = read_id(b, i)
        size, i = read_size(b, i)
        if size is None:
            stop = end
            if ident == CLUSTER:
                stop = next((a for a in _child_starts(b, i, end) if a[1] in TOP_LEVEL), (end, 0))[0]
            size = stop - i
        if i + size > end:
            raise Malformed(f"element {ident:X} at byte {at} is longer than its parent")
        yield ident, i, i + size
        i += size


def _child_starts(b: bytes, i: int, end: int) -> Iterator[tuple[int, int]]:
    while i < end:
        at = i
        ident, i = read_id(b, i)
        yield at, ident
        size, i = read_size(b, i)
        i = end if size is None else i + size


def uint(b: bytes, a: int, z: int) -> int:
    return int.from_bytes(b[a:z])


@dataclass
class Packet:
    """One frame: track, timestamp in ns, key frame or not, lacing of its block, index in its lace, byte range."""

    track: int
    timestamp_ns: int
    keyframe: bool
    lacing: int
    lace_index: int
    begin: int
    end: int


@dataclass
class Media:
    doc_type: str = ""
    timestamp_scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time in ns, track, byte place of the cluster
    clusters: list[int] = field(default_factory=list)  # byte places


def lace_sizes(b: bytes, i: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of the frames of a block's data from byte i on, and where the first begins."""
    if lacing == NO_LACING:
        return [end - i], i
    if i >= end:
        raise Malformed(f"a lace without a count at byte {i}")
    n, i, sizes = b[i] + 1, i + 1, []
    if lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while True:
                if i >= end:
                    raise Malformed(f"a lace breaks off at byte {i}")
                size += b[i]
                i += 1
                if b[i - 1] != 255:
                    break
            sizes.append(size)
    elif lacing == EBML_LACING:
        for k in range(n - 1):
            at = i
            value, i = read_size(b, i)
            if value is None:
                raise Malformed(f"a frame of unknown size at byte {at}")
            width = i - at
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    else:
        if (end - i) % n:
            raise Malformed(f"a fixed lace at byte {i} can't be divided into {n} frames")
        return [(end - i) // n] * n, i
    sizes.append(end - i - sum(sizes))
    if min(sizes) < 0:
        raise Malformed(f"a lace is longer than its block at byte {i}")
    return sizes, i


def _block(b: bytes, a: int, z: int, m: Media, cluster_time: int, simple: bool, key: bool) -> None:
    track, i = read_size(b, a)
    if track is None or i + 3 > z:
        raise Malformed(f"a block breaks off at byte {a}")
    time, flags = int.from_bytes(b[i : i + 2], signed=True), b[i + 2]
    lacing = flags >> 1 & 3
    sizes, i = lace_sizes(b, i + 3, z, lacing)
    each = m.tracks.get(track, {}).get("default_duration", 0)
    at = (cluster_time + time) * m.timestamp_scale
    for k, size in enumerate(sizes):
        m.packets.append(Packet(track, at + k * each, bool(flags >> 7) if simple else key, lacing, k, i, i + size))
        i += size


def parse(b: bytes) -> Media:
    """The packet table, tracks and cues of a file. Unknown elements are passed over; what follows the segment isn't read."""
    m, parts = Media(), elements(b, 0, len(b))
    ident, a, z = next(parts, (0, 0, 0))
    if ident != EBML:
        raise Malformed("no EBML header")
    for k, x, y in elements(b, a, z):
        if k == DOC_TYPE:
            m.doc_type = b[x:y].rstrip(b"\0").decode("ascii", "replace")
    segment = next(((x, y) for k, x, y in parts if k == SEGMENT), None)
    if segment is None:
        raise Malformed("no segment")
    base = segment[0]
    for ident, a, z in elements(b, *segment):
        if ident == INFO:
            for k, x, y in elements(b, a, z):
                if k == TIMESTAMP_SCALE:
                    m.timestamp_scale = uint(b, x, y)
        elif ident == TRACKS:
            for k, x, y in elements(b, a, z):
                if k == TRACK_ENTRY:
                    got = {e: (p, q) for e, p, q in elements(b, x, y)}
                    number = uint(b, *got[TRACK_NUMBER]) if TRACK_NUMBER in got else 0
                    m.tracks[number] = {
                        "type": uint(b, *got[TRACK_TYPE]) if TRACK_TYPE in got else 0,
                        "codec": b[slice(*got[CODEC_ID])].decode("ascii", "replace") if CODEC_ID in got else "",
                        "default_duration": uint(b, *got[DEFAULT_DURATION]) if DEFAULT_DURATION in got else 0,
                    }
        elif ident == CLUSTER:
            time = 0
            m.clusters.append(a)
            for k, x, y in elements(b, a, z):
                if k == TIMESTAMP:
                    time = uint(b, x, y)
                elif k == SIMPLE_BLOCK:
                    _block(b, x, y, m, time, True, True)
                elif k == BLOCK_GROUP:
                    inner = list(elements(b, x, y))
                    key = all(e != REFERENCE_BLOCK for e, _, _ in inner)
                    for e, p, q in inner:
                        if e == BLOCK:
                            _block(b, p, q, m, time, False, key)
        elif ident == CUES:
            for k, x, y in elements(b, a, z):
                if k == CUE_POINT:
                    when, places = 0, []
                    for e, p, q in elements(b, x, y):
                        if e == CUE_TIME:
                            when = uint(b, p, q)
                        elif e == CUE_TRACK_POSITIONS:
                            got = {f: uint(b, r, s) for f, r, s in elements(b, p, q) if f in (CUE_TRACK, CUE_CLUSTER_POSITION)}
                            places.append((got.get(CUE_TRACK, 0), base + got.get(CUE_CLUSTER_POSITION, 0)))
                    m.cues += [(when * m.timestamp_scale, t, at) for t, at in places]
    return m


def size_bytes(n: int, width: int = 0) -> bytes:
    """A variable-length number; all bits 1 mean unknown, so such values take a byte more."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width)


def element(ident: int, data: bytes | int) -> bytes:
    if isinstance(data, int):
        data = data.to_bytes(max(1, (data.bit_length() + 7) // 8))
    return ident.to_bytes((ident.bit_length() + 7) // 8) + size_bytes(len(data)) + data


def lace(frames: list[bytes], lacing: int) -> bytes:
    """The frames of a block with their lace head."""
    if lacing == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == EBML_LACING:
        last = None
        for f in frames[:-1]:
            if last is None:
                head += size_bytes(len(f))
            else:
                step = len(f) - last
                width = next(w for w in range(1, 9) if abs(step) < (1 << 7 * w - 1) - 1)
                head += size_bytes(step + (1 << 7 * width - 1) - 1, width)
            last = len(f)
    return head + b"".join(frames)


#: One sample a microsecond; frames of 1,024 samples, a lace of 8, a cluster of 4 blocks.
RATE, FRAME, LACE, BLOCKS = 1_000_000, 1024, 8, 4


def write(payload: bytes) -> bytes:
    """payload as one track of unsigned 8-bit mono samples, in laced simple blocks in clusters, with cues. Equal payloads, equal files."""
    head = element(EBML, b"".join(element(*x) for x in ((EBML_VERSION, 1), (EBML_READ_VERSION, 1), (EBML_MAX_ID, 4), (EBML_MAX_SIZE, 8), (DOC_TYPE, b"matroska"), (DOC_VERSION, 4), (DOC_READ_VERSION, 2))))
    info = element(INFO, element(TIMESTAMP_SCALE, 1000) + element(MUXING_APP, b"tessera") + element(WRITING_APP, b"tessera"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, b"\x41\x2e\x84\x80\x00\x00\x00\x00") + element(CHANNELS, 1) + element(BIT_DEPTH, 8))
    track = b"".join(element(*x) for x in ((TRACK_NUMBER, 1), (TRACK_UID, 1), (TRACK_TYPE, 2), (FLAG_LACING, 1), (DEFAULT_DURATION, FRAME * 1000), (CODEC_ID, b"A_PCM/INT/LIT"))) + audio
    body, cues, at = [info, element(TRACKS, element(TRACK_ENTRY, track))], [], 0
    place = len(body[0]) + len(body[1])
    while at < len(payload):
        start, blocks = at, [element(TIMESTAMP, at)]
        while at < len(payload) and len(blocks) <= BLOCKS:
            part = payload[at : at + FRAME * LACE]
            frames = [part[k : k + FRAME] for k in range(0, len(part), FRAME)]
            lacing = NO_LACING if len(frames) == 1 else FIXED if len(part) % FRAME == 0 else EBML_LACING
            blocks.append(element(SIMPLE_BLOCK, size_bytes(1) + (at - start).to_bytes(2, signed=True) + bytes([0x80 | lacing << 1]) + lace(frames, lacing)))
            at += len(part)
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, element(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER_POSITION, place))))
        body.append(cluster)
        place += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


def stored(b: bytes, m: Media, track: int) -> bytes:
    """The bytes of a track, from its packets' byte ranges in order of time."""
    own = sorted((p for p in m.packets if p.track == track), key=lambda p: (p.timestamp_ns, p.begin))
    return b"".join(b[p.begin : p.end] for p in own)


def features(b: bytes, m: Media, samples: bytes) -> str:
    """What the packet table and the samples say: packets, clusters, cues, laces, last timestamp, and the samples' mean, zero crossings and a checksum of the table."""
    laces = [sum(p.lacing == k for p in m.packets) for k in range(4)]
    table = zlib.crc32("".join(f"{p.track},{p.timestamp_ns},{p.begin},{p.end};" for p in m.packets).encode())
    last = max((p.timestamp_ns for p in m.packets), default=0)
    return f"packets={len(m.packets)};clusters={len(m.clusters)};cues={len(m.cues)};laces={'/'.join(map(str, laces))};last_ns={last};adler={zlib.adler32(samples)};table={table:08x}"


def packet_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, track, timestamp_ns, keyframe, lacing, lace_index, begin, end, fault): a row per packet of each media value.

    A file that can't be read gives one row with fault set and nulls; a null value and a file without packets give none.
    """
    schema = pa.schema([("id", pa.int64()), ("track", pa.int64()), ("timestamp_ns", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.int32()), ("lace_index", pa.int32()), ("begin", pa.int64()), ("end", pa.int64()), ("fault", pa.string())])

    def run(batches):
        for b in batches:
            out = []
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if raw is None:
                    continue
                try:
                    out += [(i, p.track, p.timestamp_ns, p.keyframe, p.lacing, p.lace_index, p.begin, p.end, None) for p in parse(raw).packets]
                except Malformed as e:
                    out.append((i, *[None] * 7, str(e)))
            yield batch(schema, *(zip(*out) if out else ([],) * 9))

    rows = df.select(numbered(id_col).alias("id"), F.col(f"`{media_col}`").cast("binary").alias("media"))
    return rows.mapInArrow(run, "id long, track long, timestamp_ns long, keyframe boolean, lacing int, lace_index int, begin long, end long, fault string")


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 64) -> DataFrame:
    """(doc_id, media): each text's UTF-8 bytes, filled with zeros to a positive multiple of unit, as a file."""

    @F.arrow_udf("binary")
    def run(t: pa.Array) -> pa.Array:
        return pa.array([write(padded(x, unit)) for x in t.to_pylist()], pa.binary())

    return df.select(F.col(f"`{id_col}`").alias("doc_id"), run(text_bytes(text_col)).alias("media"))


def padded(raw: bytes, unit: int = 64) -> bytes:
    return raw + bytes(-len(raw) % unit or (0 if raw else unit))


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 64) -> DataFrame:
    """One row per input row: each text is written as a file, the file parsed, and its samples read back through the packet table.

    Null and empty texts are unit zero bytes; ids may be null or repeated; texts are taken whole.
    """
    bounded_batches(df)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches):
        for b in batches:
            out = []
            for i, raw in zip(b.column(0).to_pylist(), b.column(1)):
                raw = raw.as_py()
                media = write(padded(raw, unit))
                m = parse(media)
                back = stored(media, m, 1)
                out.append((i, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(media, m, back)))
            yield batch(schema, *(zip(*out) if out else ([],) * 8))

    rows = df.select(numbered(id_col).alias("doc_id"), text_bytes(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
