import random

import pytest

from tessera.llm import matroska as M

RNG = random.Random(4)


@pytest.mark.parametrize("n", [1, 64, 1023, 1024, 1025, 8192, 8193, 32768, 32769, 200_001])
def test_round_trip(n):
    payload = RNG.randbytes(n)
    media = M.write(payload)
    m = M.parse(media)
    assert M.stored(media, m, 1) == payload
    assert m.doc_type == "matroska" and m.tracks[1]["codec"] == "A_PCM/INT/LIT"
    assert [c[2] for c in m.cues] and len(m.cues) == len(m.clusters)
    for (when, track, at), data in zip(m.cues, m.clusters):
        assert M.read_id(media, at)[0] == M.CLUSTER
        assert M.read_size(media, M.read_id(media, at)[1])[1] == data
    assert [p.timestamp_ns for p in m.packets] == [1024_000 * k for k in range(len(m.packets))]


@pytest.mark.parametrize("lacing", [M.XIPH, M.FIXED, M.EBML_LACING])
def test_lacing(lacing):
    for sizes in ([5], [0, 255, 256, 510, 3], [1, 200, 70, 9000, 9000, 0], [7] * 256):
        frames = [RNG.randbytes(sizes[0] if lacing == M.FIXED else s) for s in sizes]
        raw = b"zz" + M.lace(frames, lacing)
        got, at = M.lace_sizes(raw, 2, len(raw), lacing)
        assert got == [len(f) for f in frames]
        assert raw[at:] == b"".join(frames)


def test_numbers():
    for n in [0, 1, 126, 127, 128, 16382, 16383, 2**21, 2**55]:
        assert M.read_size(M.size_bytes(n), 0) == (n, len(M.size_bytes(n)))
    assert M.read_size(b"\xff", 0) == (None, 1)


def test_unknown_sizes_groups_and_strangers():
    head = M.element(M.EBML, M.element(M.DOC_TYPE, b"webm"))
    track = M.element(M.TRACKS, M.element(M.TRACK_ENTRY, M.element(M.TRACK_NUMBER, 2) + M.element(M.TRACK_TYPE, 1)))
    block = b"\x82\xff\xfe\x00" + b"frame"
    group = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, block) + M.element(M.REFERENCE_BLOCK, 1))
    unknown = M.CLUSTER.to_bytes(4) + b"\xff" + M.element(M.TIMESTAMP, 9) + group + M.element(0xEC, b"void")
    second = M.CLUSTER.to_bytes(4) + b"\xff" + M.element(M.TIMESTAMP, 20) + M.element(M.SIMPLE_BLOCK, b"\x82\x00\x01\x80two")
    media = head + M.SEGMENT.to_bytes(4) + b"\x01" + b"\xff" * 7 + track + unknown + second
    m = M.parse(media)
    assert [(p.track, p.timestamp_ns, p.keyframe, media[p.begin : p.end]) for p in m.packets] == [(2, 7_000_000, False, b"frame"), (2, 21_000_000, True, b"two")]


@pytest.mark.parametrize("bad", [b"", b"\x00", b"abcdef", M.write(b"x" * 64)[:80], M.element(M.EBML, b""), M.write(b"x" * 3000)[:1500]])
def test_malformed(bad):
    with pytest.raises(M.Malformed):
        M.parse(bad)


def test_frames(spark):
    import hashlib
    import zlib

    rows = [(1, "abc"), (2, None), (3, ""), (None, "é" * 40_000), (1, "abc"), (4, "x" * 64)]
    df = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, feature string")
    got = M.digest(df).collect()
    assert len(got) == 6
    for r, (i, t) in zip(got, rows):
        raw = (t or "").encode()
        pad = raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert r.media_sha256 == hashlib.sha256(M.write(pad)).hexdigest()
    assert got[0][1:] == got[4][1:] and got[1][1:] == got[2][1:]
    media = M.to_media(df).union(spark.createDataFrame([(9, b"no"), (10, None)], "doc_id long, media binary"))
    table = M.packet_table(media, "doc_id", "media")
    assert table.filter("fault is not null").select("id").collect() == [(9,)]
    assert table.filter("id = 4").selectExpr("sum(end - begin)").first()[0] == 64
    assert M.digest(df.limit(0)).count() == 0
