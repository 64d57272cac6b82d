import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tessera.llm import spieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
RNG = random.Random(3)
TEXTS = ["", " ", "  ", "a", "  a  b ", "▁a ▁", "\n\n x\t y", "é̀ 日本語 🙂🙂", "<s> </s> <0x41> <unk>", "\x00\x01 a", "a" * 5000, "lorem ipsum " * 900]
TEXTS += ["".join(RNG.choices(" ab▁\n日🙂é<0x>s", k=RNG.randint(1, 60))) for _ in range(1000)]
TEXTS += ["".join(RNG.choices(["foo", " ", " ", "▁", "barbaz", "\n", "日"], k=2000)) for _ in range(5)] + [" ".join(RNG.choices(["the", "cat", "zzyzx."], k=3000))]


def reference(t):
    ids = LIBRARY.encode(t)
    return ids, (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((LIBRARY.decode(ids) if ids else "").encode()).hexdigest())


def test_digest_and_spans_equal_the_library():
    m = spieces.Pieces(PATH)
    for t in TEXTS:
        ids, want = reference(t)
        got, spans = m.digest(t), m.spans(t)
        assert got[:3] == want
        assert [s[0] for s in spans] == ids == m.ids(t)
        assert got[3] == zlib.crc32(np.array([s[2] for s in spans], "<u4").tobytes())
        at = 0
        for _, a, b in spans:
            assert a == at <= b
            at = b
        assert at == len(t.encode()) or not spans


def charsmap(rules):
    """A double array for rules, built by trying bases; the counterpart of charmap_rules."""
    texts, place = b"", {}
    for k, v in rules.items():
        place[k.encode()] = len(texts)
        texts += v.encode() + b"\0"
    units, used, bases = {0: 0}, {0}, set()

    def fill(node, prefix):
        below = sorted({k[len(prefix)] for k in place if k.startswith(prefix) and len(k) > len(prefix)})
        labels = ([0] if prefix in place else []) + below
        base = next(b for b in range(1, 100_000) if b not in bases and all(b ^ c not in used for c in labels))
        bases.add(base)
        used.update(base ^ c for c in labels)
        units[node] = units.get(node, 0) | (node ^ base) << 10 | (256 if prefix in place else 0)
        if prefix in place:
            units[base] = 0x80000000 | place[prefix]
        for c in below:
            units[base ^ c] = c
        for c in below:
            fill(base ^ c, prefix + bytes([c]))

    fill(0, b"")
    size = (max(units) + 511) // 256 * 256  # the library wants whole kilobytes
    blob = b"".join(struct.pack("<I", units.get(i, 0)) for i in range(size))
    return struct.pack("<I", len(blob)) + blob + texts


def test_charmap():
    rules = {"ﬁ": "fi", "Ａ": "A", "é": "é", "e": "e", "　": " ", "​": "", "①": "1", "abc": "x"}
    assert spieces.charmap_rules(charsmap(rules)) == rules
    assert spieces.charmap_rules(b"") == {}
    n = spieces.Normalizer(rules)
    text = "  ﬁ　 Ａéabcab​ "
    norm, begin = n.normalize(text)
    assert norm == "▁fi▁Aéxab"
    raw = text.encode()
    at = [int(begin[len(norm[:k].encode())]) for k in range(len(norm) + 1)]  # by character
    assert [raw[a:b].decode() for a, b in zip(at[1:], at[2:])] == ["", "ﬁ", "　 ", "Ａ", "é", "abc", "a", "b​"]
    assert spieces.Normalizer(rules, suffix=True).normalize("a ")[0] == "a▁"
    assert spieces.Normalizer({}, dummy_prefix=False, squeeze=False, escape=False).normalize(" a  ")[0] == " a  "
    assert n.normalize("")[0] == n.normalize("  ")[0] == ""


def with_normalizer(path, rules, squeeze, prefix):
    """The model with another normaliser, as file bytes."""
    blob = charsmap(rules)
    spec = b"\x0a\x04test\x12" + varint(len(blob)) + blob + bytes([0x18, prefix, 0x20, squeeze, 0x28, 1])
    with open(PATH, "rb") as f:
        raw = f.read()
    kept = b"".join(raw[a:b] for field, _, a, b in spieces.proto_fields(raw) if field != 3)
    path.write_bytes(kept + b"\x1a" + varint(len(spec)) + spec)
    return str(path)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


@pytest.mark.parametrize("squeeze,prefix", [(0, 1), (1, 1), (1, 0)])
def test_a_model_with_rules_equals_the_library(tmp_path, squeeze, prefix):
    rules = {"ﬁ": "fi", "é": "e", "é": "e", "　": " ", "日": "day ", "abc": "x", "ab": "ba", "🙂": "", "\n": " "}
    path = with_normalizer(tmp_path / "m.model", rules, squeeze, prefix)
    library, m = sentencepiece.SentencePieceProcessor(model_file=path), spieces.Pieces(path)
    assert m.normalizer.rules == rules and m.normalizer.squeeze == bool(squeeze) and m.by_chunk
    rng = random.Random(squeeze * 2 + prefix)
    texts = TEXTS + ["".join(rng.choices(["ﬁ", "é", "é", "　", "日", "abc", "ab", "a", " ", "🙂", "\n", "word", "the "], k=rng.randint(1, 400))) for _ in range(300)]
    for t in texts:
        ids = library.encode(t)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((library.decode(ids) if ids else "").encode()).hexdigest())
        got, spans = m.digest(t), m.spans(t)
        assert got[:3] == want and [s[0] for s in spans] == ids
        assert got[3] == zlib.crc32(np.array([s[2] for s in spans], "<u4").tobytes())
        ends, raw = [b for _, _, b in spans], t.encode()
        assert ends == sorted(ends)
        proto = library.encode(t, return_type="proto").pieces
        assert [(p.begin, p.end) for p in proto if p.surface and all(ord(c) < 128 for c in t)] == [(a, b) for (_, a, b), p in zip(spans, proto) if p.surface and all(ord(c) < 128 for c in t)]
        assert not ends or ends[-1] <= len(raw)


@pytest.mark.parametrize("column", ["text"])
def test_frames(spark, column):
    rows = [(i, t) for i, t in enumerate(TEXTS[:40])] + [(1, None), (None, "a b")]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, spieces.round_trip(df).collect()), key=str)
    assert [x[:4] for x in got] == sorted([(i, *reference(t or "")[1]) for i, t in rows], key=str)
    enc = spieces.encode(df)
    back = spieces.decode(enc.selectExpr("doc_id", "transform(pieces, x -> x.id) ids"))
    assert sorted(map(str, [(r.doc_id, r.text) for r in back.collect()])) == sorted(map(str, [(i, LIBRARY.decode(LIBRARY.encode(t)) if t else "") for i, t in rows]))
    assert spieces.round_trip(df.limit(0)).count() == 0


def test_texts_go_to_the_library_together(monkeypatch):
    m, calls = spieces.Pieces(PATH), []
    texts = ["", "a b", "lorem ipsum " * 50, "", "日本 é"] * 40 + ["foo bar " * 20_000, " "]
    alone = [m.digest(t) for t in texts]
    for name, of in (("encode", m.merge), ("decode", m.library)):
        monkeypatch.setattr(of, name, lambda x, *a, f=getattr(of, name), n=name, **b: calls.append(n) or f(x, *a, **b))
    assert list(m.digests(texts)) == alone and [a[:3] for a in alone] == [reference(t)[1] for t in texts]
    assert calls.count("encode") == 2 and list(m.digests([])) == []
