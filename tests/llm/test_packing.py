import array
import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b ", "\n\n x\ty ", "don't I'll  we're", "é̀ 日本語 🙂🙂", "a" * 3000, "x<|endoftext|>y", "  z \x1c1", "12 345,6"]


def test_ids_equal_the_tokenizers_library():
    slow, fast, rng = Tokenizer.from_file(PATH), packing.ByteBpe(PATH), random.Random(2)
    assert fast.fast is not None
    texts = ODD + ["".join(rng.choices(" ab\n日'sé1.\t", k=rng.randint(1, 80))) for _ in range(500)]
    for t in texts:
        assert list(array.array("I", fast.encode(t))) == slow.encode(t, add_special_tokens=False).ids


BLANKS = ["\n" * 1_000_000, " " * 1_200_000 + "a", "x" + " \t\u00a0\n" * 50_000 + "\r", "\u3000" * 5000 + "b", "y " + "\n" * 4999 + "c", "a" * 300_000, "!" * 300_000]


@pytest.mark.parametrize("k", range(len(BLANKS)))
def test_long_runs_equal_the_tokenizers_library(k):
    slow, fast = Tokenizer.from_file(PATH), packing.byte_bpe(PATH)
    assert list(array.array("I", fast.encode(BLANKS[k]))) == slow.encode(BLANKS[k], add_special_tokens=False).ids


def test_long_texts_equal_the_tokenizers_library():
    slow, fast, rng = Tokenizer.from_file(PATH), packing.byte_bpe(PATH), random.Random(8)
    for _ in range(30):
        parts = ["word", " the", "  ", "\n" * rng.randint(1, 6000), " " * rng.randint(1, 6000), "日本", "é", "'ll", "123", "?!", "\x1c\x85", "🙂", "\t"]
        t = "".join(rng.choices(parts, k=rng.randint(1, 300)))
        assert list(array.array("I", fast.encode(t))) == slow.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(20))
def test_slots_stay_under_their_bound(seed):
    rng = random.Random(seed)
    capacity = rng.choice([5, 64, 300, 2048])
    h = {n: rng.choice([1, rng.randint(1, 9), rng.randint(1, 10**6)]) for n in range(1, capacity + 1) if rng.random() < rng.choice([1.0, 0.3])}
    assert len(packing.slots(packing.shortest_pack_first(h, capacity))) <= packing.slot_bound(capacity)


@pytest.mark.parametrize("seed", range(8))
def test_patterns_hold_the_histogram(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 2048])
    h = {rng.randint(1, capacity): rng.randint(1, 5000) for _ in range(rng.randint(0, 400))}
    patterns = packing.shortest_pack_first(h, capacity)
    got = defaultdict(int)
    for p, n in patterns:
        assert n > 0 and sum(size * k for size, k in p) <= capacity
        for size, k in p:
            got[size] += k * n
    assert dict(got) == h


def check(rows, packed, capacity):
    slow = Tokenizer.from_file(PATH)
    want = sorted((str(i), array.array("I", [*slow.encode(t or "", add_special_tokens=False).ids, 1]).tobytes()) for i, t in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packed:
        by_doc[(str(r.doc_id), r.doc_tokens)].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, ids in want:
        same = [x for x in want if x[0] == i and len(x[1]) == len(ids)]
        own = by_doc[(i, len(ids) // 4)]
        assert sum(p.length for p in own) == len(ids) // 4 * len(same)
        crcs = {(p.start, p.length): p.ids_crc32 for p in own}
        if len({x[1] for x in same}) == 1:
            for (s, n), crc in crcs.items():
                assert crc == zlib.crc32(ids[4 * s : 4 * (s + n)])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))


@pytest.mark.parametrize("capacity", [16, 64])
def test_pack(spark, capacity):
    rng = random.Random(capacity)
    rows = [(i, " ".join(rng.choices(["alpha", "be", "the", "日本"], k=rng.choice([0, 3, 9, 200])))) for i in range(150)] + [(7, "again"), (None, None), (None, ""), *enumerate(ODD, 900)]
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, length int, part string").repartition(5)
    out = packing.pack(df, capacity=capacity)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(rows, out.collect(), capacity)
    sizes = packing.sequence_sizes(out, capacity)
    assert sizes.filter("used > padded or (used < padded and padded <> %d)" % capacity).count() == 0


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
