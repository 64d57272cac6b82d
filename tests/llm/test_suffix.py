import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import suffix


SMALL = suffix.byte_strings(40, 24, (8, 1))
FEW_WORDS = suffix.word_strings(9, 5, (3, 1))


def brute_words(texts, span):
    """For each text which words are covered by a string of span words that starts elsewhere too, and the words' byte ranges."""
    seen, found = {}, []
    for t in texts:
        w = [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0d]+", (t or "").encode())]
        found.append(w)
        for s in range(len(w) - span + 1):
            g = tuple(x[2] for x in w[s : s + span])
            seen[g] = seen.get(g, 0) + 1
    out = []
    for w in found:
        gone = [False] * len(w)
        for s in range(len(w) - span + 1):
            if seen[tuple(x[2] for x in w[s : s + span])] > 1:
                gone[s : s + span] = [True] * span
        out.append((w, gone))
    return out


def brute_without_words(texts, span):
    out = []
    for t, (w, gone) in zip(texts, brute_words(texts, span)):
        raw, cut, k = (t or "").encode(), bytearray(), 0
        last = 0
        while k < len(w):
            if gone[k]:
                e = k
                while e + 1 < len(w) and gone[e + 1]:
                    e += 1
                cut += raw[last : w[k][0]]
                last, k = w[e][1], e
            k += 1
        out.append(None if t is None else (bytes(cut) + raw[last:]).decode())
    return out


def brute(rows, span):
    """rows of (id, text): removal by looking at every string of every text."""
    raw = [(t or "").encode() for _, t in rows]
    seen = {}
    for x in raw:
        for s in range(len(x) - span + 1):
            seen[x[s : s + span]] = seen.get(x[s : s + span], 0) + 1
    out = []
    for (i, _), x in zip(rows, raw):
        gone = np.zeros(len(x) + 1, bool)
        for s in range(len(x) - span + 1):
            if seen[x[s : s + span]] > 1:
                gone[s : s + span] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(x) else 0
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((i, len(x), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    words = [sum(gone) for _, gone in brute_words([t for _, t in rows], 9)]
    return sorted([(*x, n) for x, n in zip(out, words)], key=str)


@pytest.mark.parametrize("seed", range(6))
def test_parse_covers_every_start_once(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choices(b"ab\x00", k=rng.choice([0, 5, 39, 40, 41, 300, 2000]))) for _ in range(20)] + [b"a" * 500]
    raw, grams, ends = suffix.symbols(texts, "byte")
    old, suffix.BLOCK = suffix.BLOCK, 257
    t, lo, hi = suffix.parse(grams, ends, 40, 24)
    suffix.BLOCK = old
    starts = [s for a, b in zip(lo, hi) for s in range(a, b + 1)]
    want = [s for e, x in zip(ends, texts) for s in range(e - len(x), e - 40 + 1)]
    assert starts == want
    place = {}
    for a, b, m in zip(lo, hi, t):
        for s in range(a, b + 1):
            assert 0 <= m - s < 24
            assert place.setdefault(raw[s : s + 40], m - s) == m - s


def test_words_are_known_by_their_bytes():
    rng = random.Random(3)
    texts = [b"", b" \n", b"one", "é\x0bx  \u00a0y ".encode(), bytes(rng.choices(b"ab \t\x00\xff", k=5000)), b"long" * 100 + b" " + b"long" * 99 + b"lonG " + b"long" * 100]
    of = {}
    for t in texts:
        starts, ends, h = suffix.words(t)
        for at_once in (1, 7, 1000):
            assert all(np.array_equal(x, y) for x, y in zip(suffix.words(t, at_once), (starts, ends, h)))
        assert [t[a:b] for a, b in zip(starts, ends)] == re.findall(rb"[^\x20\x09-\x0d]+", t)
        for a, b, x in zip(starts, ends, h.tolist()):
            assert of.setdefault(t[a:b], x) == x
    assert len(set(of.values())) == len(of)
    buffer, _, ends = suffix.symbols(texts, "word")
    assert [b - a for a, b in zip([0, *ends], ends)] == [len(re.findall(rb"[^\x20\x09-\x0d]+", t)) for t in texts] and len(buffer) == 8 * ends[-1]


def make(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(60)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage, rows = text(30), []
    for i in range(40):
        kind = rng.randrange(6)
        t = text(rng.randint(0, 120))
        if kind == 0 and rows:
            t = rng.choice(rows)[1]
        elif kind == 1:
            t = t + passage + text(20)
        elif kind == 2:
            t = passage[rng.randint(0, 60) :] + t
        elif kind == 3 and rows:
            other = rng.choice(rows)[1] or ""
            k = rng.randint(0, len(other))
            t = other[:k] + "#" + other[k:]
        elif kind == 4:
            t = "ab" * rng.randint(0, 90) + t
        rows.append((i, t))
    few = text(8)
    rows += [(2000 + k, text(3) + " " + few + " " + text(3)) for k in range(30)]  # a string that many share, a little too short
    return rows + [(1000, None), (1000, ""), (None, passage), (None, passage), (3, "q" * 300), (1001, "q" * 39), (5, passage + "x"), (5, passage + "x")]


@pytest.mark.parametrize("seed,strides", [(1, (8, 1)), (2, (5, 1)), (3, (1,))])
def test_report_brute(spark, seed, strides):
    rows = make(seed)
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, id string, h int")
    got = suffix.removal_report(df, bytes_of=suffix.byte_strings(40, 24, strides), words_of=suffix.word_strings(9, 5, strides)).collect()
    want = brute(rows, 40)
    assert sorted(map(tuple, got), key=str) == want
    assert any(x[-1] for x in want) and any(x[2] for x in want)


def test_many_entries_of_one_bucket(spark):
    """A string shorter than the span in hundreds of contexts: the rows of each step grow with the entries."""
    rng = random.Random(4)
    rows = [(i, bytes(rng.choices(range(97, 123), k=60)).decode() + "s" * 3 + "hared passage of some length" + bytes(rng.choices(range(97, 123), k=60)).decode()) for i in range(400)]
    rows += [(1000 + i, rows[i][1][30:110] + str(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix.removal_report(df, bytes_of=SMALL, words_of=FEW_WORDS).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 40)


def test_texts_with_null_ids_are_told_apart(spark):
    """Two texts without an id whose 64-bit hashes agree in their low 31 bits: only the one that a third row holds goes."""
    def texts(n):
        return spark.range(n).selectExpr("concat(repeat(cast(sha2(cast(id as string), 256) as string), 7)) as t")

    pairs = texts(150_000).selectExpr("t", "xxhash64(cast(t as binary)) & 2147483647 as h").groupBy("h").agg({"t": "collect_list"}).toDF("h", "t").filter("size(t) > 1")
    a, b = pairs.first().t[:2]
    df = spark.createDataFrame([(None, a), (None, b), (1, a)], "doc_id long, text string")
    got = {(r.doc_id, r.kept_sha256): r.n_removed for r in suffix.removal_report(df, words_of=FEW_WORDS).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert got == {(None, none): 448, (1, none): 448, (None, hashlib.sha256(b.encode()).hexdigest()): 0}


@pytest.mark.parametrize("of", [SMALL, FEW_WORDS])
def test_remove_keeps_rows_and_columns(spark, of):
    rows = make(7)
    names = ["_null_text", "h1", "h2", "r", "z", "wants", "want", "rest", "spans", "_0", "_1", "u"]
    df = spark.createDataFrame([(*[c] * 5, i, t, *[c] * 7) for c in ["v"] for i, t in rows], ", ".join(f"{c} string" for c in names[:5]) + ", doc_id long, text string, " + ", ".join(f"{c} string" for c in names[5:]))
    out = suffix.remove_repeats(df, of=of)
    assert out.columns == df.columns and out.count() == len(rows)
    got = sorted((r.doc_id, r.text) for r in out.filter("doc_id is not null").collect() if r.text is not None)
    assert all(r[c] == "v" for r in out.collect() for c in names)
    if of is FEW_WORDS:
        want = zip(rows, brute_without_words([t for _, t in rows], 9))
        assert got == sorted((i, t) for (i, _), t in want if i is not None and t is not None)


def test_long_text_and_other_ids(spark):
    rng = random.Random(9)
    long = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40_000))
    rows = [("a", long), ("b", long[100_000:100_500]), ("b", None), (None, "w" * 1_000_000)]
    got = suffix.removal_report(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert all(r.doc_id is None for r in got)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(0, 0, 0), (500, 500, 1), (239_999, 500, 1), (1_000_000, 1_000_000, 1)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.removal_report(df).count() == 0
    assert suffix.remove_repeats(df).count() == 0
