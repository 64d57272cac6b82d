import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm import graph, simhash


def slow_fingerprint(text):
    words = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["", None, "  \n", "One", "a B", "a b c", "É ÉÉ \x0b x y z", "the cat sat on the mat " * 9])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == slow_fingerprint(text)


def test_fingerprint_equals_sparks_own_hash(spark):
    got = spark.sql("select xxhash64('the cat sat') h").first().h
    assert got & (2**64 - 1) == xxhash.xxh64_intdigest(b"the cat sat", 42)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_brute(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(20)] + [0, 2**64 - 1]
    fps = set(base)
    for b in base:
        for _ in range(30):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 4))))
    for _ in range(700):  # one large posting
        fps.add(base[0] ^ rng.getrandbits(16))
    want = {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= radius}
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    got = [frozenset((r.u & (2**64 - 1), r.v & (2**64 - 1))) for r in simhash.fingerprint_links(df, radius).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_star_forest(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, None), (500, 500)]
    got = {r.u: r.v for r in graph.star_forest(spark.createDataFrame(links, "u long, v long")).collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    want = components({x for e in real for x in e}, real)
    assert got == {n: r for n, r in want.items() if n != r}
    assert graph.star_forest(spark.createDataFrame([], "u long, v long")).count() == 0


def brute(rows):
    fp = [slow_fingerprint(t) for _, t in rows]
    n = range(len(rows))
    c = components(n, [(i, j) for i in n for j in n if i < j and (fp[i] ^ fp[j]).bit_count() <= 2])
    low = defaultdict(list)
    for i in n:
        low[c[i]].append(rows[i][0])
    return sorted((str(rows[i][0]), f"{fp[i]:016x}", str(min([x for x in low[c[i]] if x is not None], default=None))) for i in n)


def test_near_duplicates(spark):
    words = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 200])))) for i in range(60)]
    long = " ".join(rng.choices(words, k=3000))
    rows += [(90, long), (91, long), (92, long + " omega"), (93, None), (None, ""), (None, "only one"), (90, long), (94, "x" * 100_000)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(df).select("doc_id", simhash.hex64("fp").alias("f"), "component_id").collect()
    assert sorted((str(a), b, str(c)) for a, b, c in got) == brute(rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})


def test_names_that_clash(spark):
    names = ["_id", "_h", "_n", "keep_id", "keep_h", "fp", "component_id", "row", "id", "h", "n", "_0", "c", "none"]
    rows = [(1, "a b c d", *names), (2, "a b c d", *names), (3, None, *names), (None, None, *names), (4, "other words here now", *names), (4, "other words here now", *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(df).count() == 0
