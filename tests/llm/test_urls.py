import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import urls as U
from tessera.llm.queries import URL_RULES

RNG = random.Random(2)
ODD = [
    None, "", "no scheme", "http://", "https://WWW.Example.COM/en/x", "https://example.com/en/", "https://a.example.com/en/1?q#f", "https://example.com/EN/", "http://x.net/fr/a", "http://net/es/", "http://x.net/fr",
    "ftp://b.com", "ftp://b.com?x/en/", "http://notcom/a", "a://b://c.net/es/?", "http://É.COM/é#a?b", "http://h.org:80/p/?a=1&b=2#z", "http://u@com/x", "https://mwww.example.com/en/y", "https://q.www.example.com/en/y", "http://a.com\n/x?\ny",
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    h = re.split("[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in h), re.split("[?#]", rest[len(h) :], maxsplit=1)[0]


def longest(h, p):
    best = None
    for r in URL_RULES:
        name, rest = r.pattern.split("/", 1)
        if (h == name or h.endswith("." + name)) and p.startswith("/" + rest) and (best is None or len(r.pattern) > len(best.pattern)):
            best = r
    return best


def test_rules_brute(spark):
    made = [f"{RNG.choice(['http', 'https'])}://{RNG.choice(['', 'www.', 'a.b.', 'm.'])}{RNG.choice(['example.com', 'example.net', 'net', 'com', 'x.org'])}{RNG.choice(['', '/', '/en/', '/es/', '/fr/9', '?a', '#b', '/enx'])}" for _ in range(300)]
    rows = list(enumerate(ODD + made))
    df = spark.createDataFrame([(i, u, "r", "v") for i, u in rows], "page_id long, url string, rule string, host string")
    out = U.judge(df, URL_RULES, U.Trees())
    assert out.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    got = {r.page_id: r for r in out.collect()}
    for i, u in rows:
        h, p = split(u)
        best = longest(h, p)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (h, p, best and best.pattern, best.verdict if best else "allow"), u
    assert U.judge(df.limit(0), URL_RULES, U.Trees()).count() == 0


def make(n):
    rows = []
    for i in range(n):
        bad = RNG.random() < 0.4
        digits = "".join(RNG.choices("0123456789", k=RNG.randint(6, 14))) if bad else ""
        rows.append((i, f"https://site{RNG.choice('abc')}.{RNG.choice(['zip', 'org'] if bad else ['org', 'org', 'edu'])}/{RNG.choice(['news', 'blog'])}/{digits}{'-'.join(RNG.choices(['cat', 'dog', 'tree'], k=2))}", int(bad)))
    return rows


def test_trees_learn(spark):
    rows = make(1500)
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    model = U.train(df.filter("page_id < 1000"))
    assert model.trees and model == U.train(df.filter("page_id < 1000").repartition(7))
    out = U.judge(df.filter("page_id >= 1000"), [], model)
    right = sum((r.verdict == "block") == bool(rows[r.page_id][2]) for r in out.collect())
    assert right > 470
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_trees_equal_their_expression(spark):
    rng = np.random.default_rng(3)
    x = {f: rng.random(800) for f in ("a", "b")}
    bad = (x["a"] > 0.5) & (x["b"] > 0.3)
    start, trees = U.boost(x, bad)

    def value(t, i):
        return t if isinstance(t, float) else value(t[2] if x[t[0]][i] < t[1] else t[3], i)

    want = [1 / (1 + np.exp(-(start + sum(value(t, i) for t in trees)))) for i in range(800)]
    df = spark.createDataFrame([(i, float(x["a"][i]), float(x["b"][i])) for i in range(800)], "i long, a double, b double")
    got = {r.i: r.p for r in df.select("i", U.Trees(start, trees).chance().alias("p")).collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(800))
    assert ((np.array(want) > 0.5) == bad).mean() > 0.9
    assert U.boost(x, rng.random(800) < 0.2)[1] == [] or len(U.boost(x, rng.random(800) < 0.2)[1]) < 15
    assert U.boost({}, np.zeros(0, bool)) == (-np.inf, [])


def slow_boost(x, bad, rounds, depth, rate, bins, least, ridge, gain):
    """The trees in plain loops: every split of every feature by summing rows."""
    n, names = len(bad), sorted(x)
    start = math.log(bad.mean() / (1 - bad.mean()))
    edges = {f: np.unique(np.quantile(x[f], np.linspace(0, 1, bins + 1)[1:-1])) for f in names}
    z, trees = [start] * n, []

    def grow(rows, g, h, level):
        side = lambda s: sum(g[i] for i in s) ** 2 / (sum(h[i] for i in s) + ridge)
        best = (gain, None)
        if level < depth and len(rows) >= 2 * least:
            for f in names:
                for e in edges[f]:
                    a, b = [i for i in rows if x[f][i] < e], [i for i in rows if x[f][i] >= e]
                    if len(a) >= least and len(b) >= least and (side(a) + side(b) - side(rows)) / 2 > best[0] + 1e-9:
                        best = ((side(a) + side(b) - side(rows)) / 2, (f, float(e), a, b))
        if best[1] is None:
            return round(-rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + ridge), 6)
        f, e, a, b = best[1]
        return (f, e, grow(a, g, h, level + 1), grow(b, g, h, level + 1))

    def value(t, i):
        return t if isinstance(t, float) else value(t[2] if x[t[0]][i] < t[1] else t[3], i)

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-v)) for v in z]
        t = grow(list(range(n)), [a - float(y) for a, y in zip(p, bad)], [a * (1 - a) for a in p], 0)
        if isinstance(t, float):
            break
        trees.append(t)
        z = [v + value(t, i) for i, v in enumerate(z)]
    return start, trees


@pytest.mark.parametrize("seed", range(3))
def test_boosting_equals_plain_loops(seed):
    rng = np.random.default_rng(seed)
    x = {f: np.round(rng.random(150), 2) for f in ("a", "b", "c")}
    bad = ((x["a"] > 0.5) & (x["b"] > 0.3)) ^ (rng.random(150) < 0.1)
    how = {"rounds": 3, "depth": 2, "rate": 0.3, "bins": 8, "least": 10, "ridge": 1.0, "gain": 1.0}
    start, trees = U.boost(x, bad, **how)
    want_start, want = slow_boost(x, bad, **how)
    assert start == pytest.approx(want_start) and len(trees) == len(want) > 0

    def same(a, b):
        return a == pytest.approx(b, abs=1e-5) if isinstance(a, float) else a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])

    assert all(map(same, trees, want))


def test_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.org/en/5?x"), (2, "http://a.org/en/6"), (3, None), (4, "http://a.org/en/7"), (5, "http://a.org/99999999999999999999")], "page_id long, url string")
    labels = spark.createDataFrame([(5, 0, 0), (6, 1, 0), (6, 1, None), (7, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, U.labelled(pages, labels).collect())) == [("http://a.org/en/5?x", 1), ("http://a.org/en/6", 0)]
    assert U.train(U.labelled(pages, labels.limit(0))) == U.Trees()


def test_share_of_a_full_sample(spark):
    """1 of 10 is bad; a sample that holds only part of the labels has to keep this share, and so has the fitted start."""
    pages = spark.range(4000).selectExpr("id as page_id", "concat('http://a.org/en/', id) as url")
    labels = spark.range(4000).selectExpr("id as doc_id", "case when id % 10 = 0 then 0 else 1 end as quality", "0 as toxic")
    rows = U.labelled(pages, labels, sample=200)
    bad = [r.bad for r in rows.collect()]
    assert len(bad) == 400 and 0.05 < sum(bad) / 400 < 0.15
    assert U.train(rows).start < -1.5
    assert U.judge(pages, [], U.train(rows)).filter("verdict = 'block'").count() == 0


def test_features(spark):
    row = spark.createDataFrame([("https://a-b.x.com/p/q1?r=1&s=2#f",)], "url string")
    u = F.col("url")
    got = row.select(*[c.alias(k) for k, c in U.lexical(u, U.host(u), U.path(u)).items()]).first()
    assert (got.length, got.depth, got.parameters, got.fragment, got.hyphens, got["labels"], got.suffix_length, got.secure) == (32, 2, 2, 1, 1, 3, 3, 1)
    s = "https://a-b.x.com/p/q1?r=1&s=2#f"
    assert got.entropy == pytest.approx(-sum(s.count(c) / 32 * np.log2(s.count(c) / 32) for c in set(s)))
