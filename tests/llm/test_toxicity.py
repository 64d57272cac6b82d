import math
import random
import zlib

import pytest

from tessera.llm import toxicity as T

RNG = random.Random(6)
PLAIN = ["".join(RNG.choices("abcdefgh", k=RNG.randint(2, 7))) for _ in range(400)]
INSULTS = ["grumbo", "snark", "yikkel"]


def text(sentences, toxic):
    out = [" ".join(RNG.choices(PLAIN, k=RNG.randint(3, 12))) for _ in range(sentences)]
    if toxic:
        k = RNG.randrange(sentences)
        out[k] += " " + RNG.choice(INSULTS) + RNG.choice(["", "ung", "s"])
    return ". ".join(out) + "."


def test_noisy_or():
    assert T.noisy_or([]) == 0.0
    for z in ([0.0], [-3.0, 2.0], [-40.0] * 3, [800.0, -800.0]):
        direct = 1 - math.prod(1 - 1 / (1 + math.exp(-max(-700, min(700, x)))) for x in z)
        assert T.noisy_or(z) == pytest.approx(direct, abs=1e-9)


def test_gradient_finds_the_sentence():
    y = [int(RNG.random() < 0.3) for _ in range(900)]
    texts = [text(RNG.randint(1, 12), t) for t in y]
    m = T.fit(texts[:700], y[:700])
    right = 0
    for t, label in zip(texts[700:], y[700:]):
        s = m.sentences(t)
        right += (T.noisy_or([x[2] for x in s]) >= 0.3) == bool(label)
        if label:
            a, b, _ = max(s, key=lambda x: x[2])
            assert any(w in t[a:b] for w in INSULTS)
    assert right / 200 > 0.97
    assert T.fit(texts[:700], y[:700]) == m
    assert T.fit([], []).weights == {} and T.fit(["a"], [1]).weights == {}


def test_frames(spark):
    rows = [(i, text(RNG.randint(1, 9), int(i % 4 == 0)), int(i % 4 == 0)) for i in range(800)]
    odd = [(9001, None), (9002, ""), (None, "x grumbo"), (9003, "12 34 !!"), (9004, "fine " * 60_000), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(i, t, "s") for i, t in odd], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(5, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    m = T.train(docs, labels)
    got = T.score(docs, m)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows) + len(odd)
    truth, right = {i: y for i, _, y in rows}, 0
    for r in got.collect():
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
        if r.doc_id in (9001, 9002, 9003):
            assert r.score == 0 and r.worst_begin is None
        if r.held_out and r.doc_id in truth:
            right += r.predicted == truth[r.doc_id]
    assert right >= 0.95 * sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in truth)
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    assert T.train(docs, flipped) == m  # held-out labels are never seen
    kept = T.keep_clean(docs, m)
    assert kept.columns == docs.columns and kept.count() == got.filter("predicted = 0").count()
    found = T.locate(docs, m).filter("doc_id < 800").collect()
    assert found and all(any(w in r.sentence for w in INSULTS) for r in found)
    assert T.score(docs.limit(0), T.train(docs.limit(0), labels)).count() == 0


def test_weights_undo_the_sampling():
    """Every 10th document is toxic. Half of the clean ones' hints are weak, so the prior decides: a weighted even sample has to give the whole table's bias."""
    rng = random.Random(9)
    y = [int(i % 10 == 0) for i in range(6000)]
    texts = [" ".join(rng.choices(PLAIN, k=8) + ["hint"] * (rng.random() < (0.6 if t else 0.05))) for t in y]
    whole = T.fit(texts, y)
    some = [i for i, t in enumerate(y) if t or i % 90 < 10]  # all toxic documents, one clean one of 9
    share = [1.0 if y[i] else (len(y) - sum(y)) / (len(some) - sum(y)) for i in some]
    even, weighted = T.fit([texts[i] for i in some], [y[i] for i in some]), T.fit([texts[i] for i in some], [y[i] for i in some], weight=share)
    assert even.bias - whole.bias > 1 and abs(weighted.bias - whole.bias) < 0.35
    assert T.fit(texts, y, weight=[4.0] * len(y)).bias == pytest.approx(whole.bias, abs=1e-6)


def test_full_samples_keep_the_prior(spark):
    """One document of 10 is toxic; samples and bytes that hold only part of the labels give about the same chance to a text without any evidence."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(PLAIN, k=8) + ["grumbo"] * (i % 10 == 0 and rng.random() < 0.6)), int(i % 10 == 0)) for i in range(4000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    whole = T.train(docs, labels)
    for m in (T.train(docs, labels, sample=250), T.train(docs, labels, bytes_each=12_000)):
        assert abs(m.bias - whole.bias) < 0.6


def slow_fit(texts, toxic, rounds, rate, ridge, strictness, weight):
    """The training in plain loops over documents, sentences and words."""
    sentences = [[w for w in ([x.lower() for x in T.WORD.findall(s)] for s in T.SENTENCE.findall(t)) if w] for t in texts]
    features = lambda w: [w, *("^" + w[:k] for k in (3, 4, 5, 6) if len(w) > k)]
    seen = [{f for s in d for w in s for f in features(w)} for d in sentences]
    every, share = {f for x in seen for f in x}, sum(toxic) / len(toxic)
    chosen = {}
    for f in every:
        n = sum(f in x for x in seen)
        p = sum(f in x and y for x, y in zip(seen, toxic)) / n
        if p > share:
            tail = p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0)
            if n * tail > strictness * math.log(1 + len(every)):
                chosen[f] = 0.0
    scale = len(texts) / sum(weight)
    u = [x * scale for x in weight]
    b = math.log(sum(x for x, y in zip(u, toxic) if y) / len(texts) / max(1.0, sum(x * len(d) for x, d in zip(u, sentences)) / len(texts)))
    names = [*chosen, None]
    m1, m2 = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
    for r in range(1, rounds + 1):
        grad = {f: ridge * chosen[f] for f in chosen} | {None: 0.0}
        for d, y, x in zip(sentences, toxic, u):
            z = [b + sum(chosen.get(f, 0.0) for w in s for f in features(w)) for s in d]
            a = sum(math.log1p(math.exp(v)) for v in z)
            push = x * (-1 / math.expm1(a) if y else 1.0) if d else 0.0
            for s, v in zip(d, z):
                g = push / (1 + math.exp(-v))
                grad[None] += g
                for w in s:
                    for f in features(w):
                        if f in chosen:
                            grad[f] += g
        for f in names:
            g = grad[f] / len(texts)
            m1[f], m2[f] = 0.9 * m1[f] + 0.1 * g, 0.999 * m2[f] + 0.001 * g * g
            step = rate * (m1[f] / (1 - 0.9**r)) / (math.sqrt(m2[f] / (1 - 0.999**r)) + 1e-7)
            if f is None:
                b -= step
            else:
                chosen[f] -= step
    return chosen, b


@pytest.mark.parametrize("heavy", [1.0, 3.5])
def test_training_equals_plain_loops(heavy):
    rng = random.Random(11)
    toxic = [int(rng.random() < 0.3) for _ in range(160)]
    texts = [text(rng.randint(1, 5), t) for t in toxic]
    weight = [1.0 if t else heavy for t in toxic]
    m = T.fit(texts, toxic, rounds=7, weight=weight)
    want, bias = slow_fit(texts, toxic, 7, 0.3, 0.1, 0.7, weight)
    assert m.bias == pytest.approx(bias, abs=1e-9) and len(want) > 3
    assert m.weights == {f: pytest.approx(w, abs=1e-4) for f, w in want.items() if abs(w) > 1e-3}
