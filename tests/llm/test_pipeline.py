import random

import corpus_pipeline
from tessera.llm import quality, simhash, toxicity
from test_suffix import brute_without_words

RNG = random.Random(12)
WORDS = ["".join(RNG.choices("abcdefghij", k=RNG.randint(2, 8))) for _ in range(900)]


def corpus():
    rows, labels = [], []
    passage = " ".join(RNG.choices(WORDS, k=90))
    for i in range(240):
        words = RNG.choices(WORDS, k=RNG.randint(60, 200))
        toxic, bad = i % 8 == 0, i % 8 == 1
        if toxic:
            words[RNG.randrange(len(words))] = "grumbo"
        if bad:
            words = [w + "###" for w in words]
        t = ". ".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
        if i % 10 == 3:
            t = t + " " + passage + " " + " ".join(RNG.choices(WORDS, k=20))
        rows.append((i, t, "en", "s", len(t)))
        if i % 5:
            labels.append((i, int(not bad), int(toxic)))
    clean = [r for r in rows if r[0] % 8 > 1]
    rows += [(1000 + k, *clean[k][1:]) for k in range(20)] + [(2000, None, None, None, None), (2001, "", "en", "s", 0)]
    return rows, labels


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, d = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    lab = spark.read.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "quality rules", "simhash near-dedup", "suffix-array dedup", "packing"]
    key = lambda df: sorted((r.doc_id, r.text) for r in df.collect())

    m = toxicity.train(docs, lab)
    one = stage["toxicity"](spark, docs, d)
    assert key(one) == sorted((i, t) for i, t, *_ in rows if toxicity.noisy_or([x[2] for x in m.sentences(t or "")]) < 0.3)
    assert one.columns == docs.columns
    one.write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))

    two = stage["quality rules"](spark, one, d)
    kept = {r.doc_id for r in quality.judge(one, quality.train(one, lab)).filter("kept").collect()}
    assert key(two) == [x for x in key(one) if x[0] in kept] and two.columns == docs.columns
    assert not any("###" in t for _, t in key(two)) and len(kept) > 150
    two.write.parquet(str(tmp_path / "two"))
    two = spark.read.parquet(str(tmp_path / "two"))

    three = stage["simhash near-dedup"](spark, two, d)
    fp = {i: simhash.fingerprint(t.encode()) for i, t in key(two)}
    low = {i: i for i in fp}
    for _ in fp:
        for i in fp:
            low[i] = min(low[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 2)
        if all(low[low[i]] == low[i] for i in fp):
            break
    assert key(three) == [x for x in key(two) if low[x[0]] == x[0]] and three.columns == docs.columns
    assert not any(1000 <= i < 2000 for i, _ in key(three))
    three.write.parquet(str(tmp_path / "three"))
    three = spark.read.parquet(str(tmp_path / "three"))

    four = stage["suffix-array dedup"](spark, three, d)
    texts = key(three)
    want = list(zip([i for i, _ in texts], brute_without_words([t for _, t in texts], 50)))
    assert key(four) == sorted(want) != key(three) and four.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in four.collect())
    assert four.dtypes == docs.dtypes

    last = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == {i for i, _ in want}
