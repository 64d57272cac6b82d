"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, bounded_batches, class_weights, numbered, sample_ids, written

SENTENCE, WORD = re.compile(r"[^.!?…。！？\n]+"), re.compile(r"[^\W\d_]+")
STEMS = (3, 4, 5, 6)
CACHE_WORDS = 200_000


def word_features(w: str) -> list[str]:
    """The word itself and its stems, marked by a leading ^."""
    return [w, *["^" + w[:k] for k in STEMS if len(w) > k]]


class _Scores(dict):
    """Word to the sum of its features' weights; keeps up to CACHE_WORDS words."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, w: str) -> float:
        get = self.weights.get
        x = get(w, 0.0)
        for k in STEMS:
            if len(w) > k:
                x += get("^" + w[:k], 0.0)
        if len(self) < CACHE_WORDS:
            self[w] = x
        return x


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -10.0

    def sentences(self, text: str, scores: _Scores | None = None) -> list[tuple[int, int, float]]:
        """(begin, end, logit) of each sentence that has a word, as character offsets in text."""
        score = (scores if scores is not None else _Scores(self.weights)).__getitem__
        out = []
        for m in SENTENCE.finditer(text):
            if words := WORD.findall(m.group().lower()):
                out.append((m.start(), m.end(), self.bias + sum(map(score, words))))
        return out


def noisy_or(logits: list[float]) -> float:
    """1 - prod(1 - p): the chance that at least one sentence is toxic; 0 without sentences."""
    a = sum(x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x)) for x in logits)
    return -math.expm1(-a)


def _divergence(p: np.ndarray, q: float) -> np.ndarray:
    """Of coins that show heads with chance p from one with chance q."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * np.log(p / q), 0.0) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - q)), 0.0)


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, Callable[[int], str]]:
    """(word, feature, name): which word has which feature, as in word_features, ascending by word; name gives a feature's text. Columns, since
    stems of many different words as objects would take most of the driver's memory."""
    column = pa.array(words, pa.string())
    length, n = pc.utf8_length(column).to_numpy(), len(words)
    of_word, of_feature, stems = [np.arange(n)], [np.arange(n)], []
    for k in STEMS:
        rows = np.flatnonzero(length > k)
        coded = pc.utf8_slice_codeunits(column.take(pa.array(rows)), 0, k).dictionary_encode()
        of_word.append(rows)
        of_feature.append(coded.indices.to_numpy().astype(np.int64) + n)
        stems.append((n, coded.dictionary))
        n += len(coded.dictionary)

    def name(f: int) -> str:
        for first, texts in reversed(stems):
            if f >= first:
                return "^" + texts[f - first].as_py()
        return words[f]

    of_word, of_feature = np.concatenate(of_word), np.concatenate(of_feature)
    order = np.argsort(of_word, kind="stable")
    return of_word[order], of_feature[order], name


def _documents_with(doc: np.ndarray, word: np.ndarray, fw: np.ndarray, ff: np.ndarray, y: np.ndarray, at_once: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """In how many documents, and in how many toxic ones, each feature occurs; (doc, word) are the different words of each document, by document."""
    n = int(ff.max()) + 1
    first = np.searchsorted(fw, np.arange(int(fw.max()) + 2))
    holds, toxic_holds, a = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    while a < len(doc):
        b = int(np.searchsorted(doc, doc[min(a + at_once, len(doc)) - 1], "right"))  # whole documents
        size = first[word[a:b] + 1] - first[word[a:b]]
        which = np.repeat(first[word[a:b]] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        pairs = np.unique(np.repeat(doc[a:b].astype(np.int64), size) * n + ff[which])
        holds += np.bincount(pairs % n, minlength=n)
        toxic_holds += np.bincount(pairs[y[pairs // n]] % n, minlength=n)
        a = b
    return holds, toxic_holds


def fit(texts: list[str], toxic: list[int], rounds: int = 80, rate: float = 0.3, ridge: float = 0.1, strictness: float = 0.7, weight: list[float] | None = None) -> Model:
    """Weights by full-batch Adam on the noisy-or likelihood of the document labels.

    A sentence's logit is the bias and the weights of its words' features. A clean document pushes every sentence down; a
    toxic one pushes up the sentences that are already likeliest, which is how the labels find their place. Only features
    are used whose share of toxic documents is above the sample's by more than chance explains among so many features (Chernoff's
    bound on the tail, times strictness); rare words thus can't learn single documents by heart. The same texts give the same model.

    weight: how many labelled documents each text stands for (1 without it). Likelihood, bias and starting share are of weights, so that
    a score means the same at whatever rates the classes were sampled. The choice of features counts texts and compares with their own
    share: whether a feature depends on the label at all doesn't depend on these rates.
    """
    word_id: dict[str, int] = {}
    doc_of, sentence_of, words = (array("i") for _ in range(3))
    pairs_doc, pairs_word = array("i"), array("i")  # the different words of each document
    for d, t in enumerate(texts):
        first = len(words)
        for m in SENTENCE.finditer(t):
            found = WORD.findall(m.group().lower())
            if found:
                words.extend([word_id.setdefault(w, len(word_id)) for w in found])
                sentence_of.extend([len(doc_of)] * len(found))
                doc_of.append(d)
        own = np.unique(np.array(words[first:], np.int32))
        pairs_doc.extend([d] * len(own))
        pairs_word.extend(own.tolist())
    if not doc_of or not 0 < sum(toxic) < len(toxic):
        return Model()
    fw, ff, name = _features(list(word_id))
    y = np.array(toxic, bool)
    holds, toxic_holds = _documents_with(np.frombuffer(pairs_doc, np.int32), np.frombuffer(pairs_word, np.int32), fw, ff, y)
    base, need = float(y.mean()), strictness * math.log(1 + len(holds))
    chosen = np.flatnonzero((toxic_holds > base * holds) & (holds * _divergence(toxic_holds / holds, base) > need))
    place = np.full(len(holds), -1)
    place[chosen] = np.arange(len(chosen))
    fw, ff = fw[place[ff] >= 0], place[ff[place[ff] >= 0]]
    words, sentence_of, doc_of = (np.frombuffer(x, np.int32) for x in (words, sentence_of, doc_of))
    n_docs, n_words, n_features, n_sentences = len(texts), len(word_id), len(chosen), len(doc_of)
    of_doc = np.ones(n_docs) if weight is None else np.array(weight, float) * (n_docs / sum(weight))
    share, per_doc = float(of_doc[y].sum()) / n_docs, float(of_doc[doc_of].sum()) / n_docs
    w, b = np.zeros(n_features), math.log(share / max(1.0, per_doc))
    m1, m2 = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for r in range(1, rounds + 1):
        z = b + np.bincount(sentence_of, np.bincount(fw, w[ff], n_words)[words], n_sentences)
        p, soft = 1 / (1 + np.exp(-np.clip(z, -60, 60))), np.logaddexp(0, z)
        a = np.maximum(np.bincount(doc_of, soft, n_docs), 1e-12)
        push = of_doc * np.where(y, -1 / np.expm1(np.minimum(a, 50.0)), 1.0)
        g = push[doc_of] * p
        grad = np.r_[np.bincount(ff, np.bincount(words, g[sentence_of], n_words)[fw], n_features) + ridge * w, g.sum()] / n_docs
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        step = rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.999**r)) + 1e-7)
        w, b = w - step[:-1], b - step[-1]
    return Model({name(int(chosen[k])): float(round(w[k], 4)) for k in np.flatnonzero(np.abs(w) > 1e-3)}, float(b))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 4; null ids have none."""
    return F.crc32(F.col(doc_id).cast("string")) % 4


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, bytes_each: int = 8_000_000) -> Model:
    """A model from labels (doc_id, toxic) of documents outside fold 2.

    The driver gets at most sample documents of each class, those of smallest hash, and of these, in that order, at most
    bytes_each bytes of text of each class (one document more at most). Each counts with the number of labelled documents of its
    class for one that was taken. Null labels don't count.
    """
    trained = F.crc32(F.col("_id").cast("string")) % 4 != 2
    ids = sample_ids(labels, "toxic", sample, trained)
    rows = docs.select(numbered("doc_id").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(ids), "_id")
    rows = written(rows.groupBy("_id", "_label").agg(F.min("text").alias("text")), "toxicity-sample")  # one row of ids that repeat
    sizes = rows.select("_id", "_label", F.octet_length("text").alias("n"), F.xxhash64("_id").alias("h")).orderBy("h", "_id").limit(4 * sample).collect()
    room, take, seen, taken = {0: bytes_each, 1: bytes_each}, set(), {0: 0, 1: 0}, {0: 0, 1: 0}
    for r in sizes:
        seen[r._label] += 1
        if room[r._label] > 0:
            room[r._label] -= r.n
            take.add(r._id)
            taken[r._label] += 1
    stands_for = {k: x * seen[k] / taken[k] for k, x in class_weights(labels, "toxic", sample, trained).items() if taken[k]}
    got = sorted((r._id, r.text, r._label) for r in rows.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in sorted(take)], "_id long")), "_id").collect())
    return fit([r[1] for r in got], [r[2] for r in got], weight=[stands_for[r[2]] for r in got])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_sentences, worst_begin, worst_end): one row per input row, whole texts.

    worst_*: characters of the likeliest sentence. Texts without words (null, empty) score 0 and have no worst sentence. Null
    ids aren't held out. Ids may repeat.
    """
    bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_sentences", pa.int64()), ("worst_begin", pa.int64()), ("worst_end", pa.int64())])

    def run(batches):
        m = shared.value
        scores = _Scores(m.weights)
        for b in batches:
            out = []
            for i, held, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = m.sentences(t.as_py() or "", scores)
                p = noisy_or([x[2] for x in s])
                worst = max(s, key=lambda x: x[2], default=(None, None))
                out.append((i, held, p, int(p >= threshold), len(s), *worst[:2]))
            yield batch(schema, *(zip(*out) if out else ([],) * 7))

    rows = docs.select(numbered(id_col).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_sentences long, worst_begin long, worst_end long")


def locate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, begin, end, sentence, score): the sentences whose own chance is at least threshold."""
    bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("sentence", pa.string()), ("score", pa.float64())])

    def run(batches):
        m = shared.value
        scores = _Scores(m.weights)
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py() or ""
                out += [(i, a, z, t[a:z], p) for a, z, x in m.sentences(t, scores) if (p := noisy_or([x])) >= threshold]
            yield batch(schema, *(zip(*out) if out else ([],) * 5))

    rows = docs.select(numbered(id_col).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, begin long, end long, sentence string, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without the rows whose score reaches threshold; columns as they are."""
    bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        scores = _Scores(m.weights)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            yield b.filter(pa.array([noisy_or([x[2] for x in m.sentences(t.as_py() or "", scores)]) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
