"""Quality rules: text statistics in DataFrame functions, and decision lists learned from labelled statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import class_weights, let, numbered, sample_ids

#: What separates words, and the characters that count as symbols.
BLANKS, SYMBOLS = r"\x20\x09-\x0D", "#*$%&|<>"
#: What a decision list may ask for, each from the counts of one text. Null without words: a share that a list asks for twice is computed
#: before the tests around it, also for rows that they leave out, and in ANSI mode a division by zero is an error.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "word_length": "word_chars / nullif(n_words, 0)",
    "symbols_per_word": "n_symbols / nullif(n_words, 0)",
    "dup_lines_per_word": "n_dup_lines / nullif(n_words, 0)",
    "repeat_share": "n_repeat_words / nullif(n_words, 0)",
}


def _covered(hashes: Column, width: int) -> Column:
    """How many places the windows cover whose hash occurs more than once; hashes in order of place, width places each."""

    def twice(s):  # s: (hash, place), sorted
        return F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))

    def cover(p):  # p: places of repeated windows, ascending
        steps = F.transform(p, lambda a, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - a, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda x, y: x + y)

    def places(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(F.sort_array(F.transform(let(pairs, twice), lambda e: e["i"])), cover)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(places(h)))


def statistics(text: Column, window: int = 3) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (bigint) of a text; null counts as empty: all zero.

    Every sub-result is bound once by a lambda; repeated windows are found by sorting their 64-bit hashes, so the work grows
    as n log n with a text's words.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))

    def grams(w):
        return F.when(F.size(w) < window, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)])))

    def all_of(w):
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _covered(grams(w), window).cast("long").alias("n_repeat_words"),
        )

    return let(F.array_remove(F.split(t, f"[{BLANKS}]+"), ""), all_of)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.above else '<'} {self.threshold!r}D"


Rule = tuple[Test, ...]


def holds(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for t in rule:
        out &= t.holds(x)
    return out


def _best_test(x: dict[str, np.ndarray], bad: np.ndarray, on: np.ndarray, weight: np.ndarray) -> tuple[float, Test | None]:
    """The threshold that gains most (FOIL's gain) among the rows that the rule so far covers."""
    p0, n0 = float(weight[bad & on].sum()), float(weight[~bad & on].sum())
    before, best = math.log2(p0 / (p0 + n0)), (0.0, None)
    for name in sorted(x):
        v = x[name][on]
        order = np.argsort(v, kind="stable")
        v, y, u = v[order], bad[on][order], weight[on][order]
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cut):
            continue
        p, q = np.cumsum(u * y)[cut - 1], np.cumsum(u * ~y)[cut - 1]
        middle = (v[cut - 1] + v[cut]) / 2
        for above in (False, True):
            pos = p0 - p if above else p
            neg = np.maximum(n0 - q, 0.0) if above else q
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pos > 0, pos * (np.log2(pos / (pos + neg)) - before), -1.0)
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), Test(name, above, float(middle[k])))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, rules: int = 8, tests: int = 4, precision: float = 0.9, least: int = 10, weight: np.ndarray | None = None) -> list[Rule]:
    """An ordered list of rules for bad rows by sequential covering.

    weight: how many labelled rows each row stands for (1 without it). Gain, worth and precision are of weights, so they are those of all
    labels even where the classes were sampled at different rates; least counts rows.

    Each rule is grown test by test on two thirds of the rows left until it covers no good row, then its last tests are cut
    off while that doesn't worsen (p - n) / (p + n) on the other third. It joins the list if it covers least bad rows, at a
    precision of at least precision on the whole sample left and on the third; what it covers is taken out. The rows of each
    split are chosen by their place, so the result doesn't depend on chance.
    """
    n, out = len(bad), []
    weight = np.ones(n) if weight is None else weight
    left = np.ones(n, bool)
    grow = np.arange(n) % 3 != 2
    while len(out) < rules and (bad & left).sum() >= least:
        rule: Rule = ()
        on = grow & left
        while len(rule) < tests and (bad & on).any() and (~bad & on).any():
            _, t = _best_test(x, bad, on, weight)
            if t is None:
                break
            rule = (*rule, t)
            on = on & t.holds(x)

        def worth(r: Rule) -> float:
            c = holds(r, x, n) & left & ~grow
            p, q = float(weight[bad & c].sum()), float(weight[~bad & c].sum())
            return (p - q) / (p + q) if p + q else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())
        c = holds(rule, x, n) & left
        p, q = float(weight[bad & c].sum()), float(weight[~bad & c].sum())
        if not rule or int((bad & c).sum()) < least or p < precision * (p + q) or worth(rule) < 2 * precision - 1:
            break
        out.append(rule)
        left &= ~c
    return out


def verdict(rules: list[Rule]) -> Column:
    """The rules as an ordered conditional expression over the counts: false at the first rule that holds, else true."""
    if not rules:
        return F.lit(True)
    out = F
    for r in rules:
        out = out.when(F.expr(" and ".join(f"({t.sql()})" for t in r)), F.lit(False))
    return out.otherwise(F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = 10_000) -> list[Rule]:
    """Rules from labels (doc_id, quality): 0 is bad. At most sample labelled documents of each class, those of smallest hash, reach the driver,
    as five numbers each; each counts with the number of labels of its class for one that was sampled. Labels that are null, or of documents that aren't there, don't count; without labels there are no rules."""
    ids = sample_ids(labels, "quality", sample)
    rows = docs.select(numbered("doc_id").alias("_id"), "text").join(F.broadcast(ids), "_id")
    rows = rows.select("_id", "_label", statistics(F.col("text")).alias("s")).select("_id", "_label", "s.*").filter("n_words > 0")
    rows = rows.select("_id", "_label", *[F.expr(e).alias(f) for f, e in FEATURES.items()])
    got = sorted(map(tuple, rows.limit(4 * sample).collect()))
    x = {f: np.array([r[2 + k] for r in got], float) for k, f in enumerate(FEATURES)}
    stands_for = class_weights(labels, "quality", sample)
    return learn(x, np.array([r[1] == 0 for r in got], bool), weight=np.array([stands_for[r[1]] for r in got], float))


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept): one row per input row.

    Null texts have no words and fail; ids may be null or repeated.
    """
    counts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), statistics(F.col(f"`{text_col}`")).alias("s")).select("doc_id", "s.*")
    failed = counts.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    return failed.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """docs without the rows that judge() rejects; columns as they are."""
    s = "_quality_counts"
    kept = docs.withColumn(s, statistics(F.col(f"`{text_col}`")))
    named = kept.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(docs.columns)], f"{s}.*")
    passed = named.filter(~F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words") & verdict(rules))
    return passed.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)])
