"""URL filters: host and path rules, and gradient-boosted trees on lexical features, all in DataFrame functions."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, sample_ids

LOG = logging.getLogger(__name__)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """Fits a host and all its subdomains, where the url's path starts with the rule's."""

    pattern: str
    verdict: str

    def fits(self, h: Column, p: Column) -> Column:
        name, slash, rest = self.pattern.partition("/")
        return ((h == name) | h.endswith("." + name)) & p.startswith(slash + rest)


def rule(h: Column, p: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(pattern, verdict) of the longest rule that fits, null where none does."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        which, verdict = F.when(r.fits(h, p), F.lit(r.pattern)).otherwise(which), F.when(r.fits(h, p), F.lit(r.verdict)).otherwise(verdict)
    return which, verdict


def _entropy(s: Column) -> Column:
    """Bits per character; 0 for an empty string."""

    def bits(chars):
        n = F.char_length(s).cast("double")
        each = F.transform(F.array_distinct(chars), lambda c: (F.char_length(s) - F.char_length(F.replace(s, c, F.lit("")))) / n)
        return F.aggregate(each, F.lit(0.0), lambda a, x: a - x * F.log2(x))

    return F.when(s == "", F.lit(0.0)).otherwise(let(F.split(s, ""), bits))


def lexical(url: Column, h: Column, p: Column) -> dict[str, Column]:
    """Features of a url's spelling; the url null counts as empty. All doubles."""
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    suffix = F.substring_index(h, ".", -1)
    size = F.greatest(F.char_length(u), F.lit(1)).cast("double")

    def count(s: Column, c: str) -> Column:
        return F.char_length(s) - F.char_length(F.replace(s, F.lit(c), F.lit("")))

    out = {
        "length": F.char_length(u),
        "host_length": F.char_length(h),
        "path_length": F.char_length(p),
        "depth": count(p, "/"),
        "digit_ratio": F.char_length(F.regexp_replace(u, r"[^0-9]+", "")) / size,
        "entropy": _entropy(u),
        "host_entropy": _entropy(h),
        "parameters": F.when(query == "", F.lit(0)).otherwise(count(query, "&") + 1),
        "fragment": u.contains("#"),
        "hyphens": count(h, "-"),
        "labels": F.when(h == "", F.lit(0)).otherwise(count(h, ".") + 1),
        "suffix_length": F.char_length(suffix),
        "secure": u.startswith("https:"),
    }
    return {k: c.cast("double") for k, c in out.items()}


@dataclass
class Trees:
    """A boosted sum: start plus the leaves of trees. A tree is a leaf's value or (feature, threshold, left, right); suffixes: bad share by suffix."""

    start: float = -math.inf
    trees: list = field(default_factory=list)
    suffixes: dict[str, float] = field(default_factory=dict)
    other: float = 0.0

    def suffix_share(self, h: Column) -> Column:
        suffix, out = F.substring_index(h, ".", -1), F.lit(self.other)
        for s, share in sorted(self.suffixes.items()):
            out = F.when(suffix == s, F.lit(share)).otherwise(out)
        return out

    def chance(self) -> Column:
        """The chance that a url is bad, over columns named as the features."""
        if not math.isfinite(self.start):
            return F.lit(0.0)

        def of(t):
            return F.lit(t) if isinstance(t, float) else F.when(F.col(t[0]) < t[1], of(t[2])).otherwise(of(t[3]))

        z = F.lit(self.start)
        for t in self.trees:
            z = z + of(t)
        return 1 / (1 + F.exp(-z))


def boost(x: dict[str, np.ndarray], bad: np.ndarray, rounds: int = 15, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 20, ridge: float = 1.0, gain: float = 4.0) -> tuple[float, list]:
    """Trees by Newton steps on the logistic loss, over histograms of quantile bins.

    A split needs least rows on each side and a gain in loss; a tree without a split ends the growth, so labels that the features don't
    explain give no trees.
    """
    n, names = len(bad), sorted(x)
    share = float(np.clip(bad.mean(), 1e-4, 1 - 1e-4)) if n else 0.0
    if not n:
        return -math.inf, []
    start = math.log(share / (1 - share))
    edges = {f: np.unique(np.quantile(x[f], np.linspace(0, 1, bins + 1)[1:-1])) for f in names}
    binned = {f: np.searchsorted(edges[f], x[f], "right") for f in names}
    z, trees = np.full(n, start), []

    def leaf(g, h, on):
        return round(float(-rate * g[on].sum() / (h[on].sum() + ridge)), 6)

    def grow(on, g, h, level):
        total_g, total_h, best = g[on].sum(), h[on].sum(), (gain, None)
        if level < depth and len(on) >= 2 * least:
            for f in names:
                b, size = binned[f][on], len(edges[f]) + 1
                gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[on], h[on], np.ones(len(on))))
                ok = (nl >= least) & (len(on) - nl >= least)
                value = np.where(ok, gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge), -1.0) / 2
                if len(value) and value.max() > best[0]:
                    best = (float(value.max()), (f, int(value.argmax())))
        if best[1] is None:
            return leaf(g, h, on)
        f, k = best[1]
        left = binned[f][on] <= k
        return (f, float(edges[f][k]), grow(on[left], g, h, level + 1), grow(on[~left], g, h, level + 1))

    def apply(t, on, out):
        if isinstance(t, float):
            out[on] += t
        else:
            left = x[t[0]][on] < t[1]
            apply(t[2], on[left], out)
            apply(t[3], on[~left], out)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        t = grow(np.arange(n), p - bad, p * (1 - p), 0)
        if isinstance(t, float):
            break
        trees.append(t)
        apply(t, np.arange(n), z)
    return start, trees


def train(urls: DataFrame, sample: int = 10_000, suffixes: int = 64) -> Trees:
    """Trees from labelled urls (url, bad). At most 2 * sample rows reach the driver, as numbers, those of the smallest hash; nulls don't count.

    Suffix statistics: the smoothed bad share of each of the sample's commonest suffixes is a feature of its own.
    """
    rows = urls.filter("bad is not null").select("url", F.col("bad").cast("int").alias("bad")).orderBy(F.xxhash64("url"), "url", "bad").limit(2 * sample)
    rows = rows.select("url", "bad", host(F.col("url")).alias("h"), path(F.col("url")).alias("p"))
    features = lexical(F.col("url"), F.col("h"), F.col("p"))
    got = sorted(map(tuple, rows.select(F.substring_index("h", ".", -1).alias("suffix"), "bad", *[c.alias(f) for f, c in features.items()]).collect()))
    if not got:
        return Trees()
    bad = np.array([r[1] != 0 for r in got], bool)
    share, tally = float(bad.mean()), {}
    for s, y in zip((r[0] for r in got), bad):
        n = tally.setdefault(s, [0, 0])
        n[0] += 1
        n[1] += int(y)
    common = sorted(tally, key=lambda s: (-tally[s][0], s))[:suffixes]
    shares = {s: round((tally[s][1] + 20 * share) / (tally[s][0] + 20), 6) for s in common}
    x = {f: np.array([r[2 + k] for r in got], float) for k, f in enumerate(features)}
    x["suffix_share"] = np.array([shares.get(r[0], share) for r in got])
    start, trees = boost(x, bad)
    if not trees:
        LOG.warning("no split of %d labelled urls explains their labels: every url without a rule has the same chance, %.3f", len(bad), share)
    return Trees(start, trees, shares, share)


def labelled(pages: DataFrame, labels: DataFrame, sample: int = 10_000) -> DataFrame:
    """(url, bad) of the pages whose path's first number is the id of a labelled document: bad if that document's quality is 0 or it's toxic.

    At most 2 * sample documents are looked up, sampled over both classes together: the bad share, and with it what a chance
    means, doesn't depend on the number of labels.
    """
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(1)).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), F.lit(0))
    ids = sample_ids(labels.select("doc_id", bad.alias("bad")), "bad", sample, together=True)
    number = F.expr("try_cast(nullif(regexp_extract(_path, '/([0-9]+)', 1), '') as bigint)")
    urls = pages.select("url", path(F.col("url")).alias("_path")).select("url", number.alias("_id"))
    return urls.join(F.broadcast(ids), "_id").select("url", F.col("_label").alias("bad"))


def judge(pages: DataFrame, rules: list[Rule], model: Trees, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, chance, n_trees): one row per input row. n_trees: how many trees the model has; without any,
    chance is the bad share of the labelled urls for every url. The longest rule that fits decides; elsewhere the
    trees block from a chance of threshold on. Null urls and urls without :// have an empty host and path, and no rule fits them."""
    u = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    u = u.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    h, p = F.col("host"), F.col("path")
    which, ruled = rule(h, p, rules)
    u = u.select("page_id", "host", "path", which.alias("rule"), ruled.alias("ruled"), model.suffix_share(h).alias("suffix_share"), *[c.alias(f) for f, c in lexical(F.col("url"), h, p).items()])
    u = u.withColumn("chance", F.round(model.chance(), 9))
    verdict = F.coalesce("ruled", F.when(F.col("chance") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return u.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "chance", F.lit(len(model.trees)).alias("n_trees"))
