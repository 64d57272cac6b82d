"""Aggregations that the DataFrame API lacks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregator:
    """A typed aggregation: a buffer starts as zero(), reduce(buffer, frame) takes rows in, merge joins two buffers, finish gives the result."""

    zero: Callable[[], object]
    reduce: Callable[[object, pd.DataFrame], object]
    merge: Callable[[object, object], object]
    finish: Callable[[object], object]


def typed_aggregate(df: DataFrame, keys: Sequence[str], columns: Sequence[str], how: Aggregator, result: str, most_keys: int = 100_000) -> DataFrame:
    """(keys..., result): result is a column's name and type. Null keys are a group.

    Every task reduces its own rows to one buffer a key (and hands its buffers on when it holds most_keys of them), so a key's rows never
    meet: only its buffers do, one or a few a task.
    """
    kinds = dict(df.dtypes)
    head, name = ", ".join(f"`{k}` {kinds[k]}" for k in keys), result.split()[0]

    def partial(frames):
        held: dict = {}

        def out():
            return pd.DataFrame([(*k, pickle.dumps(b)) for k, b in held.items()], columns=[*keys, "buffer"])

        for frame in frames:
            for k, rows in frame.groupby(list(keys), dropna=False, sort=False):
                k = tuple(None if pd.isna(x) else x for x in k)
                held[k] = how.reduce(held[k] if k in held else how.zero(), rows)
            if len(held) >= most_keys:
                yield out()
                held.clear()
        yield out()

    def final(k, frame):
        buffer = how.zero()
        for b in frame["buffer"]:
            buffer = how.merge(buffer, pickle.loads(b))
        return pd.DataFrame([(*k, how.finish(buffer))], columns=[*keys, name])

    buffers = df.select(*keys, *columns).mapInPandas(partial, f"{head}, buffer binary")
    return buffers.groupBy(*keys).applyInPandas(final, f"{head}, {result}")


def histogram(df: DataFrame, col: str, buckets: Sequence[float]) -> DataFrame:
    """(bucket, n): how many values lie in each [buckets[i], buckets[i+1]), the last one closed; values outside and nulls aren't counted, empty buckets are 0."""
    b = list(buckets)
    if len(b) < 2 or sorted(set(b)) != b:
        raise ValueError("buckets must ascend and be two at least")
    c, last = F.col(col), len(b) - 2
    which = F.when(c == b[-1], F.lit(last))
    for i in range(last + 1):
        which = which.when((c >= b[i]) & (c < b[i + 1]), F.lit(i))
    counts = df.select(which.alias("bucket")).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def even_buckets(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * i / n for i in range(n)] + [high]


def ngrams(df: DataFrame, text: str, n: int, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k commonest word n-grams of a text column's sentences, per group of by: (by..., ngram array, frequency). Ties go to the smaller n-gram."""
    words = df.select(*by, F.explode(F.sentences(F.col(text))).alias("w"))
    grams = words.select(*by, F.explode(F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.slice("w", i + 1, n)))).alias("ngram"))
    counts = grams.groupBy(*by, "ngram").agg(F.count("*").alias("frequency"))
    return _top(counts, by, k)


def context_ngrams(df: DataFrame, text: str, context: Sequence[str | None], k: int, by: Sequence[str] = ()) -> DataFrame:
    """As ngrams(), of the words that stand in the places of None where the other places match context."""
    n, open_places = len(context), [i for i, c in enumerate(context) if c is None]
    words = df.select(*by, F.explode(F.sentences(F.col(text))).alias("w"))
    spots = words.select(*by, F.explode(F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.slice("w", i + 1, n)))).alias("g"))
    for i, c in enumerate(context):
        if c is not None:
            spots = spots.filter(F.col("g")[i] == c)
    grams = spots.select(*by, F.array(*[F.col("g")[i] for i in open_places]).alias("ngram"))
    return _top(grams.groupBy(*by, "ngram").agg(F.count("*").alias("frequency")), by, k)


def _top(counts: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    from tessera.operators.rows import top_by_key

    order = [F.col("frequency").desc(), F.col("ngram")]
    return top_by_key(counts, by, order, k) if by else counts.orderBy(*order).limit(k)


def nan_moments(kind: str, col: str) -> Column:
    """stddev_samp, var_samp, skewness or kurtosis with NaN, not null, where the spread of one value or of equal values is asked for."""
    c = F.col(col)
    plain = {"stddev": F.stddev_samp, "variance": F.var_samp, "skewness": F.skewness, "kurtosis": F.kurtosis}[kind](c)
    return F.when(F.count(c) > 0, F.coalesce(plain, F.lit(float("nan"))))


def numeric_histogram(df: DataFrame, keys: Sequence[str], col: str, bins: int) -> DataFrame:
    """(keys..., x, y): at most bins bins a group, x their mean value (in col's type) and y their rows; exact while a group has no more values than bins.

    histogram_numeric joins the partial histograms of two tasks by putting their bins side by side, so that a value has several bins while there is
    room. Here equal values are counted first, map-side; the bins are made from each group's different values in one task, and a value
    counts in the nearest bin. Nulls are a bin of their own, null keys a group.
    """
    values = df.groupBy(*keys, F.col(col).alias("x")).agg(F.count("*").alias("n")).repartition(*keys)
    g = values.groupBy(*keys).agg(F.histogram_numeric("x", F.lit(bins)).alias("h"), F.collect_list(F.struct(F.col("x").cast("double").alias("v"), "x", "n")).alias("l"))
    near = F.expr("if(e.v is null, null, array_min(transform(h, b -> struct(abs(b.x - e.v) as far, b.x as x))).x)")
    each = g.select(*keys, "h", F.explode("l").alias("e")).select(*keys, near.alias("c"), "e")
    mean = F.sum(F.col("e.v") * F.col("e.n")) / F.sum("e.n")
    one = F.count("*") == 1
    return each.groupBy(*keys, "c").agg(F.when(one, F.first("e.x")).otherwise(mean.cast(dict(df.dtypes)[col])).alias("x"), F.sum("e.n").alias("y")).select(*keys, "x", "y")
