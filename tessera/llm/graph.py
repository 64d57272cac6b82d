"""Connected components by alternating stars, for link tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def _mins(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def star_forest(links: DataFrame) -> DataFrame:
    """Rows (u, v): every node u that has a smaller node in its component, with the smallest one as v.

    links: two bigint columns u, v; repeats, both directions, self-links and nulls are allowed (the last two are left out).
    Each round hangs the larger neighbours of a node under its smallest one (large star), then the smaller ones (small star);
    the number of rounds grows with the logarithm of a component's size. Minima are taken map-side, so a hub does not collect
    its neighbours in one task; the joins that hand a minimum back have plain exchanges on both sides, which adaptive
    execution splits. Each round is written to the shared folder, so a lost executor costs one round at most.
    """
    e = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u is not null and v is not null and u > v").distinct(), "links")
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _mins(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        m = _mins(large)
        small = large.join(m, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v"))).distinct()
        e = written(small, "small-star")
        before, state = state, _state(e)
        if state == before:
            break
    return e
