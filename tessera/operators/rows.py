"""Row operators that the DataFrame API lacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import cut


def bucket_sample(df: DataFrame, x: int, y: int, *cols: str) -> DataFrame:
    """TABLESAMPLE (BUCKET x OUT OF y ON cols): the rows whose hash falls into bucket x of y; the buckets 1..y part the rows. A narrow filter, no shuffle."""
    if not 1 <= x <= y:
        raise ValueError("x must be in 1..y")
    return df.filter(F.pmod(F.hash(*cols), F.lit(y)) == x - 1)


def top_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of each key by order. Ranking with a limit is cut down before the shuffle by the planner's group limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def grouping_presence(*keys: str) -> Column:
    """GROUPING__ID of old: bit i is set where the i-th grouping key is present in the row's grouping set."""
    out = F.lit(0).cast("long")
    for i, k in enumerate(keys):
        out = out + (F.lit(1) - F.grouping(k)).cast("long") * (1 << i)
    return out


def indexed(df: DataFrame, *order: str) -> DataFrame:
    """(row, index): each row as a struct and its place in the order of the named columns, from 0; rows that tie are placed in any order.

    Rows are range-partitioned and sorted once and written; the sizes of the partitions, one number each, make the places global.
    """
    parted = df.select(F.struct("*").alias("row")).repartitionByRange(*[F.col(f"row.`{c}`") for c in order])
    placed = cut(parted.sortWithinPartitions(*[F.col(f"row.`{c}`") for c in order]).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)  # monotonic ids are the partition's number and the row's place in it
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("part", before.alias("before")))
    return placed.withColumn("part", part).join(offsets, "part").select("row", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("index"))


def sliding(df: DataFrame, order: str, value: str, size: int, block: int = 100_000) -> DataFrame:
    """(order, window): arrays of size consecutive values in the given order, as positional sliding gives them.

    Rows are indexed and cut into blocks of block rows; each block also gets the size - 1 rows that follow it, so that the window
    is taken block by block and no task sees the whole table.
    """
    i = F.col("index")
    blocks = F.sequence(F.floor(F.greatest(i - (size - 1), F.lit(0)) / block), F.floor(i / block))
    rows = indexed(df.select(order, value), order, value).select("row", "index", F.explode(blocks).alias("block"))
    w = Window.partitionBy("block").orderBy("index").rowsBetween(0, size - 1)
    out = rows.select("row", "index", "block", F.collect_list(F.struct(F.col(f"row.`{value}`").alias("v"))).over(w).alias("window"))
    out = out.filter((F.size("window") == size) & (F.floor(i / block) == F.col("block")))
    return out.select(F.col(f"row.`{order}`").alias(order), F.transform("window", lambda x: x["v"]).alias("window"))


def merge(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """A join by equal names whose other equal names get suffixes."""
    both = (set(left.columns) & set(right.columns)) - set(by)
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in both})
    return a.join(b, list(by), how)


def join_with(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """(_1, _2): pairs of whole rows; the side without a match is null. left and right must be aliased a and b, as on must refer to them."""
    return left.select(F.struct("*").alias("_1")).join(right.select(F.struct("*").alias("_2")), on, how)
