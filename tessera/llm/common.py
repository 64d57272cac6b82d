"""What the corpus operators share: the shared folder, written tables, text as bytes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local one is made, in local mode alone."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: lineage is cut and every later reader sees one and the same attempt.

    The folder is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _files(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Removes tables made by written() that no later plan reads: what was made of them is written itself."""
    for df in tables:
        _files(df.sparkSession, df.written_at).delete(df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at), True)


def numbered(id_col: str) -> Column:
    """An id column as bigint. What is no number counts as a null id, in every operator of this package."""
    return F.col(f"`{id_col}`").try_cast("long")


def text_bytes(col: str = "text") -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col).cast("string").cast("binary"), F.lit("").cast("binary"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable is bound, an expression inside a lambda is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def signed(x: int) -> int:
    """An unsigned 64-bit number as Spark's bigint."""
    return x - (1 << 64) if x >> 63 else x


def _labelled_ids(labels: DataFrame, label: str, where: Column | None) -> DataFrame:
    rows = labels.select(numbered("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).filter("_id is not null and _label in (0, 1)")
    rows = rows.filter(where) if where is not None else rows
    return rows.groupBy("_id").agg(F.max("_label").alias("_label"))


def sample_ids(labels: DataFrame, label: str, most: int, where: Column | None = None, together: bool = False) -> DataFrame:
    """(_id, _label): at most most ids of each label value 0 and 1, those of the smallest hash. An id labelled 1 anywhere has label 1; nulls don't count.

    together: at most 2 * most ids of both values in one sample, so that their shares stay those of all labels at every size.
    """
    rows = _labelled_ids(labels, label, where)
    if together:
        return rows.orderBy(F.xxhash64("_id"), "_id").limit(2 * most)
    pick = [rows.filter(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(most) for k in (0, 1)]
    return pick[0].union(pick[1])


def class_weights(labels: DataFrame, label: str, most: int, where: Column | None = None) -> dict[int, float]:
    """How many ids each id of sample_ids() stands for, by label value: ids of the value / sampled ids of the value."""
    rows = _labelled_ids(labels, label, where).groupBy("_label").count().collect()
    return {r._label: r["count"] / min(r["count"], most) for r in rows}


def bounded_batches(df: DataFrame) -> None:
    """From here on the session's Arrow batches hold 1,000 rows and 8 MB at most: texts are long, and the usual 10,000 rows of them don't fit small executors."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
