"""SimHash near-duplicates: 64-bit fingerprints, linked through a byte-position inverted index with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import batch, bounded_batches, numbered, signed, text_bytes, written
from tessera.llm.graph import star_forest

BITS, BYTES = 64, 8


def fingerprint(raw: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text; bytes.lower and bytes.split touch ASCII only, as asked for."""
    words = raw.lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [h(b" ".join(words), seed)]
    else:
        hashes = [h(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(shingle)))]
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    for k in range(0, n, 65536):  # bounded memory for very long texts
        part = np.array(hashes[k : k + 65536], "<u8").view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, h, fp): id, 64-bit hash of the text, fingerprint as bigint, one row per input row. A null text counts as empty."""
    bounded_batches(df)
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            yield batch(schema, b.column(0), b.column(1), [signed(fingerprint(x, shingle, seed)) for x in b.column(2).to_pylist()])

    t = text_bytes(text_col)
    return df.select(numbered(id_col).alias("doc_id"), F.xxhash64(t).alias("h"), t.alias("t")).mapInArrow(run, "doc_id long, h long, fp long")


def hex64(col: str) -> Column:
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _subsets(differ: int) -> list[tuple[int, ...]]:
    return list(combinations(range(BYTES), differ))


def _links_of(keys: np.ndarray, sub: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among rows that are sorted so that equal keys (postings) are adjacent.

    Postings of up to 256 rows compare each row with those after it; larger ones probe every fingerprint that differs in up
    to radius bits of the positions left open, so work and links grow with the rows of a posting, not with their square.
    Of each pair that meets, the shared positional bytes are tallied; it's verified if they reach the minimum, and emitted only by
    the first of the postings that it shares.
    """
    subsets = _subsets(radius)
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[new, len(keys)])
    left, right = [], []

    def emit(i: np.ndarray, j: np.ndarray) -> None:
        d = fps[i] ^ fps[j]
        differs = [((d >> np.uint64(8 * p)) & np.uint64(255)) != 0 for p in range(BYTES)]
        ok = (BYTES - np.sum(differs, axis=0) >= BYTES - radius) & (_popcount(d) <= radius) & (d != 0)  # the tally, then the distance
        i, j, differs = i[ok], j[ok], [x[ok] for x in differs]
        if not len(i):
            return
        first = np.full(len(i), -1)
        for k, s in reversed(list(enumerate(subsets))):  # the first subset of positions that covers all that differ
            covered = np.ones(len(i), bool)
            for p in range(BYTES):
                if p not in s:
                    covered &= ~differs[p]
            first[covered] = k
        ok = first == sub[i]
        left.append(fps[i[ok]])
        right.append(fps[j[ok]])

    group = np.repeat(np.arange(len(new)), size)
    end = (new + size)[group]
    few = (size <= 256)[group]
    rows, lag = np.flatnonzero(few & (size > 1)[group]), 1
    while len(rows):
        rows = rows[rows + lag < end[rows]]
        emit(rows, rows + lag)
        lag += 1
    for g in np.flatnonzero(size > 256):
        a = np.arange(new[g], new[g] + size[g])
        order = a[np.argsort(fps[a])]
        values, open_bits = fps[order], [np.uint64(1) << np.uint64(8 * p + b) for p in subsets[int(sub[a[0]])] for b in range(8)]
        for r in range(1, radius + 1):
            for flip in combinations(open_bits, r):
                want = values ^ np.bitwise_or.reduce(np.array(flip, np.uint64))
                at = np.minimum(np.searchsorted(values, want), len(values) - 1)
                hit = (values[at] == want) & (values < want)
                emit(order[hit], order[at[hit]])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def fingerprint_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): each pair of distinct fingerprints (column fp) that differ in 1 to radius bits, once.

    Two such fingerprints share at least 8 - radius of their 8 positional bytes. The inverted index lists fingerprints under
    every set of 8 - radius positional bytes (28 sets at radius 2), so a pair meets in a posting exactly if its tally of shared
    positional bytes reaches that minimum: the count filter is the key. A posting holds distinct fingerprints that differ
    in radius bytes only, so it can't exceed 65,536 rows however many documents or copies there are.
    """
    subsets = _subsets(radius)
    full = (1 << 64) - 1
    masks = [full ^ sum(255 << 8 * p for p in s) for s in subsets]
    index = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("s"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for k, m in enumerate(masks)])).alias("x"))
    index = index.select(F.col("x.s").alias("s"), F.col("x.k").alias("k"), "fp").repartition("s", "k").sortWithinPartitions("s", "k", "fp")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        rest = None
        for b in batches:
            s, k, f = (b.column(n).to_numpy() for n in range(3))
            if rest:
                s, k, f = (np.concatenate(x) for x in zip(rest, (s, k, f)))
            same = (s == s[-1]) & (k == k[-1]) if len(s) else np.zeros(0, bool)
            cut = len(s) - int(same.sum())  # the last posting may go on in the next batch
            rest = (s[cut:], k[cut:], f[cut:])
            if cut:
                yield links(s[:cut], k[:cut], f[:cut])
        if rest and len(rest[0]):
            yield links(*rest)

    def links(s, k, f):
        key = np.cumsum(np.r_[0, (s[1:] != s[:-1]) | (k[1:] != k[:-1])])
        u, v = _links_of(key, s, f.view(np.uint64), radius)
        return batch(schema, u.view(np.int64), v.view(np.int64))

    return index.mapInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """(doc_id, h, fp, component_id): one row per input row; h is a 64-bit hash of the text, component_id the smallest id reachable.

    Documents of equal fingerprints are one node, so copies are never expanded into pairs. Rows with a null id keep their
    row and take part in links; the smallest id leaves them out, and is null only where a component has no id at all.
    Empty and null texts have fingerprint 0 and link like others. Repeated rows each get a row.
    """
    docs = written(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    nodes = written(docs.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    stars = star_forest(fingerprint_links(nodes.select("fp"), radius))
    roots = stars.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct()
    members = written(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(roots).join(nodes, "fp"), "members")
    lows = members.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = members.join(lows, "root").select("fp", "component_id")
    of = written(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "components")
    return docs.join(of, "fp", "left").select("doc_id", "h", "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """df with one row of each near-duplicate group: the one of the smallest id; among rows that repeat this id, of the smallest text hash.

    Rows of a group without any id: the one of the smallest text hash.
    """
    found = near_duplicates(df, id_col, text_col, radius, shingle)
    best = found.groupBy(F.coalesce("component_id", F.lit(-1)).alias("c"), F.col("component_id").isNull().alias("none"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("f"))
    best = best.agg(F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("h"))).alias("keep_h"), F.first("component_id").alias("keep_id")).select("keep_id", "keep_h")
    # df's columns are carried in a struct by their place, so that no name of theirs can clash
    row = F.struct(*[F.col(f"`{c}`").alias(f"_{j}") for j, c in enumerate(df.columns)])
    rows = df.select(row.alias("row"), numbered(id_col).alias("id"), F.xxhash64(text_bytes(text_col)).alias("h"))
    kept = rows.join(written(best, "kept"), F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h")), "left_semi")
    kept = kept.withColumn("n", F.row_number().over(Window.partitionBy("id", "h").orderBy("h"))).filter("n = 1")
    return kept.select(*[F.col(f"row._{j}").alias(c) for j, c in enumerate(df.columns)])
