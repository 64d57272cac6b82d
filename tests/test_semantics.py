"""Literal rows: small tables whose results are known."""

import math

import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.operators import graphs, grouping, intervals, rows
from tessera.plans import engine
from tessera.sources import readers
from tessera.streaming import replay

registry.load_plans()


@pytest.fixture(scope="module")
def harvest(spark):
    return spark.createDataFrame([("north", 7, 4.0), ("south", 7, 1.5), ("north", 8, 2.5), ("north", 8, 3.0), ("south", 9, 6.0), ("south", 9, None)], "field string, month int, tons double")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rollup_and_cube(harvest):
    by_month = [("north", 7, 4.0), ("north", 8, 5.5), ("south", 7, 1.5), ("south", 9, 6.0)]
    by_field = [("north", None, 9.5), ("south", None, 7.5), (None, None, 17.0)]
    assert got(harvest.rollup("field", "month").agg(F.sum("tons"))) == sorted([*by_month, *by_field], key=str)
    assert got(harvest.cube("field", "month").agg(F.sum("tons"))) == sorted([*by_month, *by_field, (None, 7, 5.5), (None, 8, 5.5), (None, 9, 6.0)], key=str)


def test_pivot(harvest):
    assert got(harvest.groupBy("month").pivot("field", ["south", "north", "west"]).agg(F.sum("tons"))) == [(7, 1.5, 4.0, None), (8, None, 5.5, None), (9, 6.0, None, None)]


def test_grouping_presence(spark):
    t = spark.createDataFrame([("1", "11")], "key string, val string").cube("key", "val").agg(rows.grouping_presence("key", "val").alias("g"))
    assert got(t) == sorted([(None, None, 0), ("1", None, 1), (None, "11", 2), ("1", "11", 3)], key=str)


def test_null_semantics(spark):
    r = spark.sql("select 1 = null a, null <=> null b, 2 in (1, null) c, 1 in (1, null) d, coalesce(null, 3) e, greatest(1, null) f, size(cast(null as array<int>)) g, 7 / 0 h, 2147483647 + 1 i, cast('x' as int) j").first()
    assert tuple(r) == (None, True, None, True, 3, 1, None, None, -2147483648, None)


def test_bucket_sample_parts(spark):
    t = spark.range(1000)
    parts = [set(r.id for r in rows.bucket_sample(t, x, 3, "id").collect()) for x in (1, 2, 3)]
    assert sum(map(len, parts)) == 1000 == len(set.union(*parts))
    with pytest.raises(ValueError):
        rows.bucket_sample(t, 4, 3, "id")


def test_histogram(spark):
    t = spark.createDataFrame([(x,) for x in [1.0, 2.0, 2.5, 4.0, 9.0, None]], "x double")
    assert got(grouping.histogram(t, "x", [1.0, 2.0, 3.0, 4.0])) == [(0, 1), (1, 2), (2, 1)]
    with pytest.raises(ValueError):
        grouping.histogram(t, "x", [1.0])


def test_as_of_ties_and_gaps(spark):
    a = spark.createDataFrame([("k", 1), ("k", 5), ("k", 9), ("m", 5), (None, 5)], "k string, t int")
    b = spark.createDataFrame([("k", 5, "x"), ("k", 7, "y"), ("m", 6, "z")], "k string, t int, v string")
    assert got(intervals.as_of_join(a, b, "k", "k", "t", "t", ["v"])) == sorted([("k", 1, None), ("k", 5, "x"), ("k", 9, "y"), ("m", 5, None), (None, 5, None)], key=str)


def test_points_in_intervals(spark):
    p = spark.createDataFrame([(float(x),) for x in range(0, 40)], "x double")
    r = spark.createDataFrame([(0.5, 3.0), (10.0, 35.0), (39.0, 39.0)], "a double, b double")
    want = sorted([(float(x), a, b) for x in range(40) for a, b in ((0.5, 3.0), (10.0, 35.0), (39.0, 39.0)) if a <= x < b], key=str)
    assert got(intervals.point_in_interval(p, r, "x", "a", "b", 7.0)) == want


def test_jdbc_strides():
    assert readers.jdbc_strides("c", 0, 10, 3) == ["c < 3 or c is null", "c >= 3 AND c < 6", "c >= 6"]
    assert readers.jdbc_strides("c", 0, 10, 1) == [] == readers.jdbc_strides("c", 5, 5, 4)


def test_join_with_and_merge(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert got(rows.merge(a, b, ["k"], "full")) == sorted([(1, "a", None), (2, "b", "x"), (3, None, "y")], key=str)
    pairs = rows.join_with(a, b, F.col("_1.k") == F.col("_2.k"), "left").collect()
    assert sorted((r._1.v, r._2 and r._2.v) for r in pairs) == [("a", None), ("b", "x")]


def test_page_rank_of_a_star(spark):
    ranks = {r.id: r["rank"] for r in graphs.page_rank(graphs.star(spark, 5), tolerance=1e-6).collect()}
    assert ranks[0] == pytest.approx(0.15 + 0.85 * 4 * 0.15) and ranks[3] == pytest.approx(0.15)


def test_components_of_a_long_chain(spark):
    chain = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in graphs.connected_components(chain).collect()} == {0}


@pytest.mark.parametrize("parts,block", [(1, 100_000), (5, 7), (9, 3), (40, 1)])
def test_sliding_over_partitions(spark, parts, block):
    t = spark.range(50).select(((F.col("id") * 37) % 50).alias("k"), ((F.col("id") * 37) % 50 * 2).cast("string").alias("v")).repartition(parts)
    for size in (1, 3, 12):
        want = [(k, [str(2 * (k + j)) for j in range(size)]) for k in range(50 - size + 1)]
        assert sorted((r.k, r.window) for r in rows.sliding(t, "k", "v", size, block).collect()) == want
    assert rows.sliding(t.limit(0), "k", "v", 2).count() == 0
    gaps = spark.createDataFrame([(1, None), (2, "b"), (3, None)], "k int, v string")
    assert got(rows.sliding(gaps, "k", "v", 2)) == [(1, [None, "b"]), (2, ["b", None])]


def test_indexed_is_global(spark):
    t = spark.range(300).select(((F.col("id") * 7) % 300).alias("k")).repartition(11)
    assert all(r.row.k == r["index"] for r in rows.indexed(t, "k").collect())
    assert sorted(r["index"] for r in rows.indexed(t.select(F.lit(1).alias("k")), "k").collect()) == list(range(300))


def test_typed_aggregate_merges_buffers(spark):
    how = grouping.Aggregator(zero=lambda: (0, 0), reduce=lambda b, f: (b[0] + len(f), b[1] + int(f.x.fillna(0).sum())), merge=lambda a, b: (a[0] + b[0], a[1] + b[1]), finish=lambda b: f"{b[0]}/{b[1]}")
    t = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.concat(F.lit("k"), F.col("id") % 3)).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("x")).repartition(6)
    want = got(t.groupBy("k").agg(F.concat_ws("/", F.count("*"), F.sum("x"))))
    assert got(grouping.typed_aggregate(t, ["k"], ["x"], how, "s string")) == want
    assert got(grouping.typed_aggregate(t, ["k"], ["x"], how, "s string", most_keys=1)) == want
    assert got(grouping.typed_aggregate(t.limit(0), ["k"], ["x"], how, "s string")) == []


def test_svd_plus_plus_equals_its_formulas(spark):
    """A round in plain loops from the same start, compared with the joins; many rounds come closer to the ratings."""
    import math

    ratings = [(u, 100 + i, float(1 + (u * i) % 5)) for u in range(6) for i in range(5) if (u + i) % 3]
    df = spark.createDataFrame(ratings, "src long, dst long, rating double")
    users, items, mean = graphs.svd_plus_plus(df, rank=2, rounds=0)
    p, norm = {r.id: r.p for r in users.collect()}, {r.id: r.norm for r in users.collect()}
    q, y = {r.id: r.q for r in items.collect()}, {r.id: r.y for r in items.collect()}
    rated = {u: [i for v, i, _ in ratings if v == u] for u in p}
    assert mean == pytest.approx(sum(r for *_, r in ratings) / len(ratings)) and norm[1] == pytest.approx(1 / math.sqrt(len(rated[1])))
    v = {u: [p[u][k] + norm[u] * sum(y[i][k] for i in rated[u]) for k in range(2)] for u in p}
    err = {(u, i): r - min(max(mean + sum(q[i][k] * v[u][k] for k in range(2)), 0.0), 5.0) for u, i, r in ratings}
    users, items, _ = graphs.svd_plus_plus(df, rank=2, rounds=1)
    for r in users.collect():
        assert r.b == pytest.approx(0.007 * sum(err[r.id, i] for i in rated[r.id]))
        assert r.p == pytest.approx([p[r.id][k] + 0.007 * sum(err[r.id, i] * q[i][k] - 0.015 * p[r.id][k] for i in rated[r.id]) for k in range(2)])
    for r in items.collect():
        own = [u for u in rated if r.id in rated[u]]
        assert r.q == pytest.approx([q[r.id][k] + 0.007 * sum(err[u, r.id] * v[u][k] - 0.015 * q[r.id][k] for u in own) for k in range(2)])
        assert r.y == pytest.approx([y[r.id][k] + 0.007 * sum(err[u, r.id] * norm[u] * q[r.id][k] - 0.015 * y[r.id][k] for u in own) for k in range(2)])
    error = []
    for n in (0, 6):
        found = graphs.svd_guess(df, *graphs.svd_plus_plus(df, rank=2, rounds=n, pace=(0.05, 0.05)))
        error.append(found.agg(F.avg(F.pow(F.col("rating") - F.col("guess"), 2))).first()[0])
    assert error[1] < error[0]


def test_triangles_and_strong_components_by_brute_force(spark):
    import itertools
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(14), rng.randrange(14)) for _ in range(60)]
    df, ids = spark.createDataFrame(edges, "src long, dst long"), {x for e in edges for x in e}
    near = {frozenset(e) for e in edges if e[0] != e[1]}
    want = {i: sum(all(frozenset(x) in near for x in itertools.combinations(t, 2)) for t in itertools.combinations(sorted(ids), 3) if i in t) for i in ids}
    assert {r.id: r.triangles for r in graphs.triangle_count(df).collect()} == want
    some = edges[:22]
    reach = {i: {i} for e in some for i in e}
    for _ in reach:
        for a, b in some:
            for i in reach:
                if a in reach[i]:
                    reach[i].add(b)
    want = {i: min(j for j in reach[i] if i in reach[j]) for i in reach}
    got_strong = graphs.strongly_connected_components(spark.createDataFrame(some, "src long, dst long"))
    assert {r.id: r.component for r in got_strong.collect()} == want


def test_jdbc_ranges_cover_the_whole_range(spark):
    url, driver = "jdbc:derby:memory:ranges_test;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    readers.write_jdbc(spark.range(40).coalesce(1), url, "numbers", mode="overwrite", driver=driver)
    for parts in (1, 3, 50):
        df = readers.jdbc_ranges(spark, url, 'SELECT "id" FROM numbers WHERE "id" >= ? AND "id" <= ?', 5, 17, parts, driver=driver)
        assert sorted(r[0] for r in df.collect()) == list(range(5, 18))


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_results_of_streams_are_files_not_rows_in_the_driver(spark, mode):
    t = spark.range(90).select("id", (F.col("id") % 4).alias("k"))
    stream = replay.staged(t, 3, "id")
    out = replay.finished(stream if mode == "append" else stream.groupBy("k").agg(F.count("*").alias("n")), mode)
    assert out.inputFiles()
    assert got(out) == got(t if mode == "append" else t.groupBy("k").agg(F.count("*").alias("n")))
    none = replay.finished(replay.staged(t.limit(0), 3, "id"))
    assert (none.columns, none.count()) == (["id", "k"], 0)


def test_numeric_histogram_over_partitions(spark):
    t = spark.range(4000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 11 > 0, (F.col("id") % 7).cast("int")).alias("x")).repartition(9)
    assert got(grouping.numeric_histogram(t, ["k"], "x", 20)) == got(t.groupBy("k", "x").agg(F.count("*")))
    wide = spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") % 500).cast("double").alias("x")).repartition(7)
    found = grouping.numeric_histogram(wide, ["k"], "x", 20).collect()
    assert len(found) <= 20 and sum(r.y for r in found) == 5000 and sum(r.x * r.y for r in found) == pytest.approx(5000 * 249.5)


def test_document_frequencies_of_every_word(spark, tmp_path):
    """More words than a million, one in all documents; a repeated id is one document."""
    words = F.concat_ws(" ", F.lit("ALL"), F.transform(F.sequence(F.lit(0), F.lit(999)), lambda k: F.concat(F.lit("w"), F.col("id") * 1000 + k)))
    t = spark.range(1100).select(F.col("id").alias("doc_id"), words.alias("text"))
    t.union(t.filter("doc_id = 5")).write.parquet(f"{tmp_path}/documents.parquet")
    r = registry.QUERIES["m02_text_features"](spark, str(tmp_path)).groupBy("idf").agg(F.count("*").alias("n"), F.min("term").alias("a")).orderBy("n").collect()
    assert [(x.n, x.idf) for x in r] == [(1, round(math.log(1102 / 1101), 9)), (1_100_000, round(math.log(1102 / 2), 9))] and r[0].a == "all"


def test_triangles_make_no_row_for_each_wedge(spark):
    """A full graph of 60 vertices: every two edges of a vertex are a wedge, and no table or join has as many rows."""
    t = spark.createDataFrame([(a, b) for a in range(60) for b in range(60)], "src long, dst long")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else finished stages hide their operators
    try:
        out = graphs.triangle_count(t)
        most = max(n for kind, n in engine.plan_metrics(out) if "Join" in kind)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert most <= 60 * 59 // 2 and {r.triangles for r in out.collect()} == {59 * 58 // 2}


def test_staged_batches_are_written_by_several_tasks(spark, tmp_path):
    """Every task writes its part of a batch, and a trigger gets one batch whole, also where only one task has rows of it or none has."""
    for name, t, sizes in (("even", spark.range(900).repartition(3), [300, 300, 300]), ("ordered", spark.range(0, 900, 1, 3), [300, 300, 300]), ("gap", spark.range(0, 900, 1, 3).filter("id < 300 or id >= 600"), [300, 0, 300])):
        t.write.parquet(f"{tmp_path}/{name}")
        seen, q = [], replay.staged(spark.read.parquet(f"{tmp_path}/{name}"), 3, "id").select("id", F.input_file_name().alias("f"))
        q = q.writeStream.foreachBatch(lambda b, _, seen=seen: seen.append([(r.id, r.f) for r in b.collect()])).option("checkpointLocation", f"{tmp_path}/{name}-at").trigger(availableNow=True).start()
        q.awaitTermination()
        assert [len(b) for b in seen] == sizes and sorted(i for b in seen for i, _ in b) == sorted(r.id for r in spark.read.parquet(f"{tmp_path}/{name}").collect())
        assert all(a[0] < b[0] for x, y in zip(seen, seen[1:]) for a in x for b in y)
        assert name != "even" or all(len({f for _, f in b}) > 1 for b in seen)


def test_sessions_go_on_over_batches_and_end_at_the_gap(spark, tmp_path):
    hours = {
        1: [k * 1.5 for k in range(40)],  # one session through all batches
        2: [0, 2, 4, 6 - 1e-6 / 3600, 59],  # two hours are a gap, a microsecond less is none
        3: [19.9, 20.1, 39.9, 40.1],  # at the ends of batches
        4: [30, 30, 30],
        None: [1, 2, 50],
    }
    rows = [(u, round(h * 3_600_000_000)) for u, hs in hours.items() for h in hs]
    df = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(rows)], "event_id long, user_id long, t long")
    df = df.select("event_id", F.timestamp_micros(F.col("t") + 1_700_000_000_000_000).cast("timestamp_ntz").alias("ts"), "user_id", F.lit("click").alias("event_type"), F.lit(1.0).alias("value"))
    df.repartition(3).write.parquet(f"{tmp_path}/some/events.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/none/events.parquet")
    run = registry.QUERIES["t20_session_windows"]
    assert got(run(spark, f"{tmp_path}/some")) == sorted([(1, 1, 40), (2, 4, 5), (3, 2, 4), (4, 1, 3), (None, 2, 3)], key=str)
    assert got(run(spark, f"{tmp_path}/none")) == []


def test_all_pairs_of_a_name_take_little_room(spark, tmp_path):
    names = spark.range(3001).selectExpr("id * 7919 % 100003 AS p_partkey", "if(id = 3000, 'other', 'part') AS p_name")
    odd = spark.createDataFrame([(7, "x"), (7, "x"), (None, "x"), (8, None), (9, "")], "p_partkey long, p_name string")
    for name, df in (("many", names), ("odd", odd)):
        df.write.parquet(f"{tmp_path}/{name}/part.parquet")
    run = registry.QUERIES["j16_binary_key"]
    assert got(run(spark, f"{tmp_path}/odd")) == sorted([(7, 7)] * 4 + [(7, None), (None, 7)] * 2 + [(None, None), (9, 9)], key=str)
    run(spark, f"{tmp_path}/many").write.parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs")
    assert pairs.count() == pairs.distinct().count() == 9_000_001
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 2_000_000


def test_pairs_of_a_name_are_shared_by_all_cores(spark, tmp_path):
    spark.range(2001).selectExpr("id AS p_partkey", "if(id = 2000, 'other', 'part') AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    pairs = registry.QUERIES["j16_binary_key"](spark, str(tmp_path))
    shares = [r[0] for r in pairs.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(shares) == pairs.distinct().count() == 4_000_001
    assert max(shares) < 1_000_000
