"""Graph algorithms (G rows of the survey) over customers and suppliers of the same orders, nations and generated graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graphs, lineage
from tessera.registry import query
from tessera.sources.tables import table

_NATIONS = "(SELECT n_nationkey AS src, n_regionkey + 100 AS dst FROM nation)"


def nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 100).cast("long").alias("dst"))


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Customers (even ids) to the parts (odd ids) they ordered, one edge a line of an order."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    e = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return e.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))


_TRADE = "(SELECT o_custkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _spread(what: str, out: str, steps: int = 12) -> str:
    """SQL that spreads the least or greatest id over _TRADE for a fixed number of steps, more than its components are wide."""
    sql = f"WITH b AS MATERIALIZED (SELECT DISTINCT src, dst FROM {_TRADE} UNION SELECT dst, src FROM {_TRADE}), s0 AS MATERIALIZED (SELECT DISTINCT src AS id, src AS x FROM b)"
    for k in range(1, steps + 1):
        sql += f", s{k} AS MATERIALIZED (SELECT id, {what}(any_value(s.x), {'min' if what == 'least' else 'max'}(n.x)) AS x FROM s{k - 1} s JOIN b ON b.src = s.id JOIN s{k - 1} n ON n.id = b.dst GROUP BY s.id)".replace("SELECT id,", "SELECT s.id AS id,")
    return sql + f" SELECT id, x AS {out} FROM s{steps}"


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Customer, part and supplier of each order line as a triangle; ids 3k, 3k + 1 and 3k + 2."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    t = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") * 3).alias("c"), (F.col("l_partkey") * 3 + 1).alias("p"), (F.col("l_suppkey") * 3 + 2).alias("s"))
    return t.select(F.explode(F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in ("cp", "ps", "sc")])).alias("e")).select("e.*")


def places(spark: SparkSession, d: str) -> DataFrame:
    """Regions and their nations, both ways, and customers to their nation; ids 3k, 3k + 1 and 3k + 2."""
    n = table(spark, d, "nation").select((F.col("n_regionkey") * 3).cast("long").alias("r"), (F.col("n_nationkey") * 3 + 1).cast("long").alias("n"))
    c = table(spark, d, "customer").select((F.col("c_custkey") * 3 + 2).alias("src"), (F.col("c_nationkey") * 3 + 1).cast("long").alias("dst"))
    return c.union(n.select("r", "n")).union(n.select("n", "r"))


@query("g01_triplets", "SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey")
def triplets(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    v = v.union(table(spark, d, "region").select((F.col("r_regionkey") + 100).cast("long"), "r_name"))
    return graphs.triplets(v, nations(spark, d)).select(F.col("src_attr.name").alias("a"), F.col("dst_attr.name").alias("b"))


@query("g02_edge_list", "SELECT n_nationkey AS src, n_regionkey + 100 AS dst, 1 AS attr FROM nation")
def edge_list(spark: SparkSession, d: str) -> DataFrame:
    path = lineage.scratch(spark, "edges")
    lines = nations(spark, d).select(F.concat_ws(" ", "dst", "src").alias("value")).union(spark.createDataFrame([("# a comment",)], "value string"))
    lines.write.text(path)
    return graphs.edge_list(spark, path, canonical=True)


@query("g03_degrees", f"SELECT id, count(*) AS degree FROM (SELECT src AS id FROM {_TRADE} UNION ALL SELECT dst FROM {_TRADE}) GROUP BY id")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graphs.degrees(trade(spark, d))


@query("g04_reverse", f"SELECT dst AS src, src AS dst FROM {_NATIONS}")
def reverse(spark: SparkSession, d: str) -> DataFrame:
    return graphs.reverse(nations(spark, d)).select("src", "dst")


@query("g05_aggregate_messages", f"SELECT dst AS id, sum(src) AS message FROM {_NATIONS} GROUP BY dst")
def messages(spark: SparkSession, d: str) -> DataFrame:
    e = nations(spark, d)
    return graphs.aggregate_messages(graphs.vertices_of(e), e, F.sum("msg"), to_dst=F.col("src_attr.id"))


@query("g06_neighbours", f"SELECT id, count(DISTINCT o) AS n FROM (SELECT src AS id, dst AS o FROM {_TRADE} UNION ALL SELECT dst, src FROM {_TRADE}) GROUP BY id")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graphs.collect_neighbour_ids(trade(spark, d)).select("id", F.size("neighbours").alias("n"))


@query("g06_canonical", f"SELECT least(src, dst) AS src, greatest(src, dst) AS dst, count(*) AS w FROM {_TRADE} GROUP BY 1, 2")
def canonical(spark: SparkSession, d: str) -> DataFrame:
    return graphs.canonical(trade(spark, d).withColumn("w", F.lit(1).cast("long")), "w")


@query("g08_pregel_maximum", _spread("greatest", "attr"))
def pregel(spark: SparkSession, d: str) -> DataFrame:
    e = trade(spark, d)
    return graphs.pregel(graphs.vertices_of(e), e, F.col("id"), F.greatest("attr", "message"), F.max("msg"), to_dst=F.col("src_attr.attr"), to_src=F.col("dst_attr.attr"))


@query("g09_page_rank", f"WITH e AS (SELECT DISTINCT src, dst FROM {_NATIONS}) SELECT id, round(0.15 + 0.85 * coalesce(s, 0), 9) AS rank FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) LEFT JOIN (SELECT dst AS id, sum(0.15) AS s FROM e GROUP BY dst) USING (id)")
def page_rank(spark: SparkSession, d: str) -> DataFrame:
    return graphs.page_rank(nations(spark, d), 5).select("id", F.round("rank", 9).alias("rank"))


@query("g10_connected_components", _spread("least", "component"))
def components(spark: SparkSession, d: str) -> DataFrame:
    return graphs.connected_components(trade(spark, d))


@query("g11_strong_components", "SELECT n_nationkey * 3 + 1 AS id, n_regionkey * 3 AS component FROM nation UNION ALL SELECT DISTINCT n_regionkey * 3, n_regionkey * 3 FROM nation UNION ALL SELECT c_custkey * 3 + 2, c_custkey * 3 + 2 FROM customer")
def strong(spark: SparkSession, d: str) -> DataFrame:
    return graphs.strongly_connected_components(places(spark, d))


_LINES = "(SELECT o_custkey * 3 AS c, l_partkey * 3 + 1 AS p, l_suppkey * 3 + 2 AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query("g12_triangles", f"WITH l AS MATERIALIZED (SELECT * FROM {_LINES}), cp AS (SELECT DISTINCT c, p FROM l), ps AS (SELECT DISTINCT p, s FROM l), cs AS (SELECT DISTINCT c, s FROM l), t AS MATERIALIZED (SELECT cp.c AS c, cp.p AS p, ps.s AS s FROM cp JOIN ps ON cp.p = ps.p JOIN cs ON cs.c = cp.c AND cs.s = ps.s) SELECT id, count(*) AS triangles FROM (SELECT c AS id FROM t UNION ALL SELECT p FROM t UNION ALL SELECT s FROM t) GROUP BY id")
def triangles(spark: SparkSession, d: str) -> DataFrame:
    return graphs.triangle_count(lines(spark, d))


@query("g13_label_propagation", f"SELECT n_nationkey AS id, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS label FROM nation UNION ALL SELECT DISTINCT n_regionkey + 100, min(n_nationkey) OVER (PARTITION BY n_regionkey) FROM nation")
def labels(spark: SparkSession, d: str) -> DataFrame:
    e = nations(spark, d)
    first = e.groupBy("dst").agg(F.min("src").alias("m"))
    own = e.join(first, "dst")
    ring = own.select("src", F.col("m").alias("dst")).union(own.select(F.col("dst").alias("src"), F.col("m").alias("dst"))).union(own.select(F.col("m").alias("src"), F.col("m").alias("dst")))
    return graphs.label_propagation(ring, 3)


@query("g14_shortest_paths", "WITH r AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation), l AS (SELECT DISTINCT r FROM r) SELECT r * 3 AS id, r * 3 AS landmark, 0 AS hops FROM l UNION ALL SELECT n * 3 + 1, r * 3, 1 FROM r UNION ALL SELECT c_custkey * 3 + 2, r * 3, 2 FROM customer JOIN r ON c_nationkey = n")
def paths(spark: SparkSession, d: str) -> DataFrame:
    regions = [r.n_regionkey * 3 for r in table(spark, d, "nation").select("n_regionkey").distinct().collect()]
    return graphs.shortest_paths(places(spark, d), regions)


@query("g15_svd_plus_plus", f"SELECT count(*) AS n, round(avg(rating), 6) AS mean, true AS closer FROM (SELECT DISTINCT src, dst, 1.0 + src // 2 % 3 + dst // 2 % 2 AS rating FROM {_TRADE})")
def svd(spark: SparkSession, d: str) -> DataFrame:
    """Customers of three tempers rate two kinds of parts; the model is closer to these ratings than their mean is."""
    e = trade(spark, d).distinct().withColumn("rating", F.expr("1.0D + src div 2 % 3 + dst div 2 % 2"))
    users, items, mean = graphs.svd_plus_plus(e, rank=3, rounds=3)
    found = graphs.svd_guess(e, users, items, mean)
    error = F.sum(F.pow(F.col("rating") - F.col("guess"), 2)) < F.sum(F.pow(F.col("rating") - mean, 2))
    return found.agg(F.count("*").alias("n"), F.round(F.lit(mean), 6).alias("mean"), error.alias("closer"))


@query("g16_grid", "SELECT CAST(i AS BIGINT) AS src, CAST(i + 1 AS BIGINT) AS dst FROM range(0, 42) t(i) WHERE i % 7 < 6 UNION ALL SELECT i, i + 7 FROM range(0, 35) t(i)")
def grid(spark: SparkSession, d: str) -> DataFrame:
    return graphs.grid(spark, 6, 7)


@query("g16_star", "SELECT CAST(i AS BIGINT) AS src, CAST(0 AS BIGINT) AS dst FROM range(1, 1 + (SELECT count(*) FROM nation)) t(i)")
def star(spark: SparkSession, d: str) -> DataFrame:
    return graphs.star(spark, table(spark, d, "nation").count() + 1)


@query("g16_random", "SELECT CAST(i AS BIGINT) AS src, true AS inside FROM range(0, 50) t(i)")
def random_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Every vertex of a log-normal graph has edges, all of them and those of an R-MAT graph to known vertices."""
    near, far = graphs.log_normal(spark, 50, 2.0, 0.3), graphs.rmat(spark, 5, 100)
    strays = far.filter("src not between 0 and 31 or dst not between 0 and 31").count()
    return near.groupBy("src").agg((F.min("dst") >= 0).alias("low"), (F.max("dst") < 50).alias("high")).select("src", (F.col("low") & F.col("high") & F.lit(strays == 0)).alias("inside"))
