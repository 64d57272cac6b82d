"""Property graphs as two tables, vertices (id, ...) and edges (src, dst, ...), and algorithms that loop over joins."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import cut


def edge_list(spark: SparkSession, path: str, canonical: bool = False) -> DataFrame:
    """edges of a text file: two ids a line, # starts a comment line; canonical puts the smaller id first."""
    lines = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    ends = F.split(F.trim("value"), r"\s+")
    e = lines.select(ends[0].cast("long").alias("src"), ends[1].cast("long").alias("dst"))
    if canonical:
        e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return e.withColumn("attr", F.lit(1))


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "_s", "dst": "src"}).withColumnRenamed("_s", "dst")


def canonical(edges: DataFrame, attr: str, merge: Callable[[str], Column] = F.sum) -> DataFrame:
    """One edge of each pair of ends, the smaller id first, attributes merged."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(merge(attr).alias(attr))


def triplets(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with the attributes of their ends as structs src_attr and dst_attr."""
    v = vertices.select("id", F.struct("*").alias("a"))
    s = edges.join(v.withColumnsRenamed({"id": "src", "a": "src_attr"}), "src")
    return s.join(v.withColumnsRenamed({"id": "dst", "a": "dst_attr"}), "dst")


def degrees(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(id, degree) of ids that have edges; direction: in, out or both."""
    ends = {"in": [edges.select(F.col("dst").alias("id"))], "out": [edges.select(F.col("src").alias("id"))]}
    ends["both"] = ends["in"] + ends["out"]
    ids = ends[direction][0] if len(ends[direction]) == 1 else ends[direction][0].unionAll(ends[direction][1])
    return ids.groupBy("id").agg(F.count("*").alias("degree"))


def aggregate_messages(vertices: DataFrame, edges: DataFrame, merge: Column, to_src: Column | None = None, to_dst: Column | None = None) -> DataFrame:
    """(id, message): messages, as expressions over a triplet, sent to the ends of each edge and merged per vertex (merge is over column msg).

    Null messages aren't sent. The merge runs map-side, so a hub's messages don't meet in one task.
    """
    t = triplets(vertices, edges)
    sent = [t.select(F.col(end).alias("id"), m.alias("msg")) for end, m in (("src", to_src), ("dst", to_dst)) if m is not None]
    both = sent[0] if len(sent) == 1 else sent[0].unionByName(sent[1])
    return both.filter("msg is not null").groupBy("id").agg(merge.alias("message"))


def collect_neighbour_ids(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    return both.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def pregel(vertices: DataFrame, edges: DataFrame, start: Column, program: Column, merge: Column, to_dst: Column | None = None, to_src: Column | None = None, rounds: int = 20) -> DataFrame:
    """(id, attr): attr starts as start (over the vertex); in each round the messages (over src_attr, dst_attr) are merged (over msg) and program
    (over attr and message) gives the new attr of those that got one. Ends when no attr changes, or after rounds."""
    v = cut(vertices.select("id", start.alias("attr")))
    e = cut(edges.select("src", "dst", *[c for c in edges.columns if c not in ("src", "dst")]))
    for _ in range(rounds):
        m = aggregate_messages(v, e, merge, to_src, to_dst)
        new = cut(v.join(m, "id", "left").select("id", F.when(F.col("message").isNull(), F.col("attr")).otherwise(program).alias("attr"), F.col("attr").alias("_old")))
        changed = new.filter(~F.col("attr").eqNullSafe(F.col("_old"))).limit(1).count()
        v = new.select("id", "attr")
        if not changed:
            break
    return v


def page_rank(edges: DataFrame, rounds: int = 10, reset: float = 0.15, tolerance: float | None = None, source: int | None = None) -> DataFrame:
    """(id, rank), not normalised: rank = reset + (1 - reset) * sum of the neighbours' rank / out-degree, what dead ends hold being lost.

    A fixed number of rounds, or until no rank moves by more than tolerance; source makes it personal: only that id is reset.
    """
    e = cut(edges.select("src", "dst").join(degrees(edges, "out").withColumnsRenamed({"id": "src", "degree": "n"}), "src"))
    base = F.lit(reset) if source is None else F.when(F.col("id") == source, F.lit(reset)).otherwise(F.lit(0.0))
    r = cut(vertices_of(edges).select("id", base.alias("rank")) if source is None else vertices_of(edges).select("id", F.when(F.col("id") == source, F.lit(reset)).otherwise(F.lit(0.0)).alias("rank")))
    ids = r.select("id")
    for _ in range(rounds if tolerance is None else 200):
        sent = e.join(r.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("n")).alias("s"))
        new = cut(ids.join(sent, "id", "left").select("id", (base + (1 - reset) * F.coalesce("s", F.lit(0.0))).alias("rank")))
        if tolerance is not None:
            far = new.join(r.withColumnRenamed("rank", "old"), "id").agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
            r = new
            if far is None or far <= tolerance:
                break
        r = new
    return r


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id that can be reached, edges taken both ways. Labels also jump to their label's label, so long chains take few rounds."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    c = cut((vertices.select("id") if vertices is not None else vertices_of(edges)).select("id", F.col("id").alias("component")))
    for _ in range(rounds):
        m = both.join(c.withColumnsRenamed({"id": "dst", "component": "m"}), "dst").groupBy(F.col("src").alias("id")).agg(F.min("m").alias("m"))
        near = c.join(m, "id", "left").select("id", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        jump = near.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = cut(near.join(jump, "component").select("id", F.least("component", "further").alias("component"), "old"))
        changed = new.filter("component <> old").limit(1).count()
        c = new.select("id", "component")
        if not changed:
            break
    return c


def strongly_connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id of those that reach each other. Colours spread forward, each colour's own reach is taken backward, and what is found leaves the graph."""
    e, left = cut(edges.select("src", "dst").distinct()), cut(vertices_of(edges))
    done = None
    for _ in range(rounds):
        if left.limit(1).count() == 0:
            break
        colour = pregel(left, e, F.col("id"), F.least("attr", "message"), F.min("msg"), to_dst=F.col("src_attr.attr"), rounds=rounds)
        inside = triplets(colour, e).filter("src_attr.attr = dst_attr.attr").select("src", "dst")
        root = colour.select("id", F.struct(F.col("attr").alias("colour"), (F.col("id") == F.col("attr")).alias("hit")).alias("a"))
        reach = pregel(root, inside, F.col("a.hit"), F.col("attr") | F.col("message"), F.max("msg"), to_src=F.col("dst_attr.attr"), rounds=rounds)
        found = colour.join(reach.filter("attr").select("id"), "id").select("id", F.col("attr").alias("component"))
        done = cut(found if done is None else done.union(found))
        left = cut(left.join(done, "id", "left_anti"))
        e = cut(e.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return done if done is not None else left.select("id", F.col("id").alias("component"))


def triangle_count(edges: DataFrame) -> DataFrame:
    """(id, triangles), loops and double edges left out. Edges run from the end of lower degree to the other, which bounds the lists at a hub.

    For each edge u, v the ends of u's edges that rank above v go to v as one array and meet v's own; wedges are never rows.
    """
    e = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    d = degrees(e.withColumnsRenamed({"a": "src", "b": "dst"}))
    e = e.join(d.withColumnsRenamed({"id": "a", "degree": "da"}), "a").join(d.withColumnsRenamed({"id": "b", "degree": "db"}), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    o = e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("s"), F.greatest(F.struct(F.col("da").alias("d"), F.col("a").alias("t")), F.struct(F.col("db").alias("d"), F.col("b").alias("t"))).alias("x"))
    near = cut(o.groupBy("s").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]).alias("n")))
    sent = near.select(F.col("s").alias("u"), "n", F.posexplode("n").alias("k", "v")).filter("k < size(n) - 1").select("u", "v", F.expr("slice(n, k + 2, size(n))").alias("rest"))
    found = sent.join(near.withColumnRenamed("s", "v"), "v").select("u", "v", F.array_intersect("rest", "n").alias("w"))
    parts = F.expr("concat(array(struct(u as id, cast(size(w) as bigint) as n), struct(v as id, cast(size(w) as bigint) as n)), transform(w, x -> struct(x as id, 1L as n)))")
    n = found.select(F.explode(parts).alias("x")).groupBy("x.id").agg(F.sum("x.n").alias("n"))
    return vertices_of(edges).join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("triangles"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label): in each round a vertex takes the commonest label of its neighbours, the smallest of equals."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")))
    v = cut(vertices_of(edges).select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        votes = both.join(v.withColumnRenamed("id", "src"), "src").groupBy("dst", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy(F.col("dst").alias("id")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("new"))
        v = cut(v.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label")))
    return v


def shortest_paths(edges: DataFrame, landmarks: Iterable[int], rounds: int = 100) -> DataFrame:
    """(id, landmark, hops) for each landmark that an id reaches along the edges."""
    spark = edges.sparkSession
    back = cut(edges.select("src", "dst").distinct())
    d = cut(spark.createDataFrame([(x, x, 0) for x in landmarks], "id long, landmark long, hops int"))
    front = d
    for _ in range(rounds):
        step = back.join(front.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "landmark", F.col("hops") + 1).toDF("id", "landmark", "hops").distinct()
        front = cut(step.join(d, ["id", "landmark"], "left_anti"))
        if front.limit(1).count() == 0:
            break
        d = cut(d.union(front))
    return d


def svd_plus_plus(ratings: DataFrame, rank: int = 8, rounds: int = 5, low: float = 0.0, high: float = 5.0, pace: tuple[float, float] = (0.007, 0.007), ridge: tuple[float, float] = (0.005, 0.015)) -> tuple[DataFrame, DataFrame, float]:
    """Matrix factorisation with implicit feedback: (users, items, mean) from ratings (src, dst, rating), a user rating an item once.

    A rating is predicted as mean + b_u + b_i + q_i . (p_u + |N_u|^-1/2 sum of y_j over the items N_u that u rated), cut to low..high.
    Each round sums the gradients of all ratings per user and item and takes one step: pace and ridge are (of biases, of vectors).
    users: id, norm, b, p; items: id, b, q, y. Vectors are columns' arrays of rank doubles; sums run map-side, dimension by dimension.
    """
    e = cut(ratings.select("src", "dst", F.col("rating").cast("double").alias("rating")))
    mean = e.agg(F.avg("rating")).first()[0] or 0.0
    (pace_b, pace_v), (ridge_b, ridge_v), dims = pace, ridge, range(rank)

    def start(salt: str) -> Column:  # the same at every run: a hash of the id, in [-0.5, 0.5) / rank
        return F.array(*[(F.pmod(F.xxhash64(F.lit(salt), F.lit(k), "id"), F.lit(1 << 20)) / float(1 << 20) - 0.5) / rank for k in dims])

    def vector_sum(x: Column) -> list[Column]:
        return [F.sum(x[k]) for k in dims]

    def moved(x: str, step: str, by: float) -> Column:
        return F.zip_with(x, step, lambda a, g: a + by * g)

    users = cut(degrees(e, "out").select("id", (1 / F.sqrt("degree")).alias("norm"), F.lit(0.0).alias("b"), start("p").alias("p")))
    items = cut(degrees(e, "in").select("id", F.lit(0.0).alias("b"), start("q").alias("q"), start("y").alias("y")))
    for _ in range(rounds):
        implicit = e.join(items.select(F.col("id").alias("dst"), "y"), "dst").groupBy(F.col("src").alias("id")).agg(F.array(*vector_sum(F.col("y"))).alias("s"))
        full = cut(users.join(implicit, "id").withColumn("v", F.expr("zip_with(p, s, (a, x) -> a + norm * x)")).drop("s"))
        t = e.join(full.selectExpr("id as src", "norm", "b as bu", "p", "v"), "src").join(items.selectExpr("id as dst", "b as bi", "q", "y"), "dst")
        dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
        guess = F.greatest(F.least(F.lit(mean) + F.col("bu") + F.col("bi") + dot, F.lit(high)), F.lit(low))
        t = cut(t.withColumn("err", F.col("rating") - guess))
        of_users = t.groupBy(F.col("src").alias("id")).agg(
            F.sum(F.col("err") - ridge_b * F.col("bu")).alias("gb"), F.array(*[F.sum(F.col("err") * F.col("q")[k] - ridge_v * F.col("p")[k]) for k in dims]).alias("gp")
        )
        of_items = t.groupBy(F.col("dst").alias("id")).agg(
            F.sum(F.col("err") - ridge_b * F.col("bi")).alias("gb"),
            F.array(*[F.sum(F.col("err") * F.col("v")[k] - ridge_v * F.col("q")[k]) for k in dims]).alias("gq"),
            F.array(*[F.sum(F.col("err") * F.col("norm") * F.col("q")[k] - ridge_v * F.col("y")[k]) for k in dims]).alias("gy"),
        )
        users = cut(users.join(of_users, "id").select("id", "norm", (F.col("b") + pace_b * F.col("gb")).alias("b"), moved("p", "gp", pace_v).alias("p")))
        items = cut(items.join(of_items, "id").select("id", (F.col("b") + pace_b * F.col("gb")).alias("b"), moved("q", "gq", pace_v).alias("q"), moved("y", "gy", pace_v).alias("y")))
    return users, items, mean


def svd_guess(ratings: DataFrame, users: DataFrame, items: DataFrame, mean: float, low: float = 0.0, high: float = 5.0) -> DataFrame:
    """ratings (src, dst, ...) with the guess of a model of svd_plus_plus; the implicit part is of the ratings given here."""
    rank = len((items.select("q").first() or [[]])[0])
    y = ratings.join(items.select(F.col("id").alias("dst"), "y"), "dst").groupBy("src").agg(F.array(*[F.sum(F.col("y")[k]) for k in range(rank)]).alias("s"))
    v = users.withColumnRenamed("id", "src").join(y, "src").selectExpr("src", "b as bu", "zip_with(p, s, (a, x) -> a + norm * x) as v")
    t = ratings.join(v, "src").join(items.selectExpr("id as dst", "b as bi", "q"), "dst")
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda x, z: x + z)
    return t.select(*ratings.columns, F.greatest(F.least(F.lit(mean) + F.col("bu") + F.col("bi") + dot, F.lit(high)), F.lit(low)).alias("guess"))


def grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """Edges to the right and down of a grid whose ids go row by row."""
    n = spark.range(rows * cols)
    right = n.filter((F.col("id") % cols) < cols - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = n.filter(F.col("id") < (rows - 1) * cols).select(F.col("id").alias("src"), (F.col("id") + cols).alias("dst"))
    return right.union(down)


def star(spark: SparkSession, n: int) -> DataFrame:
    """Edges from 1..n-1 to 0."""
    return spark.range(1, n).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))


def log_normal(spark: SparkSession, n: int, mu: float = 4.0, sigma: float = 1.3, seed: int = 1) -> DataFrame:
    """Edges whose out-degrees are log-normal, to ids chosen evenly."""
    size = F.least(F.exp(F.randn(seed) * sigma + mu).cast("int"), F.lit(n - 1))
    wide = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.greatest(size, F.lit(0)))).alias("k")).filter("k > 0")
    return wide.select("src", F.pmod(F.xxhash64("src", "k", F.lit(seed)), F.lit(n)).alias("dst"))


def rmat(spark: SparkSession, scale: int, edges: int, seed: int = 1, a: float = 0.45, b: float = 0.15, c: float = 0.15) -> DataFrame:
    """Distinct edges over 2**scale ids, each bit of both ends drawn by quadrant."""
    s, t = F.lit(0).cast("long"), F.lit(0).cast("long")
    df = spark.range(edges)
    for k in range(scale):
        df = df.withColumn(f"r{k}", F.rand(seed + k))
        r = F.col(f"r{k}")
        s = s * 2 + F.when(r >= a + b, F.lit(1)).otherwise(F.lit(0))
        t = t * 2 + F.when(((r >= a) & (r < a + b)) | (r >= a + b + c), F.lit(1)).otherwise(F.lit(0))
    return df.select(s.alias("src"), t.alias("dst")).distinct()
