"""Learning and statistics: transitions, conjugate updates, tests, centroids, clusters and linear models."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.bars import daily_bars
from tickloom.functions import windows as W
from tickloom.operators.rolling import r
from tickloom.plans.sql import daily, over
from tickloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"""WITH {daily()}, s AS (SELECT symbol, d, CASE WHEN close > lag(close) {over()} * 1.02::DOUBLE THEN 'up' WHEN close < lag(close) {over()} * 0.98::DOUBLE THEN 'down' ELSE 'flat' END AS state FROM bars), t AS (SELECT state AS a, lead(state) {over()} AS b FROM s),
 n AS (SELECT a, b, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY 1, 2), g AS (SELECT x.a, y.b FROM (VALUES ('up'), ('down'), ('flat')) x(a), (VALUES ('up'), ('down'), ('flat')) y(b))
 SELECT a, b, coalesce(n, 0) AS n, round((coalesce(n, 0) + 1) / CAST(sum(coalesce(n, 0) + 1) OVER (PARTITION BY a) AS DOUBLE), 6) AS p FROM g LEFT JOIN n USING (a, b)""")
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laplace-smoothed transitions between rising, falling and flat days; nine cells, counted with partial sums."""
    c = W.ref("close")
    s = daily_bars(spark, sf_dir).select("symbol", "d", F.when(F.col("close") > c * 1.02, "up").when(F.col("close") < c * 0.98, "down").otherwise("flat").alias("a"))
    t = s.select("a", F.lead("a").over(W.by_time()).alias("b")).where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    states = ["up", "down", "flat"]
    grid = spark.createDataFrame([(x, y) for x in states for y in states], "a string, b string")
    full = grid.join(t, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("p", F.round((F.col("n") + 1) / F.sum(F.col("n") + 1).over(Window.partitionBy("a")), 6))


@query("""SELECT event_type, count(*) AS n, round((50 / 100.0::DOUBLE + sum(value) / 400.0::DOUBLE) / (1 / 100.0::DOUBLE + count(*) / 400.0::DOUBLE), 6) AS mean, round(sqrt(1 / (1 / 100.0::DOUBLE + count(*) / 400.0::DOUBLE)), 6) AS sd FROM events GROUP BY 1""")
def conjugate_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal beliefs (mean 50, deviation 10) updated by all events of a type at once (deviation 20): order-free sums."""
    precision = 1 / 100.0 + F.count("*") / 400.0
    g = table(spark, sf_dir, "events").groupBy("event_type")
    return g.agg(F.count("*").alias("n"), r("mean", (50 / 100.0 + F.sum("value") / 400.0) / precision), r("sd", F.sqrt(1 / precision)))


@query("""WITH m AS (SELECT count(*) FILTER (WHERE event_type = 'click') AS n1, count(*) FILTER (WHERE event_type = 'view') AS n2, avg(value) FILTER (WHERE event_type = 'click') AS m1, avg(value) FILTER (WHERE event_type = 'view') AS m2,
 var_samp(value) FILTER (WHERE event_type = 'click') AS v1, var_samp(value) FILTER (WHERE event_type = 'view') AS v2 FROM events) SELECT n1, n2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS effect FROM m""")
def two_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Welch's t and Cohen's d of two groups from their moments."""
    one = lambda f, t: f(F.when(F.col("event_type") == t, F.col("value")))
    m = table(spark, sf_dir, "events").agg(*[one(f, t).alias(f"{n}{k}") for k, t in ((1, "click"), (2, "view")) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    off = F.col("m1") - F.col("m2")
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    return m.select("n1", "n2", r("t", off / F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))), r("effect", off / F.sqrt(pooled)))


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label AS centre, i, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY 1, 2),
 s AS (SELECT vec_id, centre, sum((v - m) * (v - m)) AS far FROM x JOIN c USING (i) GROUP BY 1, 2) SELECT vec_id, arg_min(centre, (round(far, 9), centre)) AS centre, round(sqrt(min(far)), 5) AS distance FROM s GROUP BY 1""")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest class mean. There is one centroid a class, sent as one small array of bounded size."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    means = e.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    c = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    centres = c.agg(F.collect_list(F.struct(F.col("label").alias("centre"), "m")).alias("cs"))
    far = lambda s: F.aggregate(F.zip_with("x", s["m"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, y: t + y)
    near = F.array_min(F.transform("cs", lambda s: F.struct(F.round(far(s), 9).alias("far"), s["centre"].alias("centre"))))
    return e.join(F.broadcast(centres)).select("vec_id", near.alias("n")).select("vec_id", F.col("n.centre").alias("centre"), r("distance", F.sqrt("n.far"), 5))


@query()
def cluster_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-means clusters of the embeddings (scalable seeding, 50 iterations, tolerance 1e-3), numbered by their size."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=5, seed=7, maxIter=50, tol=1e-3, initMode="k-means||").fit(e)
    found = model.transform(e).select("vec_id", "prediction")
    sizes = found.groupBy("prediction").agg(F.count("*").alias("n"))
    order = sizes.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("n"), "prediction")) - 1)
    return found.join(order, "prediction").select("vec_id", "cluster", F.col("n").alias("size"))


@query()
def model_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic regression on rolling features of the bars; weights are the coefficients' sizes against the largest,
    times three, between 0.5 and 4."""
    names = ["momentum", "volume", "place"]
    f = daily_bars(spark, sf_dir).select(
        "symbol", "d", W.change("close", 5).alias("momentum"), W.ratio("volume", W.ma("volume", 20)).alias("volume"),
        W.ratio(F.col("close") - W.lowest("low", 20), W.highest("high", 20) - W.lowest("low", 20)).alias("place"),
        (F.lead("close", 5).over(W.by_time()) > F.col("close")).cast("double").alias("label"),
    ).dropna()
    x = VectorAssembler(inputCols=names, outputCol="features").transform(f)
    model = LogisticRegression(regParam=0.01, standardization=True).fit(x)
    sizes = [abs(c) for c in model.coefficients.toArray().tolist()]
    top = max(sizes) or 1.0
    return spark.createDataFrame([(n, float(min(max(s / top * 3, 0.5), 4.0))) for n, s in zip(names, sizes)], "feature string, weight double")


@query(f"""WITH {daily()}, f AS (SELECT symbol, d, (close / nullif(lag(close) {over()}, 0) - 1) * 100 AS chg FROM bars), w AS (SELECT symbol, d, list(chg) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS x, row_number() {over()} AS rn, max(d) OVER (PARTITION BY symbol) AS last FROM f),
 q AS (SELECT symbol, x AS q FROM w WHERE d = last), s AS (SELECT w.symbol, w.d, list_cosine_similarity(w.x, q.q) AS sim FROM w JOIN q USING (symbol) WHERE w.rn > 10 AND w.d < w.last)
 SELECT symbol, d, round(sim, 5) AS sim FROM s QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sim DESC, d) <= 5""")
def similar_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five windows of ten changes most like a symbol's latest one, by cosine similarity."""
    f = daily_bars(spark, sf_dir).select("symbol", "d", W.change("close").alias("chg"))
    w = f.select("symbol", "d", F.collect_list("chg").over(W.back(10)).alias("x"), W.row().alias("rn"), F.max("d").over(Window.partitionBy("symbol")).alias("last"))
    w = w.where("rn > 10")
    q = w.where("d = last").select("symbol", F.col("x").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    s = w.where("d < last").join(q, "symbol").select("symbol", "d", (dot("x", "q") / (F.sqrt(dot("x", "x")) * F.sqrt(dot("q", "q")))).alias("sim"))
    top = Window.partitionBy("symbol").orderBy(F.desc("sim"), "d")
    return s.withColumn("place", F.row_number().over(top)).where("place <= 5").select("symbol", "d", r("sim", "sim", 5))
