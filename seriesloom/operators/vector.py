"""Vector distances, exact search, and an inverted-file index with product quantisation."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """l2; cosine, 1 where a norm is 0; dot, negated."""
    if metric == "l2":
        return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))
    if metric == "dot":
        return -dot(a, b)
    if metric == "cosine":
        n = norm(a) * norm(b)
        return F.when(n > 0, 1 - dot(a, b) / F.when(n > 0, n)).otherwise(1.0)
    raise ValueError(f"unknown metric {metric}")


def cosine_similarity(a: Column, b: Column) -> Column:
    """With a small term under the bar, so zero vectors give 0; other lengths raise an error when run."""
    same = F.when(F.size(a) == F.size(b), dot(a, b) / (norm(a) * norm(b) + 1e-10))
    return F.coalesce(same, F.raise_error(F.lit("vectors differ in length")).cast("double"))


def normalize(a: Column) -> Column:
    """Of length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / F.when(n > 0, n))).otherwise(a)


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def score(d: Column, metric: str = "l2") -> Column:
    """Higher is nearer. For dot the similarity itself, since 1 / (1 + d) has a pole there."""
    return -d if metric == "dot" else 1 / (1 + d)


def nearest(vectors: DataFrame, query: list[float], k: int, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """The k vectors nearest to one query, of those that pass `where`: a scan and a top-k, no shuffle of vectors."""
    if where is not None:
        vectors = vectors.where(where)
    d = distance(F.col("embedding"), literal(query), metric)
    return vectors.withColumn("distance", d).withColumn("score", score(F.col("distance"), metric)).orderBy("distance", "id").limit(k)


def assign_lists(vectors: DataFrame, centroids: DataFrame, metric: str = "l2") -> DataFrame:
    """vectors with list_id, the nearest of centroids (list_id, centroid): there are as many as the index has lists, a bounded number."""
    pairs = vectors.join(F.broadcast(centroids.select(F.array_sort(F.collect_list(F.struct("list_id", "centroid"))).alias("cs"))))
    near = F.transform("cs", lambda c: F.struct(distance(F.col("embedding"), c["centroid"], metric).alias("d"), c["list_id"].alias("list_id")))
    return pairs.withColumn("list_id", F.array_min(near)["list_id"]).drop("cs")


def probe(indexed: DataFrame, centroids: DataFrame, query: list[float], k: int, nprobe: int, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """The k nearest within the nprobe lists nearest to the query, by exact distances; lists prune the scan if partitioned."""
    lists = centroids.withColumn("d", distance(F.col("centroid"), literal(query), metric)).orderBy("d", "list_id").limit(nprobe).select("list_id")
    return nearest(indexed.join(F.broadcast(lists), "list_id", "left_semi"), query, k, metric, where)


def train_lists(vectors: DataFrame, lists: int, seed: int = 42, iterations: int = 20) -> DataFrame:
    """Centroids by distributed k-means: (list_id, centroid)."""
    model = KMeans(k=lists, seed=seed, maxIter=iterations, featuresCol="f").fit(vectors.select(array_to_vector("embedding").alias("f")))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "list_id int, centroid array<double>")


def subvectors(m: int, dim: int, of: str = "embedding") -> list[Column]:
    if dim % m:
        raise ValueError("the length must be divisible by the number of subspaces")
    return [F.slice(of, i * (dim // m) + 1, dim // m) for i in range(m)]


def residuals(indexed: DataFrame, centroids: DataFrame) -> DataFrame:
    """embedding minus the centroid of its list."""
    joined = indexed.join(F.broadcast(centroids), "list_id")
    return joined.withColumn("embedding", F.zip_with("embedding", "centroid", lambda x, y: x - y)).drop("centroid")


def train_codebook(vectors: DataFrame, m: int, codes: int, dim: int, seed: int = 42, iterations: int = 10) -> DataFrame:
    """(sub, code, word): k-means in each of m subspaces."""
    rows = []
    for i, part in enumerate(subvectors(m, dim)):
        model = KMeans(k=codes, seed=seed, maxIter=iterations, featuresCol="f").fit(vectors.select(array_to_vector(part).alias("f")))
        rows += [(i, c, [float(x) for x in w]) for c, w in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "sub int, code int, word array<double>")


def encode(vectors: DataFrame, codebook: DataFrame, m: int, dim: int) -> DataFrame:
    """codes: the nearest word in each subspace. The codebook has m * codes rows, a bounded number."""
    books = codebook.select(F.array_sort(F.collect_list(F.struct("sub", "code", "word"))).alias("cb"))
    parts = subvectors(m, dim)

    def nearest_code(i: int) -> Column:
        words = F.filter("cb", lambda c: c["sub"] == i)
        return F.array_min(F.transform(words, lambda c: F.struct(distance(parts[i], c["word"]).alias("d"), c["code"].alias("code"))))["code"]

    return vectors.join(F.broadcast(books)).withColumn("codes", F.array(*[nearest_code(i) for i in range(m)])).drop("cb")


def decode(coded: DataFrame, codebook: DataFrame, m: int) -> DataFrame:
    books = codebook.select(F.array_sort(F.collect_list(F.struct("sub", "code", "word"))).alias("cb"))

    def word(i: int) -> Column:
        return F.filter("cb", lambda c: (c["sub"] == i) & (c["code"] == F.col("codes")[i]))[0]["word"]

    return coded.join(F.broadcast(books)).withColumn("decoded", F.flatten(F.array(*[word(i) for i in range(m)]))).drop("cb")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """The share of exact (query_id, id) that was found."""
    hits = exact.join(found.select("query_id", "id").distinct().withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def list_sizes(indexed: DataFrame) -> DataFrame:
    return indexed.groupBy("list_id").agg(F.count("*").alias("n"))


def choose_index(rows: int, dim: int, memory_bytes: int, exact_below: int = 100_000) -> str:
    """exact, lists or quantized: the plainest that fits."""
    if rows < exact_below:
        return "exact"
    return "lists" if rows * dim * 4 <= memory_bytes else "quantized"


def nearest_in_time(samples: DataFrame, vectors: DataFrame, within_ms: int) -> DataFrame:
    """Vectors within so many ms of each sample: an equi-join on buckets of that length and their neighbours."""
    left = samples.withColumn("b", F.explode(F.sequence(F.floor((F.col("ts_ms") - within_ms) / within_ms), F.floor((F.col("ts_ms") + within_ms) / within_ms))))
    right = vectors.select(F.col("id"), F.col("ts_ms").alias("vector_ms"), F.floor(F.col("ts_ms") / within_ms).alias("b"))
    return left.join(right, "b").where(F.abs(F.col("vector_ms") - F.col("ts_ms")) <= within_ms).drop("b")


def peaks(samples: DataFrame, deviations: float) -> DataFrame:
    """Samples so many standard deviations above their series' mean."""
    # aggregated partially, then joined, so one series with most of the samples is no single task
    limits = samples.groupBy("series_key").agg((F.avg("value") + deviations * F.stddev_pop("value")).alias("limit"))
    return samples.join(limits, "series_key").where("value > limit").select(*samples.columns)
