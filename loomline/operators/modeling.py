"""Model-side operators: folds, purchase models, generators, dimension reduction, clusterings, imputation by neighbours, and a stored vector index."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .index import choose_backend, forest_knn
from .ordered import quantiles, running_total
from .search import code_plan, distance, hyperplanes, knn_join, lsh_codes, sign_codes


def fold_of(key: list[str], folds: int, seed: int = 0) -> Column:
    """A fold from 0 by a hash of the key: the same on every run and any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), F.lit(folds)).cast("int")


def roc_auc_by_group(df: DataFrame, group: str, positive: Column, score: str) -> DataFrame:
    """(group, auc, n_pos, n_neg): the area of every group in one pass over distinct scores; null where a class is missing."""
    x = df.select(F.col(group).alias("g"), positive.alias("y"), F.col(score).cast("double").alias("s")).where("g is not null and y is not null and s is not null and not isnan(s)")
    c = x.groupBy("g", "s").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum((~F.col("y")).cast("long")).alias("neg"))
    t = running_total(c, [F.desc("s")], {"tp": "pos"}, by=["g"])
    return t.groupBy(F.col("g").alias(group)).agg(F.try_divide(F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0), F.sum("pos") * F.sum("neg")).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def confusion_by_fold(df: DataFrame, fold: Column, truth: str, pred: str) -> DataFrame:
    """(fold, truth, pred, n, share of the fold's true label)."""
    c = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(fold.alias("fold"), F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("fold", "truth")))


def _hyp2f1(a: float, b: np.ndarray, c: float, z: np.ndarray, terms: int = 2000) -> np.ndarray:
    """The Gauss hypergeometric series for 0 <= z < 1."""
    out = np.ones_like(z)
    term = np.ones_like(z)
    for k in range(terms):
        term = term * (a + k) * (b + k) / (c + k) / (k + 1) * z
        out = out + term
        if np.max(np.abs(term), initial=0) < 1e-12 * np.max(np.abs(out), initial=1):
            break
    return out


def expected_purchases(t: Column, r: float, alpha: float, a: float, b: float) -> Column:
    """Purchases that the beta-geometric negative-binomial model expects of a new customer by time t (a other than 1)."""

    @F.pandas_udf(T.DoubleType())
    def f(s: pd.Series) -> pd.Series:
        x = s.to_numpy(float)
        z = x / (alpha + x)
        return pd.Series((a + b - 1) / (a - 1) * (1 - (alpha / (alpha + x)) ** r * _hyp2f1(r, np.full_like(z, b), a + b - 1, z)))

    return f(t.cast("double"))


def generate_bgnbd(spark: SparkSession, customers: int, t: float, r: float, alpha: float, a: float, b: float, seed: int = 0) -> DataFrame:
    """(customer, frequency, recency, t): customers drawn from the model; each draws from a generator of its own, so partitioning doesn't matter."""

    def run(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                g = np.random.default_rng((seed, int(i)))
                rate, drop = g.gamma(r, 1 / alpha), g.beta(a, b)
                at, n, last = 0.0, 0, 0.0
                while True:
                    at += g.exponential(1 / rate)
                    if at > t:
                        break
                    n, last = n + 1, at
                    if g.random() < drop:
                        break
                out.append((int(i), n, last, t))
            yield pd.DataFrame(out, columns=["customer", "frequency", "recency", "t"])

    return spark.range(customers).mapInPandas(run, "customer long, frequency long, recency double, t double")


def frequency_recency_grid(spark: SparkSession, top_frequency: int, top_recency: int, value) -> DataFrame:
    """(frequency, recency, value) over both ranges; ``value`` maps the two columns to one."""
    g = spark.range(top_frequency + 1).select(F.col("id").alias("frequency"), F.explode(F.sequence(F.lit(0), F.lit(top_recency))).alias("recency"))
    return g.withColumn("value", value(F.col("frequency"), F.col("recency")))


def pca(df: DataFrame, vector: str, k: int) -> tuple[DataFrame, list[float]]:
    """The frame with a column of k principal components, and the share of variance of each."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.where(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    m = PCA(k=k, inputCol="_v", outputCol="_p").fit(x)
    return m.transform(x).withColumn("components", vector_to_array("_p")).drop("_v", "_p"), m.explainedVariance.toArray().tolist()


def kmeans_elbow(df: DataFrame, vector: str, ks: list[int], seed: int = 1) -> DataFrame:
    """(k, inertia) for each number of clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features")).persist()
    rows = [(k, float(KMeans(k=k, seed=seed).fit(x).summary.trainingCost)) for k in ks]
    x.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


def text_classifier(df: DataFrame, text: str, label: str, features: int = 1 << 12):
    """A fitted pipeline of hashed term frequencies, inverse document frequencies and logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer

    stages = [StringIndexer(inputCol=label, outputCol="label_index"), RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\W+"), HashingTF(inputCol="_w", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="features"), LogisticRegression(featuresCol="features", labelCol="label_index", maxIter=20)]
    return Pipeline(stages=stages).fit(df.where(F.col(text).isNotNull() & F.col(label).isNotNull()))


def impute_by_neighbours(df: DataFrame, key: str, vector: str, column: str, k: int = 5) -> DataFrame:
    """Fills a column's nulls with the mean of the k nearest rows (by vector) that have it; rows without a vector stay null."""
    have, lack = df.where(F.col(column).isNotNull()), df.where(F.col(column).isNull())
    # exact while the comparisons are bounded, else among the leaves of a projection forest
    if choose_backend("auto", lack.count(), have.count()) == "exact":
        found = knn_join(lack, have, key, vector, k)
    else:
        found = forest_knn(lack, have, key, vector, k)
    near = found.join(have.select(F.col(key).cast("long").alias("item_id"), F.col(column).cast("double").alias("v")), "item_id")
    fill = near.groupBy("query_id").agg(F.avg("v").alias("_f"))
    return df.join(fill, F.col(key) == F.col("query_id"), "left").withColumn(column, F.coalesce(F.col(column).cast("double"), F.col("_f"))).drop("_f", "query_id")


def save_index(df: DataFrame, path: str, key: str, vector: str, tables: int | None = None, bits: int | None = None, seed: int = 5) -> None:
    """Writes a vector index: the vectors by id, their hyperplane codes sorted by code, so that a query's filter skips most of the codes' row groups, and one row of settings. Every row is indexed; tables and bits follow their number unless given."""
    x = df.where(F.col(vector).isNotNull())
    s = x.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    if tables is None or bits is None:
        tables, bits = code_plan(s.n)
    dims = s.d or 0
    codes = lsh_codes(x, key, vector, hyperplanes(dims, tables, bits, seed), tables, bits, False, "id")
    codes.repartitionByRange("code").sortWithinPartitions("code").write.mode("overwrite").parquet(f"{path}/codes")
    x.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).write.mode("overwrite").parquet(f"{path}/vectors")
    df.sparkSession.createDataFrame([(dims, tables, bits, seed)], "dims int, tables int, bits int, seed long").write.mode("overwrite").parquet(f"{path}/settings")


def _settings(spark: SparkSession, path: str) -> tuple[np.ndarray, int, int]:
    s = spark.read.parquet(f"{path}/settings").first()
    return hyperplanes(s.dims, s.tables, s.bits, s.seed), s.tables, s.bits


def query_index(spark: SparkSession, path: str, query: list[float], k: int) -> DataFrame:
    """(id, score) of the nearest vectors among those that share a code, or all signs but one, with the query in any table."""
    planes, tables, bits = _settings(spark, path)
    probes = sign_codes(np.asarray([query], float), planes, tables, bits, True)[0]
    near = spark.read.parquet(f"{path}/codes").where(F.col("code").isin([int(c) for c in probes])).select("id").distinct()
    got = spark.read.parquet(f"{path}/vectors").join(near, "id", "left_semi")
    return got.select("id", F.round(distance(F.col("vector"), F.array(*[F.lit(float(v)) for v in query]), "cosine"), 8).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def query_index_all(queries: DataFrame, path: str, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, item_id, score, rank): as ``query_index`` for every row of ``queries`` that has a vector, in one join with the stored codes; ties by item."""
    spark = queries.sparkSession
    x = queries.where(F.col(vector).isNotNull())
    probes = lsh_codes(x, key, vector, *_settings(spark, path), True, "query_id")
    codes = spark.read.parquet(f"{path}/codes").withColumnRenamed("id", "item_id")
    pairs = probes.join(codes, "code").select("query_id", "item_id").distinct()
    items = spark.read.parquet(f"{path}/vectors").toDF("item_id", "v")
    own = x.select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("q"))
    scored = pairs.join(own, "query_id").join(items, "item_id").select("query_id", "item_id", F.round(distance(F.col("v"), F.col("q"), "cosine"), 8).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Bins counted in one pass of ``knuth_bins``, over all numbers of bins together.
CELLS = 1 << 20


def _knuth_scores(counted: DataFrame, n: int, lo: float, hi: float, first: int, last: int) -> dict[int, float]:
    """Knuth's posterior of each number of bins from ``first`` to ``last``; bins are exact, the last one closed."""
    base = np.concatenate(([0], np.cumsum(np.arange(first, last + 1))))

    def count(batches):
        out = np.zeros(base[-1], np.int64)
        for pdf in batches:
            pdf = pdf.sort_values("x")
            x, cum = pdf["x"].to_numpy(), np.concatenate(([0], np.cumsum(pdf["n"].to_numpy())))
            for k, m in enumerate(range(first, last + 1)):
                at = np.append(np.searchsorted(x, np.linspace(lo, hi, m + 1)[:-1]), len(x))
                out[base[k] : base[k + 1]] += np.diff(cum[at])
        cell = np.flatnonzero(out)
        yield pd.DataFrame({"m": np.searchsorted(base, cell, side="right") - 1 + first, "cell": cell, "n": out[cell]})

    def gain(batches):
        half = math.lgamma(0.5)
        for pdf in batches:
            yield pd.DataFrame({"m": pdf["m"], "g": [math.lgamma(c + 0.5) - half for c in pdf["n"]]})

    cells = counted.mapInPandas(count, "m long, cell long, n long").groupBy("m", "cell").agg(F.sum("n").alias("n")).select("m", "n")
    got = cells.mapInPandas(gain, "m long, g double").groupBy("m").agg(F.sum("g").alias("g")).collect()
    return {r.m: n * math.log(r.m) + math.lgamma(r.m / 2) - math.lgamma(n + r.m / 2) + r.g for r in got}


def knuth_bins(df: DataFrame, column: str) -> int:
    """The number of equal bins that maximises Knuth's posterior.

    Every number from 1 to twice that of the Freedman rule is measured exactly;
    the range doubles while the best lies in its upper half, up to one bin a row.
    """
    counted = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)").groupBy("x").agg(F.count("*").alias("n"))
    s = counted.agg(F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not s.n or s.lo == s.hi:
        return 1
    counted = materialise(counted, "values")
    q = quantiles(df, column, {"a": 0.25, "z": 0.75}).first()
    width = 2 * (q.z - q.a) / s.n ** (1 / 3)
    start = math.ceil(min(s.n, (s.hi - s.lo) / width)) if width else math.ceil(s.n ** (1 / 3))
    done, top, best = 0, min(s.n, 2 * start), (-math.inf, 1)
    while done < top:
        last = done + 1
        while last < top and (last + 1) * (last + 2) // 2 - done * (done + 1) // 2 <= CELLS:
            last += 1
        got = _knuth_scores(counted, s.n, s.lo, s.hi, done + 1, last)
        best = max([best, *((p, m) for m, p in got.items())], key=lambda b: (b[0], -b[1]))
        done = last
        if done == top and 2 * best[1] > top:
            top = min(s.n, 2 * top)
    return best[1]


def fold_intervals(df: DataFrame, start: str, end: str, weight: str, bins: int) -> DataFrame:
    """(bin, exposure): weighted length of intervals folded onto [0, 1) and cut into equal bins. Whole turns are added at once, so a long interval costs no more rows than bins."""
    x = df.select(F.col(start).cast("double").alias("a"), F.col(end).cast("double").alias("z"), F.col(weight).cast("double").alias("w")).where("a is not null and z > a and w is not null")
    b = x.select("a", "z", "w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    lo, hi = F.col("bin") / bins, (F.col("bin") + 1) / bins
    covered = lambda t: F.floor(t) / bins + F.greatest(F.lit(0.0), F.least(t - F.floor(t), hi) - lo)
    return b.groupBy("bin").agg(F.sum(F.col("w") * (covered(F.col("z")) - covered(F.col("a")))).alias("exposure"))


def signal_to_noise(t: Column, source: Column, sky: Column, dark: Column, read: Column, pixels: Column) -> Column:
    """The signal-to-noise ratio of an exposure of a detector."""
    return F.try_divide(t * source, F.sqrt(t * (source + pixels * (sky + dark)) + pixels * read * read))


def fwhm_to_sigma(x: Column) -> Column:
    return x / (2 * math.sqrt(2 * math.log(2)))


def aic(log_likelihood: Column, k: Column, n: Column) -> Column:
    return 2 * k - 2 * log_likelihood + F.when(n / k < 40, F.try_divide(2 * k * (k + 1), n - k - 1)).otherwise(0.0)


def bic(log_likelihood: Column, k: Column, n: Column) -> Column:
    return k * F.log(n) - 2 * log_likelihood
