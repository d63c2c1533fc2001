"""Evaluation by group: curves for folds, models or hues with weights, input validation, residual families, baselines and exact silhouettes.

Rows with a null group, truth or score, or a NaN score, are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .ordered import quantiles, running_total


def counts_by_group(df: DataFrame, group: str, positive: Column, score: str, weight: str | None = None) -> DataFrame:
    """(g, s, pos, neg) by distinct score of a group, weights summed."""
    w = F.col(weight).cast("double") if weight else F.lit(1).cast("long")
    x = df.select(F.col(group).alias("g"), positive.alias("y"), F.col(score).cast("double").alias("s"), w.alias("w")).where("g is not null and y is not null and s is not null and not isnan(s)")
    zero = F.lit(0.0) if weight else F.lit(0).cast("long")
    return x.groupBy("g", "s").agg(F.sum(F.when(F.col("y"), F.col("w")).otherwise(zero)).alias("pos"), F.sum(F.when(~F.col("y"), F.col("w")).otherwise(zero)).alias("neg"))


def curves_by_group(df: DataFrame, group: str, positive: Column, score: str, weight: str | None = None) -> DataFrame:
    """(group, threshold, fpr, tpr, precision, pos, neg, tp, fp, all_pos, all_neg) at every distinct score of every group, from the highest down."""
    c = counts_by_group(df, group, positive, score, weight)
    r = running_total(c, [F.desc("s")], {"tp": "pos", "fp": "neg"}, {"all_pos": "pos", "all_neg": "neg"}, ["g"])
    return r.select(
        F.col("g").alias(group), F.col("s").alias("threshold"), F.try_divide("fp", "all_neg").alias("fpr"), F.try_divide("tp", "all_pos").alias("tpr"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), "pos", "neg", "tp", "fp", "all_pos", "all_neg",
    )


def scores_by_group(df: DataFrame, group: str, positive: Column, score: str, weight: str | None = None) -> DataFrame:
    """(group, auc, average_precision, ks) of every group: area by the trapezoid rule, precision times gain in recall, and the largest distance of the class distributions."""
    c = curves_by_group(df, group, positive, score, weight)
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0)
    both = F.max("all_pos") * F.max("all_neg")
    ap = F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.max("all_pos"))
    return c.groupBy(group).agg(F.try_divide(area, both).alias("auc"), ap.alias("average_precision"), F.max(F.col("tpr") - F.col("fpr")).alias("ks"))


def fold_summary(scores: DataFrame, *columns: str) -> DataFrame:
    """One row: the mean and population deviation over folds of each column."""
    return scores.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_std") for c in columns])


def check_classes(df: DataFrame, truth: str, most: int = 1000) -> list:
    """The sorted classes of a label column; fewer than two, or more than ``most``, raise."""
    got = [r[0] for r in df.where(F.col(truth).isNotNull()).select(truth).distinct().limit(most + 1).collect()]
    if len(got) < 2:
        raise ValueError(f"{truth} has {len(got)} class(es); at least two are needed")
    if len(got) > most:
        raise ValueError(f"{truth} has more than {most} classes")
    return sorted(got)


def one_hot_truth(df: DataFrame, truth: str, positive: object | None = None, out: str = "y") -> DataFrame:
    """Adds the truth as a boolean (two classes: against ``positive``, by default the second class) or as an array of 0 and 1 in the order of the classes."""
    classes = check_classes(df, truth)
    if len(classes) == 2 or positive is not None:
        pick = classes[1] if positive is None else positive
        if pick not in classes:
            raise ValueError(f"{pick!r} is no class of {truth}")
        return df.withColumn(out, F.col(truth) == pick)
    return df.withColumn(out, F.when(F.col(truth).isNotNull(), F.array(*[(F.col(truth) == c).cast("int") for c in classes])))


def class_score(df: DataFrame, scores: str, index: int | None = None, rescale: bool = False, out: str = "s") -> DataFrame:
    """Adds the score of one class from a number or an array column. Arrays of different lengths, and an index outside of them, raise; ``rescale`` maps the column to 0..1 over the table."""
    kind = dict(df.dtypes)[scores]
    if kind.startswith("array"):
        sizes = [r[0] for r in df.where(F.col(scores).isNotNull()).select(F.size(scores)).distinct().limit(2).collect()]
        if len(sizes) > 1:
            raise ValueError("score arrays of different lengths")
        at = (sizes[0] - 1 if sizes else 0) if index is None else index
        if sizes and not 0 <= at < sizes[0]:
            raise ValueError(f"class {at} of {sizes[0]}")
        x = df.withColumn(out, F.get(F.col(scores), at).cast("double"))
    else:
        x = df.withColumn(out, F.col(scores).cast("double"))
    if not rescale:
        return x
    s = x.where(~F.isnan(out)).agg(F.min(out).alias("_lo"), F.max(out).alias("_hi"))
    y = x.join(F.broadcast(s))
    return y.withColumn(out, F.when(F.col("_hi") > F.col("_lo"), (F.col(out) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.when(F.col(out).isNotNull(), 0.0))).drop("_lo", "_hi")


def fit_families(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(family, a, b) of the residuals by moments, medians and ranges: normal (mean, deviation), laplace (median, mean distance to it), logistic (mean, scale), gumbel (location, scale), uniform (least, greatest), and of their absolute values exponential (0, mean) and lognormal (mean and deviation of the logarithm of those above 0)."""
    r = df.select((F.col(truth) - F.col(pred)).cast("double").alias("r")).where("r is not null and not isnan(r)")
    med = quantiles(r, "r", {"med": 0.5})
    x = r.join(F.broadcast(med))
    log = F.when(F.col("r") != 0, F.log(F.abs("r")))
    s = x.agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("sd"), F.max("med").alias("med"), F.avg(F.abs(F.col("r") - F.col("med"))).alias("mad"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.avg(F.abs("r")).alias("abs"), F.avg(log).alias("lm"), F.stddev_pop(log).alias("ls")).where("m is not null")
    beta = F.col("sd") * math.sqrt(6) / math.pi
    row = lambda n, a, b: F.struct(F.lit(n).alias("family"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    rows = F.array(
        row("normal", F.col("m"), F.col("sd")), row("laplace", F.col("med"), F.col("mad")), row("logistic", F.col("m"), F.col("sd") * math.sqrt(3) / math.pi),
        row("gumbel", F.col("m") - 0.5772156649015329 * beta, beta), row("uniform", F.col("lo"), F.col("hi")), row("exponential", F.lit(0.0), F.col("abs")), row("lognormal", F.col("lm"), F.col("ls")),
    )
    return s.select(F.explode(rows).alias("f")).select("f.*")


def probability_plot(df: DataFrame, column: str, points: int = 99) -> DataFrame:
    """(p, expected, observed): quantiles of a column against those of a normal distribution, at evenly spaced shares."""
    from .intervals import _normal_quantile

    shares = [k / (points + 1) for k in range(1, points + 1)]
    q = quantiles(df, column, {f"q{i}": p for i, p in enumerate(shares)})
    rows = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(_normal_quantile(p)).alias("expected"), F.col(f"q{i}").alias("observed")) for i, p in enumerate(shares)])
    return q.select(F.explode(rows).alias("r")).select("r.*")


def dummy_regressor(df: DataFrame, target: str, strategy: str = "mean", value: float = 0.5, weight: str | None = None) -> DataFrame:
    """One row (prediction): the mean, median, quantile (``value``) or a constant (``value``), with weights if given. A weighted quantile is the least value at which the running weight reaches its share."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = df.select(F.col(target).cast("double").alias("x"), w.alias("w")).where("x is not null and not isnan(x) and w > 0")
    if strategy == "constant":
        return df.sparkSession.range(1).select(F.lit(float(value)).alias("prediction"))
    if strategy == "mean":
        return x.agg(F.try_divide(F.sum(F.col("x") * F.col("w")), F.sum("w")).alias("prediction"))
    p = 0.5 if strategy == "median" else float(value)
    if not weight:
        return quantiles(x, "x", {"prediction": p})
    c = x.groupBy("x").agg(F.sum("w").alias("w"))
    r = running_total(c, [F.asc("x")], {"cum": "w"}, {"all": "w"})
    return r.agg(F.min(F.when(F.col("cum") >= p * F.col("all"), F.col("x"))).alias("prediction"))


def silhouette_of(queries: DataFrame, df: DataFrame, key: str, vector: str, cluster: str) -> DataFrame:
    """(key, cluster, a, b, silhouette) by Euclidean distance of a stated set of rows against all rows: mean distance within the own cluster and to the nearest other one.

    Blocks of queries meet blocks of rows, and each pair of blocks sends sums by cluster only.
    """
    block = 1024

    def pack(x: DataFrame, name: str) -> DataFrame:
        def run(batches):
            for pdf in batches:
                for a in range(0, len(pdf), block):
                    p = pdf.iloc[a : a + block]
                    yield pd.DataFrame({f"{name}_id": [p["id"].tolist()], f"{name}_c": [p["c"].tolist()], f"{name}_m": [np.array(p["v"].tolist(), np.float64).tobytes()]})

        some = x.where(F.col(vector).isNotNull() & F.col(cluster).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(cluster).cast("string").alias("c"), F.col(vector).cast("array<double>").alias("v"))
        return some.mapInPandas(run, f"{name}_id array<long>, {name}_c array<string>, {name}_m binary")

    def meet(batches):
        for pdf in batches:
            out = []
            for qi, qc, qm, ii, ic, im in pdf.itertuples(index=False):
                q, x = np.frombuffer(qm, np.float64).reshape(len(qi), -1), np.frombuffer(im, np.float64).reshape(len(ii), -1)
                d = np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T))
                d[np.asarray(qi)[:, None] == np.asarray(ii)[None, :]] = 0
                labels, number = np.unique(np.asarray(ic), return_inverse=True)
                sums = np.zeros((len(qi), len(labels)))
                np.add.at(sums.T, number, d.T)
                n = np.bincount(number)
                for r, (i, c) in enumerate(zip(qi, qc)):
                    out += [(i, c, lab, float(sums[r, k]), int(n[k])) for k, lab in enumerate(labels)]
            yield pd.DataFrame(out, columns=["id", "c", "other", "d", "n"])

    # a stated set of queries against all rows, in blocks
    got = pack(queries, "q").join(pack(df, "i"), how="cross").mapInPandas(meet, "id long, c string, other string, d double, n long")
    s = got.groupBy("id", "c", "other").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    own = F.col("other") == F.col("c")
    m = s.groupBy("id", "c").agg(F.max(F.when(own & (F.col("n") > 1), F.col("d") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("d") / F.col("n"))).alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return m.select(F.col("id").alias(key), F.col("c").alias("cluster"), "a", "b", value.alias("silhouette"))


#: What the columns of an n-tile table say (fixed values).
TILE_COLUMNS = {
    "decile": "tile, 1 the highest scores", "prob_min": "lowest score", "prob_max": "highest score", "prob_avg": "mean score", "cnt_cust": "rows", "cnt_resp": "positives", "cnt_non_resp": "negatives",
    "cum_cust": "rows so far", "cum_resp": "positives so far", "cum_non_resp": "negatives so far", "cnt_resp_rndm": "positives expected at random", "cnt_resp_wiz": "positives of a perfect order",
    "resp_rate": "positives in percent", "cum_resp_rate": "positives so far in percent of rows", "cum_cust_pct": "rows so far in percent", "cum_resp_pct": "positives so far in percent of all", "cum_non_resp_pct": "negatives so far in percent of all",
    "ks": "difference of the two shares", "lift": "share of positives over share of rows, so far", "decile_lift": "rate over the overall rate",
}


def describe_tiles(df: DataFrame) -> DataFrame:
    """(position, column_name, meaning) of the columns of an n-tile table."""
    rows = [(i, c, TILE_COLUMNS.get(c, "")) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, meaning string")


def tile_series(table: DataFrame, by: list[str]) -> DataFrame:
    """(by..., ntile, cumgains, cumlift, response, cumresponse) of a table of tiles with n, pos, gain, cum_n, cum_pos and cum_lift."""
    return table.select(*by, "ntile", F.col("gain").alias("cumgains"), F.col("cum_lift").alias("cumlift"), F.try_divide("pos", "n").alias("response"), F.try_divide("cum_pos", "cum_n").alias("cumresponse"))


def plotting_scope(table: DataFrame, scope: str, **chosen: object) -> DataFrame:
    """The rows of a table of tiles that a comparison shows, by its columns model, dataset and target_class: no_comparison fixes all three; compare_models, compare_datasets and compare_targetclasses leave one open. A column that has to be fixed and isn't raises."""
    free = {"no_comparison": None, "compare_models": "model", "compare_datasets": "dataset", "compare_targetclasses": "target_class"}
    if scope not in free:
        raise ValueError(f"unknown scope {scope!r}; known: {sorted(free)}")
    for c in ("model", "dataset", "target_class"):
        if c == free[scope] or c not in table.columns:
            continue
        if c not in chosen:
            raise ValueError(f"{scope} needs a {c}")
        table = table.where(F.col(c) == chosen[c])
    return table


def prepare_subset(df: DataFrame, truth: str, scores: list[str]) -> DataFrame:
    """The rows that have a truth and all scores, with scores as doubles; NaN counts as missing. A table without such rows raises."""
    x = df.withColumns({c: F.col(c).try_cast("double") for c in scores})
    ok = F.col(truth).isNotNull()
    for c in scores:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    got = x.where(ok)
    if not got.limit(1).count():
        raise ValueError("no row has a truth and all scores")
    return got


def learning_curve(df: DataFrame, key: list[str], features: list[str], label: str, shares: list[float], folds: int = 3, seed: int = 0) -> DataFrame:
    """(share, n_train, train_mean, train_std, test_mean, test_std): accuracy of a logistic regression fitted on growing shares of the training folds.

    Folds and shares are hashes of the key, so a larger share contains the smaller ones.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    from .modeling import fold_of

    hashed = F.pmod(F.xxhash64(F.lit(seed + 1), *[F.col(k) for k in key]), F.lit(1 << 20)) / F.lit(float(1 << 20))
    x = df.select(fold_of(key, folds, seed).alias("fold"), hashed.alias("u"), label, *[F.col(c).cast("double").alias(c) for c in features]).na.drop()
    x = VectorAssembler(inputCols=features, outputCol="x").transform(x)
    x = materialise(StringIndexer(inputCol=label, outputCol="y").fit(x).transform(x).select("fold", "u", "x", "y"), "folds")
    rows = []
    for share in shares:
        train, test, sizes = [], [], []
        for f in range(folds):
            part = x.where((F.col("fold") != f) & (F.col("u") < share))
            m = LogisticRegression(featuresCol="x", labelCol="y", maxIter=20).fit(part)
            hit = lambda z: m.transform(z).agg(F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("a"), F.count("*").alias("n")).first()  # noqa: B023, E731
            a, b = hit(part), hit(x.where(F.col("fold") == f))
            train.append(a.a)
            test.append(b.a)
            sizes.append(a.n)
        rows.append((share, int(np.mean(sizes)), float(np.mean(train)), float(np.std(train)), float(np.mean(test)), float(np.std(test))))
    return df.sparkSession.createDataFrame(rows, "share double, n_train long, train_mean double, train_std double, test_mean double, test_std double")


def dummy_names(columns: list[str]) -> dict[str, str]:
    """The prefix of each label column's indicator names: its first two letters, or its whole name where others share them."""
    short = [c[:2] for c in columns]
    return {c: c if short.count(c[:2]) > 1 else c[:2] for c in columns}


def dummies_of(df: DataFrame, columns: list[str], dtype: str = "int", sparse: bool = False, separator: str = ",") -> DataFrame:
    """Several multi-label columns as indicators of a type, in place of the columns; ``sparse`` gives one array of the numbers of the indicators that are set (``indicator_ids``), in the order of names that the dense form has."""
    from .encode import categories, parts

    names = dummy_names(columns)
    pairs = [(c, k, f"{names[c]}_{k}") for c in columns for k in categories(df, c, separator)[0]]
    x = df.withColumns({f"_p_{c}": parts(c, separator) for c in columns})
    rest = [c for c in df.columns if c not in columns]
    flags = [F.array_contains(f"_p_{c}", k) for c, k, _ in pairs]
    if sparse:
        ids = F.array_compact(F.array(*[F.when(f, F.lit(i)) for i, f in enumerate(flags)])) if pairs else F.array().cast("array<int>")
        return x.select(*rest, ids.alias("indicator_ids"))
    return x.select(*rest, *[f.cast(dtype).alias(n) for f, (_, _, n) in zip(flags, pairs)])
