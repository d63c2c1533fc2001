"""Tables and curves behind model evaluation plots.

Inputs are columns of truth and score. Rows with a null truth or a null or NaN
score are left out everywhere; empty inputs give empty curves, and a rate of a
class that doesn't occur is null. Curves work on
distinct scores, so ties share a point and the data shrink before any ordering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .ordered import quantiles, running_total, with_previous


def confusion_matrix(df: DataFrame, truth: str, pred: str, labels: list | None = None, normalize: str | None = None) -> DataFrame:
    """(truth, pred, n[, share]) for every pair of labels, empty cells included; ``normalize`` is true, pred or all.

    Labels are those of either column unless given; they are few, and the grid is built from them alone. Null labels are left out.
    """
    some = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).select(F.col(truth).alias("truth"), F.col(pred).alias("pred"))
    counts = some.groupBy("truth", "pred").agg(F.count("*").alias("n"))
    if labels is None:
        kind = counts.select(F.explode(F.array("truth", "pred")).alias("label")).distinct()
        both = F.array_sort(F.collect_set("label"))
        grid = kind.agg(both.alias("l")).select(F.explode("l").alias("truth"), "l").select("truth", F.explode("l").alias("pred"))
    else:
        every = F.array(*[F.lit(x) for x in labels])
        grid = df.sparkSession.range(1).select(F.explode(every).alias("truth")).select("truth", F.explode(every).alias("pred"))
    full = grid.join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))
    if normalize is None:
        return full
    w = {"true": Window.partitionBy("truth"), "pred": Window.partitionBy("pred"), "all": Window.partitionBy(F.lit(1))}[normalize]
    total = F.sum("n").over(w)
    return full.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(label, precision, recall, f1, support) by class, and rows accuracy, macro avg and weighted avg. A ratio without a denominator is 0."""
    m = confusion_matrix(df, truth, pred)
    cell = m.select(F.col("truth").cast("string").alias("t"), F.col("pred").cast("string").alias("p"), "n")
    long = cell.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called")))).alias("s")).select("s.*")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    one = long.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("called").alias("called"))
    one = one.select("label", ratio(F.col("tp"), F.col("called")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("called") + F.col("support")).alias("f1"), "support", "tp")
    n = F.sum("support")
    acc = ratio(F.sum("tp"), n)
    wavg = lambda c: ratio(F.sum(F.col(c) * F.col("support")), n)
    names = ["precision", "recall", "f1"]
    some = one.groupBy().agg(n.alias("support"), acc.alias("acc"), *[F.avg(c).alias(f"m_{c}") for c in names], *[wavg(c).alias(f"w_{c}") for c in names]).where("support is not null")
    rows = F.array(
        F.struct(F.lit("accuracy").alias("label"), *[F.col("acc").alias(c) for c in names], "support"),
        F.struct(F.lit("macro avg").alias("label"), *[F.col(f"m_{c}").alias(c) for c in names], "support"),
        F.struct(F.lit("weighted avg").alias("label"), *[F.col(f"w_{c}").alias(c) for c in names], "support"),
    )
    return one.drop("tp").unionByName(some.select(F.explode(rows).alias("r")).select("r.*"))


def binary(df: DataFrame, positive: Column, score: str, weight: str | None = None) -> DataFrame:
    """(score, pos, neg) summed by distinct score."""
    x = df.select(positive.alias("_y"), F.col(score).cast("double").alias("score"), (F.col(weight).cast("double") if weight else F.lit(1)).alias("_w"))
    x = x.where(F.col("_y").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    zero = F.lit(0.0) if weight else F.lit(0)
    return x.groupBy("score").agg(F.sum(F.when(F.col("_y"), F.col("_w")).otherwise(zero)).alias("pos"), F.sum(F.when(~F.col("_y"), F.col("_w")).otherwise(zero)).alias("neg"))


def cumulative(counts: DataFrame) -> DataFrame:
    """Adds tp, fp (from the highest score down) and the totals to counts by score."""
    return running_total(counts, [F.desc("score")], {"tp": "pos", "fp": "neg"}, {"all_pos": "pos", "all_neg": "neg"})


def roc_curve(df: DataFrame, positive: Column, score: str, weight: str | None = None) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score; the point (0, 0) has threshold infinity."""
    c = cumulative(binary(df, positive, score, weight)).select(F.col("score").alias("threshold"), F.try_divide("fp", "all_neg").alias("fpr"), F.try_divide("tp", "all_pos").alias("tpr"))
    start = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return c.unionByName(start)


def roc_auc(df: DataFrame, positive: Column, score: str, weight: str | None = None) -> DataFrame:
    """(auc, n_pos, n_neg) by the trapezoid rule over distinct scores, which counts ties as one half."""
    c = cumulative(binary(df, positive, score, weight))
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0)
    return c.agg(area.alias("a"), F.max("all_pos").alias("n_pos"), F.max("all_neg").alias("n_neg")).select(F.try_divide(F.col("a"), F.col("n_pos") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def pr_curve(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """(threshold, precision, recall) at every distinct score."""
    c = cumulative(binary(df, positive, score))
    return c.select(F.col("score").alias("threshold"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", "all_pos").alias("recall"))


def average_precision(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """One row: the sum over scores of precision times the gain in recall."""
    c = cumulative(binary(df, positive, score))
    return c.agg(F.try_divide(F.sum(F.try_divide(F.col("pos") * F.col("tp"), F.col("tp") + F.col("fp"))), F.max("all_pos")).alias("average_precision"))


def gain_curve(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """(score, percentage, gain) at the end of each tie group, with the point (0, 0)."""
    c = cumulative(binary(df, positive, score))
    n = F.col("all_pos") + F.col("all_neg")
    got = c.select("score", F.try_divide(F.col("tp") + F.col("fp"), n).alias("percentage"), F.try_divide("tp", "all_pos").alias("gain"))
    start = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("percentage"), F.lit(0.0).alias("gain"))
    return got.unionByName(start)


def lift_curve(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """(score, percentage, lift): gain over the share of rows, without the undefined first point."""
    return gain_curve(df, positive, score).where("score is not null").select("score", "percentage", F.try_divide("gain", "percentage").alias("lift"))


def ks_curve(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """(threshold, pct_neg, pct_pos): distribution functions of both classes at each score; thresholds 0 and 1 are added where missing."""
    c = running_total(binary(df, positive, score), [F.asc("score")], {"cp": "pos", "cn": "neg"}, {"all_pos": "pos", "all_neg": "neg"})
    got = c.select(F.col("score").alias("threshold"), F.try_divide("cn", "all_neg").alias("pct_neg"), F.try_divide("cp", "all_pos").alias("pct_pos"))
    ends = df.sparkSession.range(1).select(F.explode(F.array(F.struct(F.lit(0.0).alias("threshold"), F.lit(0.0).alias("pct_neg"), F.lit(0.0).alias("pct_pos")), F.struct(F.lit(1.0).alias("threshold"), F.lit(1.0).alias("pct_neg"), F.lit(1.0).alias("pct_pos")))).alias("e")).select("e.*")
    missing = ends.join(got.where("threshold in (0.0, 1.0)").select("threshold"), "threshold", "left_anti")
    return got.unionByName(missing)


def ks_statistic(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """(ks, threshold): the largest signed difference of the class distributions and the first score where it occurs."""
    c = ks_curve(df, positive, score).withColumn("d", F.col("pct_neg") - F.col("pct_pos"))
    best = c.agg(F.max(F.struct("d", -F.col("threshold"))).alias("b"))
    return best.select(F.col("b.d").alias("ks"), (-F.col("b.col2")).alias("threshold"))


def roc_auc_by_class(df: DataFrame, truth: str, scores: dict[str, str]) -> DataFrame:
    """(class, auc) one against the rest, from one score column a class, all in one pass."""
    long = df.where(F.col(truth).isNotNull()).select(F.explode(F.array(*[F.struct(F.lit(k).alias("class"), (F.col(truth) == k).alias("y"), F.col(c).cast("double").alias("score")) for k, c in scores.items()])).alias("s")).select("s.*")
    c = long.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("class", "score").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum((~F.col("y")).cast("long")).alias("neg"))
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0)
    return running_total(c, [F.desc("score")], {"tp": "pos"}, by=["class"]).groupBy("class").agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("auc"))


def roc_auc_micro(df: DataFrame, truth: str, scores: dict[str, str]) -> DataFrame:
    """(auc, n_pos, n_neg) over all pairs of row and class."""
    long = df.where(F.col(truth).isNotNull()).select(F.explode(F.array(*[F.struct((F.col(truth) == k).alias("y"), F.col(c).cast("double").alias("score")) for k, c in scores.items()])).alias("s")).select("s.*")
    return roc_auc(long, F.col("y"), "score")


def calibration_curve(df: DataFrame, positive: Column, score: str, bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """(bin, n, mean_predicted, fraction_positive); empty bins are left out.

    Uniform bins are right-open but the last; quantile bins are bounded by exact quantiles and right-closed.
    """
    x = df.select(positive.cast("int").alias("y"), F.col(score).cast("double").alias("s")).where("y is not null and s is not null and not isnan(s)")
    if strategy == "uniform":
        b = F.greatest(F.lit(0), F.least(F.floor(F.col("s") * bins), F.lit(bins - 1))).cast("int")
        binned = x.withColumn("bin", b)
    else:
        edges = quantiles(x, "s", {f"q{k}": k / bins for k in range(1, bins)})
        above = sum((F.col("s") > F.col(f"q{k}")).cast("int") for k in range(1, bins))
        binned = x.join(F.broadcast(edges)).withColumn("bin", above)  # one row of edges
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("s").alias("mean_predicted"), F.avg("y").alias("fraction_positive"))


def ntile_of(rank: Column, n: Column, tiles: int) -> Column:
    """The tile (1 the first) of a 1-based rank among n, as SQL's ntile gives it."""
    q, r = F.floor(n / tiles), n % tiles
    return F.when(rank <= r * (q + 1), F.floor((rank - 1) / (q + 1)) + 1).otherwise(F.floor((rank - 1 - r) / F.greatest(q, F.lit(1))) + 1).cast("int")


def decile_table(df: DataFrame, positive: Column, score: str, key: list[str], tiles: int = 10) -> DataFrame:
    """The n-tile table: for each tile from the highest scores its bounds, counts, rates, cumulative shares, lifts and KS.

    Ties in score are ordered by ``key``, and rows that tie there too are alike.
    """
    x = df.select(positive.cast("long").alias("y"), F.col(score).cast("double").alias("s"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(key)], F.lit(1).alias("one")).where("y is not null and s is not null and not isnan(s)")
    r = running_total(x, [F.desc("s"), *[F.col(f"k{i}") for i in range(len(key))]], {"rank": "one"}, {"n_all": "one", "pos_all": "y"})
    t = r.groupBy(ntile_of(F.col("rank"), F.col("n_all"), tiles).alias("decile")).agg(F.min("s").alias("prob_min"), F.max("s").alias("prob_max"), F.avg("s").alias("prob_avg"), F.count("*").alias("cnt_cust"), F.sum("y").alias("cnt_resp"), F.max("n_all").alias("n_all"), F.max("pos_all").alias("pos_all"))
    # from here on there are as many rows as tiles
    w = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("cum_cust", F.sum("cnt_cust").over(w)).withColumn("cum_resp", F.sum("cnt_resp").over(w))
    t = t.withColumn("cnt_non_resp", F.col("cnt_cust") - F.col("cnt_resp")).withColumn("cum_non_resp", F.col("cum_cust") - F.col("cum_resp"))
    neg = F.col("n_all") - F.col("pos_all")
    return t.select(
        "decile", "prob_min", "prob_max", "prob_avg", "cnt_cust", "cnt_resp", "cnt_non_resp", "cum_cust", "cum_resp", "cum_non_resp",
        (F.col("cnt_cust") * F.col("pos_all") / F.col("n_all")).alias("cnt_resp_rndm"),
        F.least(F.col("cnt_cust"), F.greatest(F.lit(0), F.col("pos_all") - (F.col("cum_cust") - F.col("cnt_cust")))).alias("cnt_resp_wiz"),
        (100.0 * F.col("cnt_resp") / F.col("cnt_cust")).alias("resp_rate"),
        (100.0 * F.col("cum_resp") / F.col("cum_cust")).alias("cum_resp_rate"),
        (100.0 * F.col("cum_cust") / F.col("n_all")).alias("cum_cust_pct"),
        F.try_divide(100.0 * F.col("cum_resp"), F.col("pos_all")).alias("cum_resp_pct"),
        F.try_divide(100.0 * F.col("cum_non_resp"), neg).alias("cum_non_resp_pct"),
        (F.try_divide(100.0 * F.col("cum_resp"), F.col("pos_all")) - F.try_divide(100.0 * F.col("cum_non_resp"), neg)).alias("ks"),
        (F.try_divide("cum_resp", "pos_all") / (F.col("cum_cust") / F.col("n_all"))).alias("lift"),
        F.try_divide(F.col("cnt_resp") / F.col("cnt_cust"), F.col("pos_all") / F.col("n_all")).alias("decile_lift"),
    )


def ntile_financials(table: DataFrame, fixed: float, variable: float, profit: float) -> DataFrame:
    """Adds cumulative costs, revenues, profit and return on investment to a decile table."""
    cost = F.lit(float(fixed)) + F.col("cum_cust") * F.lit(float(variable))
    revenue = F.col("cum_resp") * F.lit(float(profit))
    return table.select("decile", "cum_cust", "cum_resp", cost.alias("investments"), revenue.alias("revenues"), (revenue - cost).alias("profit"), F.when(cost != 0, (revenue - cost) / cost).alias("roi"))


def modelplot_scores(df: DataFrame, groups: list[str], truth: str, scores: dict[str, str], key: list[str], tiles: int = 10) -> DataFrame:
    """(groups..., target_class, ntile, n, pos, cum_n, cum_pos, gain, cum_lift): an n-tile table for every group and class.

    Ranks come from running totals by group over distinct scores of a group, and rows of one score share consecutive ranks by key.
    """
    long = df.where(F.col(truth).isNotNull()).select(*groups, *key, F.explode(F.array(*[F.struct(F.lit(k).alias("target_class"), (F.col(truth) == k).cast("long").alias("y"), F.col(c).cast("double").alias("s")) for k, c in scores.items()])).alias("x")).select(*groups, *key, "x.*")
    by = [*groups, "target_class"]
    order = [*[F.col(b) for b in by], F.desc("s"), *[F.col(k) for k in key]]
    ranked = running_total(long.where("s is not null and not isnan(s)").withColumn("one", F.lit(1)), order, {"r": "one"})
    sizes = long.where("s is not null and not isnan(s)").groupBy(*by).agg(F.count("*").alias("n_all"), F.sum("y").alias("pos_all"))
    sizes = materialise(sizes, "sizes")
    w = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)  # one row a group and class
    base = sizes.withColumn("before", F.coalesce(F.sum("n_all").over(w), F.lit(0)))
    got = ranked.join(F.broadcast(base), by).withColumn("ntile", ntile_of(F.col("r") - F.col("before"), F.col("n_all"), tiles))
    t = got.groupBy(*by, "ntile").agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.max("n_all").alias("n_all"), F.max("pos_all").alias("pos_all"))
    c = Window.partitionBy(*by).orderBy("ntile").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("cum_n", F.sum("n").over(c)).withColumn("cum_pos", F.sum("pos").over(c))
    return t.select(*by, "ntile", "n", "pos", "cum_n", "cum_pos", F.try_divide("cum_pos", "pos_all").alias("gain"), F.try_divide(F.col("cum_pos") / F.col("cum_n"), F.col("pos_all") / F.col("n_all")).alias("cum_lift"))


def residual_summary(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: count, mean, population deviation, quartiles and range of the residuals."""
    r = df.select((F.col(truth) - F.col(pred)).cast("double").alias("r")).where("r is not null and not isnan(r)")
    q = quantiles(r, "r", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return r.agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.min("r").alias("min"), F.max("r").alias("max")).join(F.broadcast(q))  # one row each


def interpolate(df: DataFrame, x: str, y: str, grid: list[float]) -> DataFrame:
    """(x, y) of a piecewise linear function at the grid points, flat beyond its ends; the function's points have distinct x."""
    nodes = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    segments = with_previous(nodes, [F.asc("x")], {"x0": ("x", None), "y0": ("y", None)})
    points = F.array(*[F.lit(float(g)) for g in grid])
    ends = nodes.agg(F.min(F.struct("x", "y")).alias("a"), F.max(F.struct("x", "y")).alias("b"))
    inner = segments.select("x", "y", "x0", "y0", F.explode(F.filter(points, lambda g: (g > F.col("x0")) & (g <= F.col("x")))).alias("g"))
    mid = inner.select(F.col("g").alias("x"), (F.col("y0") + (F.col("y") - F.col("y0")) * (F.col("g") - F.col("x0")) / (F.col("x") - F.col("x0"))).alias("y"))
    out = ends.select(F.explode(F.filter(points, lambda g: (g <= F.col("a.x")) | (g > F.col("b.x")))).alias("g"), "a", "b").select(F.col("g").alias("x"), F.when(F.col("g") <= F.col("a.x"), F.col("a.y")).otherwise(F.col("b.y")).alias("y"))
    return mid.unionByName(out)


def label_frequency(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share); nulls are one label, and so are NaN."""
    c = df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def silhouette(df: DataFrame, key: str, vector: str, cluster: str) -> DataFrame:
    """(cluster, n, silhouette): mean simplified silhouette with squared Euclidean distances.

    Mean squared distances to a cluster follow from its count, vector sum and sum
    of squares, so points meet the few clusters only, never each other. A point
    alone in its cluster, or in the only cluster, has silhouette 0.
    """
    p = df.where(F.col(vector).isNotNull() & F.col(cluster).isNotNull()).select(F.col(key).alias("id"), F.col(cluster).alias("c"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    p = p.withColumn("sq", F.aggregate("v", F.lit(0.0), lambda a, v: a + v * v))
    flat = p.select("c", F.posexplode("v").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("s"))
    sums = flat.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda z: z["s"]).alias("sv"))
    stats = p.groupBy("c").agg(F.count("*").alias("n"), F.sum("sq").alias("ss")).join(sums, "c")
    every = stats.agg(F.collect_list(F.struct("c", "n", "ss", "sv")).alias("k"))
    x = p.join(F.broadcast(every))  # one row, as long as there are clusters
    dot = lambda k: F.aggregate(F.zip_with(F.col("v"), k["sv"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    total = lambda k: k["n"] * F.col("sq") + k["ss"] - 2 * dot(k)
    x = x.withColumn("d", F.transform("k", lambda k: F.struct((k["c"] == F.col("c")).alias("own"), k["n"].alias("n"), F.greatest(F.lit(0.0), F.when(k["c"] == F.col("c"), F.when(k["n"] > 1, total(k) / (k["n"] - 1))).otherwise(total(k) / k["n"])).alias("m"))))
    a = F.array_max(F.transform(F.filter("d", lambda d: d["own"] & (d["n"] > 1)), lambda d: d["m"]))
    b = F.array_min(F.transform(F.filter("d", lambda d: ~d["own"]), lambda d: d["m"]))
    x = x.select("c", a.alias("a"), b.alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return x.groupBy(F.col("c").alias("cluster")).agg(F.count("*").alias("n"), F.avg(s).alias("silhouette"))


def missing_profile(df: DataFrame, top: int = 25) -> DataFrame:
    """(column_name, n_missing) of the columns with most missing values (null or NaN), in one pass."""
    gone = lambda c, t: F.sum((F.col(c).isNull() | (F.isnan(F.col(c)) if t in ("double", "float") else F.lit(False))).cast("long"))
    one = df.agg(*[F.coalesce(gone(c, t), F.lit(0)).alias(c) for c, t in df.dtypes])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in df.columns]))
    return one.select(rows.alias("r")).select("r.*").orderBy(F.desc("n_missing"), "column_name").limit(top)


def roc_macro(df: DataFrame, truth: str, scores: dict[str, str], points: int = 101) -> DataFrame:
    """(fpr, tpr): the mean over classes of their curves at evenly spaced false-positive rates.

    Each class's curve is a step between its distinct scores; it is read at every grid point with linear interpolation.
    """
    long = df.where(F.col(truth).isNotNull()).select(F.explode(F.array(*[F.struct(F.lit(k).alias("class"), (F.col(truth) == k).alias("y"), F.col(c).cast("double").alias("s")) for k, c in scores.items()])).alias("z")).select("z.*")
    c = long.where(F.col("s").isNotNull() & ~F.isnan("s")).groupBy("class", "s").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum((~F.col("y")).cast("long")).alias("neg"))
    r = running_total(c, [F.desc("s")], {"fp": "neg", "tp": "pos"}, {"n": "neg", "p": "pos"}, ["class"])
    p = r.select("class", F.try_divide("fp", "n").alias("x"), F.try_divide("tp", "p").alias("y"))
    zero = p.select("class").distinct().select("class", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    p = p.unionByName(zero).groupBy("class", "x").agg(F.max("y").alias("y"))
    # the row before, across the whole table; a class starts anew
    p = with_previous(p, [F.asc("class"), F.asc("x")], {"c0": ("class", None), "x0": ("x", None), "y0": ("y", None)})
    same = F.col("c0").eqNullSafe(F.col("class"))
    p = p.withColumn("x0", F.when(same, F.col("x0"))).withColumn("y0", F.when(same, F.col("y0")))
    grid = F.array(*[F.lit(i / (points - 1)) for i in range(points)])
    at = p.select("class", "x", "y", "x0", "y0", F.explode(F.filter(grid, lambda g: (g <= F.col("x")) & (F.col("x0").isNull() | (g > F.col("x0"))))).alias("fpr"))
    value = F.when(F.col("x0").isNull() | (F.col("fpr") == F.col("x")), F.col("y")).otherwise(F.col("y0") + (F.col("y") - F.col("y0")) * (F.col("fpr") - F.col("x0")) / (F.col("x") - F.col("x0")))
    return at.groupBy("fpr").agg(F.avg(value).alias("tpr"))


def selection_summary(table: DataFrame, tile: int) -> DataFrame:
    """One row: customers, responders, response rate and lift of the tiles up to ``tile`` of a decile table."""
    s = table.where(F.col("decile") <= tile)
    return s.agg(F.sum("cnt_cust").alias("customers"), F.sum("cnt_resp").alias("responders"), F.try_divide(F.sum("cnt_resp"), F.sum("cnt_cust")).alias("response"), F.max_by("lift", "decile").alias("lift"))
