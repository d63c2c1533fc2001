"""Recency, frequency and monetary summaries, their holdouts, and lifetime-value models.

Purchases of one period collapse first, so a customer's many rows shrink before
any shuffle; rows with a null customer or time are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DAYS = {"day": 1, "week": 7}


def periods(df: DataFrame, customer: str, at: str, money: str | None, unit: str = "day") -> DataFrame:
    """(customer, period, money): one row a customer and period, with the money summed."""
    x = df.where(F.col(customer).isNotNull() & F.col(at).isNotNull())
    p = F.date_trunc(unit, F.col(at)).cast("date")
    return x.groupBy(F.col(customer).alias("customer"), p.alias("period")).agg(F.sum(money).alias("money") if money else F.lit(None).cast("double").alias("money"))


def rfm_summary(df: DataFrame, customer: str, at: str, money: str | None = None, unit: str = "day", end: Column | None = None) -> DataFrame:
    """(customer, frequency, recency, t, monetary_value): repeat periods, age at the last one, age at the end, and mean money of repeat periods (0 without any).

    The end is the last period of the table unless given.
    """
    p = periods(df, customer, at, money, unit)
    if end is not None:
        p = p.where(F.col("period") <= end)
    one = p.groupBy("customer").agg(F.count("*").alias("n"), F.min("period").alias("first"), F.max("period").alias("last"), F.sum("money").alias("total"), F.min_by("money", "period").alias("first_money"))
    stop = p.agg(F.max("period").alias("stop")) if end is None else df.sparkSession.range(1).select(end.alias("stop"))
    d = _DAYS[unit]
    f = F.col("n") - 1
    return one.join(F.broadcast(stop)).select("customer", f.alias("frequency"), (F.datediff("last", "first") / d).alias("recency"), (F.datediff("stop", "first") / d).alias("t"), F.when(f > 0, (F.col("total") - F.col("first_money")) / f).otherwise(0.0).alias("monetary_value"))


def calibration_holdout(df: DataFrame, customer: str, at: str, money: str | None, split: Column, end: Column, unit: str = "day") -> DataFrame:
    """The summary up to ``split`` with frequency_holdout, monetary_value_holdout and duration_holdout of (split, end]; customers without holdout purchases have 0."""
    cal = rfm_summary(df.where(F.col(at).cast("date") <= split), customer, at, money, unit, split)
    hold = df.where((F.col(at).cast("date") > split) & (F.col(at).cast("date") <= end))
    h = hold.groupBy(F.col(customer).alias("customer")).agg(F.countDistinct(F.date_trunc(unit, F.col(at))).alias("frequency_holdout"), (F.avg(money) if money else F.lit(0.0)).alias("monetary_value_holdout"))
    got = cal.join(h, "customer", "left").na.fill(0, ["frequency_holdout", "monetary_value_holdout"])
    return got.withColumn("duration_holdout", F.datediff(end, split) / _DAYS[unit])


def cumulative_transactions(df: DataFrame, customer: str, at: str, unit: str = "week") -> DataFrame:
    """(period, n, repeat_n, cumulative, incremental) for every period of the calendar, with or without purchases; repeats exclude a customer's first period.

    The calendar has a row a period, whatever the number of purchases.
    """
    p = periods(df, customer, at, None, unit).select("customer", "period")
    first = p.groupBy("customer").agg(F.min("period").alias("first"))
    c = p.join(first, "customer").groupBy("period").agg(F.count("*").alias("n"), F.sum((F.col("period") > F.col("first")).cast("long")).alias("repeat_n"))
    span = c.agg(F.min("period").alias("a"), F.max("period").alias("z")).where("a is not null")
    step = F.expr("interval 7 days" if unit == "week" else "interval 1 day")
    cal = span.select(F.explode(F.sequence("a", "z", step)).alias("period"))
    w = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    full = cal.join(c, "period", "left").na.fill(0, ["n", "repeat_n"])
    full = full.withColumn("cumulative", F.sum("repeat_n").over(w))
    return full.withColumn("incremental", F.col("cumulative") - F.coalesce(F.lag("cumulative").over(Window.orderBy("period")), F.lit(0)))


def frequency_histogram(df: DataFrame, customer: str, at: str, top: int = 7) -> DataFrame:
    """(frequency, customers): repeat counts, the last bucket open."""
    s = rfm_summary(df, customer, at)
    return s.groupBy(F.least("frequency", F.lit(top)).alias("frequency")).agg(F.count("*").alias("customers"))


def lifetime_value(summary: DataFrame, months: int, rate: float, per_month: Column, money: str = "monetary_value") -> DataFrame:
    """(customer, clv): the discounted sum over months of expected purchases (``per_month``) times money."""
    terms = F.transform(F.sequence(F.lit(1), F.lit(months)), lambda m: F.lit(1.0) / F.pow(F.lit(1.0 + rate), m))
    factor = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return summary.select("customer", (F.col(money) * per_month * factor).alias("clv"))


def probability_alive(frequency: Column, recency: Column, t: Column, r: float, alpha: float, a: float, b: float) -> Column:
    """Probability that a customer is still active under the beta-geometric negative-binomial model."""
    term = F.log(F.lit(a)) - F.log(b + F.greatest(frequency, F.lit(1)) - 1) + (r + frequency) * (F.log(alpha + t) - F.log(alpha + recency))
    return F.when(frequency == 0, 1.0).otherwise(1 / (1 + F.exp(term)))


def valid_summary(summary: DataFrame) -> DataFrame:
    """Rows that break a summary's rules: negative values, recency beyond the age, or a recency without repeats."""
    return summary.where((F.col("frequency") < 0) | (F.col("recency") < 0) | (F.col("t") < F.col("recency")) | ((F.col("frequency") == 0) & (F.col("recency") != 0)))
