"""Relational building blocks of the metric layers, all as plain DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows up to which a dimension may be sent to every executor.
SMALL_ROWS = 100_000


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first in the order. Spark cuts each key down to its first row
    before the shuffle as well (WindowGroupLimit), so a key of any size moves few rows."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def in_force(facts: DataFrame, versions: DataFrame, on: Sequence[str], at: Column, start: str, end: str, how: str = "left") -> DataFrame:
    """Join with the version whose closed interval holds the date: an equi-join on the keys,
    with the interval as a residual, against a side that is broadcast if it is small."""
    v = small(versions).alias("_v")
    f = facts.alias("_f")
    cond = at.between(F.col(f"_v.{start}"), F.col(f"_v.{end}"))
    for k in on:
        cond = cond & (F.col(f"_f.{k}") == F.col(f"_v.{k}"))
    return f.join(v, cond, how).select("_f.*", *[F.col(f"_v.{c}") for c in versions.columns if c not in on])


def flagged(df: DataFrame, keys: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Adds 1 or 0: whether the row's keys occur in keys."""
    marks = keys.select(*on).distinct().withColumn("_hit", F.lit(1))
    return df.join(marks, list(on), "left").withColumn(name, F.coalesce("_hit", F.lit(0))).drop("_hit")


def widened(events: DataFrame, key: str, kind: str, time: str, names: dict[str, str]) -> DataFrame:
    """First time of each kind of event as a column of its own."""
    return events.groupBy(key).agg(*[F.min(F.when(F.col(kind) == k, F.col(time))).alias(n) for k, n in names.items()])


def money(column: Column | str, scale: int = 4) -> Column:
    """Sum of money independent of the order of rows: exact decimals, as a double at the end."""
    column = F.col(column) if isinstance(column, str) else column
    return F.sum(column.cast(f"decimal(18,{scale})")).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def seconds_between(a: str, b: str) -> Column:
    """Second boundaries crossed from a to b."""
    return F.expr(f"timestampdiff(SECOND, date_trunc('second', {a}), date_trunc('second', {b}))")


def epoch(column: str) -> Column:
    """Seconds since 1970 with fractions."""
    return F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1e6)


def top_share(df: DataFrame, dim: str, measure: str, k: int = 30) -> DataFrame:
    """The k values of dim with the largest measure and their share of the total over all
    values. The total adds up the sums by value, so the input is read and shuffled once."""
    sums = df.groupBy(dim).agg(F.sum(F.col(measure).cast("decimal(18,4)")).alias("_sum"))
    total = sums.agg(F.sum("_sum").alias("_total"))
    top = sums.orderBy(F.desc("_sum"), F.asc_nulls_last(dim)).limit(k)
    return top.join(F.broadcast(total)).select(dim, F.col("_sum").cast("double").alias(measure), ratio(F.col("_sum").cast("double"), F.col("_total").cast("double")).alias("share"))


def delta(now: Column, before: Column) -> Column:
    """Relative change against the period before; 0 if under 0.05 %, null without a base."""
    d = (now - before) / F.nullif(F.abs(before), F.lit(0.0))
    return F.when(F.abs(d) < 0.0005, F.lit(0.0)).otherwise(d)


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], absolute: float = 0.011, relative: float = 1e-9) -> DataFrame:
    """Cells in which two recomputations differ by more than max(absolute, |value| * relative), keys of only one side included."""
    both = a.alias("a").join(b.alias("b"), list(keys), "full_outer")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"a.{c}").cast("double").alias("left"), F.col(f"b.{c}").cast("double").alias("right")) for c in columns]))
    out = both.select(*keys, cells.alias("x")).select(*keys, "x.*")
    far = F.abs(F.col("left") - F.col("right")) > F.greatest(F.lit(absolute), F.abs("left") * relative)
    return out.filter(F.coalesce(far, F.col("left").isNull() != F.col("right").isNull()))


def not_unique(df: DataFrame, *keys: str) -> DataFrame:
    return df.filter(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def nulls(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unaccepted(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter(~F.col(column).isin(*values))
