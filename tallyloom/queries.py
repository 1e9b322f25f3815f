"""Each data-plane operator as a query over the driver's tables, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyloom.operators import relational as R
from tallyloom.sources.tables import query as bound
from tallyloom.sources.tables import register, table, work_folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def define(oracle: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLE[f.__name__] = oracle
        return f

    return put


#: lineitem's newest version of each (l_orderkey, l_linenumber); ties are broken by every column.
_LATEST = """(SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1)"""
_VERSION = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], [F.desc(c) for c in _VERSION])


def _day(c: str):
    return F.col(c).cast("date")


# --- scans, projections, predicates


@define("SELECT o_orderkey, o_totalprice * 0.5 AS half, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def project_filter(spark, sf):
    return table(spark, sf, "orders").filter("o_orderstatus = 'F' and o_totalprice > 100000").select("o_orderkey", (F.col("o_totalprice") * 0.5).alias("half"), _day("o_orderdate").alias("day"))


@define("SELECT o.*, CAST(o_orderdate AS DATE) AS day FROM orders o WHERE o_orderstatus IN ('F', 'P')")
def star_in_list(spark, sf):
    return table(spark, sf, "orders").alias("o").filter(F.col("o_orderstatus").isin("F", "P")).select("o.*", _day("o_orderdate").alias("day"))


@define("SELECT event_id, user_id, value FROM events WHERE value IS NOT NULL AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def not_null_between(spark, sf):
    return bound(spark, "select event_id, user_id, value from {e} where value is not null and ts between :a and :b".format(e=_view(spark, sf, "events")), {"a": _ts("2024-01-05"), "b": _ts("2024-01-12")})


def _ts(day: str):
    import datetime

    return datetime.datetime.fromisoformat(day)


def _view(spark: SparkSession, sf: str, name: str) -> str:
    table(spark, sf, name).createOrReplaceTempView(name)
    return name


@define("SELECT o_orderkey, CAST(CASE WHEN EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') THEN 1 ELSE 0 END AS INTEGER) AS returned FROM orders o")
def exists_in_case(spark, sf):
    register(spark, sf, ("orders", "lineitem"))
    return spark.sql("select o_orderkey, case when exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag = 'R') then 1 else 0 end as returned from orders o")


@define("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) IN (DATE '1996-01-02', DATE '1997-05-05', DATE '1998-08-01') GROUP BY 1")
def in_date_list(spark, sf):
    days = [F.lit(d).cast("date") for d in ("1996-01-02", "1997-05-05", "1998-08-01")]
    return table(spark, sf, "orders").filter(_day("o_orderdate").isin(*days)).groupBy(_day("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))


#: Dimensions that a caller may group by.
DIMENSIONS = {"status": "o_orderstatus", "priority": "o_orderpriority"}


@define("SELECT o_orderpriority AS name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS amount FROM orders GROUP BY 1")
def whitelisted_dimension(spark, sf, dim: str = "priority"):
    return table(spark, sf, "orders").groupBy(F.col(DIMENSIONS[dim]).alias("name")).agg(R.money("o_totalprice").alias("amount"))


# --- joins


@define("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def inner_join(spark, sf):
    n, r = R.small(table(spark, sf, "nation")), R.small(table(spark, sf, "region"))
    return table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@define("SELECT c_custkey, CAST(o_orderkey AS DOUBLE) AS o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def left_join(spark, sf):
    o = table(spark, sf, "orders").filter("o_totalprice > 300000")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_orderkey").cast("double").alias("o_orderkey"))


@define("SELECT l_orderkey, l_linenumber, l_shipdate, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus IN ('F', 'P') WHERE l_returnflag = 'R'")
def join_is_filter(spark, sf):
    o = table(spark, sf, "orders")
    return table(spark, sf, "lineitem").filter("l_returnflag = 'R'").join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & F.col("o_orderstatus").isin("F", "P")).select("l_orderkey", "l_linenumber", "l_shipdate", "o_custkey")


#: Versions of a made-up rate by priority.
RATES = [("1-URGENT", 7.0, "1990-01-01", "1996-12-31"), ("1-URGENT", 7.5, "1997-01-01", "2005-12-31"), ("2-HIGH", 6.0, "1990-01-01", "1999-12-31"), ("3-MEDIUM", 5.0, "1998-01-01", "2005-12-31")]
_RATES_SQL = ", ".join(f"('{p}', CAST({r} AS DOUBLE), DATE '{a}', DATE '{b}')" for p, r, a, b in RATES)


@define(f"""SELECT o_orderkey, rate, o_totalprice * rate AS converted FROM orders
LEFT JOIN (VALUES {_RATES_SQL}) v(o_orderpriority, rate, effective_start, effective_end)
ON orders.o_orderpriority = v.o_orderpriority AND CAST(o_orderdate AS DATE) BETWEEN effective_start AND effective_end""")
def scd2_interval_join(spark, sf):
    v = spark.createDataFrame(RATES, "o_orderpriority string, rate double, a string, b string").select("o_orderpriority", "rate", F.col("a").cast("date").alias("effective_start"), F.col("b").cast("date").alias("effective_end"))
    out = R.in_force(table(spark, sf, "orders"), v, ["o_orderpriority"], _day("o_orderdate"), "effective_start", "effective_end")
    return out.select("o_orderkey", "rate", (F.col("o_totalprice") * F.col("rate")).alias("converted"))


@define("""SELECT p.event_id, count(*) AS n FROM events p JOIN events e ON p.user_id = e.user_id
AND p.event_type = 'purchase' AND e.event_type = 'error' AND date_diff('second', p.ts, e.ts) BETWEEN 0 AND 3600 GROUP BY 1""")
def theta_time_window_join(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    p = ev.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("paid"))
    e = ev.filter("event_type = 'error'").select("user_id", F.col("ts").alias("failed"))
    return p.join(e, "user_id").filter(R.seconds_between("paid", "failed").between(0, 3600)).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@define("""SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate <= o_orderdate + INTERVAL 14 DAY AND l_returnflag = 'R' GROUP BY 1""")
def join_back_window(spark, sf):
    j = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.filter("l_shipdate <= o_orderdate + interval 14 day").groupBy("l_orderkey").agg(R.money("l_extendedprice").alias("amount"))


@define("""SELECT o_orderkey, CAST(CASE WHEN f.l_orderkey IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS has_return FROM orders
LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') f ON o_orderkey = f.l_orderkey""")
def flag_join(spark, sf):
    keys = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.flagged(table(spark, sf, "orders").select("o_orderkey"), keys, ["o_orderkey"], "has_return")


_DAILY = {
    "a": "SELECT CAST(o_orderdate AS DATE) AS dt, count(*) AS orders_n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS gmv FROM orders GROUP BY 1",
    "b": "SELECT CAST(l_shipdate AS DATE) AS dt, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS shipped FROM lineitem GROUP BY 1",
    "c": "SELECT CAST(l_shipdate AS DATE) AS dt, count(DISTINCT l_orderkey) AS returned_n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1",
}


@define(f"SELECT dt, orders_n, gmv, shipped, coalesce(returned_n, 0) AS returned_n FROM ({_DAILY['a']}) LEFT JOIN ({_DAILY['b']}) USING (dt) LEFT JOIN ({_DAILY['c']}) USING (dt)")
def multiway_using_join(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    a = o.groupBy(_day("o_orderdate").alias("dt")).agg(F.count(F.lit(1)).alias("orders_n"), R.money("o_totalprice").alias("gmv"))
    b = li.groupBy(_day("l_shipdate").alias("dt")).agg(R.money("l_extendedprice").alias("shipped"))
    c = li.filter("l_returnflag = 'R'").groupBy(_day("l_shipdate").alias("dt")).agg(F.countDistinct("l_orderkey").alias("returned_n"))
    return a.join(b, "dt", "left").join(c, "dt", "left").fillna(0, ["returned_n"])


@define("SELECT s_suppkey, n FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) t ON s_suppkey = t.l_suppkey")
def derived_table_join(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", "n")


@define("""SELECT dt, CAST(a.n AS DOUBLE) AS ordered, CAST(b.n AS DOUBLE) AS shipped FROM (SELECT CAST(o_orderdate AS DATE) AS dt, count(*) AS n FROM orders GROUP BY 1) a
FULL OUTER JOIN (SELECT CAST(l_shipdate AS DATE) AS dt, count(*) AS n FROM lineitem GROUP BY 1) b USING (dt) WHERE a.n IS NULL OR b.n IS NULL""")
def date_alignment(spark, sf):
    a = table(spark, sf, "orders").groupBy(_day("o_orderdate").alias("dt")).agg(F.count(F.lit(1)).alias("ordered"))
    b = table(spark, sf, "lineitem").groupBy(_day("l_shipdate").alias("dt")).agg(F.count(F.lit(1)).alias("shipped"))
    both = a.join(b, "dt", "full_outer").filter("ordered is null or shipped is null")
    return both.select("dt", F.col("ordered").cast("double").alias("ordered"), F.col("shipped").cast("double").alias("shipped"))


# --- aggregation


@define("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS qty, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS mean_qty FROM lineitem GROUP BY 1, 2")
def basic_aggregates(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), R.money("l_quantity").alias("qty"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), (R.money("l_quantity") / F.count(F.lit(1))).alias("mean_qty")
    )


@define("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1")
def count_distinct(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(_day("ts")).alias("days"))


@define("SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,4)) ELSE 0 END) AS DOUBLE) AS done FROM orders GROUP BY 1")
def conditional_sum(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(R.money(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)).alias("done"))


@define("SELECT l_suppkey, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS returned FROM lineitem GROUP BY 1")
def conditional_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.countDistinct(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("returned"))


@define("""SELECT CAST(o_orderdate AS DATE) AS dt, CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(epoch_us(l_shipdate) - epoch_us(o_orderdate) AS DECIMAL(18,0)) END) AS DOUBLE)
/ nullif(CAST(count(CASE WHEN o_orderpriority <> '1-URGENT' THEN 1 END) AS DOUBLE), 0) / 3600000000.0::DOUBLE AS hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def conditional_average(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    micros = F.unix_micros(F.col("l_shipdate").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    some = F.col("o_orderpriority") != "1-URGENT"
    return j.groupBy(_day("o_orderdate").alias("dt")).agg((R.ratio(F.sum(F.when(some, micros.cast("decimal(18,0)"))), F.count(F.when(some, 1))) / F.lit(3600000000.0)).alias("hours"))


@define("SELECT user_id, min(CASE WHEN event_type = 'view' THEN ts END) AS first_view, min(CASE WHEN event_type = 'purchase' THEN ts END) AS first_purchase, min(CASE WHEN event_type = 'error' THEN ts END) AS first_error FROM events GROUP BY 1")
def event_widening(spark, sf):
    return R.widened(table(spark, sf, "events"), "user_id", "event_type", "ts", {"view": "first_view", "purchase": "first_purchase", "error": "first_error"})


@define("""SELECT o_custkey, min(o_orderdate) AS first_at, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order,
arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first_amount FROM orders GROUP BY 1""")
def first_purchase(spark, sf):
    order = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_at"), F.min_by("o_orderkey", order).alias("first_order"), F.min_by("o_totalprice", order).alias("first_amount"))


@define("SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS amount, count(DISTINCT o_custkey) AS customers FROM orders")
def global_aggregate(spark, sf):
    return table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"), R.money("o_totalprice").alias("amount"), F.countDistinct("o_custkey").alias("customers"))


@define("SELECT l_orderkey, l_linenumber, count(*) AS versions FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def having(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("versions")).filter("versions > 1")


@define("SELECT l_suppkey, CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS DOUBLE) / nullif(CAST(count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS DOUBLE), 0) AS rate FROM lineitem GROUP BY 1")
def guarded_ratio(spark, sf):
    n = lambda c, v: F.count(F.when(F.col(c) == v, 1))
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(R.ratio(n("l_returnflag", "R"), n("l_linestatus", "F")).alias("rate"))


@define("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def select_distinct(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", "o_orderstatus").distinct()


@define("""SELECT dt, CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(n) AS BIGINT) AS lines, count(DISTINCT l_orderkey) AS orders_n FROM (
SELECT CAST(l_shipdate AS DATE) AS dt, l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS amount, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) GROUP BY 1""")
def two_level_aggregate(spark, sf):
    per = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(_day("l_shipdate").alias("dt"), "l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).alias("amount"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("dt").agg(F.sum("amount").cast("double").alias("amount"), F.sum("n").alias("lines"), F.countDistinct("l_orderkey").alias("orders_n"))


# --- windows


@define(f"SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM {_LATEST}")
def dedup_latest(spark, sf):
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")


@define("SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def filter_then_dedup(spark, sf):
    return R.latest(table(spark, sf, "events").filter("event_type = 'purchase'"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "ts")


@define("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t WHERE rn = 1")
def dedup_subquery(spark, sf):
    _view(spark, sf, "events")
    return spark.sql("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) t where rn = 1")


@define("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq FROM orders")
def purchase_sequence(spark, sf):
    seq = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", seq.alias("seq"))


@define("SELECT o_orderkey, CAST(min(o_orderdate) OVER (PARTITION BY o_custkey) AS DATE) AS first_day FROM orders")
def window_minimum(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.min("o_orderdate").over(W.partitionBy("o_custkey")).cast("date").alias("first_day"))


# --- order, limit, shares, sets


@define("SELECT CAST(o_orderdate AS DATE) AS dt, count(*) AS n FROM orders GROUP BY 1 ORDER BY dt")
def ordered_series(spark, sf):
    return table(spark, sf, "orders").groupBy(_day("o_orderdate").alias("dt")).agg(F.count(F.lit(1)).alias("n")).orderBy("dt")


@define("SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS gmv FROM orders GROUP BY 1 ORDER BY gmv DESC, o_custkey LIMIT 30")
def top_30(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(R.money("o_totalprice").alias("gmv")).orderBy(F.desc("gmv"), "o_custkey").limit(30)


@define("""SELECT o_custkey, gmv AS o_totalprice, gmv / total AS share FROM (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS gmv FROM orders GROUP BY 1 ORDER BY gmv DESC, o_custkey LIMIT 30),
(SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM orders)""")
def share_of_total(spark, sf):
    return R.top_share(table(spark, sf, "orders"), "o_custkey", "o_totalprice", 30)


@define("SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS at FROM orders UNION ALL SELECT 'line', l_orderkey, l_shipdate FROM lineitem")
def union_versions(spark, sf):
    a = table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    return a.unionByName(table(spark, sf, "lineitem").select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("at")))


# --- scalar functions


@define("""SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day, CAST(l_quantity AS BIGINT) AS qty, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day_text,
coalesce(nullif(l_tax, 0), l_discount) AS fallback, abs(l_discount - l_tax) AS gap, CAST(round(CAST(l_extendedprice AS DECIMAL(18,4)), 1) AS DOUBLE) AS rounded FROM lineitem""")
def scalar_functions(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", _day("l_shipdate").alias("day"), F.col("l_quantity").cast("bigint").alias("qty"), _day("l_shipdate").cast("string").alias("day_text"),
        F.coalesce(F.nullif(F.col("l_tax"), F.lit(0.0)), F.col("l_discount")).alias("fallback"), F.abs(F.col("l_discount") - F.col("l_tax")).alias("gap"),
        F.round(F.col("l_extendedprice").cast("decimal(18,4)"), 1).cast("double").alias("rounded"),
    )


@define("""SELECT l_orderkey, l_linenumber, CAST(date_diff('day', o_orderdate, l_shipdate) AS BIGINT) AS days, CAST(date_diff('second', o_orderdate, l_shipdate) AS BIGINT) AS secs,
epoch(l_shipdate) AS at, o_orderdate + INTERVAL 30 MINUTE AS later FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def time_functions(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("days"), R.seconds_between("o_orderdate", "l_shipdate").alias("secs"), R.epoch("l_shipdate").alias("at"), F.expr("o_orderdate + interval 30 minute").alias("later"))


@define("""SELECT event_id, CASE WHEN event_type = 'purchase' AND (value > 50 OR user_id % 2 = 0) THEN 'big' WHEN event_type = 'error' THEN 'bad' ELSE event_type END AS label,
CASE WHEN value > 10 THEN 1.0::DOUBLE END AS marked FROM events""")
def searched_case(spark, sf):
    t, v = F.col("event_type"), F.col("value")
    label = F.when((t == "purchase") & ((v > 50) | (F.col("user_id") % 2 == 0)), "big").when(t == "error", "bad").otherwise(t)
    return table(spark, sf, "events").select("event_id", label.alias("label"), F.when(v > 10, 1.0).alias("marked"))


# --- dashboards and traps


@define(f"""WITH li AS {_LATEST}, d AS (SELECT CAST(l_shipdate AS DATE) AS dt, CAST(l_extendedprice AS DECIMAL(18,4)) AS amount, o_orderkey,
 CASE WHEN l_returnflag = 'R' AND date_diff('day', o_orderdate, l_shipdate) <= 14 THEN CAST(l_extendedprice AS DECIMAL(18,4)) ELSE 0 END AS refund
 FROM li LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus IN ('F', 'P'))
SELECT dt, CAST(sum(amount) AS DOUBLE) AS gmv, count(DISTINCT o_orderkey) AS orders_n, CAST(sum(refund) AS DOUBLE) AS refund_amt_14d,
 CAST(sum(refund) AS DOUBLE) / nullif(CAST(sum(amount) AS DOUBLE), 0) AS refund_rate_14d FROM d GROUP BY 1""")
def refund_rate_14d(spark, sf):
    """Daily 14-day refund rate: versions resolved, status as part of the join, window in the measure."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus").filter(F.col("o_orderstatus").isin("F", "P"))
    j = _lines(spark, sf).join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    refund = F.when((F.col("l_returnflag") == "R") & (F.datediff("l_shipdate", "o_orderdate") <= 14), F.col("l_extendedprice")).otherwise(0.0)
    out = j.groupBy(_day("l_shipdate").alias("dt")).agg(R.money("l_extendedprice").alias("gmv"), F.countDistinct("o_orderkey").alias("orders_n"), R.money(refund).alias("refund_amt_14d"))
    return out.withColumn("refund_rate_14d", R.ratio(F.col("refund_amt_14d"), F.col("gmv")))


@define("SELECT CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS mn, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS mx FROM orders")
def dashboard_meta(spark, sf):
    return table(spark, sf, "orders").agg(F.min(_day("o_orderdate")).cast("string").alias("mn"), F.max(_day("o_orderdate")).cast("string").alias("mx"))


@define("""WITH p AS (SELECT CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-03-31' THEN 1 ELSE 0 END AS cur, * FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-29' AND DATE '1997-03-31'),
a AS (SELECT cur, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS gmv, count(*) AS n, count(DISTINCT o_custkey) AS users FROM p GROUP BY 1),
b AS (SELECT c.gmv, q.gmv AS gmv_prev, c.n AS orders_n, q.n AS orders_prev, c.gmv / c.users AS atv, q.gmv / q.users AS atv_prev FROM a c, a q WHERE c.cur = 1 AND q.cur = 0)
SELECT *, CASE WHEN abs((gmv - gmv_prev) / nullif(abs(gmv_prev), 0)) < 0.0005 THEN 0 ELSE (gmv - gmv_prev) / nullif(abs(gmv_prev), 0) END AS gmv_delta FROM b""")
def period_over_period(spark, sf, start: str = "1997-03-01", end: str = "1997-03-31"):
    """A period against the equally long one before it; users are counted again on detail, ratios divided anew."""
    from tallyloom.functions.periods import span

    s, e, ps, pe = span(start, end)
    day = _day("o_orderdate")
    rows = table(spark, sf, "orders").filter(day.between(F.lit(ps), F.lit(e))).withColumn("cur", day >= F.lit(s))
    a = rows.groupBy("cur").agg(R.money("o_totalprice").alias("gmv"), F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("users"))
    pick = lambda c, cur: F.max(F.when(F.col("cur") == cur, F.col(c)))
    b = a.agg(*[pick(c, cur).alias(f"{c}{'' if cur else '_prev'}") for c in ("gmv", "n", "users") for cur in (True, False)])
    return b.select("gmv", "gmv_prev", F.col("n").alias("orders_n"), F.col("n_prev").alias("orders_prev"), (F.col("gmv") / F.col("users")).alias("atv"), (F.col("gmv_prev") / F.col("users_prev")).alias("atv_prev"), R.delta(F.col("gmv"), F.col("gmv_prev")).alias("gmv_delta"))


@define("""SELECT CAST(o_orderdate AS DATE) AS dt, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,4)) END), 0) AS DOUBLE) AS F,
CAST(coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,4)) END), 0) AS DOUBLE) AS O, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,4)) END), 0) AS DOUBLE) AS P FROM orders GROUP BY 1""")
def trend_pivot(spark, sf):
    return table(spark, sf, "orders").groupBy(_day("o_orderdate").alias("dt")).pivot("o_orderstatus", ["F", "O", "P"]).agg(R.money("o_totalprice")).fillna(0.0)


@define("SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS o_totalprice, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) / (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) FROM orders) AS share FROM orders GROUP BY 1")
def breakdown(spark, sf):
    return R.top_share(table(spark, sf, "orders"), "o_orderstatus", "o_totalprice", 30)


@define("SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) / count(DISTINCT o_custkey) AS per_user, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) / count(DISTINCT o_orderkey) AS per_order FROM orders")
def per_user_per_order(spark, sf):
    return table(spark, sf, "orders").agg((R.money("o_totalprice") / F.countDistinct("o_custkey")).alias("per_user"), (R.money("o_totalprice") / F.countDistinct("o_orderkey")).alias("per_order"))


@define("""WITH a AS (SELECT CAST(l_shipdate AS DATE) AS dt, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT dt, CAST(sum(v) AS DOUBLE) AS v FROM (SELECT CAST(l_shipdate AS DATE) AS dt, l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) GROUP BY 1)
SELECT count(*) AS days, max(abs(a.v - b.v)) AS most FROM a JOIN b USING (dt)""")
def duplicated_metric(spark, sf):
    r = table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    a = r.groupBy(_day("l_shipdate").alias("dt")).agg(R.money("l_extendedprice").alias("v"))
    b = two_level_aggregate(spark, sf).select("dt", F.col("amount").alias("w"))
    return a.join(b, "dt").agg(F.count(F.lit(1)).alias("days"), F.max(F.abs(F.col("v") - F.col("w"))).alias("most"))


@define("""WITH p AS (SELECT user_id, ts, lag(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen, event_type, event_id FROM events)
SELECT event_id, CASE WHEN seen IS NOT NULL AND ts <= seen + INTERVAL 30 MINUTE THEN 'view' ELSE 'direct' END AS attributed FROM p WHERE event_type = 'purchase'""")
def delayed_attribution(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    seen = F.last(F.when(F.col("event_type") == "view", F.col("ts")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    p = table(spark, sf, "events").withColumn("seen", seen).filter("event_type = 'purchase'")
    return p.select("event_id", F.when(F.expr("seen is not null and ts <= seen + interval 30 minute"), "view").otherwise("direct").alias("attributed"))


@define("SELECT 'by_ship' AS attribution, CAST(l_shipdate AS DATE) AS dt, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'by_order', CAST(o_orderdate AS DATE), count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 2")
def stat_date_attribution(spark, sf):
    li = table(spark, sf, "lineitem")
    a = li.groupBy(_day("l_shipdate").alias("dt")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("by_ship").alias("attribution"), "dt", "n")
    b = li.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(_day("o_orderdate").alias("dt")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b.select(F.lit("by_order").alias("attribution"), "dt", "n"))


@define("SELECT 'unique' AS test, count(*) AS failures FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'not_null', count(*) FROM orders WHERE o_custkey IS NULL UNION ALL SELECT 'accepted', count(*) FROM (SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))")
def column_tests(spark, sf):
    o = table(spark, sf, "orders")
    parts = [("unique", R.not_unique(o, "o_orderkey")), ("not_null", R.nulls(o, "o_custkey")), ("accepted", R.unaccepted(o, "o_orderstatus", ["F", "O"]))]
    out = None
    for name, rows in parts:
        one = rows.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("test"), "failures")
        out = one if out is None else out.unionByName(one)
    return out


@define("""SELECT dt, 'n' AS metric, CAST(a.n AS DOUBLE) AS "left", CAST(b.n AS DOUBLE) AS "right" FROM (SELECT CAST(l_shipdate AS DATE) AS dt, count(*) AS n FROM lineitem GROUP BY 1) a
FULL OUTER JOIN (SELECT CAST(l_shipdate AS DATE) AS dt, count(DISTINCT (l_orderkey, l_linenumber)) AS n FROM lineitem GROUP BY 1) b USING (dt) WHERE abs(a.n - b.n) > 0.011""")
def recompute_difference(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("dt", _day("l_shipdate"))
    return R.difference(li.groupBy("dt").agg(F.count(F.lit(1)).alias("n")), li.groupBy("dt").agg(F.countDistinct("l_orderkey", "l_linenumber").alias("n")), ["dt"], ["n"])


# --- the example project, the simulated warehouse, and definitions read from plans


def _quickstart(spark: SparkSession) -> None:
    from tallyloom.warehouse import models

    root = Path(__file__).resolve().parent.parent / "examples" / "quickstart" / "seeds"
    # small files beside the code: the driver reads them, so that executors need not have the folder
    seeds = {}
    for name, ddl in models.QUICKSTART_SOURCES.items():
        _, *lines = (root / f"{name}.csv").read_text().splitlines()
        seeds[name] = spark.createDataFrame([(x,) for x in lines], "value string").select(F.from_csv("value", F.lit(ddl)).alias("r")).select("r.*")
    models.build(spark, seeds, models.QUICKSTART)


@define("""SELECT * FROM (VALUES (DATE '2026-08-01', 393.0::DOUBLE, 393.0::DOUBLE / 10000), (DATE '2026-08-02', 700.0::DOUBLE, 700.0::DOUBLE / 5500), (DATE '2026-08-03', 0.0::DOUBLE, 0.0::DOUBLE))
t(stat_date, refund_amt_14d, refund_rate)""")
def quickstart_refund_rate(spark, sf):
    _quickstart(spark)
    return spark.table("dm_refund_rate_1d")


@define("SELECT * FROM (VALUES (DATE '2026-08-01', 10000.0::DOUBLE, 3::BIGINT), (DATE '2026-08-02', 5500.0::DOUBLE, 3), (DATE '2026-08-03', 2150.0::DOUBLE, 2)) t(stat_date, gmv, order_cnt)")
def quickstart_sales(spark, sf):
    _quickstart(spark)
    return spark.table("dm_sales_1d")


def _warehouse(spark: SparkSession) -> None:
    from tallyloom.warehouse import models, simulate

    models.build(spark, simulate.simulate(spark), models.MODELS, work_folder(spark))


@define("SELECT 'T' || i AS trap, true AS ok FROM range(1, 15) t(i)")
def warehouse_traps(spark, sf):
    from tallyloom.warehouse import checks

    _warehouse(spark)
    return checks.traps(spark).select("trap", "ok")


@define("""SELECT metric, true AS compared, 0::BIGINT AS differing FROM (VALUES ('gmv'), ('pay_amt'), ('pay_order_cnt'), ('pay_user_cnt'), ('atv'), ('refund_amt_14d'), ('refund_rate_14d'), ('refund_amt_total'),
('flash_refund_order_ratio'), ('delivered_rate'), ('avg_ship_hours'), ('new_user_cnt'), ('new_user_gmv_ratio'), ('repurchase_rate'), ('live_gmv')) t(metric)""")
def warehouse_recomputation(spark, sf):
    """Each measure of the overview: whether it has days to compare, and how many differ from the sources."""
    from tallyloom.warehouse import checks

    _warehouse(spark)
    return checks.confirmed(spark)


def _graph(spark: SparkSession, which: str = "quickstart"):
    from tallyloom.plans.lineage import build_graph
    from tallyloom.warehouse import models

    # a session of its own: empty views of the models must not hide the tables of this one
    own = spark.newSession()
    return build_graph(own, *((models.QUICKSTART, models.QUICKSTART_SOURCES) if which == "quickstart" else (models.MODELS, models.SOURCES)))


#: The example's column edges.
EDGES = [
    *[("stg_orders", c, "raw_orders", c) for c in ("order_id", "user_id", "amount", "status", "paid_at")],
    *[("stg_refunds", c, "raw_refunds", c) for c in ("refund_id", "order_id", "refund_amount", "refunded_at")],
    ("dm_sales_1d", "stat_date", "stg_orders", "paid_at"), ("dm_sales_1d", "gmv", "stg_orders", "amount"), ("dm_sales_1d", "order_cnt", "stg_orders", "order_id"),
    ("dm_refund_rate_1d", "stat_date", "stg_orders", "paid_at"), ("dm_refund_rate_1d", "refund_amt_14d", "stg_refunds", "refund_amount"),
    ("dm_refund_rate_1d", "refund_rate", "stg_orders", "amount"), ("dm_refund_rate_1d", "refund_rate", "stg_refunds", "refund_amount"),
]
_EDGES_SQL = "(VALUES " + ", ".join(str(e) for e in EDGES) + ') e(model, "column", up_model, up_column)'


@define(f"SELECT * FROM {_EDGES_SQL}")
def lineage_edges(spark, sf):
    return _graph(spark).column_edges()


@define(f"""WITH RECURSIVE e AS (SELECT * FROM {_EDGES_SQL}), c AS (
SELECT model, "column", up_model, up_column, 1 AS hops FROM e UNION SELECT c.model, c."column", e.up_model, e.up_column, c.hops + 1 FROM c JOIN e ON c.up_model = e.model AND c.up_column = e."column")
SELECT model, "column", up_model, up_column, CAST(min(hops) AS INTEGER) AS hops FROM c GROUP BY ALL""")
def lineage_closure(spark, sf):
    from tallyloom.plans.trace import closure

    return closure(_graph(spark).column_edges())


@define("""SELECT * FROM (VALUES ('stg_orders', 'where', 'is_test = 0', true), ('stg_refunds', 'qualify', 'rn = 1', true), ('dm_sales_1d', 'where', 'status = ''paid''', true),
('dm_refund_rate_1d', 'join_on', 'order_id = order_id', false), ('dm_refund_rate_1d', 'where', 'status = ''paid''', true), ('dm_refund_rate_1d', 'where', 'refunded_at <= paid_at + interval ''14'' day', false),
('dm_refund_rate_1d', 'join_on', 'order_id = order_id', false)) t(model, kind, norm, row_level)""")
def lineage_conditions(spark, sf):
    return _graph(spark).conditions().select("model", "kind", "norm", "row_level")


@define("""SELECT * FROM (VALUES ('stg_refunds', 'window', 'rn'), ('dm_sales_1d', 'stat_date_key', 'stat_date'), ('dm_refund_rate_1d', 'coalesce', 'refund_amt_14d'),
('dm_refund_rate_1d', 'coalesce', 'refund_rate'), ('dm_refund_rate_1d', 'stat_date_key', 'stat_date')) t(model, type, "column")""")
def lineage_semantics(spark, sf):
    return _graph(spark).semantics().select("model", "type", "column")


@define("""SELECT * FROM (VALUES ('app_business_overview_1d.refund_amt_total', 'dm_trade_stats_1d.refund_amt', 'duplicate'),
('dm_after_sale_stats_1d.refund_amt_total', 'dm_trade_stats_1d.refund_amt', 'duplicate')) t(a, b, tier)""")
def governance_duplicates(spark, sf):
    """The refund amount that is built twice (trap T8), and the wide table's copy of one of the two."""
    from tallyloom.plans import governance

    g = _graph(spark, "warehouse")
    return governance.pairs(governance.metric_rows(g, ("dt", "order_id", "user_id"), ("dm", "app"))).filter("tier = 'duplicate'").select("a", "b", "tier")


@define("SELECT * FROM (VALUES ('rate', 'condition_added', 'high'), ('rate', 'condition_removed', 'high')) t(metric, kind, severity)")
def drift_events(spark, sf):
    import dataclasses

    from tallyloom.plans import governance
    from tallyloom.plans.lineage import build_graph
    from tallyloom.warehouse import models

    own, snaps = spark.newSession(), []
    for days in ("14 day", "30 day"):
        changed = [dataclasses.replace(m, sql=m.sql.replace("14 day", days)) for m in models.QUICKSTART]
        snaps.append(governance.facts_of(own, governance.snapshot(build_graph(own, changed, models.QUICKSTART_SOURCES), {"rate": "dm_refund_rate_1d.refund_rate"})))
    return governance.drift(*snaps).select("metric", "kind", "severity")


@define("SELECT 170::BIGINT AS columns_n, 170::BIGINT AS proven")
def formulas_proven(spark, sf):
    from tallyloom.plans.formula import compose

    g = _graph(spark, "warehouse")
    found = [compose(g, f"{f.model}.{c}").status for f in g.facts.values() for c, _ in f.columns]
    return g.spark.createDataFrame([(len(found), found.count("proven"))], "columns_n bigint, proven bigint")


#: Small definitions with a case each: values of either side of a join, unions, sub-queries as conditions, a part that can't be told.
CASES = {
    "sides": "select a.x, s.v, t.w from raw_a a left join (select id, v from raw_b where flag = 1) s on a.id = s.id and s.v > 3 left join (select id, v as w from raw_b where flag = 2) t on a.id = t.id",
    "joined": "select a.x from raw_a a join raw_b b on a.id = b.id and b.flag = 4 where a.k > 0",
    "both": "select x as y from raw_a union all select v * 2 from raw_b",
    "total": "select sum(y) as s from both",
    "among": "select x from raw_a a where exists (select 1 from raw_b b where b.id = a.id and b.flag = 1)",
    "among_others": "select x from raw_a a where exists (select 1 from raw_b b where b.id = a.id and b.flag = 2)",
    "again": "select id, x from raw_a a where k = 1 and exists (select 1 from raw_b b where b.id = a.id and b.flag = 1)",
    "highest": "select x - (select max(v) from raw_b) as d from raw_a",
}
CASE_SOURCES = {"raw_a": "id int, x int, k int, flag int", "raw_b": "id int, v int, flag int"}


def _cases(spark: SparkSession):
    from tallyloom.plans.lineage import build_graph
    from tallyloom.warehouse.models import Model

    return build_graph(spark.newSession(), [Model(k, "", v) for k, v in CASES.items()], CASE_SOURCES)


@define("""SELECT * FROM (VALUES ('sides.v', 'id = id'), ('sides.v', 'v > 3'), ('sides.v', 'flag = 1'), ('sides.w', 'id = id'), ('sides.w', 'flag = 2'),
('joined.x', 'id = id'), ('joined.x', 'flag = 4'), ('joined.x', 'k > 0')) t(target, norm)""")
def trace_conditions(spark, sf):
    """Conditions by the value they bind: each side of a join has its own, the preserved side none."""
    from tallyloom.plans.trace import trace

    g = _cases(spark)
    return g.spark.createDataFrame([(t, c["norm"]) for t in ("sides.x", "sides.v", "sides.w", "joined.x") for c in trace(g, t).conditions], "target string, norm string")


@define("SELECT * FROM (VALUES ('both.y', 'proven', 'union(1: raw_a.x; 2: (raw_b.v * 2))', 'raw_a.x,raw_b.v')) t(target, status, formula, leaves)")
def union_formula(spark, sf):
    from tallyloom.plans.formula import compose

    g = _cases(spark)
    f = compose(g, "both.y")
    return g.spark.createDataFrame([("both.y", f.status, f.top, ",".join(f.leaves))], "target string, status string, formula string, leaves string")


@define("SELECT * FROM (VALUES ('highest.d', 'ambiguous'), ('among.x', 'proven'), ('total.s', 'proven')) t(target, status)")
def refused_formula(spark, sf):
    from tallyloom.plans.formula import compose

    g = _cases(spark)
    return g.spark.createDataFrame([(t, compose(g, t).status) for t in ("highest.d", "among.x", "total.s")], "target string, status string")


@define("SELECT * FROM (VALUES ('again', 'among')) t(a, b)")
def condition_fingerprints(spark, sf):
    """Models that share an EXISTS condition: those whose sub-queries say the same."""
    g = _cases(spark)
    c = g.conditions().filter("sql like 'EXISTS%' or sql like 'exists%'").select("model", "fp").distinct()
    return c.select(F.col("model").alias("a"), "fp").join(c.select(F.col("model").alias("b"), "fp"), "fp").filter("a < b").select("a", "b")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
