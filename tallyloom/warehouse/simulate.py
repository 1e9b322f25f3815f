"""Sources of the warehouse as Spark expressions of row numbers: every value follows from a
hash of the row's id and the column, so any part of any size comes out the same everywhere,
on any number of machines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, DAYS = "2026-06-01", 90
#: Fixed values of the simulated world.
PROVINCES = ("Guangdong", "Zhejiang", "Jiangsu", "Sichuan", "Beijing", "Shanghai", "Hubei", "Shandong")
CATEGORIES = ("clothing", "food", "beauty", "digital", "home", "sports")
RATES = [("CNY", 1.0, "2020-01-01", "2030-12-31"), ("USD", 7.25, "2020-01-01", "2026-06-20"), ("USD", 7.1, "2026-06-21", "2026-07-20"), ("USD", 6.95, "2026-07-21", "2026-08-10"), ("USD", 7.05, "2026-08-11", "2030-12-31")]


def unit(key: str, salt: str) -> Column:
    """A number in [0, 1) drawn for a row and a purpose."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def pick(u: Column, values: tuple, weights: tuple[float, ...] | None = None) -> Column:
    """One of the values by a number in [0, 1)."""
    weights = weights or tuple(1 / len(values) for _ in values)
    out, at = F.lit(values[-1]), sum(weights)
    for v, w in reversed(list(zip(values, weights, strict=True))):
        at -= w
        out = F.when(u < at + w, F.lit(v)).otherwise(out)
    return out


def wait(u: Column, mean: float) -> Column:
    """An exponential delay in whole seconds."""
    return F.floor(-F.log(1 - u) * mean).cast("bigint")


def after(t: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(t.cast("timestamp")) + seconds).cast("timestamp_ntz")


def simulate(spark: SparkSession, orders: int = 20_000, users: int = 4_000) -> dict[str, DataFrame]:
    parts = max(1, math.ceil(orders / 500_000))
    zero = F.lit(f"{START} 00:00:00").cast("timestamp_ntz")
    u = spark.range(0, users, 1, parts).withColumnRenamed("id", "user_id")
    user = u.select(
        "user_id", F.concat(F.lit("user"), "user_id").alias("nick_name"), pick(unit("user_id", "g"), ("F", "M", "U"), (0.5, 0.45, 0.05)).alias("gender"),
        pick(unit("user_id", "p"), PROVINCES).alias("province"), after(zero, F.floor((unit("user_id", "r") * 1.2 - 0.7) * DAYS * 86400).cast("bigint")).alias("register_time"),
        pick(unit("user_id", "c"), ("app", "h5", "live", "ground")).alias("register_channel"), (unit("user_id", "t") < 0.01).cast("int").alias("is_test_account"),
    )
    user = user.withColumn("binlog_ts", F.col("register_time"))
    user = user.unionByName(user.filter("user_id % 3 = 0").withColumn("binlog_ts", F.expr("binlog_ts + interval 5 day")))

    o = spark.range(0, orders, 1, parts).withColumnRenamed("id", "order_id")
    o = o.withColumn("user_id", F.floor(F.pow(unit("order_id", "u"), F.lit(1.6)) * users).cast("bigint"))
    o = o.withColumn("order_time", after(zero, F.floor(unit("order_id", "o") * DAYS * 86400).cast("bigint")))
    o = o.withColumn("paid", unit("order_id", "paid") < 0.88).withColumn("pay_time", F.when(F.col("paid"), after(F.col("order_time"), wait(unit("order_id", "w"), 400.0))))
    o = o.withColumn("channel_id", pick(unit("order_id", "c"), ("app", "h5", "live"), (0.6, 0.2, 0.2)))
    watched = (F.col("channel_id") == "live") | (unit("order_id", "lw") < 0.1)
    o = o.withColumn("live_room_id", F.when(watched, F.floor(unit("order_id", "lr") * 40 + 1).cast("double")))
    o = o.withColumn("live_end_time", F.when(F.col("live_room_id").isNotNull(), after(F.col("order_time"), F.floor((unit("order_id", "le") - 0.4) * 7200).cast("bigint"))))
    o = o.withColumn("category_id", F.floor(unit("order_id", "k") * len(CATEGORIES)).cast("int")).withColumn("category_name", F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category_id") + 1))
    o = o.withColumn("province", pick(unit("order_id", "p"), PROVINCES)).withColumn("order_amt", F.round(F.exp(F.lit(4.2) + 1.8 * (unit("order_id", "a") + unit("order_id", "b") - 1)), 2))
    o = o.withColumn("currency", F.when(unit("order_id", "cur") < 0.04, "USD").otherwise("CNY")).withColumn("item_cnt", (F.floor(unit("order_id", "i") * 4) + 1).cast("int"))
    o = o.withColumn("is_presale", (unit("order_id", "pre") < 0.12).cast("int")).withColumn("is_risk_order", (unit("order_id", "risk") < 0.01).cast("int"))
    # One draw deals paid orders into cohorts that exclude each other: refunded within a minute, around day 14, later or at once, never.
    o = o.withColumn("cohort", F.when(~F.col("paid"), "none").otherwise(pick(unit("order_id", "cohort"), ("flash", "edge", "usual", "none"), (0.02, 0.05, 0.1, 0.83))))
    shipped = F.col("paid") & (F.col("cohort") != "flash")
    done = F.when(~F.col("paid"), F.lit(60)).when(F.col("cohort") == "flash", 90).when(shipped & (unit("order_id", "st") < 0.8), 40).otherwise(30)
    o = o.withColumn("final_status", done.cast("int")).withColumn("shipped", shipped).cache()
    columns = ["order_id", "user_id", "order_time", "pay_time", "order_status", "channel_id", "live_room_id", "live_end_time", "category_id", "category_name", "province", "order_amt", "currency", "item_cnt", "is_presale", "is_risk_order", "binlog_ts"]
    made = o.withColumn("order_status", F.lit(10)).withColumn("binlog_ts", F.col("order_time")).withColumn("pay_time", F.lit(None).cast("timestamp_ntz")).select(columns)
    paid = o.filter("paid").withColumn("order_status", F.lit(20)).withColumn("binlog_ts", F.col("pay_time")).select(columns)
    last = o.withColumn("order_status", F.col("final_status")).withColumn("binlog_ts", F.expr("coalesce(pay_time, order_time) + interval 20 day")).select(columns)
    order = made.unionByName(paid).unionByName(last)

    item = o.select("order_id", "category_id", "category_name", "order_amt", "currency", "order_time", F.explode(F.sequence(F.lit(1), F.col("item_cnt"))).alias("n")).withColumn("item_id", F.col("order_id") * 10 + F.col("n"))
    item = item.withColumn("w", unit("item_id", "w") + 0.1)
    total = item.groupBy("order_id").agg(F.sum("w").alias("all_w"))
    item = item.join(total, "order_id").select("item_id", "order_id", F.floor(unit("item_id", "s") * 5000).cast("int").alias("sku_id"), F.concat(F.lit("sku"), "item_id").alias("sku_name"), "category_id", "category_name", (F.col("order_amt") * F.col("w") / F.col("all_w")).alias("item_amt"), F.lit(1).alias("quantity"), "currency", F.col("order_time").alias("binlog_ts"))

    rate = spark.createDataFrame(RATES, "currency string, rate_to_cny double, a string, b string").select("currency", "rate_to_cny", F.col("a").cast("date").alias("effective_start"), F.col("b").cast("date").alias("effective_end"))
    cny = F.when(F.col("currency") == "USD", F.col("order_amt") * 7.1).otherwise(F.col("order_amt"))
    pay = o.filter("paid").select((F.col("order_id") * 2).alias("pay_id"), "order_id", "user_id", F.round(cny * 100).cast("bigint").alias("pay_amt_cent"), F.lit("CNY").alias("currency_pay"), pick(unit("order_id", "pt"), ("alipay", "wechat", "card")).alias("pay_type"), F.lit("SUCCESS").alias("pay_status"), "pay_time")
    failed = pay.filter("order_id % 20 = 0").withColumn("pay_id", F.col("pay_id") + 1).withColumn("pay_status", F.lit("FAIL"))
    pay = pay.unionByName(failed).withColumn("binlog_ts", F.col("pay_time"))

    back = o.filter("cohort in ('flash', 'edge', 'usual')")
    delay = F.when(F.col("cohort") == "flash", F.floor(unit("order_id", "fd") * 50).cast("bigint")).when(F.col("cohort") == "edge", (F.floor(unit("order_id", "ed") * 3) + 11) * 86400).otherwise(wait(unit("order_id", "ud"), 8 * 86400.0) + 120)
    apply_ = back.withColumn("apply_time", after(F.col("pay_time"), delay)).withColumn("ok", unit("order_id", "ok") < 0.93)
    apply_ = apply_.select((F.col("order_id") + 1_000_000_000).alias("refund_id"), "order_id", "user_id", "cohort", "ok", F.when(F.col("shipped"), "return").otherwise("refund_only").alias("refund_type"), pick(unit("order_id", "why"), ("size", "quality", "regret")).alias("refund_reason"), F.round(cny * 100).cast("bigint").alias("refund_apply_amt_cent"), "apply_time", "pay_time")
    first = apply_.withColumn("refund_status", F.lit("APPLY")).withColumn("binlog_ts", F.col("apply_time"))
    second = apply_.withColumn("refund_status", F.when(F.col("ok"), "REFUNDED").otherwise("REJECTED")).withColumn("binlog_ts", F.expr("apply_time + interval 3 day"))
    kept = ["refund_id", "order_id", "user_id", "refund_type", "refund_status", "refund_reason", "refund_apply_amt_cent", "apply_time", "binlog_ts"]
    payout = apply_.filter("ok").select((F.col("refund_id") * 2).alias("refund_pay_id"), "refund_id", "order_id", F.when(unit("refund_id", "miss") >= 0.06, F.col("refund_apply_amt_cent").cast("double")).alias("refund_suc_amt_cent"), F.lit("original").alias("payout_channel"), after(F.col("apply_time"), F.when(F.col("cohort") == "flash", F.lit(30)).otherwise(F.floor(unit("refund_id", "pd") * 2.5 * 86400)).cast("bigint")).alias("refund_suc_time"))
    payout = payout.withColumn("binlog_ts", F.col("refund_suc_time"))

    w = o.filter("shipped").select("order_id", "pay_time", "is_presale", (F.col("order_id") + 5_000_000_000).alias("waybill_id"))
    w = w.withColumn("ship_op_time", after(F.col("pay_time"), wait(unit("waybill_id", "so"), 10 * 3600.0) + F.col("is_presale") * 6 * 86400 + 600))
    w = w.withColumn("pickup_time", F.when(unit("waybill_id", "pu") < 0.97, after(F.col("ship_op_time"), wait(unit("waybill_id", "pw"), 8 * 3600.0) + 3600)))
    w = w.withColumn("sign_time", F.when(F.col("pickup_time").isNotNull() & (unit("waybill_id", "sg") < 0.93), after(F.col("pickup_time"), wait(unit("waybill_id", "sw"), 40 * 3600.0) + 7200)))
    logistics = w.select("waybill_id", "order_id", pick(unit("waybill_id", "ca"), ("SF", "YTO", "ZTO")).alias("carrier"), pick(unit("waybill_id", "wh"), ("W1", "W2", "W3")).alias("warehouse_code"), "ship_op_time", F.when(F.col("sign_time").isNotNull(), "SIGNED").when(F.col("pickup_time").isNotNull(), "TRANSPORT").otherwise("SHIPPED").alias("logistics_status"), F.col("ship_op_time").alias("binlog_ts"))
    event = lambda kind, time, extra=0: w.select("waybill_id", F.lit(kind).alias("event_type"), after(F.col(time), F.lit(extra)).alias("event_time")).filter("event_time is not null")
    trace = event("SHIP", "ship_op_time").unionByName(event("PICKUP", "pickup_time")).unionByName(event("SIGN", "sign_time")).unionByName(event("SIGN", "sign_time", 900).filter("waybill_id % 9 = 0"))
    trace = trace.withColumn("trace_id", F.xxhash64("waybill_id", "event_type", "event_time"))
    return {
        "ods_user_info": user, "ods_order_info": order, "ods_order_item": item, "ods_payment_flow": pay, "ods_exchange_rate": rate,
        "ods_refund_apply": first.select(kept).unionByName(second.select(kept)), "ods_refund_payment": payout, "ods_logistics_order": logistics, "ods_logistics_trace": trace,
    }
