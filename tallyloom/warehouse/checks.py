"""Checks of the built warehouse: whether each of fourteen traps shows in the data, and the
overview computed once more from the sources alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyloom.operators import relational as R

Tables = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Trap:
    """numbers: one row over the tables; shows: what has to hold of it. Counts are asked as shares, so that it holds at any size."""

    title: str
    numbers: Callable[[Tables], DataFrame]
    shows: Callable[[], Column]


def _share(condition: Column | str) -> Column:
    """Of all rows, the share that meets a condition."""
    condition = F.expr(condition) if isinstance(condition, str) else condition
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def _flash(t: Tables) -> DataFrame:
    by = t("dwm_trade_order_flag_1d").groupBy("is_flash_refund").agg(F.count(F.lit(1)).alias("n"), F.sum("order_amt_cny").alias("amt"))
    part = lambda c: F.sum(F.col(c) * F.col("is_flash_refund")) / F.sum(c)
    return by.agg(part("n").alias("of_orders"), part("amt").alias("of_amount"))


def _boundary(t: Tables) -> DataFrame:
    """The refunds that were paid out on the days around the window's end, each day for itself."""
    rows = t("dwd_after_refund_detail").filter("refund_status = 'REFUNDED' and days_pay_to_refund is not null")
    day = F.col("days_pay_to_refund")
    return rows.agg(
        (F.sum(F.when(day > 14, F.col("refund_amt"))) / F.sum("refund_amt")).alias("outside"),
        *[_share(day == d).alias(f"day_{d}") for d in (13, 14, 15)],
        F.sum(F.when(day == 14, F.col("refund_amt"))).alias("amt_14"),
    )


def _first_days(t: Tables) -> DataFrame:
    both = t("dwm_user_first_pay_1d").join(t("dwd_user_register_detail"), "user_id")
    return both.agg(_share("first_pay_date <> register_date").alias("apart"))


def _parcels(t: Tables) -> DataFrame:
    events = t("ods_logistics_trace").groupBy("waybill_id").agg(F.count_if(F.col("event_type") == "SIGN").alias("signs"), F.max(F.col("event_type") == "PICKUP").alias("picked"))
    every = t("ods_logistics_order").select("waybill_id").distinct().join(events, "waybill_id", "left")
    return every.agg(_share("signs > 1").alias("signed_twice"), _share("picked").alias("picked"))


def _averages(t: Tables) -> DataFrame:
    users = t("dwm_trade_order_flag_1d").groupBy("user_id").agg(F.count(F.lit(1)).alias("orders"))
    return users.agg((F.sum("orders") / F.count(F.lit(1)) - 1).alias("apart"))


def _shipping(t: Tables) -> DataFrame:
    rows = t("dwd_logistics_ship_detail").filter("pickup_time is not null")
    hours = lambda to: F.expr(f"timestampdiff(SECOND, pay_time, {to})") / 3600
    by = rows.groupBy("is_presale").agg(F.count(F.lit(1)).alias("n"), F.sum(hours("pickup_time")).alias("h"), F.sum(hours("ship_op_time")).alias("operated"))
    now = F.col("is_presale") == 0
    usual = F.sum(F.when(now, F.col("h"))) / F.sum(F.when(now, F.col("n")))
    return by.agg((F.sum("h") / F.sum("n") / usual - 1).alias("presale_adds"), (usual - F.sum(F.when(now, F.col("operated"))) / F.sum(F.when(now, F.col("n")))).alias("hours_later"))


def _rates_of_one_name(t: Tables) -> DataFrame:
    both = t("dm_trade_stats_1d").select("dt", "refund_rate").join(t("app_business_overview_1d").select("dt", "refund_rate_14d"), "dt")
    return both.filter("refund_rate_14d <> 0").agg(F.avg(F.abs(F.col("refund_rate") / F.col("refund_rate_14d") - 1)).alias("apart"))


def _built_twice(t: Tables) -> DataFrame:
    a = t("dm_trade_stats_1d").select("dt", F.coalesce("refund_amt", F.lit(0.0)).alias("amt"))
    b = t("dm_after_sale_stats_1d").select("dt", F.coalesce("refund_amt_total", F.lit(0.0)).alias("amt"))
    common = a.select("dt").intersect(b.select("dt"))
    differing = R.difference(a.join(common, "dt", "left_semi"), b.join(common, "dt", "left_semi"), ["dt"], ["amt"])
    counts = differing.agg(F.count(F.lit(1)).alias("n")).select(F.lit("differing").alias("k"), "n").unionByName(common.agg(F.count(F.lit(1)).alias("n")).select(F.lit("days").alias("k"), "n"))
    return counts.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("days", "differing")])


def _versions(t: Tables) -> DataFrame:
    source = t("ods_order_info").groupBy("order_id").agg(F.count(F.lit(1)).alias("versions"))
    detail = t("dwd_trade_order_detail").groupBy("order_id").agg(F.count(F.lit(1)).alias("rows"))
    return source.join(detail, "order_id", "left").agg(F.avg("versions").alias("versions"), F.max("rows").alias("most_rows"))


def _again(t: Tables) -> DataFrame:
    last = t("dwm_trade_order_flag_1d").groupBy("user_id").agg(F.max("purchase_seq").alias("purchases"))
    return last.agg(_share("purchases > 1").alias("again"))


def _after_the_show(t: Tables) -> DataFrame:
    amount = lambda c: F.sum(F.when(F.col(c) == "live", F.col("order_amt_cny")))
    return t("dwm_trade_order_flag_1d").agg((amount("attributed_channel") / amount("channel_id") - 1).alias("more"))


def _rates_in_force(t: Tables) -> DataFrame:
    rows = t("dwd_trade_order_detail").filter("currency = 'USD' and pay_date is not null")
    held = R.in_force(rows, t("ods_exchange_rate"), ["currency"], F.col("_f.pay_date"), "effective_start", "effective_end", "inner")
    return held.agg(F.countDistinct("rate_to_cny").alias("rates"), (F.sum("order_amt_cny") / F.sum("order_amt")).alias("factor"))


def _payouts(t: Tables) -> DataFrame:
    rows = t("dwd_after_refund_detail").filter("refund_status = 'REFUNDED'")
    return rows.agg(_share("refund_suc_amt is null").alias("missing"), (F.sum("refund_amt") / F.sum("refund_suc_amt") - 1).alias("filled_in"), _share("refund_suc_date > cast(apply_time as date)").alias("later_day"))


_C = F.col
TRAPS = {
    "T1": Trap("flash refunds leave the GMV", _flash, lambda: (_C("of_orders") > 0.003) & (_C("of_amount") > 0.003)),
    "T2": Trap("14-day refund window", _boundary, lambda: (_C("outside") > 0.02) & (_C("day_13") > 0.002) & (_C("day_14") > 0.002) & (_C("day_15") > 0.002) & (_C("amt_14") > 0)),
    "T3": Trap("new users by first payment, not registration", _first_days, lambda: _C("apart") > 0.2),
    "T4": Trap("delivered rate over picked-up parcels", _parcels, lambda: (_C("signed_twice") > 0.02) & (_C("picked") < 1)),
    "T5": Trap("average per user or per order", _averages, lambda: _C("apart") > 0.05),
    "T6": Trap("hours to ship without presale, to pick-up", _shipping, lambda: (_C("presale_adds") > 0.15) & (_C("hours_later") > 1)),
    "T7": Trap("two refund rates of one name", _rates_of_one_name, lambda: _C("apart") > 0.05),
    "T8": Trap("one refund amount built twice", _built_twice, lambda: (_C("differing") == 0) & (_C("days") > 80)),
    "T9": Trap("several versions of an order", _versions, lambda: (_C("versions") > 1.5) & (_C("most_rows") == 1)),
    "T10": Trap("repurchase by sequence", _again, lambda: _C("again").between(0.05, 0.95)),
    "T11": Trap("live attribution after the show", _after_the_show, lambda: _C("more") > 0.02),
    "T12": Trap("rate in force on the day", _rates_in_force, lambda: (_C("rates") >= 3) & (_C("factor") > 5)),
    "T13": Trap("missing payout amounts", _payouts, lambda: (_C("missing") > 0.02) & (_C("filled_in") > 0.01)),
    "T14": Trap("payout on another day", _payouts, lambda: _C("later_day") > 0.3),
}


def traps(spark: SparkSession) -> DataFrame:
    """trap, title, ok and the numbers as JSON, over the warehouse's views."""
    rows = [x.numbers(spark.table).select(F.lit(name).alias("trap"), F.lit(x.title).alias("title"), x.shows().alias("ok"), F.to_json(F.struct("*")).alias("numbers")) for name, x in TRAPS.items()]
    return reduce(DataFrame.unionByName, rows)


MEASURES = ("gmv", "pay_amt", "pay_order_cnt", "pay_user_cnt", "atv", "refund_amt_14d", "refund_rate_14d", "refund_amt_total", "flash_refund_order_ratio", "delivered_rate", "avg_ship_hours", "new_user_cnt", "new_user_gmv_ratio", "repurchase_rate", "live_gmv")


def _paid_orders(t: Tables) -> DataFrame:
    """The orders that count, straight from the sources: last versions, real users, rate of the day, a successful payment."""
    real = R.latest(t("ods_user_info"), ["user_id"], [F.desc("binlog_ts")]).filter("coalesce(is_test_account, 0) = 0")
    order = R.latest(t("ods_order_info"), ["order_id"], [F.desc("binlog_ts")]).filter("is_risk_order = 0 and pay_time is not null and order_status in (20, 30, 40, 50, 90)")
    order = order.join(real, "user_id", "left_semi").withColumn("dt", F.to_date("pay_time"))
    order = R.in_force(order, t("ods_exchange_rate"), ["currency"], F.col("_f.dt"), "effective_start", "effective_end")
    flow = R.latest(t("ods_payment_flow").filter("pay_status = 'SUCCESS'"), ["order_id"], [F.desc("pay_time")]).select("order_id", (F.col("pay_amt_cent") / 100).alias("paid"))
    order = order.join(flow, "order_id").withColumn("amt", F.round(F.col("order_amt") * F.col("rate_to_cny"), 2))
    wishes = R.latest(t("ods_refund_apply"), ["refund_id"], [F.desc("binlog_ts")]).select("order_id", "apply_time")
    quick = order.select("order_id", "pay_time").join(wishes, "order_id").filter(R.seconds_between("pay_time", "apply_time") <= 60)
    return R.flagged(order, quick, ["order_id"], "flash")


def recomputed(t: Tables) -> DataFrame:
    """The overview's measures by day from the sources, by routes that the models don't take:
    counts a user and day before counts a day, earlier days of a user by a window."""
    order = _paid_orders(t)
    mine = order.groupBy("dt", "user_id").agg(
        F.sum("paid").alias("paid"), F.count(F.lit(1)).alias("orders"), F.sum("flash").alias("flash"), F.sum(F.col("amt") * (1 - F.col("flash"))).alias("amt"),
        F.sum(F.when((F.col("live_room_id") > 0) & ((F.col("channel_id") == "live") | F.expr("pay_time <= live_end_time + interval 30 minute")) | (F.col("channel_id") == "live"), F.col("amt") * (1 - F.col("flash")))).alias("live"),
    )
    ahead = F.sum("orders").over(W.partitionBy("user_id").orderBy("dt").rowsBetween(W.unboundedPreceding, -1))
    mine = mine.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    new = F.col("ahead") == 0
    day = mine.groupBy("dt").agg(
        F.sum("amt").alias("gmv"), F.sum("paid").alias("pay_amt"), F.sum("orders").alias("pay_order_cnt"), F.count(F.lit(1)).alias("pay_user_cnt"), F.sum("flash").alias("flash"),
        F.count_if(new).alias("new_user_cnt"), F.sum(F.when(new, F.col("amt")).otherwise(0.0)).alias("new_amt"), F.count_if(F.col("ahead") + F.col("orders") > 1).alias("again"), F.sum("live").alias("live_gmv"),
    )
    placed = R.latest(t("ods_order_info"), ["order_id"], [F.desc("binlog_ts")]).filter("is_risk_order = 0")
    placed = placed.join(R.latest(t("ods_user_info"), ["user_id"], [F.desc("binlog_ts")]).filter("coalesce(is_test_account, 0) = 0"), "user_id", "left_semi").select("order_id", "pay_time", "order_status", "is_presale")
    wishes = R.latest(t("ods_refund_apply"), ["refund_id"], [F.desc("binlog_ts")]).filter("refund_status = 'REFUNDED'")
    back = wishes.join(t("ods_refund_payment").filter("refund_suc_time is not null").select("refund_id", "refund_suc_time", "refund_suc_amt_cent"), "refund_id")
    back = back.join(placed.filter("order_status in (20, 30, 40, 50, 90)").select("order_id", "pay_time"), "order_id")
    back = back.withColumn("amt", F.coalesce("refund_suc_amt_cent", "refund_apply_amt_cent") / 100).withColumn("near", F.datediff("refund_suc_time", "pay_time") <= 14)
    refunds = back.groupBy(F.to_date("refund_suc_time").alias("dt")).agg(F.sum("amt").alias("refund_amt_total"), F.sum(F.when(F.col("near"), F.col("amt")).otherwise(0.0)).alias("refund_amt_14d"))
    parcel = R.widened(t("ods_logistics_trace"), "waybill_id", "event_type", "event_time", {"PICKUP": "pickup", "SIGN": "sign"}).filter("pickup is not null")
    parcel = parcel.join(t("ods_logistics_order").select("waybill_id", "order_id"), "waybill_id").join(placed, "order_id")
    hours = F.expr("timestampdiff(MICROSECOND, pay_time, pickup)") / 3.6e9
    ship = parcel.groupBy(F.to_date("pickup").alias("dt")).agg(_share("sign is not null").alias("delivered_rate"), F.avg(F.when(F.col("is_presale") == 0, hours)).alias("avg_ship_hours"))
    out = day.join(refunds, "dt", "left").join(ship, "dt", "left")
    over = lambda a, b: R.ratio(F.col(a), F.col(b))
    return out.withColumns({"atv": over("pay_amt", "pay_user_cnt"), "refund_rate_14d": over("refund_amt_14d", "pay_amt"), "flash_refund_order_ratio": over("flash", "pay_order_cnt"), "new_user_gmv_ratio": over("new_amt", "gmv"), "repurchase_rate": over("again", "pay_user_cnt")}).select("dt", *MEASURES)


def overview(t: Tables) -> DataFrame:
    """The wide table's measures, and the channel table's live amount."""
    live = t("app_channel_overview_1d").filter("attributed_channel = 'live'").groupBy("dt").agg(F.sum("gmv").alias("live_gmv"))
    return t("app_business_overview_1d").join(live, "dt", "left").select("dt", *MEASURES)


def recomputation(spark: SparkSession) -> DataFrame:
    """Cells of the overview that the recomputation doesn't confirm; none in a sound build."""
    return R.difference(overview(spark.table), recomputed(spark.table), ["dt"], MEASURES)


def confirmed(spark: SparkSession) -> DataFrame:
    """For each measure: whether there are days and values to compare, and how many days differ."""
    differing = recomputation(spark).groupBy("metric").agg(F.count(F.lit(1)).alias("differing"))
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in MEASURES]))
    there = recomputed(spark.table).select(cells.alias("c")).groupBy("c.metric").agg((F.count("c.value") > 80).alias("compared"))
    return there.join(differing, "metric", "left").select("metric", "compared", F.coalesce("differing", F.lit(0)).cast("long").alias("differing"))
