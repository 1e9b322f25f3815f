"""The simulated warehouse, its checks, dashboard, and the example's published results."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.periods import checked, span
from tallyloom.operators.relational import delta
from tallyloom.sources.tables import csv_seed
from tallyloom.warehouse import checks, dashboard, models, simulate


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    return models.build(spark, simulate.simulate(spark, 12_000, 2_500), models.MODELS, str(tmp_path_factory.mktemp("store")))


def test_sources_have_the_declared_columns(spark, built):
    for name, ddl in models.SOURCES.items():
        assert set(built[name].columns) == set(spark.createDataFrame([], ddl).columns)


def test_all_traps_show(spark, built):
    found = {r["trap"]: r for r in checks.traps(spark).collect()}
    assert len(found) == 14 and all(r["ok"] for r in found.values()), found


def test_recomputation_confirms_the_overview(spark, built):
    assert checks.recomputation(spark).count() == 0 and built["app_business_overview_1d"].count() > 80
    found = checks.confirmed(spark).collect()
    assert len(found) == 15 and all(r["compared"] and not r["differing"] for r in found)


def test_recomputation_sees_a_wrong_cell(spark, built):
    wrong = built["app_business_overview_1d"].selectExpr("* except (gmv)", "gmv + if(dt = '2026-07-03', 1, 0) as gmv")
    try:
        wrong.createOrReplaceTempView("app_business_overview_1d")
        assert [(str(r["dt"]), r["metric"]) for r in checks.recomputation(spark).collect()] == [("2026-07-03", "gmv")]
    finally:
        built["app_business_overview_1d"].createOrReplaceTempView("app_business_overview_1d")


@pytest.mark.parametrize("model", [m for m in models.MODELS if m.unique], ids=lambda m: m.name)
def test_keys_are_unique(built, model):
    from tallyloom.operators.relational import not_unique, nulls

    assert not_unique(built[model.name], *model.unique).count() == 0
    assert nulls(built[model.name], model.unique[0]).count() == 0


def test_simulation_is_the_same_again(spark):
    a, b = (simulate.simulate(spark, 500, 100)["ods_order_info"] for _ in range(2))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_overview(spark, built):
    out = dashboard.document(spark, "2026-07-01", "2026-07-10")
    cards = {c["key"]: c for c in out["cards"]}
    assert (out["prev_start"], out["prev_end"]) == ("2026-06-21", "2026-06-30") and len(cards) == 14
    rows = spark.table("app_business_overview_1d").filter("dt between '2026-07-01' and '2026-07-10'").collect()
    assert cards["gmv"]["value"] == pytest.approx(sum(r["gmv"] for r in rows)) and len(cards["gmv"]["spark"]) == len(cards["live_gmv"]["spark"]) == 10
    users = spark.table("dwm_trade_order_flag_1d").filter("dt between '2026-07-01' and '2026-07-10'").select("user_id").distinct().count()
    assert cards["pay_user_cnt"]["value"] == users < sum(r["pay_user_cnt"] for r in rows)
    before = dashboard.document(spark, "2026-06-21", "2026-06-30")["cards"]
    for c, p in zip(out["cards"], before, strict=True):
        assert c["prev"] == pytest.approx(p["value"])
        assert c["delta"] == pytest.approx((c["value"] - p["value"]) / abs(p["value"]), abs=5e-4)


def test_a_day_of_the_overview_is_the_table(spark, built):
    """Over one day all fourteen measures are those of the wide table."""
    day = {r["metric"]: r["now"] for r in dashboard.overview(spark, "2026-07-05", "2026-07-05").collect()}
    row = {r["metric"]: r["value"] for r in dashboard.daily(spark, "2026-07-05", "2026-07-05").collect()}
    assert set(day) == set(row) == set(dashboard.MEASURES)
    assert all(day[m] == pytest.approx(row[m]) for m in day)


@pytest.mark.parametrize("dim", sorted(dashboard.DIMENSIONS))
def test_breakdown_shares_are_of_the_whole(spark, built, dim):
    rows = dashboard.breakdown(spark, "2026-07-01", "2026-07-10", dim, 3).orderBy("place").collect()
    assert len(rows) == 3 and sum(r["share"] for r in rows) <= 1 + 1e-9
    assert [r["gmv"] for r in rows] == sorted((r["gmv"] for r in rows), reverse=True)
    assert rows[0]["share"] == pytest.approx(rows[0]["gmv"] / rows[0]["whole"])
    assert all(r["name"] is not None for r in rows)


def test_trend(spark, built):
    assert [str(r["dt"]) for r in dashboard.daily(spark, "2026-07-01", "2026-07-03").filter("metric = 'gmv'").orderBy("dt").collect()] == ["2026-07-01", "2026-07-02", "2026-07-03"]
    assert dashboard.channels(spark, "2026-07-01", "2026-07-03").columns == ["dt", "app", "h5", "live"]
    assert dashboard.meta(spark).first()["mn"] < "2026-07-01"


def test_ranges():
    assert [str(x) for x in span("2026-07-01", "2026-07-02")] == ["2026-07-01", "2026-07-02", "2026-06-29", "2026-06-30"]
    for a, b in (("x", "2026-01-01"), ("2026-01-02", "2026-01-01"), ("2026-01-01", "2026-12-01")):
        with pytest.raises(ValueError):
            checked(a, b)
    with pytest.raises(ValueError):
        dashboard.breakdown(None, "2026-01-01", "2026-01-02", "drop table")


def test_changes(spark):
    rows = spark.createDataFrame([(1.1, 1.0), (1.0001, 1.0), (1.0, 0.0), (None, 1.0)], "a double, b double")
    got = [r["d"] for r in rows.select(delta(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [pytest.approx(0.1), 0, None, None]


def test_csv_seeds(spark):
    seeds = {n: csv_seed(spark, f"examples/quickstart/seeds/{n}.csv", s) for n, s in models.QUICKSTART_SOURCES.items()}
    models.build(spark, seeds, models.QUICKSTART)
    got = [tuple(r)[1:] for r in spark.table("dm_refund_rate_1d").orderBy("stat_date").collect()]
    assert got == [(393.0, 0.0393), (700.0, 0.12727272727272726), (0.0, 0.0)]
