"""Definitions read from plans: lineage, conditions, traces, formulas, duplicates, drift, projects."""

import dataclasses
import json

import pytest

from tallyloom import api, cli
from tallyloom.plans import evidence, formula, governance, reader
from tallyloom.plans.lineage import build_graph
from tallyloom.plans.project import GraphError, Project, checked_config, to_spark, without_qualify
from tallyloom.plans.trace import render, resolve, trace
from tallyloom.warehouse import models


@dataclasses.dataclass(frozen=True)
class M:
    name: str
    sql: str
    layer: str = "dm"
    unique: tuple = ()


@pytest.fixture(scope="module")
def own(spark):
    return spark.newSession()


@pytest.fixture(scope="module")
def quick(own):
    return build_graph(own, models.QUICKSTART, models.QUICKSTART_SOURCES)


@pytest.fixture(scope="module")
def trap(own):
    return build_graph(own, models.MODELS, models.SOURCES)


def graph(own, sql, sources=None, **more):
    return build_graph(own, [M("m", sql), *[M(k, v) for k, v in more.items()]], sources or {"a": "id int, amount int, dt date, status string", "b": "id int, active int"})


def edges(g, column, model="m"):
    return {(u, c) for own, u, c in g.facts[model].edges if own == column}


def test_published_counts_of_the_example(quick):
    f = quick.facts.values()
    assert (len(f), sum(len(x.columns) for x in f), sum(len(x.conditions) for x in f), sum(len(x.semantics) for x in f)) == (4, 15, 7, 5)


def test_every_formula_of_the_warehouse_is_proven(trap):
    assert not trap.errors
    assert {formula.compose(trap, f"{f.model}.{c}").status for f in trap.facts.values() for c, _ in f.columns} == {"proven"}


@pytest.mark.parametrize("a,b", [("14 >= x.a", "a <= 14"), ("not (x is null)", "t.x is not null"), ("in_(1)", "IN_(1)"), ("x in (2, 1)", "X in (1,2)"), ("not a > 3", "a <= 3"), ("s = 'Paid'", "T.s = 'Paid'")])
def test_predicates_that_are_one(own, a, b):
    assert reader.normal(reader.expression(own, a)) == reader.normal(reader.expression(own, b))


@pytest.mark.parametrize("a,b", [("a < 14", "a <= 14"), ("s = 'Paid'", "s = 'paid'"), ("a = 1", "b = 1")])
def test_predicates_that_differ(own, a, b):
    assert reader.normal(reader.expression(own, a)) != reader.normal(reader.expression(own, b))


def test_only_from_and_inner_joins_bind_rows(own):
    g = graph(own, "select a.id from a join (select id from b where active = 1) i on a.id = i.id left join (select id from b where active = 2) l on a.id = l.id where amount > 3")
    found = {c["norm"]: c["row_level"] for c in g.facts["m"].conditions if not c["is_pure_key"]}
    assert found == {"active = 1": True, "active = 2": False, "amount > 3": True}


def test_right_and_full_joins_bind_no_left_rows(own):
    g = graph(own, "select b.id from (select id from a where amount > 3) a right join (select id from b where active = 1) b on a.id = b.id")
    assert {c["norm"]: c["row_level"] for c in g.facts["m"].conditions if not c["is_pure_key"]} == {"amount > 3": False, "active = 1": True}


def test_count_star_falls_back_to_the_rows(own):
    g = graph(own, "select dt, count(*) as n from f group by dt", f="select * from a where status = 'x'")
    assert edges(g, "n") == {("f", "*")}
    t = trace(g, "m.n")
    assert t.sources == ["a.*"] and [c["norm"] for c in t.conditions] == ["status = 'x'"]


def test_unions_go_by_position(own):
    g = graph(own, "select id as k, amount as v from a union all select active, id from b")
    assert edges(g, "k") == {("a", "id"), ("b", "active")} and edges(g, "v") == {("a", "amount"), ("b", "id")}


def test_lateral_pivot_and_struct(own):
    src = {"c": "key string, files array<struct<id:string,url:string>>, tod string, v bigint"}
    g = build_graph(own, [M("m", "select key, f.url as u from c lateral view explode(files) as f"), M("p", "select * from (select key, tod, v from c) pivot (sum(v) for tod in ('am' as am, 'pm' as pm))")], src)
    assert edges(g, "u") == {("c", "files")} and ("c", "v") in edges(g, "am", "p")


def test_using_and_star_except(own):
    g = graph(own, "select * except (active) from a left join b using (id)")
    assert [c for c, _ in g.facts["m"].columns] == ["id", "amount", "dt", "status"]
    assert [c["norm"] for c in g.facts["m"].conditions] == ["using (id)"]


def test_grain_keys_and_risk(own):
    g = graph(own, "select id, sum(amount) as s from a group by id", d="select id, amount from (select *, row_number() over (partition by id order by dt) as rn from a) where rn = 1", j="select a.id, b.active from a join b on a.id = b.id")
    assert g.facts["m"].grain == ["id"] and g.facts["d"].unique_on == ["id"] and g.facts["d"].grain == []
    assert g.facts["j"].risk_joins == [{"table": "b", "keys": ["id"], "how": "Inner"}]


@pytest.mark.parametrize("text,want", [("count(*)", "rowcount"), ("count(1)", "rowcount"), ("sum(1)", "rowcount"), ("sum(case when amount > 1 then 1 else 0 end)", "count"), ("count(distinct id)", "count:distinct"), ("avg(amount)", "avg")])
def test_aggregates_that_count_the_same(own, text, want):
    assert graph(own, f"select {text} as x from a").facts["m"].aggregates == [want]


def test_lines_are_those_of_the_text(own):
    g = graph(own, "select id\nfrom a\nwhere amount > 1\n  and status = 'x'")
    assert {c["norm"]: c["line"] for c in g.facts["m"].conditions} == {"amount > 1": 3, "status = 'x'": 4}


def test_failures_are_boundaries(own):
    g = graph(own, "select sum(v) as total from broken", broken="select nope as v from a", worse="selec id fro a")
    assert g.facts["broken"].error.startswith("qualify: ") and g.facts["worse"].error.startswith("parse: ") and set(g.errors) == {"m", "broken", "worse"}


def test_trace_of_a_rate(quick):
    t = trace(quick, "dm_refund_rate_1d.refund_rate")
    assert t.sources == ["raw_orders.amount", "raw_refunds.refund_amount"] and t.depth == 2
    assert {c["norm"] for c in t.conditions if c["kind"] != "join_on"} == {"status = 'paid'", "refunded_at <= paid_at + interval '14' day", "rn = 1", "is_test = 0"}
    assert "raw_orders.amount" in render(t)
    with pytest.raises(KeyError):
        trace(quick, "dm_refund_rate_1d.nope")
    with pytest.raises(KeyError):
        resolve(quick, "nope")


def test_context_tables_shape_rows_only(own):
    g = graph(own, "select o.amount as v from a o left join b on o.id = b.id")
    assert trace(g, "m.v").context_tables == ["b"] and trace(g, "m.v").sources == ["a.amount"]


def test_formula_and_tree(quick, trap):
    f = formula.compose(quick, "dm_sales_1d.gmv")
    assert (f.status, f.top, f.leaves) == ("proven", "sum(raw_orders.amount)", ["raw_orders.amount"])
    f = formula.compose(trap, "app_business_overview_1d.refund_rate_14d")
    assert f.top == "([dm_after_sale_stats_1d.refund_amt_14d] / nullif([dm_trade_stats_1d.pay_amt], 0))" and any(d["name"] == "dm_trade_stats_1d.pay_amt" for d in f.defs)
    t = formula.tree(trap, "app_business_overview_1d.refund_rate_14d")
    assert [b["operator"] for b in t["branches"]] == ["", "/"] and any("is_risk_order" in c for c in t["shared"])
    assert "is_risk_order" in formula.render_tree(t)


@pytest.mark.parametrize("text,want", [("(a / b)", [("", "a"), ("/", "b")]), ("round((a + b), 2)", [("", "a"), ("+", "b")]), ("sum(a - b)", [("", "sum(a - b)")]), ("a", [("", "a")])])
def test_split(text, want):
    assert formula.split(text) == want


def test_publication():
    assert formula.publication(True, "high", "agree") == "VERIFIED" and formula.publication(True, "high", "disagree") == "TECHNICAL_ONLY"
    assert formula.publication(False, "medium", "agree") == "REVIEW_REQUIRED" and formula.publication(True, "high", "agree", True) == "REVIEW_REQUIRED"


def tiers(own, more, **kw):
    g = build_graph(own, more, {"a": "id int, amount int, dt date", "b": "id int, active int"}, **kw)
    return {(r["a"], r["b"]): r["tier"] for r in governance.pairs(governance.metric_rows(g, ("dt", "id"))).collect()}


def test_tiers(own):
    x, y = M("x", "select dt, sum(amount) as rev from a group by dt"), M("y", "select dt, sum(amount) as rev from a group by dt")
    assert tiers(own, [x, y]) == {("x.rev", "y.rev"): "duplicate"}
    assert tiers(own, [x, M("y", "select dt, avg(amount) as rev from a group by dt")]) == {("x.rev", "y.rev"): "agg_distinct"}
    ratio = M("x", "select dt, sum(amount) / count(amount) as rev from a group by dt")
    assert tiers(own, [ratio, M("y", "select dt, avg(amount) as rev from a group by dt")]) == {("x.rev", "y.rev"): "candidate"}
    assert tiers(own, [x, M("y", "select dt, max(amount) as rev from a group by dt")]) == {("x.rev", "y.rev"): "agg_distinct"}
    assert tiers(own, [x, M("y", "select id, sum(amount) as rev from a group by id")]) == {("x.rev", "y.rev"): "family"}
    assert tiers(own, [x, M("y", "select dt, sum(amount) as other from a group by dt")]) == {("x.rev", "y.other"): "candidate"}
    assert tiers(own, [x, M("y", "select dt, sum(amount) as rev from a where id > 3 group by dt")]) == {}
    joined = M("y", "select a.dt, sum(a.amount) as rev from a join b on a.id = b.id group by a.dt")
    assert tiers(own, [x, joined]) == {("x.rev", "y.rev"): "row_mismatch"}
    assert tiers(own, [x, joined], declared={"b": [["id"]]}) == {("x.rev", "y.rev"): "duplicate"}


def test_lineal_models_are_no_duplicates(own):
    assert tiers(own, [M("x", "select dt, amount as rev from a"), M("y", "select dt, rev from x")]) == {}


def snap(own, change=lambda s: s, target="dm_refund_rate_1d.refund_rate"):
    changed = [dataclasses.replace(m, sql=change(m.sql)) for m in models.QUICKSTART]
    return governance.snapshot(build_graph(own, changed, models.QUICKSTART_SOURCES), {"rate": target})


def events(own, a, b):
    return sorted((r["kind"], r["severity"]) for r in governance.drift(governance.facts_of(own, a), governance.facts_of(own, b)).collect())


def test_drift(own):
    a = snap(own)
    assert events(own, a, snap(own)) == []
    assert events(own, a, snap(own, lambda s: s.replace("14 day", "30 day"))) == [("condition_added", "high"), ("condition_removed", "high")]
    assert events(own, a, snap(own, lambda s: s.replace("/ sum(o.amount)", "/ max(o.amount)"))) == [("expr_changed", "medium")]
    assert events(own, a, {}) == [("metric_removed", "info")] and events(own, {}, a) == [("metric_added", "info")]
    assert ("target_changed", "high") in events(own, a, snap(own, target="dm_sales_1d.gmv"))


def test_snapshots_block(own, tmp_path):
    s = governance.Snapshots(tmp_path)
    assert s.check(own, snap(own), "1") == []
    changed = snap(own, lambda t: t.replace("14 day", "30 day"))
    assert len(s.check(own, changed, "2", block_high=True)) == 2 and len(s.check(own, changed, "3")) == 2 and s.check(own, changed, "4") == []
    assert len((tmp_path / "events.jsonl").read_text().splitlines()) == 2


def test_evidence(own, quick):
    t = trace(quick, "dm_refund_rate_1d.refund_rate")
    claims = [{"sql": "'paid' = o.status"}, {"sql": "a = 9"}, {"sql": "r.order_id = o.order_id"}, {"sql": "((("}]
    found = evidence.classify_filters(own, quick, t, claims)
    assert [c["status"] for c in found] == ["matched", "suspect", "pure_key", "unparsed"] and evidence.coverage(t, found) == 0.25
    assert evidence.compare_sources(["amount", "x.y"], t) == (["raw_refunds.refund_amount"], ["x.y"]) or evidence.compare_sources(["amount", "x.y"], t)[1] == ["x.y"]
    assert evidence.quotes_verbatim(["Select  1", "nope"], "select 1 from t") == ["nope"]
    assert [evidence.confidence(*x) for x in (([], [], 1.0, 0, 0), ([], ["x"], 0.9, 0, 1), (["x"], [], 1.0, 0, 0))] == ["high", "medium", "low"]
    assert evidence.free_text("stg_orders.amount within 14 days, 99 and no_such.thing", quick, t) == ["no_such.thing", "99"]
    assert [e["id"] for e in evidence.numbered(t)][:2] == ["E1", "E2"]


def test_qualify_is_rewritten(own):
    sql = "with v as (select * from a qualify row_number() over (partition by id order by dt desc) = 1) select id, amount from v where amount > 1"
    assert graph(own, without_qualify(sql)).facts["m"].error is None and "qualify" not in without_qualify(sql)
    assert "timestampdiff(DAY," in to_spark("select datediff('day', x, y)") and "min_by(" in to_spark("select arg_min(a, b)")


def project(folder, sql="select dt, sum(amount) as rev from db.main.stg group by dt"):
    (folder / "target").mkdir(exist_ok=True)
    node = lambda name, code, **k: {"resource_type": "model", "name": name, "package_name": "p", "fqn": ["p", "dm", name], "compiled_code": code, "columns": {}, **k}
    manifest = {
        "metadata": {"project_name": "p"}, "sources": {"source.p.raw": {"resource_type": "source", "name": "raw", "columns": {}}},
        "nodes": {"model.p.stg": node("stg", 'select * from "db"."main"."raw" where amount > 0'), "model.p.rev": node("rev", sql), "model.other.x": node("x", "select 1", package_name="other"),
                  "test.u": {"resource_type": "test", "attached_node": "model.p.rev", "column_name": "dt", "test_metadata": {"name": "unique"}}},
        "exposures": {"exposure.d": {"name": "board", "depends_on": {"nodes": ["model.p.rev"]}}},
    }
    (folder / "target/manifest.json").write_text(json.dumps(manifest))
    (folder / "target/catalog.json").write_text(json.dumps({"sources": {"source.p.raw": {"columns": {"a": {"name": "amount", "type": "DOUBLE"}, "d": {"name": "dt", "type": "DATE"}}}}}))


def test_projects_cards_and_cli(spark, tmp_path, capsys):
    project(tmp_path)
    g = api.build_graph(spark, tmp_path)
    assert g.declared == {"rev": [["dt"]]} and api.trace(spark, tmp_path, "rev.rev").sources == ["raw.amount"]
    loaded = Project.load(tmp_path)
    assert loaded.warnings and {m.name for m in loaded.models} == {"stg", "rev"}
    config = tmp_path / "c.yml"
    config.write_text("metrics: [{key: rev, target: rev.rev}]")
    for args, want in ((["graph", str(tmp_path)], "2 models"), (["trace", str(tmp_path), "rev.rev"], "raw.amount"), (["columns", str(tmp_path)], "rev.dt date"), (["tree", str(tmp_path), "rev.rev"], "sum(amount)"), (["cards", str(tmp_path), "--config", str(config)], "rev"), (["drift", str(tmp_path), "--config", str(config)], "")):
        assert cli.main(args) == 0 and want in capsys.readouterr().out
    assert [c["exposures"] for c in api.cards(tmp_path)] == [["board"]]
    assert cli.main(["trace", str(tmp_path), "rev.nope"]) == 1
    project(tmp_path, "select nope from stg")
    with pytest.raises(GraphError):
        api.build_graph(spark, tmp_path)
    assert api.build_graph(spark, tmp_path, allow_partial=True).errors


def test_configuration():
    assert checked_config({"metrics": [{"key": "a", "target": "m.c"}]})["metrics"]
    for bad in ({"metrics": [{"key": "A b", "target": "m.c"}]}, {"metrics": [{"key": "a"}]}, {"metrics": [{"key": "index", "target": "m.c"}]}, {"metrics": [{"key": "a", "target": "m.c"}] * 2}, {"metrics": [{"key": "a", "target": "c"}]}, {"metrics": {}}, {"governance": {"skip_columns": "x"}}):
        with pytest.raises(ValueError):
            checked_config(bad)


TWO = {"raw_a": "id int, x int, k int, flag int", "raw_b": "id int, v int, x int, flag int"}


def test_a_union_shows_all_its_inputs(own):
    g = build_graph(own, [M("u", "select x as y from raw_a union all select v * 2 from raw_b"), M("same", "select x from raw_a union all select x from raw_b"), M("total", "select sum(y) as s from u")], TWO)
    f = formula.compose(g, "u.y")
    assert (f.status, f.top, f.leaves) == ("proven", "union(1: raw_a.x; 2: (raw_b.v * 2))", ["raw_a.x", "raw_b.v"])
    assert formula.compose(g, "same.x").top == "union(1: raw_a.x; 2: raw_b.x)"
    assert "raw_b.v * 2" in formula.compose(g, "total.s").top


def test_conditions_belong_to_the_values_they_bind(own):
    g = graph(own, """select a.x, s.v, t.w from raw_a a
        left join (select id, v from raw_b where flag = 1) s on a.id = s.id and s.v > 3
        left join (select id, v as w from raw_b where flag = 2) t on a.id = t.id""", TWO)
    norms = lambda c: {x["norm"] for x in trace(g, f"m.{c}").conditions}
    assert norms("x") == set() and norms("v") == {"id = id", "v > 3", "flag = 1"} and norms("w") == {"id = id", "flag = 2"}


def test_inner_names_are_put_in(own):
    g = graph(own, "with p as (select id, x * 2 as y from raw_a where k = 1), q as (select id, sum(y) as z from p group by id) select z / 3 as r from q", TWO)
    assert formula.compose(g, "m.r").top == "(sum((raw_a.x * 2)) / 3)"


def test_bodies_of_sub_queries_tell_conditions_apart(own):
    q = "select x from raw_a a where exists (select 1 from raw_b b where b.id = a.id and b.flag = {})"
    g = build_graph(own, [M("e1", q.format(1)), M("e2", q.format(2)), M("e3", "select id, x\nfrom raw_a  a  where k = 0 and exists (select 1 from raw_b b where b.id = a.id and b.flag = 1)")], TWO)
    prints = {m: {c["fp"] for c in g.facts[m].conditions} for m in ("e1", "e2", "e3")}
    assert not prints["e1"] & prints["e2"] and prints["e1"] < prints["e3"]


def test_too_many_parts_are_refused(own, monkeypatch):
    monkeypatch.setattr(formula, "MAX_DEFS", 1)
    monkeypatch.setattr(formula, "INLINE_MAX", 10)
    g = build_graph(own, [M("p", "select id, sum(x) as y, max(x) as z from raw_a group by id"), M("m", "select sum(y) / sum(z) as r from p")], TWO)
    f = formula.compose(g, "m.r")
    assert f.status == "unsupported" and "named parts" in f.reasons[0]


def test_order_follows_what_is_read_not_words(own):
    g = build_graph(own, [M("late", "select y as early from early"), M("early", "select x as y, 'late' as late from raw_a -- late")], TWO)
    assert not g.errors and g.facts["late"].columns == [("early", "int")]


def test_an_empty_quote_is_no_quote():
    assert evidence.quotes_verbatim(["", "  ", "select"], "SELECT 1") == ["", "  "]
