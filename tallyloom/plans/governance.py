"""Duplicated and subtly different metrics, as joins over fact tables, and changes of
definitions between two snapshots, as full outer joins."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.lineage import Graph
from tallyloom.plans.trace import trace

PAIR_CAP = 2000


def metric_rows(graph: Graph, skip: Iterable[str] = (), layers: Iterable[str] = ()) -> DataFrame:
    """A row a model column with sources: the facts that decide whether two are one metric."""
    layers, rows = set(layers), []
    leaf: dict[str, set[str]] = {}

    def leaf_rows(m: str) -> set[str]:
        if m not in leaf:
            leaf[m] = set()
            f = graph.facts.get(m)
            leaf[m] = {m} if f is None or f.error else set().union(*[leaf_rows(t) for t in f.row_set] or [set()])
        return leaf[m]

    def risk(m: str, seen: frozenset = frozenset()) -> set[str]:
        f = graph.facts.get(m)
        if f is None or f.error or m in seen:
            return set()
        out = set().union(*[risk(t, seen | {m}) for t in f.row_set] or [set()])
        for j in f.risk_joins:
            own = graph.facts.get(j["table"])
            proofs = [p for p in [*(graph.declared.get(j["table"], [])), *([own.grain, own.unique_on] if own else [])] if p]
            if not any(set(p) <= set(j["keys"]) for p in proofs):
                out |= leaf_rows(j["table"])
        return out

    for m, f in graph.facts.items():
        if f.error or layers and f.layer not in layers:
            continue
        for c, kind in f.columns:
            if c in skip:
                continue
            t = trace(graph, f"{m}.{c}")
            if not t.sources:
                continue
            chain = [graph.facts[e["model"]] for e in t.expr_chain]
            grain = next((x.grain for x in chain if x.grain), [])
            signature = sorted({a for e in t.expr_chain for a in re.findall(r"\b(sum|avg|min|max|min_by|max_by)\(", e["expr"])} | {"count:distinct" for e in t.expr_chain if "count(distinct" in e["expr"]} | {"count" for e in t.expr_chain if re.search(r"\bcount\((?!\*|distinct)", e["expr"])} | {"rowcount" for e in t.expr_chain if "count(*)" in e["expr"]})
            prints = sorted({x["fp"] for x in t.conditions if not x["is_pure_key"]})
            base = re.sub(r"_(1d|7d|14d|30d|total|cnt|sum)$", "", c)
            lineal = sorted({x for x in t.models if x != m})
            rows.append((m, f.layer, c, kind, base, sorted(t.sources), prints, signature, sorted(grain), sorted(risk(m)), lineal))
    schema = "model string, layer string, column string, type string, base string, sources array<string>, conditions array<string>, aggregates array<string>, grain array<string>, risk array<string>, lineal array<string>"
    df = graph.spark.createDataFrame(rows, schema)
    key = F.concat_ws("|", F.concat_ws(",", F.array_sort("sources")), F.concat_ws(",", F.array_sort("conditions")))
    return df.withColumn("fp", F.substring(F.md5(key), 1, 16))


def pairs(metrics: DataFrame, cap: int = PAIR_CAP) -> DataFrame:
    """Pairs of different models whose columns have one fingerprint, each with its tier. The
    join is within fingerprints; the first rule that holds decides."""
    ref = F.concat_ws(".", "model", "column").alias("ref")
    side = lambda p: metrics.select("fp", *[F.col(c).alias(f"{p}_{c}") for c in ("model", "layer", "column", "base", "aggregates", "grain", "risk", "lineal")], ref.alias(f"{p}_ref"))
    both = side("a").join(side("b"), "fp").filter((F.col("a_ref") < F.col("b_ref")) & (F.col("a_model") != F.col("b_model")))
    both = both.filter(~F.array_contains("a_lineal", F.col("b_model")) & ~F.array_contains("b_lineal", F.col("a_model")))
    full = lambda c: (F.size(f"a_{c}") > 0) & (F.size(f"b_{c}") > 0)
    differ = lambda c: F.concat_ws(",", f"a_{c}") != F.concat_ws(",", f"b_{c}")
    # an average, and the sum and count that one can be made of
    parts = lambda c: F.array_contains(c, "sum") & F.arrays_overlap(c, F.array(*map(F.lit, ("count", "count:distinct", "rowcount"))))
    averages = (F.array_contains("a_aggregates", "avg") & parts("b_aggregates")) | (F.array_contains("b_aggregates", "avg") & parts("a_aggregates"))
    tier = (
        F.when(full("aggregates") & differ("aggregates"), F.when(averages, "candidate").otherwise("agg_distinct"))
        .when(differ("risk"), "row_mismatch")
        .when(full("grain") & differ("grain"), "family")
        .when(F.col("a_base") == F.col("b_base"), "duplicate")
        .otherwise("candidate")
    )
    return both.select("fp", F.col("a_ref").alias("a"), F.col("b_ref").alias("b"), tier.alias("tier")).orderBy("a", "b").limit(cap)


def snapshot(graph: Graph, metrics: dict[str, str], filters: dict[str, str] | None = None) -> dict:
    """key -> what defines the metric now."""
    out = {}
    for key, target in metrics.items():
        t = trace(graph, target)
        out[key] = {
            "target": t.target, "query_filter": (filters or {}).get(key, ""), "sources": t.sources,
            "conditions": {c["fp"]: f"{c['model']}: {c['norm']}" for c in t.conditions if not c["is_pure_key"]},
            "semantics": sorted(f"{s['type']}:{s['model']}.{s['column']}" for s in t.semantics), "exprs": {f"{e['model']}.{e['column']}": e["expr"] for e in t.expr_chain},
        }
    return out


#: How grave each kind of change is.
SEVERITY = {"metric_added": "info", "metric_removed": "info", "expr_changed": "medium", "expr_added": "medium", "expr_removed": "medium"}


def facts_of(spark, snap: dict) -> DataFrame:
    """metric, part (target, source, condition, ...), key and value of a snapshot."""
    rows = []
    for key, m in snap.items():
        rows += [(key, "metric", "", ""), (key, "target", "", m["target"]), (key, "query_filter", "", m["query_filter"])]
        rows += [(key, "source", s, "") for s in m["sources"]] + [(key, "semantic", s, "") for s in m["semantics"]]
        rows += [(key, "condition", k, "") for k in m["conditions"]] + [(key, "expr", k, v) for k, v in m["exprs"].items()]
    return spark.createDataFrame(rows, "metric string, part string, key string, value string")


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """metric, kind, severity, key, before and after of every change."""
    both = old.withColumnRenamed("value", "before").withColumn("was", F.lit(True)).join(new.withColumnRenamed("value", "after").withColumn("is", F.lit(True)), ["metric", "part", "key"], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    events = both.withColumn("kind", F.concat_ws("_", "part", change)).filter(change.isNotNull())
    gone = events.filter("part = 'metric'").select("metric", F.lit(1).alias("whole")).distinct()
    events = events.join(gone, "metric", "left").filter("whole is null or part = 'metric'")
    severity = F.lit("high")
    for kind, level in SEVERITY.items():
        severity = F.when(F.col("kind") == kind, level).otherwise(severity)
    return events.select("metric", "kind", severity.alias("severity"), "key", "before", "after")


class Snapshots:
    """Baselines and an event log in a folder. A check with grave changes moves neither if it is told to block."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def latest(self) -> dict | None:
        found = sorted(self.folder.glob("snapshot-*.json"))
        return json.loads(found[-1].read_text()) if found else None

    def check(self, spark, snap: dict, stamp: str, save: bool = True, block_high: bool = False) -> list[dict]:
        old = self.latest()
        events = [] if old is None else [r.asDict() for r in drift(facts_of(spark, old), facts_of(spark, snap)).orderBy("metric", "kind", "key").collect()]
        if not save or block_high and any(e["severity"] == "high" for e in events):
            return events
        self.folder.mkdir(parents=True, exist_ok=True)
        part = self.folder / f".{stamp}.tmp"
        part.write_text(json.dumps(snap))
        part.rename(self.folder / f"snapshot-{stamp}.json")
        with (self.folder / "events.jsonl").open("a") as log:
            log.writelines(json.dumps(e | {"at": stamp}) + "\n" for e in events)
        return events
