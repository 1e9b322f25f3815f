"""The three entry points: build_graph, trace and cards."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession

from tallyloom.plans import evidence, formula
from tallyloom.plans.lineage import Graph
from tallyloom.plans.project import GraphError, Project, checked_config, load_graph, save_graph
from tallyloom.plans.trace import Trace
from tallyloom.plans.trace import trace as _trace

__all__ = ["GraphError", "Store", "build_graph", "card", "cards", "publish", "trace"]


def _place(folder: str | Path) -> Path:
    return Path(folder) / ".tallyloom"


def build_graph(spark: SparkSession, folder: str | Path, target_path: str | None = None, allow_partial: bool = False) -> Graph:
    graph = Project.load(folder, target_path).graph(spark, allow_partial)
    save_graph(graph, _place(folder) / "graph.json")
    return graph


def trace(spark: SparkSession, folder: str | Path, target: str) -> Trace:
    return _trace(load_graph(spark, _place(folder) / "graph.json"), target)


def card(graph: Graph, key: str, target: str, title: str = "", query_filter: str = "") -> dict:
    """What can be said of a metric from plans alone."""
    t, f = _trace(graph, target), formula.compose(graph, target)
    return {
        "schema_version": 1, "key": key, "title": title or key, "target": t.target, "query_filter": query_filter, "formula": f.to_dict(), "tree": formula.tree(graph, target),
        "sources": t.sources, "context_tables": t.context_tables, "conditions": t.conditions, "semantics": t.semantics, "evidence": evidence.numbered(t),
        "exposures": [e["name"] for e in graph.exposures if t.target.rpartition(".")[0] in e["models"]],
        "publication": formula.publication(f.status == "proven", "medium", "none", f.status == "unsupported"),
    }


class Store:
    """Batches of cards: a folder a run, and a pointer to the active one that moves last."""

    def __init__(self, root: str | Path):
        self.root = Path(root)

    def active(self) -> Path | None:
        pointer = self.root / "active_run"
        return self.root / "runs" / pointer.read_text().strip() if pointer.exists() else None

    def publish(self, found: list[dict], run_id: str, keep: int = 3) -> None:
        place = self.root / "runs" / run_id
        place.mkdir(parents=True)
        for c in found:
            (place / f"{c['key']}.json").write_text(json.dumps(c, indent=1))
        (place / "index.json").write_text(json.dumps([{k: c[k] for k in ("key", "title", "target", "publication")} for c in found]))
        part = self.root / ".active_run"
        part.write_text(run_id)
        part.rename(self.root / "active_run")
        import shutil

        for old in sorted(p for p in (self.root / "runs").iterdir() if p != place)[: -(keep - 1) or None]:
            shutil.rmtree(old)

    def index(self) -> list[dict]:
        place = self.active()
        return json.loads((place / "index.json").read_text()) if place else []

    def card(self, key: str) -> dict:
        """A card; of one that needs review only what identifies it."""
        c = json.loads(((self.active() or self.root) / f"{key}.json").read_text())
        return {k: c[k] for k in ("key", "title", "target", "publication")} if c["publication"] == "REVIEW_REQUIRED" else c


def publish(spark: SparkSession, folder: str | Path, config: dict) -> list[dict]:
    graph = load_graph(spark, _place(folder) / "graph.json")
    found = [card(graph, m["key"], m["target"], m.get("title", ""), m.get("query_filter", "")) for m in checked_config(config)["metrics"]]
    Store(_place(folder)).publish(found, datetime.now(UTC).strftime("%Y%m%dT%H%M%S%f"))
    return found


def cards(folder: str | Path) -> list[dict]:
    store = Store(_place(folder))
    return [store.card(c["key"]) for c in store.index()]
