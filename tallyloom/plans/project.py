"""Projects of SQL models: from compiled artifacts (manifest.json, catalog.json) or as objects."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from tallyloom.plans.lineage import Graph, build_graph


class GraphError(ValueError):
    """Models that can't be read; errors has the reason for each."""

    def __init__(self, errors: dict[str, str]):
        super().__init__("; ".join(f"{m}: {e}" for m, e in sorted(errors.items())))
        self.errors = errors


@dataclass(frozen=True)
class ProjectModel:
    name: str
    layer: str
    sql: str
    unique: tuple[str, ...] = ()
    uid: str = ""


#: Type names of catalogs and Spark's for them; unknown ones count as strings.
TYPES = {"INTEGER": "int", "INT": "int", "BIGINT": "bigint", "HUGEINT": "decimal(38,0)", "SMALLINT": "smallint", "TINYINT": "tinyint", "DOUBLE": "double", "FLOAT": "float", "REAL": "float", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "TIMESTAMP WITH TIME ZONE": "timestamp", "VARCHAR": "string", "TEXT": "string", "STRING": "string"}


def spark_type(name: str | None) -> str:
    name = (name or "VARCHAR").upper()
    if m := re.match(r"(?:DECIMAL|NUMERIC|NUMBER)\((\d+),\s*(\d+)\)", name):
        return f"decimal({min(38, int(m[1]))},{m[2]})"
    return TYPES.get(re.sub(r"\(.*", "", name).strip(), "string")


def without_qualify(sql: str) -> str:
    """QUALIFY of other dialects as a filter over a sub-query: at the end of each query block,
    `select ... qualify c` becomes a selection from the block with c as a column."""
    m = re.search(r"\bqualify\b", sql, re.I)
    while m:
        depth, end = 0, len(sql)
        for i in range(m.end(), len(sql)):
            depth += (sql[i] == "(") - (sql[i] == ")")
            if depth < 0 or not depth and re.match(r"\border\s+by\b|\blimit\b|\bunion\b", sql[i:], re.I) and not sql[i - 1].isalnum():
                end = i
                break
        condition = sql[m.end() : end].strip()
        depth, start = 0, 0
        for i in range(m.start() - 1, -1, -1):
            depth += (sql[i] == ")") - (sql[i] == "(")
            if depth < 0:
                start = i + 1
                break
        block = sql[start : m.start()]
        heads = [h for h in re.finditer(r"\bselect\b", block, re.I) if block[: h.start()].count("(") == block[: h.start()].count(")")]
        head = heads[-1]
        froms = [f for f in re.finditer(r"\bfrom\b", block, re.I) if f.start() > head.start() and block[: f.start()].count("(") == block[: f.start()].count(")")]
        at = froms[0].start()
        inner = f"{block[head.start() : at].rstrip()}, ({condition}) as qualified_\n{block[at:].rstrip()}"
        sql = f"{sql[:start]}{block[: head.start()]}select * except (qualified_) from ({inner}) q_ where qualified_{' ' if end < len(sql) and sql[end] != ')' else ''}{sql[end:]}"
        m = re.search(r"\bqualify\b", sql, re.I)
    return sql


def to_spark(sql: str) -> str:
    """Foreign spellings that Spark's parser doesn't take."""
    sql = without_qualify(sql)
    sql = re.sub(r"\bdatediff\(\s*'(\w+)'\s*,", lambda m: f"timestampdiff({m.group(1).upper()},", sql, flags=re.I)
    sql = re.sub(r"\barg_min\(", "min_by(", sql, flags=re.I)
    sql = re.sub(r"\barg_max\(", "max_by(", sql, flags=re.I)
    sql = re.sub(r"\bepoch\(([\w.]+)\)", r"(unix_micros(cast(\1 as timestamp_ltz)) / 1e6)", sql, flags=re.I)
    # names with a database and schema come down to the last part, which is the view's name
    return re.sub(r"\b(from|join)(\s+)(?:\w+\.){1,2}(\w+)", r"\1\2\3", sql.replace('"', ""), flags=re.I)


@dataclass
class Project:
    models: list[ProjectModel]
    sources: dict[str, str]
    declared: dict[str, list[list[str]]] = field(default_factory=dict)
    exposures: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, folder: str | Path, target: str | None = None, internal: set[str] | None = None) -> Project:
        """From the artifacts in the target folder: the argument, else the environment, else the project file, else `target`."""
        folder = Path(folder)
        if target is None and os.environ.get("DBT_TARGET_PATH"):
            target = os.environ["DBT_TARGET_PATH"]
        if target is None and (folder / "dbt_project.yml").exists():
            import yaml

            target = (yaml.safe_load((folder / "dbt_project.yml").read_text()) or {}).get("target-path")
        place = folder / (target or "target")
        manifest = json.loads((place / "manifest.json").read_text())
        catalog = json.loads((place / "catalog.json").read_text()) if (place / "catalog.json").exists() else {}
        measured = {**catalog.get("nodes", {}), **catalog.get("sources", {})}
        root = manifest.get("metadata", {}).get("project_name")
        models, sources, declared, warnings, places = [], {}, {}, [], {}

        def columns(uid: str, node: dict) -> str:
            found = {c["name"]: spark_type(c.get("type")) for c in measured.get(uid, {}).get("columns", {}).values()}
            for c in node.get("columns", {}).values():
                found.setdefault(c["name"], spark_type(c.get("data_type")))
            return ", ".join(f"`{n}` {t}" for n, t in found.items())

        for uid, node in {**manifest.get("nodes", {}), **manifest.get("sources", {})}.items():
            kind, name = node.get("resource_type"), node.get("alias") or node.get("identifier") or node.get("name")
            if kind not in ("model", "seed", "snapshot", "source") or (node.get("config") or {}).get("materialized") == "ephemeral":
                continue
            if places.setdefault(name, uid) != uid:
                raise ValueError(f"{name} is the relation of {places[name]} and of {uid}")
            own = kind == "model" and (internal is None and node.get("package_name") in (None, root) or internal is not None and node.get("package_name") in {root, *internal})
            sql = node.get("compiled_code") or node.get("compiled_sql")
            if not sql and node.get("compiled_path") and (folder / node["compiled_path"]).exists():
                sql = (folder / node["compiled_path"]).read_text()
            if own and sql:
                models.append(ProjectModel(name, (node.get("fqn") or ["", ""])[-2] if len(node.get("fqn") or []) > 1 else "", to_spark(sql), uid=uid))
            else:
                if own:
                    warnings.append(f"{name} isn't compiled and counts as a source")
                sources[name] = columns(uid, node)
                if not sources[name]:
                    warnings.append(f"{name} has no known columns")
        by_uid = {u: n for n, u in places.items()}
        for node in manifest.get("nodes", {}).values():
            test = node.get("test_metadata") or {}
            attached = by_uid.get(node.get("attached_node") or next(iter((node.get("depends_on") or {}).get("nodes", [])), ""))
            if test.get("name") == "unique" and attached:
                declared.setdefault(attached, []).append([node.get("column_name") or test.get("kwargs", {}).get("column_name")])
            elif test.get("name") == "unique_combination_of_columns" and attached:
                declared.setdefault(attached, []).append(list(test.get("kwargs", {}).get("combination_of_columns", [])))
        exposures = [{"name": e.get("name"), "models": [by_uid[u] for u in (e.get("depends_on") or {}).get("nodes", []) if u in by_uid]} for e in manifest.get("exposures", {}).values()]
        return cls(models, {n: c for n, c in sources.items()}, declared, exposures, warnings)

    def graph(self, spark: SparkSession, allow_partial: bool = False) -> Graph:
        g = build_graph(spark, self.models, self.sources, self.declared, self.exposures)
        if g.errors and not allow_partial:
            raise GraphError(g.errors)
        return g


def save_graph(graph: Graph, path: str | Path) -> None:
    """Writes the graph beside its place and moves it there, so that readers see a whole one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(".tmp")
    part.write_text(json.dumps(graph.to_dict()))
    part.rename(path)


def load_graph(spark: SparkSession, path: str | Path) -> Graph:
    return Graph.from_dict(spark, json.loads(Path(path).read_text()))


_KEY = re.compile(r"[a-z][a-z0-9_]*\Z")
#: Names that a metric's key may not take.
RESERVED = {"index", "runs", "active_run"}


def checked_config(raw: dict[str, Any]) -> dict[str, Any]:
    """Settings with their defaults; ValueError names the entry that is wrong."""
    metrics, seen = raw.get("metrics", []), set()
    if not isinstance(metrics, list):
        raise ValueError("metrics is a list")
    for i, m in enumerate(metrics):
        if not isinstance(m, dict) or not m.get("key") or not m.get("target"):
            raise ValueError(f"metrics[{i}] needs key and target")
        if not _KEY.match(str(m["key"])) or m["key"] in RESERVED:
            raise ValueError(f"metrics[{i}].key {m['key']!r} isn't lower case, digits and _")
        if m["key"].casefold() in seen:
            raise ValueError(f"metrics[{i}].key {m['key']} is there twice")
        if str(m["target"]).count(".") < 1:
            raise ValueError(f"metrics[{i}].target is model.column")
        seen.add(m["key"].casefold())
    governance = raw.get("governance") or {}
    for name in ("skip_columns", "scan_layers"):
        if not isinstance(governance.get(name, []), list):
            raise ValueError(f"governance.{name} is a list")
    return {"metrics": metrics, "governance": {"skip_columns": governance.get("skip_columns", []), "scan_layers": governance.get("scan_layers", [])}, "lexicon": raw.get("lexicon") or {}}
