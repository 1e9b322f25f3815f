"""python -m tallyloom.cli graph|columns|trace|tree|cards|govern|drift FOLDER [...]. Exit
codes: 0 done, 1 a finding or failure, 2 wrong use, 130 interrupted."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("graph", "columns", "cards", "govern", "drift", "trace", "tree"):
        c = commands.add_parser(name)
        c.add_argument("folder")
        if name in ("trace", "tree"):
            c.add_argument("target")
        if name == "graph":
            c.add_argument("--allow-partial", action="store_true")
            c.add_argument("--target-path")
        if name == "drift":
            c.add_argument("--no-save", action="store_true")
            c.add_argument("--strict", action="store_true")
        if name in ("cards", "drift", "govern"):
            c.add_argument("--config")
    args = parser.parse_args(argv)
    from tallyloom import api
    from tallyloom.plans import formula, governance
    from tallyloom.plans.project import checked_config, load_graph
    from tallyloom.plans.trace import render
    from tallyloom.plans.trace import trace as walk
    from tallyloom.session import session
    from tallyloom.sources.tables import yaml_settings

    spark = session(None, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    place = Path(args.folder) / ".tallyloom"
    try:
        if args.command == "graph":
            g = api.build_graph(spark, args.folder, args.target_path, args.allow_partial)
            print(f"{len(g.facts)} models, {sum(len(f.columns) for f in g.facts.values())} columns, {sum(len(f.conditions) for f in g.facts.values())} conditions, {sum(len(f.semantics) for f in g.facts.values())} semantic points")
            return 0
        g = load_graph(spark, place / "graph.json")
        config = checked_config(yaml_settings(args.config) if getattr(args, "config", None) else {})
        if args.command == "columns":
            print("\n".join(f"{f.model}.{c} {t}" for f in g.facts.values() for c, t in f.columns))
        elif args.command == "trace":
            print(render(walk(g, args.target)))
        elif args.command == "tree":
            print(formula.render_tree(formula.tree(g, args.target)))
        elif args.command == "cards":
            print(json.dumps([c["key"] for c in api.publish(spark, args.folder, config)]))
        elif args.command == "govern":
            rows = governance.pairs(governance.metric_rows(g, config["governance"]["skip_columns"], config["governance"]["scan_layers"])).collect()
            print("\n".join(f"{r['tier']}: {r['a']} / {r['b']}" for r in rows))
        elif args.command == "drift":
            snap = governance.snapshot(g, {m["key"]: m["target"] for m in config["metrics"]}, {m["key"]: m.get("query_filter", "") for m in config["metrics"]})
            events = governance.Snapshots(place / "drift").check(spark, snap, datetime.now(UTC).strftime("%Y%m%dT%H%M%S%f"), not args.no_save, args.strict)
            print("\n".join(f"{e['severity']} {e['metric']} {e['kind']} {e['key']}" for e in events))
            return int(args.strict and any(e["severity"] == "high" for e in events))
        return 0
    except KeyboardInterrupt:
        return 130
    except (KeyError, ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
