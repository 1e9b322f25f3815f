"""Cards as one HTML page, grouped by what may be published, and the lineage around a column as a graph."""

from __future__ import annotations

from collections.abc import Iterable
from html import escape
from pathlib import Path

from tallyloom.plans.lineage import Graph
from tallyloom.plans.trace import resolve

#: Order and headings of the groups.
GROUPS = {"VERIFIED": "Verified", "TECHNICAL_ONLY": "Technical facts only", "REVIEW_REQUIRED": "To be reviewed"}

_STYLE = "body{font:15px sans-serif;max-width:60em;margin:2em auto;color:#222}section{border:1px solid #ccc;border-radius:6px;padding:1em;margin:1em 0}code{background:#f4f4f4;padding:1px 4px}h2{border-bottom:1px solid #ccc}"


def _list(title: str, rows: Iterable[str]) -> str:
    rows = list(rows)
    return f"<h4>{escape(title)}</h4><ul>{''.join(f'<li><code>{escape(r)}</code></li>' for r in rows)}</ul>" if rows else ""


def card_html(card: dict) -> str:
    head = f"<h3>{escape(card['title'])}</h3><p><code>{escape(card['target'])}</code></p>"
    if "formula" not in card:  # a card under review shows only what identifies it
        return f"<section id='{escape(card['key'])}'>{head}</section>"
    f = card["formula"]
    body = f"<p>{escape(f['status'])}: <code>{escape(f['top'])}</code></p>" + _list("Parts", (f"{d['name']} = {d['expr']}" for d in f["defs"]))
    body += _list("Sources", card["sources"]) + _list("Rows also shaped by", card["context_tables"])
    body += _list("Conditions", (f"{c['model']}:{c['line']} {c['norm']}" for c in card["conditions"])) + _list("Evidence", (f"{e['id']} {e['text']}" for e in card["evidence"]))
    return f"<section id='{escape(card['key'])}'>{head}{body}{_list('Used by', card.get('exposures', []))}</section>"


def export(cards: list[dict], path: str | Path, stale: str = "") -> None:
    """stale: a line to show above if the cards are older than the graph."""
    parts = [f"<p><b>{escape(stale)}</b></p>"] if stale else []
    for status, heading in GROUPS.items():
        some = [c for c in cards if c["publication"] == status]
        if some:
            parts.append(f"<h2>{heading} ({len(some)})</h2>{''.join(map(card_html, some))}")
    Path(path).write_text(f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Metrics</title><style>{_STYLE}</style></head><body><h1>Metrics</h1>{''.join(parts)}</body></html>", encoding="utf-8")


def lineage_view(graph: Graph, model: str, column: str | None = None) -> dict:
    """Nodes (models and sources, with layer and columns met) and edges upstream of a model or one of its columns."""
    start = resolve(graph, model)
    todo = [(start, c) for c, _ in graph.facts[start].columns if column in (None, c)]
    seen, nodes, edges = set(), {}, set()
    while todo:
        m, c = todo.pop()
        if (m, c) in seen:
            continue
        seen.add((m, c))
        facts = graph.facts.get(m)
        nodes.setdefault(m, {"id": m, "layer": facts.layer if facts else "source", "columns": set()})["columns"].add(c)
        for own, up, up_column in facts.edges if facts else ():
            if own == c:
                edges.add((f"{up}.{up_column}", f"{m}.{c}"))
                todo.append((up, up_column))
    return {"nodes": [n | {"columns": sorted(n["columns"])} for _, n in sorted(nodes.items())], "edges": [{"from": a, "to": b} for a, b in sorted(edges)]}
