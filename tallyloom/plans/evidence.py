"""Checks of a reader's claims about a metric (a person's or a model's) against the plans."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import SparkSession

from tallyloom.plans import reader as P
from tallyloom.plans.lineage import Graph
from tallyloom.plans.trace import Trace

_IDENTIFIER = re.compile(r"\b[a-z][a-z0-9]*(?:[._][a-z0-9]+)+\b")
_NUMBER = re.compile(r"(?<![\w.])\d{2,}(?![\w.])")


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def quotes_verbatim(quotes: list[str], sql: str) -> list[str]:
    """The quotes that the text doesn't contain, white space and case aside; an empty one quotes nothing."""
    whole = normalised(sql)
    return [q for q in quotes if not normalised(q) or normalised(q) not in whole]


def classify_filters(spark: SparkSession, graph: Graph, t: Trace, claims: list[dict]) -> list[dict]:
    """Each claimed filter {model, sql}: matched, pure_key, out_of_scope, suspect or unparsed."""
    on_path = {c["fp"] for c in t.conditions}
    out = []
    for claim in claims:
        try:
            fp = P.fingerprint(P.normal(P.expression(spark, claim["sql"])))
        except Exception as e:  # the gateway raises its own types for texts it can't parse
            out.append(claim | {"status": "unparsed", "detail": str(e).splitlines()[0]})
            continue
        own = [c for m in graph.facts.values() for c in m.conditions if c["fp"] == fp]
        status = "suspect" if not own else "pure_key" if all(c["is_pure_key"] for c in own) else "matched" if fp in on_path else "out_of_scope"
        out.append(claim | {"status": status, "fp": fp})
    return out


def coverage(t: Trace, classified: list[dict]) -> float:
    wanted = {c["fp"] for c in t.conditions if not c["is_pure_key"]}
    return len(wanted & {c.get("fp") for c in classified}) / len(wanted) if wanted else 1.0


def compare_sources(claimed: list[str], t: Trace) -> tuple[list[str], list[str]]:
    """Sources that were missed and that were made up; a shorter name may stand for a longer one, and context tables may be named."""
    def same(a: str, b: str) -> bool:
        return a == b or a.endswith(f".{b}") or b.endswith(f".{a}")

    missing = [s for s in t.sources if not any(same(s, c) for c in claimed)]
    extra = [c for c in claimed if not any(same(s, c) for s in t.sources) and not any(c.startswith(f"{x}.") for x in t.context_tables)]
    return missing, extra


#: Grades from the best down: most sources missed and made up, least coverage, most failed quotes and suspect filters.
GRADES = (("high", 0, 0, 0.999, 0, 0), ("medium", 0, 1, 0.8, 0, 1))


def confidence(missing: list[str], extra: list[str], covered: float, quote_failures: int, suspects: int) -> str:
    """The first grade whose limits a claim keeps, else low."""
    kept = (g for g, missed, made_up, least, failed, odd in GRADES if len(missing) <= missed and len(extra) <= made_up and covered >= least and quote_failures <= failed and suspects <= odd)
    return next(kept, "low")


def free_text(text: str, graph: Graph, t: Trace, allowed: set[str] = frozenset({"100"})) -> list[str]:
    """Identifiers and numbers in prose that nothing in the metric's facts explains."""
    facts = " ".join([*t.sources, *t.models, *t.context_tables, *(e["expr"] for e in t.expr_chain), *(c["norm"] for c in t.conditions), *(s["detail"] for s in t.semantics)])
    words = {w for f in graph.facts.values() for w in (f.model, *(c for c, _ in f.columns))} | set(_IDENTIFIER.findall(facts))
    numbers = set(_NUMBER.findall(facts)) | set(re.findall(r"\d{2,}", facts)) | set(allowed)
    return [w for w in _IDENTIFIER.findall(text.lower()) if w not in words and not any(w.endswith(f".{x}") or x.endswith(f".{w}") for x in words)] + [n for n in _NUMBER.findall(text) if n not in numbers]


def numbered(t: Trace) -> list[dict]:
    """Evidence with ids: E expressions, S sources, X conditions, Q semantics."""
    groups: list[tuple[str, list[Any]]] = [("E", [f"{e['model']}.{e['column']} = {e['expr']}" for e in t.expr_chain]), ("S", t.sources), ("X", [f"{c['model']}: {c['norm']}" for c in t.conditions]), ("Q", [f"{s['type']} {s['model']}.{s['column']}: {s['detail']}" for s in t.semantics])]
    return [{"id": f"{p}{i}", "text": x} for p, xs in groups for i, x in enumerate(dict.fromkeys(xs), 1)]
