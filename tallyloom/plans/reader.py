"""Catalyst plans as plain Python trees. The analyzed plan comes as JSON in one call; the
parsed plan, for texts and line numbers as written, is walked through the gateway. All use
of Spark's internals is in this module."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import SparkSession


@dataclass
class Node:
    """A plan or expression: class name without package, children, and its other fields."""

    kind: str
    children: list[Node] = field(default_factory=list)
    fields: dict[str, Any] = field(default_factory=dict)

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.walk()

    def exprs(self, name: str) -> list[Node]:
        """A field's expressions; one is a list of one."""
        return self.fields.get(name) or []

    @property
    def id(self) -> int | None:
        e = self.fields.get("exprId")
        return e["id"] if e else None


_EXPRESSIONS = ("projectList", "aggregateExpressions", "groupingExpressions", "condition", "output", "windowExpressions", "partitionSpec", "orderSpec", "order", "generator", "generatorOutput", "projections", "keys")


def _tree(flat: list[dict], at: int = 0) -> tuple[Node, int]:
    own = flat[at]
    node = Node(own["class"].rpartition(".")[2].rstrip("$"), [], {})
    for k, v in own.items():
        if k in ("class", "num-children", "origin"):
            continue
        if k in _EXPRESSIONS and isinstance(v, list):
            if v and isinstance(v[0], dict):
                v = [_tree(v)[0]]
            else:
                v = [_tree(x)[0] for x in v if isinstance(x, list) and x and isinstance(x[0], dict)]
        elif isinstance(v, list) and v and isinstance(v[0], dict) and "class" in v[0]:
            v = [_tree(v)[0]]
        node.fields[k] = v
    at += 1
    for _ in range(own["num-children"]):
        child, at = _tree(flat, at)
        node.children.append(child)
    return node, at


def analyzed(spark: SparkSession, sql: str) -> Node:
    return _tree(json.loads(spark.sql(sql)._jdf.queryExecution().analyzed().toJSON()))[0]


def parsed(spark: SparkSession, sql: str) -> Any:
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def expression(spark: SparkSession, text: str) -> Any:
    return spark._jsparkSession.sessionState().sqlParser().parseExpression(text)


def kind(j: Any) -> str:
    return j.getClass().getSimpleName()


def items(seq: Any) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def line_of(j: Any) -> int | None:
    found = j.origin().line()
    return found.get() if found.isDefined() else None


def error_of(spark: SparkSession, sql: str) -> str | None:
    """Why a text can't be read: None, "parse: ..." or "qualify: ..."."""
    try:
        spark.sql(sql)
    except ParseException as e:
        return f"parse: {e.getCondition() or 'PARSE_SYNTAX_ERROR'}"
    except AnalysisException as e:
        return f"qualify: {e.getCondition() or str(e).splitlines()[0]}"
    return None


def conjuncts(j: Any) -> list:
    if kind(j) == "And":
        return [x for c in items(j.children()) for x in conjuncts(c)]
    return [j]


_FLIP = {"EqualTo": "=", "LessThan": ">", "LessThanOrEqual": ">=", "GreaterThan": "<", "GreaterThanOrEqual": "<="}
_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'")
_QUALIFIER = re.compile(r"\b[a-z_]\w*\.(?=[a-z_])")


_SUBQUERIES = frozenset(("Exists", "ScalarSubquery", "ListQuery", "InSubquery", "LateralSubquery", "DynamicPruningSubquery"))


def subqueries(j: Any) -> list:
    """The parsed plans inside an expression."""
    own = [j.plan()] if kind(j) in _SUBQUERIES - {"InSubquery"} else []
    if kind(j) == "InSubquery":
        own = [j.query().plan()]
    return own + [x for c in items(j.children()) for x in subqueries(c)]


def relations(spark: SparkSession, sql: str) -> set[str]:
    """Last parts of the names of all relations that a text reads, its own CTEs aside."""
    found: set[str] = set()

    def visit(p: Any, own: frozenset) -> None:
        if kind(p) == "UnresolvedWith":
            for t in items(p.cteRelations()):
                visit(t._2(), own)
                own = own | {t._1()}
        elif kind(p) == "UnresolvedRelation" and (name := items(p.multipartIdentifier())[-1]) not in own:
            found.add(name)
        for e in items(p.expressions()):
            for q in subqueries(e):
                visit(q, own)
        for c in items(p.children()):
            visit(c, own)

    try:
        visit(parsed(spark, sql), frozenset())
    except ParseException:
        return set()
    return found


_PLAN_MARKS = re.compile(r"[:+|'\s-]*\n[:+|'\s-]*|#\d+L?|'(?=[A-Za-z])")


def written(j: Any) -> str:
    """An expression as text, with the plans of its sub-queries, which Spark's own text leaves out."""
    bodies = [_PLAN_MARKS.sub(lambda m: " < " if "\n" in m.group() else "", p.toString().strip()).strip(" <") for p in subqueries(j)]
    return " ".join([j.sql(), *(f"[{b}]" for b in bodies)])


def normal(j: Any) -> str:
    """A predicate's text for comparison: literals right, no qualifiers, lower case but in
    quotes, IS NOT NULL for NOT IS NULL, lists of IN sorted."""
    k = kind(j)
    if k == "Not" and kind(items(j.children())[0]) == "IsNull":
        return f"{normal(items(items(j.children())[0].children())[0])} is not null"
    if k == "Not" and kind(items(j.children())[0]) in _FLIP and kind(items(j.children())[0]) != "EqualTo":
        inner = items(j.children())[0]
        a, b = items(inner.children())
        opposite = {"LessThan": ">=", "LessThanOrEqual": ">", "GreaterThan": "<=", "GreaterThanOrEqual": "<"}[kind(inner)]
        return f"{normal(a)} {opposite} {normal(b)}"
    if k in _FLIP:
        a, b = items(j.children())
        if kind(a) == "Literal" and kind(b) != "Literal":
            return f"{normal(b)} {_FLIP[k]} {normal(a)}"
        straight = {"EqualTo": "=", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">="}[k]
        return f"{normal(a)} {straight} {normal(b)}"
    if k == "In":
        first, *rest = items(j.children())
        return f"{normal(first)} in ({', '.join(sorted(normal(x) for x in rest))})"
    if k in ("IsNull", "IsNotNull"):
        return f"{normal(items(j.children())[0])} is {'not ' * (k == 'IsNotNull')}null"
    text = " ".join(written(j).replace("`", "").split())
    while text.startswith("(") and text.endswith(")") and _closes(text):
        text = text[1:-1]
    out, at = [], 0
    for m in _QUOTED.finditer(text):
        out += [_QUALIFIER.sub("", text[at : m.start()].lower()), m.group()]
        at = m.end()
    return "".join([*out, _QUALIFIER.sub("", text[at:].lower())])


def _closes(text: str) -> bool:
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if not depth and i < len(text) - 1:
            return False
    return True


def fingerprint(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()[:12]


_INFIX = {"Add": "+", "Subtract": "-", "Multiply": "*", "Divide": "/", "EqualTo": "=", "EqualNullSafe": "<=>", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "And": "and", "Or": "or", "Remainder": "%", "TimestampAddInterval": "+", "TimeAdd": "+", "DateAddInterval": "+"}
_AGGREGATES = frozenset("Sum Count Min Max Average First Last MinBy MaxBy CollectList CollectSet StddevSamp VarianceSamp ApproxCountDistinct".split())
_NAMES = {"Average": "avg", "MinBy": "min_by", "MaxBy": "max_by", "RowNumber": "row_number", "DenseRank": "dense_rank", "NullIf": "nullif", "DateDiff": "datediff", "If": "if", "GetStructField": "field", "TimestampDiff": "timestampdiff", "TruncTimestamp": "date_trunc"}


def render(e: Node, names: dict[int, str] | None = None) -> str:
    """An analyzed expression as text; names replaces attributes by their ids."""
    names = names or {}
    c = e.children
    r = lambda x: render(x, names)
    if e.kind in ("AttributeReference", "OuterReference"):
        return names.get(e.id, e.fields.get("name", "?"))
    if e.kind == "Alias":
        return r(c[0])
    if e.kind == "Literal":
        value, kind_ = e.fields.get("value"), e.fields.get("dataType")
        return "null" if value is None else f"'{value}'" if kind_ in ("string", "date", "timestamp", "timestamp_ntz") else str(value)
    if e.kind == "Cast":
        to = e.fields.get("dataType")
        return f"cast({r(c[0])} as {to})" if to in ("date", "string", "timestamp", "timestamp_ntz") else r(c[0])
    if e.kind == "AggregateExpression":
        f = c[0]
        inner = ", ".join(r(x) for x in f.children)
        if f.kind == "Count" and all(x.kind == "Literal" for x in f.children):
            inner = "*"
        where = f" filter (where {r(c[1])})" if len(c) > 1 else ""
        return f"{_NAMES.get(f.kind, f.kind.lower())}({'distinct ' * bool(e.fields.get('isDistinct'))}{inner}){where}"
    if e.kind in _INFIX and len(c) == 2:
        return f"({r(c[0])} {_INFIX[e.kind]} {r(c[1])})"
    if e.kind == "CaseWhen":
        pairs = [f"when {r(c[i])} then {r(c[i + 1])}" for i in range(0, len(c) - 1, 2)]
        return f"case {' '.join(pairs)}{f' else {r(c[-1])}' if len(c) % 2 else ''} end"
    if e.kind in ("IsNull", "IsNotNull"):
        return f"{r(c[0])} is {'not ' * (e.kind == 'IsNotNull')}null"
    if e.kind == "Not":
        return f"not {r(c[0])}"
    if e.kind == "In":
        return f"{r(c[0])} in ({', '.join(r(x) for x in c[1:])})"
    if e.kind == "WindowExpression":
        spec = c[1]
        parts, orders = [x for x in spec.children if x.kind not in ("SortOrder", "SpecifiedWindowFrame", "UnspecifiedFrame")], [x for x in spec.children if x.kind == "SortOrder"]
        text = [f"partition by {', '.join(map(r, parts))}"] * bool(parts) + [f"order by {', '.join(r(x.children[0]) for x in orders)}"] * bool(orders)
        return f"{r(c[0])} over ({' '.join(text)})"
    if e.kind == "ScalarSubquery":
        return "(scalar subquery)"
    if e.kind == "NullIf":  # rewritten to a conditional over a shared value
        value = next((x.children[0] for x in e.walk() if x.kind == "CommonExpressionDef"), None)
        test = next((x for x in e.walk() if x.kind == "EqualTo"), None)
        if value is not None and test is not None:
            return f"nullif({r(value)}, {r(test.children[1])})"
    keep = c
    if isinstance(e.fields.get("replacement"), int) and c:  # a rewritten function: the arguments of what replaces it
        keep = c[e.fields["replacement"]].children or c
    return f"{_NAMES.get(e.kind, e.kind.lower())}({', '.join(r(x) for x in keep)})"


def has_aggregate(e: Node) -> bool:
    return any(x.kind == "AggregateExpression" for x in e.walk())
