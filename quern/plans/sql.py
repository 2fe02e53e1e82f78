"""What a step's SQL may be and what it reads, from Spark's own parser; lineage of its columns from the analysed plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quern.plans.graph import PipelineError


def parse(spark: SparkSession, text: str):
    """The parsed plan of one query. EMPTY_SQL, NOT_A_QUERY (commands, several statements) or BAD_SQL otherwise."""
    body = text.strip().rstrip(";").strip()
    if not body:
        raise PipelineError("EMPTY_SQL", "there is no query")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
    except Exception as e:
        message = str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__
        raise PipelineError("NOT_A_QUERY" if ";" in body else "BAD_SQL", message) from None
    name = plan.getClass().getName()
    if ".command." in name or name.rpartition(".")[2].startswith(("Insert", "Create", "Drop", "Alter", "Merge", "Delete", "Update", "Truncate", "Replace", "Set", "Use", "Show", "Describe", "Cache", "Refresh", "Compound", "Explain")):
        raise PipelineError("NOT_A_QUERY", f"only queries are allowed, not {name.rpartition('.')[2]}")
    return plan


def _all(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def tables(spark: SparkSession, text: str) -> list[str]:
    """Names that a query reads, without those of its own common table expressions, in order."""
    found: list[str] = []

    def walk(node, hidden: frozenset[str]) -> None:
        kind = node.nodeName()
        if "UnresolvedWith" in node.getClass().getName():
            names = hidden
            for pair in _all(node.cteRelations()):
                walk(pair._2(), names)
                names = names | {pair._1().lower()}
            walk(node.child(), names)
            return
        if kind == "UnresolvedRelation" or node.getClass().getName().endswith("UnresolvedRelation"):
            parts = _all(node.multipartIdentifier())
            if (name := ".".join(parts)) not in found and not (len(parts) == 1 and name.lower() in hidden):
                found.append(name)
        for child in _all(node.children()):
            walk(child, hidden)
        for e in _all(node.expressions()):
            inner(e, hidden)

    def inner(e, hidden: frozenset[str]) -> None:
        if hasattr(e, "plan") and "Subquery" in e.getClass().getName() or e.getClass().getName().rpartition(".")[2] in ("Exists", "ListQuery", "ScalarSubquery", "InSubquery"):
            try:
                walk(e.plan(), hidden)
            except Exception:  # noqa: BLE001 - InSubquery holds its query below
                pass
        for child in _all(e.children()):
            inner(child, hidden)

    walk(parse(spark, text), frozenset())
    return found


@dataclass
class Origin:
    """Where a column comes from: kind (direct, renamed, literal, expression, multi_column, aggregation, window) and (table, column)s."""

    column: str
    kind: str
    origins: list[tuple[str, str]] = field(default_factory=list)


def lineage(df: DataFrame) -> list[Origin]:
    """Of each output column of a plan over temporary views or tables; needs a classic (not Connect) session."""
    plan = df._jdf.queryExecution().analyzed()
    made: dict[int, object] = {}
    owner: dict[int, tuple[str, str]] = {}

    def walk(node, view: str) -> None:
        kind = node.getClass().getName().rpartition(".")[2]
        if kind == "SubqueryAlias":
            view = node.identifier().name() if view == "" else view
            for a in _all(node.output()):
                owner.setdefault(a.exprId().id(), (node.identifier().name(), a.name()))
        for e in _all(node.expressions()):
            collect(e)
        for child in _all(node.children()):
            walk(child, view)

    def collect(e) -> None:
        if e.getClass().getName().rpartition(".")[2] == "Alias":
            made.setdefault(e.exprId().id(), e.child())
        for child in _all(e.children()):
            collect(child)

    def leaves(e, seen: set[int]) -> list[tuple[str, str]]:
        if e.getClass().getName().rpartition(".")[2] == "AttributeReference":
            i = e.exprId().id()
            if i in made and i not in seen:
                return leaves(made[i], seen | {i})
            return [owner.get(i, ("", e.name()))]
        return [x for c in _all(e.children()) for x in leaves(c, seen)]

    def names(e, seen: set[int]) -> set[str]:
        out = {e.getClass().getName().rpartition(".")[2]}
        if "AttributeReference" in out and e.exprId().id() in made and e.exprId().id() not in seen:
            out |= names(made[e.exprId().id()], seen | {e.exprId().id()})
        for c in _all(e.children()):
            out |= names(c, seen)
        return out

    walk(plan, "")
    out = []
    for a in _all(plan.output()):
        i = a.exprId().id()
        e = made.get(i, a)
        found = list(dict.fromkeys(leaves(e, {i})))
        nodes = names(e, {i})
        chain = e
        while chain.getClass().getName().rpartition(".")[2] == "AttributeReference" and chain.exprId().id() in made:
            chain = made[chain.exprId().id()]
        bare = chain.getClass().getName().rpartition(".")[2] == "AttributeReference"
        kind = "window" if "WindowExpression" in nodes else "aggregation" if "AggregateExpression" in nodes else "literal" if not found else ("direct" if found[0][1] == a.name() else "renamed") if bare else "multi_column" if len(found) > 1 else "expression"
        out.append(Origin(a.name(), kind, found))
    return out


def depends(df: DataFrame, source: DataFrame, column: str) -> list[str]:
    """Columns of df that are made of a column of source, a frame that df reads."""
    out = source._jdf.queryExecution().analyzed().output()
    wanted = {a.exprId().id() for a in _all(out) if a.name() == column}
    if not wanted:
        raise PipelineError("NO_COLUMN", column)
    made: dict[int, set[int]] = {}

    def ids(e) -> set[int]:
        found = {e.exprId().id()} if e.getClass().getName().rpartition(".")[2] == "AttributeReference" else set()
        return found.union(*[ids(c) for c in _all(e.children())])

    def walk(node) -> None:
        for e in _all(node.expressions()):
            aliases(e)
        below = _all(node.children())
        if node.nodeName() == "Union":  # a column of a union is made of those at its place
            for i, a in enumerate(_all(node.output())):
                made.setdefault(a.exprId().id(), set()).update(c.output().apply(i).exprId().id() for c in below)
        elif len(below) == 1 and node.nodeName() in ("View", "SubqueryAlias"):
            for a, b in zip(_all(node.output()), _all(below[0].output()), strict=False):
                made.setdefault(a.exprId().id(), set()).add(b.exprId().id())
        for child in below:
            walk(child)

    def aliases(e) -> None:
        if e.getClass().getName().rpartition(".")[2] == "Alias":
            made.setdefault(e.exprId().id(), set()).update(ids(e.child()))
        for child in _all(e.children()):
            aliases(child)

    plan = df._jdf.queryExecution().analyzed()
    walk(plan)

    def reaches(i: int) -> bool:
        seen, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x in wanted:
                return True
            if x not in seen:
                seen.add(x)
                todo += made.get(x, ())
        return False

    return [a.name() for a in _all(plan.output()) if reaches(a.exprId().id())]
