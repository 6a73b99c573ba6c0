"""Which columns the columns of a result come from, by the analysed plan: every name that their values have had on the way.

Every attribute of a plan has an expression id. Walking from the relations up, an alias takes the origins of all attributes in its
expression (those of subqueries too), a union those of all its inputs at a place, a reference to a common table expression those of its
definition; nodes that make attributes in ways not known here give them the origins of everything below, so an origin
is never lost. Names under which an expression reaches into a struct, a map or JSON count as origins as well.
"""

from __future__ import annotations

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame

_PLANS = "org.apache.spark.sql.catalyst.plans.logical."
_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
#: Expressions that reach into a value by a name that is a literal.
_REACHES = ("GetMapValue", "ElementAt", "GetJsonObject", "VariantGet", "JsonTuple", "ParseUrl", "TryElementAt")


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


class _Walk:
    def __init__(self, gateway):
        self.gateway = gateway
        self.definitions: dict[int, tuple[object, dict]] = {}

    def _is(self, x, name: str) -> bool:
        return is_instance_of(self.gateway, x, name)

    def _expression(self, e, known: dict) -> set[str]:
        """Origins of an expression."""
        kind = e.getClass().getSimpleName()
        if self._is(e, f"{_EXPRESSIONS}AttributeReference"):
            return known.get(e.exprId().id(), {e.name()})
        found: set[str] = set()
        if kind == "OuterReference":
            found |= self._expression(e.e(), known)
        if kind in ("GetStructField", "GetArrayStructFields"):
            found.add(e.field().name() if kind == "GetArrayStructFields" else e.extractFieldName())
        children = _items(e.children())
        if kind in _REACHES:
            found |= {c.toString() for c in children if self._is(c, f"{_EXPRESSIONS}Literal")}
        if self._is(e, f"{_EXPRESSIONS}PlanExpression"):
            inner = self.plan(e.plan(), known)
            for a in _items(e.plan().output()):
                found |= inner[a.exprId().id()]
        for c in children:
            found |= self._expression(c, known)
        return found

    def plan(self, node, outer: dict | None = None) -> dict[int, set[str]]:
        """Origins of every attribute that the node's expressions may see, by expression id."""
        kind = node.getClass().getSimpleName()
        if kind == "WithCTE":
            for d in _items(node.cteDefs()):
                self.definitions[d.id()] = (d.child(), self.plan(d.child(), outer))
        children = _items(node.children())
        if kind == "WithCTE":
            children = [node.plan()]
        below = [self.plan(c, outer) for c in children]
        known = dict(outer or {})
        for b in below:
            known |= b
        if kind == "CTERelationRef":
            child, inner = self.definitions[node.cteId()]
            for mine, theirs in zip(_items(node.output()), _items(child.output())):
                known[mine.exprId().id()] = inner[theirs.exprId().id()]
        elif kind in ("Union", "Intersect", "Except"):
            for place, mine in enumerate(_items(node.output())):
                found: set[str] = set()
                for c, b in zip(children, below):
                    found |= b[c.output().apply(place).exprId().id()]
                known[mine.exprId().id()] = found
        else:
            for e in _items(node.expressions()):
                self._aliases(e, known)
        missing = [a for a in _items(node.output()) if a.exprId().id() not in known]
        for a in missing:
            known[a.exprId().id()] = set().union(*(v for b in below for v in b.values())) if children else {a.name()}
        return known

    def _aliases(self, e, known: dict) -> None:
        for c in _items(e.children()):
            self._aliases(c, known)
        if self._is(e, f"{_EXPRESSIONS}Alias"):
            known[e.exprId().id()] = self._expression(e.child(), known) | {e.name()}


def origins(df: DataFrame) -> list[set[str]]:
    """For each column of df, the names of all columns that its values come from, and those that they have had since."""
    analysed = df._jdf.queryExecution().analyzed()
    known = _Walk(df.sparkSession.sparkContext._gateway).plan(analysed)
    return [known[a.exprId().id()] for a in _items(analysed.output())]
