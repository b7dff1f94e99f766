"""SQLX01-SQLX03: one read-only statement of SQL over the session's views, lineage and masking."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The parsed nodes that a read may consist of; any other is refused, whatever the statement's words.
_NODES = frozenset("""Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Tail Distinct Union Except Intersect
SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedHaving WithWindowDefinition UnresolvedInlineTable OneRowRelation
Generate Pivot UnresolvedPivot Unpivot UnresolvedUnpivot Sample UnresolvedRelation LocalRelation UnresolvedHint ParameterizedQuery
ShowTables ShowColumns ShowNamespaces ShowViews DescribeRelation DescribeColumn UnresolvedTableOrView UnresolvedNamespace CurrentNamespace""".split())
_RELATIONS = ("UnresolvedRelation", "UnresolvedTableOrView")
_CALLS = re.compile(r"\b(read_files|java_method|reflect|try_reflect|input_file_name)\s*\(", re.I)


class Refused(ValueError):
    pass


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _nodes(plan):
    """The plan's nodes, with those of subqueries and of common table expressions."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        todo += _items(node.children())
        for inner in (node.innerChildren(), node.subqueries()):
            todo += [x for x in _items(inner) if hasattr(x, "children")]


def check(spark: SparkSession, sql: str, schemas: tuple[str, ...] = ()) -> None:
    """One statement that only reads, judged by the parsed plan: all its nodes are known reads, and its
    relations are views or tables of the session, by one name or in one of ``schemas``."""
    if _CALLS.search(sql):
        raise Refused("files and reflection can't be read")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused("not one statement that parses") from e
    for node in _nodes(plan):
        kind = node.nodeName().strip("'$")
        if kind not in _NODES:
            raise Refused(f"only reads are allowed, not {kind}")
        if kind in _RELATIONS:
            parts = _items(node.multipartIdentifier())
            if len(parts) > 1 and (len(parts) > 2 or parts[0].lower() not in schemas):
                raise Refused(f"{'.'.join(parts)} is not one of the relations that may be read")


def query(spark: SparkSession, sql: str, max_rows: int | None = None, args: dict | None = None, schemas: tuple[str, ...] = ()) -> DataFrame:
    """SQLX01: the statement's rows; with ``max_rows`` one more is kept, which tells of truncation (SRT03)."""
    check(spark, sql, schemas)
    df = spark.sql(sql, args=args or {})
    return df if max_rows is None else df.limit(max_rows + 1)


def lineage(df: DataFrame) -> dict[str, set[str]]:
    """SQLX02: for each output column the names of the base columns it is made of, by the expression ids
    of the analysed plan; "?" stands for what can't be followed."""
    made: dict[int, set[int]] = {}
    names: dict[int, str] = {}
    defined: dict[int, list[int]] = {}
    key = lambda e: e.exprId().id()
    outputs = lambda p: [key(o) for o in _items(p.output())]

    def parts(e) -> set[int]:
        """The attributes that an expression is made of; aliases on the way are noted."""
        kind = e.getClass().getSimpleName()
        if kind == "AttributeReference":
            return {key(e)}
        out: set[int] = set()
        if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            visit(e.plan())
            out.update(outputs(e.plan()))
        for c in _items(e.children()):
            out |= parts(c)
        if kind == "Alias":
            made.setdefault(key(e), set()).update(out)
        return out

    def visit(node) -> None:
        kind, kids = node.getClass().getSimpleName(), _items(node.children())
        for c in kids:
            visit(c)
        if kind == "CTERelationDef":
            defined[node.id()] = outputs(node.child())
        elif kind == "CTERelationRef":
            for o, base in zip(outputs(node), defined.get(node.cteId(), []), strict=False):
                made.setdefault(o, set()).add(base)
        elif not kids:
            names.update((key(o), o.name()) for o in _items(node.output()))
        elif kind in ("Union", "Intersect", "Except"):
            for c in kids:
                for o, base in zip(outputs(node), outputs(c), strict=True):
                    if o != base:
                        made.setdefault(o, set()).add(base)
        else:
            found: set[int] = set()
            for e in _items(node.expressions()):
                found |= parts(e)
            if kind == "Generate":
                for o in _items(node.generatorOutput()):
                    made.setdefault(key(o), set()).update(found)

    plan = df._jdf.queryExecution().analyzed()
    visit(plan)
    out: dict[str, set[str]] = {}
    for name, first in zip(df.columns, outputs(plan), strict=True):
        todo, seen, found = [first], set(), set()
        while todo:
            k = todo.pop()
            if k in seen:
                continue
            seen.add(k)
            if k in names:
                found.add(names[k])
            if k in made:
                todo += made[k]
            elif k not in names:
                found.add("?")
        out[name] = found
    return out


def mask(df: DataFrame, classes: dict[str, str], allowed: set[str]) -> DataFrame:
    """SQLX02: columns that touch a class that is not allowed come out masked; columns of unknown
    origin are masked too, so what lineage can't follow is never shown."""
    origin = lineage(df)

    def one(name: str):
        base = origin.get(name, set())
        if base and all(classes.get(b, "restricted") in allowed for b in base):
            return F.col(f"`{name}`")
        return F.lit("***").alias(name)

    return df.select(*[one(c) for c in df.columns])


def schema_catalog(spark: SparkSession, examples: dict[str, str] | None = None) -> DataFrame:
    """SQLX03: tables and columns of the session, with an example query each."""
    rows = [(t.name, c.name, c.dataType, (examples or {}).get(t.name, f"SELECT * FROM {t.name} LIMIT 10")) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, example string")
