"""User SQL over governed views, in a session of its own.

Spark parses, plans and runs the text; its plan is checked twice. The parsed plan may hold only
listed nodes, expressions and built-in functions, and names of governed views or CTEs in scope, so
no path, catalog table, global view or computed name gets past the views. In the analysed plan, where
every name is settled, whatever reads data must be one of those views: the walk goes through all that
a node is made of, subqueries in any place included, and does not depend on the first check.

``NOT IN`` over a subquery is asked of Spark as ``NOT EXISTS`` (see ``_shuffled``): as it stands, Spark would
gather the whole list in the driver and broadcast it.

Policies and tables are read for every query: a scope that is gone shuts its tables at once, and rows
that have come are seen. Needs the JVM handle of classic PySpark; with Spark Connect use
``governed_table``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping

from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from palisade.operators.enforce import (
    AccessDenied,
    GovernedTable,
    ResidencyKey,
    cap_rows,
    check_access,
    govern,
)
from palisade.operators.audit import log_denial, run_recorded
from palisade.session import materialise, shared_folder
from palisade.sources.policy import Bundle
from palisade.sources.registry import Registry

# Plan nodes of a plain query. Commands, path and time-travel relations, computed names,
# table functions and scripts are not in the list and so are refused.
PLAIN_NODES = frozenset(
    """
    Project Filter Aggregate UnresolvedHaving Distinct Deduplicate Expand
    Join LateralJoin AsOfJoin Union Intersect Except
    Sort GlobalLimit LocalLimit Offset Tail Sample
    WithWindowDefinition Window Generate Pivot Unpivot UnresolvedPivot UnresolvedUnpivot
    UnresolvedWith UnresolvedRelation SubqueryAlias UnresolvedSubqueryColumnAliases
    UnresolvedInlineTable LocalRelation OneRowRelation OneRowRelation$
    RepartitionByExpression PipeOperator
    """.split()
)
# Expressions of a plain query as the parser makes them. Computed identifiers, parameters and
# whatever a later Spark adds are not in the list and so are refused.
PLAIN_EXPRESSIONS = frozenset(
    """
    UnresolvedAttribute UnresolvedStar UnresolvedStarExceptOrReplace AttributeReference UnresolvedRegex UnresolvedAlias Alias MultiAlias Literal
    UnresolvedFunction UnresolvedGenerator AggregateExpression UnresolvedExtractValue SemiStructuredExtract
    UnresolvedOrdinal GetStructField
    Cast Collate UnresolvedCollation Extract TimestampAdd TimestampDiff Substring Overlay StringTrim
    StringTrimLeft StringTrimRight StringTrimBoth StringLocate Concat
    And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual
    IsNull IsNotNull IsTrue IsNotTrue IsFalse IsNotFalse IsUnknown IsNotUnknown
    In InSubquery ListQuery Exists ScalarSubquery
    Like ILike RLike LikeAll LikeAny NotLikeAll NotLikeAny Between UnresolvedBetween UnresolvedBinaryComparison
    Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive
    BitwiseAnd BitwiseOr BitwiseXor BitwiseNot ShiftLeft ShiftRight ShiftRightUnsigned
    CaseWhen If Coalesce CreateNamedStruct CreateStruct CreateArray CreateMap
    LambdaFunction UnresolvedNamedLambdaVariable
    SortOrder WindowExpression WindowSpecDefinition UnresolvedWindowExpression WindowSpecReference
    SpecifiedWindowFrame UnspecifiedFrame CurrentRow UnboundedPreceding UnboundedFollowing
    GroupingSets Cube Rollup Grouping GroupingID First Last AnyValue Count PercentileCont PercentileDisc
    CurrentDate CurrentTime CurrentTimestamp Now CurrentUser Uuid
    UnresolvedInlineTable UnresolvedSubqueryColumnAliases NamedArgumentExpression
    """.split()
)
# Leaves of an analysed plan that read no stored data.
DATALESS_LEAVES = frozenset("OneRowRelation LocalRelation ResolvedInlineTable CTERelationRef UnionLoopRef".split())
# Built-in functions that reach outside the data.
BLOCKED_FUNCTIONS = (
    "java_method",
    "reflect",
    "try_reflect",
    "input_file_name",
    "input_file_block_start",
    "input_file_block_length",
)

# Values whose text can stand again in a subquery: columns, and simple sums of them.
_REPEATABLE = frozenset("UnresolvedAttribute Literal Cast Add Subtract Multiply Divide UnaryMinus".split())
# What makes a list depend on the order of its rows or on chance.
_ARBITRARY = frozenset("GlobalLimit LocalLimit Offset Tail Sample".split())
_IN_LIST = re.compile(r"(?:NOT\s+)?IN\s*\((.*)\)", re.IGNORECASE | re.DOTALL)


class QueryRefused(AccessDenied):
    def __init__(self, reason: str):
        super().__init__("query_refused", reason)


class GovernedSession:
    """SQL for one agent over one source. Views appear as queries name them.

    ``bundle`` may be a function without arguments, asked for the policies before every query
    (say, ``lambda: Bundle.read(spark, path)``); a plain bundle may be set anew at any time.
    With ``audit`` (a path) refused queries leave a denial there, and ``run`` leaves a record
    of every query it runs.
    """

    def __init__(
        self,
        spark: SparkSession,
        registry: Registry,
        bundle: Bundle | Callable[[], Bundle],
        agent: str,
        source: str,
        *,
        residency: Mapping[str, ResidencyKey] | None = None,
        barrier: bool = False,
        audit: str | None = None,
        **options,
    ):
        self.registry, self.bundle, self.agent, self.source = registry, bundle, agent, source
        self.residency, self.barrier, self.options = residency or {}, barrier, options
        self.audit = audit
        self.tables: dict[str, GovernedTable] = {}  # by lower-case name
        self.session = spark.newSession()
        self.session.conf.set("spark.sql.runSQLOnFiles", "false")
        for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
            self.session.conf.set(key, spark.conf.get(key))
        self.main = spark
        self._classes = {
            name: self._class(f"org.apache.spark.sql.catalyst.{name}")
            for name in ("plans.logical.LogicalPlan", "expressions.Expression", "expressions.PlanExpression")
        } | {name: self._class(name) for name in ("scala.collection.Iterable", "scala.Option")}
        self._drop_blocked_functions()

    def register(self, *tables: str) -> None:
        """Make governed views of the named tables, of their files as they are now; all or none."""
        spelled = {t.lower(): t for t in self.registry.tables(self.source)}
        names = list(dict.fromkeys(spelled.get(t.lower(), t) for t in tables))
        if not names:
            return
        bundle = self.bundle() if callable(self.bundle) else self.bundle
        try:
            allowed = check_access(bundle, self.agent, self.source, names)
        except AccessDenied:
            self._drop([t.lower() for t in names])
            raise
        for table, access in allowed.items():
            view = table.lower()
            raw = self.registry.load(self.session, self.source, table)
            result = govern(raw, access, residency=self._residency(view), **self.options)
            if self.barrier:
                stored = materialise(result.df, "governed", shared_folder(self.main))
                result = GovernedTable(stored, access, result.masked)
            result.df.createOrReplaceTempView(view)
            self.tables[view] = result

    def _residency(self, view: str) -> ResidencyKey | None:
        return next((key for table, key in self.residency.items() if table.lower() == view), None)

    def _drop(self, views: list[str]) -> None:
        for view in views:
            if self.tables.pop(view, None) is not None:
                self.session.catalog.dropTempView(view)

    def sql(self, query: str) -> DataFrame:
        """The query's result under the tightest row cap of the tables it names."""
        try:
            names = self.check(query)
            self.register(*names)
            result = self._planned(query)
            self.check_lineage(result, names)
        except AccessDenied:
            if self.audit:
                log_denial(self.main, self.agent, self.source, _first_line(query), self.audit)
            raise
        views = dict.fromkeys(n.lower() for n in names)
        caps = [self.tables[v].access.max_rows for v in views if self.tables[v].access.max_rows > 0]
        return cap_rows(result, min(caps, default=0))

    def _planned(self, query: str) -> DataFrame:
        # as a subquery, the text can be nothing but a query
        whole = "SELECT * FROM (\n{}\n) AS governed"
        as_written = self.session.sql(whole.format(query))
        text = self._shuffled(query)
        if text != query:
            try:
                result = self.session.sql(whole.format(text))
            except AnalysisException:  # a list that cannot be asked twice
                return as_written
            if result._jdf.queryExecution().analyzed().deterministic() and result.schema == as_written.schema:
                return result
        return as_written

    def _shuffled(self, query: str) -> str:
        """The query with ``x NOT IN (list)`` among the conditions of a WHERE as an anti join, which is shuffled. A row stays if
        nothing in the list equals x and nothing in it is NULL; where x itself is NULL, if the list is empty."""
        if "${" in query:  # Spark replaces variables first, so places in the text would be off
            return query
        item = "listed"
        while item in query.lower():
            item += "_"
        while found := max(self._lists(query), default=None):
            at, to, value, items, infix = found
            same = f"SELECT 1 FROM (\n{items}\n) AS {item}({item}) WHERE {item}.{item} = {value}"
            gap = f"SELECT 1 FROM (\n{items}\n) AS {item}({item}) WHERE {item}.{item} IS NULL"
            kept = f"NOT EXISTS ({same}) AND CASE WHEN ({value}) IS NULL THEN NOT EXISTS (\n{items}\n) ELSE NOT EXISTS ({gap}) END"
            # where x stands before the replaced words, it is compared to itself
            query = query[:at] + (f" IS NOT DISTINCT FROM ({value}) AND {kept}" if infix else f"({kept})") + query[to:]
        return query

    def _lists(self, query: str) -> Iterator[tuple[int, int, str, str, bool]]:
        """(from, to, value, list, whether the value stands before ``from``) of the lists to replace; an inner list starts last."""
        for no, test in self._not_in(self.session._jsparkSession.sessionState().sqlParser().parsePlan(query)):
            values = _items(test.values())
            if len(values) != 1 or not _made_of(values[0], _REPEATABLE) or _kinds(test.query().plan()) & _ARBITRARY:
                continue
            (at, to), (start, end), value = _span(no), _span(test), slice(*_span(values[0]))
            listed = _IN_LIST.fullmatch(query[start:end])
            if listed:
                yield at, to, query[value], listed[1], at > value.start

    def _not_in(self, node) -> Iterator[tuple]:
        """NOT and IN of every ``NOT IN`` over a subquery that a WHERE demands beside its other conditions."""
        waiting = [node]
        while waiting:
            at = waiting.pop()
            if self._is(at, "plans.logical.LogicalPlan"):
                if at.getClass().getSimpleName() == "UnresolvedWith":
                    waiting += [cte._2() for cte in _items(at.cteRelations())]
                if at.getClass().getSimpleName() == "Filter":
                    yield from _demanded(at.condition())
                waiting += _items(at.expressions())
            elif self._is(at, "expressions.PlanExpression"):
                waiting.append(at.plan())
            waiting += _items(at.children())

    def run(self, query: str, action: Callable[[DataFrame], object], name: str = "QUERY") -> dict:
        """Run ``action`` on the query's result and append its record to the audit trail."""
        if not self.audit:
            raise ValueError("no audit trail: give the session a path in audit")
        result = self.sql(query)
        resource = ",".join(dict.fromkeys(n.lower() for n in self.check(query))) or _first_line(query)
        return run_recorded(result, action, self.audit, self.agent, self.source, resource, name)

    def check(self, query: str) -> list[str]:
        """Tables the query reads, in first-mention order; QueryRefused if it is not plain."""
        try:
            plan = self.session._jsparkSession.sessionState().sqlParser().parsePlan(query)
        except Exception as err:
            raise QueryRefused(f"not a query: {str(err).strip().splitlines()[0]}") from err
        return list(dict.fromkeys(self._relations(plan, frozenset())))

    def masked_columns(self) -> dict[str, list[str]]:
        return {t: [m["name"] for m in g.masked] for t, g in self.tables.items()}

    def _relations(self, node, ctes: frozenset[str]) -> Iterator[str]:
        kind = node.getClass().getSimpleName()
        if kind not in PLAIN_NODES:
            raise QueryRefused(f"{kind} is not allowed in a governed query")
        if kind == "UnresolvedRelation":
            parts = _items(node.multipartIdentifier())
            if len(parts) != 1:
                raise QueryRefused(f"{'.'.join(parts)} is not a governed view")
            if parts[0].lower() not in ctes:
                yield parts[0]
        if kind == "UnresolvedWith":
            for cte in _items(node.cteRelations()):
                name = cte._1().lower()
                inside = ctes | {name} if node.allowRecursion() else ctes
                yield from self._relations(cte._2(), inside)
                ctes = ctes | {name}  # visible to later definitions and the body only
        for child in _items(node.children()):
            yield from self._relations(child, ctes)
        expressions = _items(node.expressions())
        if kind == "WithWindowDefinition":
            expressions += _items(node.windowDefinitions().values().toSeq())
        for expression in expressions:
            yield from self._in_expression(expression, ctes)

    def _in_expression(self, expression, ctes: frozenset[str]) -> Iterator[str]:
        """Only plain expressions and built-in functions: a computed name could be any
        function's, and a stored SQL function could read any table."""
        made = expression.getClass()
        kind = (made.getSimpleName() or made.getSuperclass().getSimpleName()).rstrip("$")
        if kind not in PLAIN_EXPRESSIONS:
            raise QueryRefused(f"{kind} is not allowed in a governed query")
        name = None
        if kind == "UnresolvedFunction":
            name = ".".join(_items(expression.nameParts()))
        elif kind == "UnresolvedGenerator":
            name = expression.name().funcName()
        if name is not None and (name.lower() in BLOCKED_FUNCTIONS or not self._built_in(name.lower())):
            raise QueryRefused(f"function {name} is not allowed in a governed query")
        if self._is(expression, "expressions.PlanExpression"):
            yield from self._relations(expression.plan(), ctes)
        for child in _items(expression.children()):
            yield from self._in_expression(child, ctes)

    def check_lineage(self, df: DataFrame, names: Iterable[str]) -> None:
        """QueryRefused unless all data that ``df`` reads come from the governed views of ``names``."""
        allowed = {n.lower() for n in names}
        waiting = [df._jdf.queryExecution().analyzed()]
        while waiting:
            at = waiting.pop()
            plan = self._is(at, "plans.logical.LogicalPlan")
            if plan:
                kind = at.getClass().getSimpleName().rstrip("$")
                if kind == "View":
                    self._check_view(at, allowed)
                    continue
                if not at.children().size() and kind not in DATALESS_LEAVES:
                    raise QueryRefused(f"{kind} is read beside the governed views")
                if kind == "LocalRelation":
                    continue  # values of the text itself
            elif self._is(at, "expressions.PlanExpression"):
                waiting.append(at.plan())
            if self._is(at, "scala.collection.Iterable") or self._is(at, "scala.Option"):
                parts = at.iterator()
            elif plan or self._is(at, "expressions.Expression") or at.getClass().getName().startswith("scala.Tuple"):
                parts = at.productIterator()
            else:
                continue  # a type, a name, a number: nothing that reads
            while parts.hasNext():
                part = parts.next()
                if isinstance(part, JavaObject):
                    waiting.append(part)

    def _check_view(self, view, allowed: set[str]) -> None:
        """A view is governed if it is this session's own, by name and by what it stands for."""
        name = view.desc().identifier()
        table = name.table().lower()
        own = view.isTempView() and name.database().isEmpty() and table in allowed and table in self.tables
        if not own or not view.child().sameResult(self.tables[table].df._jdf.queryExecution().analyzed()):
            raise QueryRefused(f"{name.unquotedString()} is read beside the governed views")

    def _class(self, name: str):
        thread = self.main._jvm.java.lang.Thread.currentThread()
        return self.main._jvm.java.lang.Class.forName(name, True, thread.getContextClassLoader())

    def _is(self, thing, name: str) -> bool:
        return self._classes[name].isInstance(thing)

    def _identifier(self, name: str):
        return self.session._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)

    def _built_in(self, name: str) -> bool:
        registry = self.session._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry
        return registry.builtin().functionExists(self._identifier(name)) or self._table_function(name)

    def _table_function(self, name: str) -> bool:
        registry = self.session._jvm.org.apache.spark.sql.catalyst.analysis.TableFunctionRegistry
        return registry.builtin().functionExists(self._identifier(name))

    def _drop_blocked_functions(self) -> None:
        """Second lock: the functions do not even resolve in this session."""
        state = self.session._jsparkSession.sessionState()
        for name in BLOCKED_FUNCTIONS:
            state.functionRegistry().dropFunction(self._identifier(name))


def _first_line(query: str) -> str:
    return next(iter(query.strip().splitlines()), "")


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _span(expression) -> tuple[int, int]:
    """Where the parser found an expression in the text."""
    origin = expression.origin()
    return origin.startIndex().get(), origin.stopIndex().get() + 1


def _demanded(condition) -> Iterator[tuple]:
    if _kind(condition) == "And":
        yield from _demanded(condition.left())
        yield from _demanded(condition.right())
    elif _kind(condition) == "Not" and _kind(condition.child()) == "InSubquery":
        yield condition, condition.child()


def _made_of(expression, kinds: frozenset[str]) -> bool:
    return _kind(expression) in kinds and all(_made_of(c, kinds) for c in _items(expression.children()))


def _kinds(plan) -> set[str]:
    return {_kind(plan)}.union(*map(_kinds, _items(plan.children())))
