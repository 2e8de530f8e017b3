"""Read-only SQL for guests: what of a query's plan may run, what it may cost, how long and how many rows, and whose rows it sees.

A guest's text is parsed by Spark, never matched as text.  Its plan may hold only the
kinds of nodes in ``NODES`` and functions of the groups in ``GROUPS``; so commands,
scripts, files named as tables, Java calls and functions of users don't get in.  It is
analysed in a session of its own that has nothing but the guest's tables as views, and what the
analyser bound its names to is checked again: every leaf must lie under one of these views.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_CHARACTERS, MOST_ROWS, MOST_BYTES, MOST_SECONDS, CELL = 5000, 500, 1 << 40, 30.0, 8000
#: Plan nodes a query may have before it is analysed.
NODES = frozenset(
    """Project Filter UnresolvedHaving Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except Join LateralJoin SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation
    UnresolvedInlineTable OneRowRelation UnresolvedWith WithWindowDefinition Window Generate UnresolvedTableValuedFunction UnresolvedHint UnresolvedOrdinal Pivot Unpivot LocalRelation""".split()
)
#: Groups of built-in functions a query may call; the group of the others talks to the machine.
GROUPS = frozenset(
    "agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs date_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs sketch_funcs string_funcs struct_funcs url_funcs variant_funcs window_funcs".split()
)
TABLE_FUNCTIONS = frozenset("explode explode_outer inline inline_outer posexplode posexplode_outer stack json_tuple".split())
#: Columns that have a word index: matching them row by row is refused.
SEARCHED = frozenset("subject body_text from_addr to_addr filename extracted_text".split())


class Refused(ValueError):
    """Why a guest's query doesn't run."""


def _seq(found) -> Iterator:
    it = found.iterator()
    while it.hasNext():
        yield it.next()


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _walk(plan, see: Callable[[object], bool | None], see_expression: Callable[[object], None]) -> None:
    """Show every node and expression of a plan, those of subqueries and common tables too; a node for which ``see`` is true isn't entered."""
    plans = [plan]
    while plans:
        node = plans.pop()
        if see(node):
            continue
        plans += list(_seq(node.children()))
        if _name(node) == "UnresolvedWith":
            plans += [pair._2() for pair in _seq(node.cteRelations())]
        expressions = list(_seq(node.expressions()))
        while expressions:
            e = expressions.pop()
            see_expression(e)
            expressions += list(_seq(e.children()))
            if _name(e) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
                plans.append(e.plan())
            elif _name(e) == "InSubquery":
                expressions.append(e.query())


def _parsed(spark: SparkSession, sql: str | None):
    if not sql or not sql.strip():
        raise Refused("there is no query")
    if len(sql) > MOST_CHARACTERS:
        raise Refused(f"a query has at most {MOST_CHARACTERS} characters")
    state = spark._jsparkSession.sessionState()
    plan = state.sqlParser().parsePlan(sql.strip().rstrip(";"))
    registry, builder = state.functionRegistry(), spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier

    def node(p) -> None:
        kind = _name(p)
        if kind not in NODES:
            raise Refused(f"only queries are answered, not {kind}")
        if kind == "UnresolvedTableValuedFunction" and (".".join(_seq(p.name())).lower() not in TABLE_FUNCTIONS):
            raise Refused(f"table function {'.'.join(_seq(p.name()))} is not offered")
        if kind == "UnresolvedRelation" and p.multipartIdentifier().size() > 1:
            raise Refused(f"no table {'.'.join(_seq(p.multipartIdentifier()))}")

    def expression(e) -> None:
        kind = _name(e)
        if kind == "UnresolvedFunction":
            name = list(_seq(e.nameParts()))
            info = registry.lookupFunction(builder(name[0].lower())) if len(name) == 1 else None
            if info is None or info.isEmpty() or info.get().getGroup() not in GROUPS:
                raise Refused(f"function {'.'.join(name)} is not offered")
        if kind in ("Like", "ILike", "RLike", "UnresolvedLike") or kind.startswith(("LikeA", "NotLikeA")):
            left = next(_seq(e.children()))
            if _name(left) == "UnresolvedAttribute" and list(_seq(left.nameParts()))[-1].lower() in SEARCHED:
                raise Refused(f"{left.name()} is searched by its words, not row by row")

    _walk(plan, node, expression)
    return plan


def _rebound(df: DataFrame, session: SparkSession) -> DataFrame:
    """The same table in another session."""
    return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.queryExecution().analyzed()), session)


def query(spark: SparkSession, sql: str | None, tables: dict[str, DataFrame], user: str | None = None, shared: frozenset[str] = frozenset(), most_bytes: int = MOST_BYTES) -> DataFrame:
    """A guest's query as a table, checked and bound but not run.

    With ``user``, tables show only that user's rows; one without an owner has to be named in ``shared``.
    """
    guest = spark.newSession()
    _parsed(guest, sql)
    for name, df in tables.items():
        if user is not None and name not in shared:
            if "user_id" not in df.columns:
                raise Refused(f"table {name} has no owner")
            df = df.where(F.col("user_id") == user)
        _rebound(df, guest).createOrReplaceTempView(name)
    out = guest.sql(sql.strip().rstrip(";"))
    named = {t.lower() for t in tables}

    def bound(p) -> bool:
        kind = _name(p)
        if kind == "View" and p.isTempView() and p.desc().identifier().database().isEmpty() and p.desc().identifier().table().lower() in named:
            return True
        if p.children().isEmpty() and kind not in ("OneRowRelation", "LocalRelation", "CTERelationRef"):
            raise Refused("the query reads what is no table of yours")
        return False

    def own(e) -> None:
        if "UDF" in _name(e) or "Reflection" in _name(e) or _name(e) in ("Invoke", "StaticInvoke") and "catalyst.expressions" not in e.getClass().getName():
            raise Refused("the query calls what is not offered")

    _walk(out._jdf.queryExecution().analyzed(), bound, own)
    cost = planned_bytes(out)
    if cost > most_bytes:
        raise Refused(f"the query is estimated to handle {cost:,} bytes of at most {most_bytes:,}")
    return _rebound(out, spark)


def by_owner(df: DataFrame, path: str) -> DataFrame:
    """A table of ``user_id`` written once and read back: each tenant's query reads that tenant's rows and the columns it names, not the joins the table is made by."""
    df.sortWithinPartitions("user_id").write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def planned_bytes(df: DataFrame) -> int:
    """An estimate of the bytes a query handles: what it scans, and for joins without an equality each pair of rows."""

    def of(p) -> tuple[int, int]:
        """(bytes that come out, bytes handled below and here)"""
        below = [of(c) for c in _seq(p.children())]
        if not below:
            size = int(str(p.stats().sizeInBytes()))
            return size, size
        handled = sum(h for _, h in below)
        if _name(p) == "Join":
            (a, _), (b, _) = below
            condition = p.condition()
            pairs = [e for e in _seq(condition.get().collectLeaves())] if condition.isDefined() else []
            equal = bool(pairs) and ("=" in condition.get().sql() and any(x in _conjuncts(condition.get()) for x in ("EqualTo", "EqualNullSafe")))
            out = a + b if equal else a * b
            return out, handled + (0 if equal else out)
        return max(o for o, _ in below) if len(below) == 1 else sum(o for o, _ in below), handled

    return of(df._jdf.queryExecution().optimizedPlan())[1]


def _conjuncts(condition) -> list[str]:
    """The kinds of a condition's parts that all have to hold."""
    if _name(condition) == "And":
        return [x for c in _seq(condition.children()) for x in _conjuncts(c)]
    return [_name(condition)]


@dataclass
class Answer:
    columns: list[str]
    rows: list[tuple]
    truncated: bool
    error: str | None = None


def answer(
    spark: SparkSession, sql: str | None, tables: dict[str, DataFrame], user: str | None = None, shared: frozenset[str] = frozenset(), most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, seconds: float = MOST_SECONDS
) -> Answer:
    """At most ``most_rows`` rows of a guest's query within ``seconds``; what is refused or fails is the answer's error."""
    tag, late, context = f"guest-{uuid.uuid4().hex}", threading.Event(), spark.sparkContext

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    try:
        out = query(spark, sql, tables, user, shared, most_bytes)
        context.addJobTag(tag)
        timer.start()
        found = out.limit(most_rows + 1).collect()
    except Exception as e:  # the item's error is its answer
        return Answer([], [], False, f"stopped after {seconds:g} seconds" if late.is_set() else next(iter(str(e).strip().splitlines()), type(e).__name__))
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    rows = [tuple(_shown(v) for v in r) for r in found[:most_rows]]
    return Answer(out.columns, rows, len(found) > most_rows)


def _shown(value: object) -> object:
    if isinstance(value, bytes | bytearray):
        return f"<blob {len(value)} bytes>"
    return clip(value) if isinstance(value, str) else value


def answers(spark: SparkSession, queries: list[str], tables: dict[str, DataFrame], user: str | None = None, most: int = 100) -> list[Answer]:
    """Many queries at once; one that fails doesn't take the others with it."""
    if len(queries) > most:
        return [Answer([], [], False, f"at most {most} queries")]
    return [answer(spark, sql, tables, user) for sql in queries]


# fixed values: the mark of a text that was cut, and how many characters are kept for it
CUT_MARK, MARK_ROOM = "… [truncated: original {} chars]", 32


def clip(text: str, most: int = CELL) -> str:
    return text if len(text) <= most else text[: most - MARK_ROOM] + CUT_MARK.format(len(text))


def clipped(text: Column, most: int = CELL) -> Column:
    """A text of more than ``most`` characters ends in a mark with its length."""
    before, after = CUT_MARK.split("{}")
    mark = F.concat(F.lit(before), F.length(text).cast("string"), F.lit(after))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - MARK_ROOM), mark)).otherwise(text)


def clipped_cells(df: DataFrame, most: int = CELL) -> DataFrame:
    """Long texts shortened, each column as it was otherwise."""
    return df.select(*(clipped(F.col(c), most).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def detail(df: DataFrame, level: str, id: str, subject: str, body: str, snippet: int = 200, summary: str | None = None) -> DataFrame:
    """A result as references, with snippets, with summaries (a snippet where there is none), or in full."""
    if level == "refs":
        return df.select(F.concat(F.col(id), F.lit(" "), F.coalesce(F.col(subject), F.lit(""))).alias("ref"))
    short = F.substring(body, 1, snippet)
    if level == "snippet":
        return df.select(id, subject, short.alias("snippet"))
    if level == "summary":
        return df.select(id, subject, F.coalesce(F.col(summary), short).alias("summary"))
    return df.select(id, subject, body)


def first_matches(df: DataFrame, matches: str, most: int) -> DataFrame:
    """``df`` with at most ``most`` of an array's items and whether some were left out."""
    return df.withColumn("matches_truncated", F.size(matches) > most).withColumn(matches, F.slice(matches, 1, most))


def documented(tables: dict[str, DataFrame], docs: dict[str, set[str]]) -> list[str]:
    """Columns that are documented but missing, or there but undocumented."""
    there = {f"{t}.{c}" for t, df in tables.items() for c in df.columns}
    told = {f"{t}.{c}" for t, columns in docs.items() for c in columns}
    return sorted(there ^ told)
