"""Ad-hoc read-only SQL over registered views, and the canned collections of the product surface."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SQL_BYTES = 64 * 1024
MAX_RESULT_BYTES = 8 * 1024 * 1024
TIMEOUT_S = 15.0
#: Functions that reach out of the data: they call any code of the JVM.
REFUSED_FUNCTIONS = frozenset(("java_method", "reflect", "try_reflect"))
#: Nodes of a parsed plan that only read; whatever else there is, is refused.
PLANS = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Except Intersect Join LateralJoin SubqueryAlias UnresolvedWith OneRowRelation LocalRelation "
    "Generate WithWindowDefinition Pivot Unpivot Sample PipeOperator UnresolvedHint".split()
)
ANALYSIS = frozenset(
    "UnresolvedAttribute UnresolvedAlias UnresolvedFunction UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedRelation UnresolvedHaving UnresolvedInlineTable UnresolvedTableValuedFunction "
    "UnresolvedTVFAliases UnresolvedSubqueryColumnAliases UnresolvedOrdinal UnresolvedExtractValue UnresolvedRegex UnresolvedWindowExpression UnresolvedGenerator MultiAlias".split()
)
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())


class Refused(ValueError):
    """The text isn't one read-only statement of bounded size over registered views."""


def _nodes(tree: object) -> Iterator[dict]:
    """All nodes of a plan's JSON form, those of expressions and subqueries too."""
    waiting = [tree]
    while waiting:
        at = waiting.pop()
        if isinstance(at, dict):
            if "class" in at:
                yield at
            waiting += at.values()
        elif isinstance(at, list):
            waiting += at


def _last(name: str) -> str:
    """The last part of a name as plans print it: [a, b, c]."""
    return name.strip("[]").rsplit(", ", 1)[-1].lower()


def checked(spark: SparkSession, text: str) -> str:
    """The statement without its closing semicolon, if it may run.

    It is parsed, not run.  A plan with a node that isn't known to read only, that reads anything but temporary views and
    its own common table expressions, or that calls a function that leaves the data, is refused.
    """
    if len(text.encode()) > MAX_SQL_BYTES:
        raise Refused("the statement is too long")
    statement = text.strip().removesuffix(";").strip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except ParseException as e:
        raise Refused("the statement can't be parsed as one query") from e
    nodes = list(_nodes(json.loads(plan.toJSON())))
    known = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    for node in nodes:
        package, _, name = node["class"].rpartition(".")
        if package.endswith(".plans.logical") and name not in PLANS or package.endswith(".catalyst.analysis") and name not in ANALYSIS or ".execution" in package:
            raise Refused(f"not read-only: {name}")
        if name == "UnresolvedWith":
            known |= {each["_1"].lower() for each in node["cteRelations"]}
    for node in nodes:
        name = node["class"].rpartition(".")[2]
        if name == "UnresolvedRelation" and node["multipartIdentifier"].strip("[]").lower() not in known:
            raise Refused(f"no registered view: {node['multipartIdentifier']}")
        if name == "UnresolvedFunction" and _last(node["nameParts"]) in REFUSED_FUNCTIONS:
            raise Refused(f"not allowed: {node['nameParts']}")
        if name == "UnresolvedTableValuedFunction" and _last(node["name"]) not in TABLE_FUNCTIONS:
            raise Refused(f"not allowed: {node['name']}")
    return statement


def read_only(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(checked(spark, text))


def as_csv(spark: SparkSession, text: str, timeout: float = TIMEOUT_S, limit: int = MAX_RESULT_BYTES) -> str:
    """The statement's result as CSV; too slow or too large a result is refused as a whole."""
    df = read_only(spark, text)
    group, context = uuid.uuid4().hex, spark.sparkContext
    line = F.concat_ws(",", *[F.concat(F.lit('"'), F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), '"', '""'), F.lit('"')) for c in df.columns])
    timer = threading.Timer(timeout, lambda: context.cancelJobGroup(group))
    context.setJobGroup(group, "ad-hoc statement", interruptOnCancel=True)
    timer.start()
    try:
        out, size = [",".join(df.columns)], 0
        for row in df.select(line.alias("line")).toLocalIterator():
            size += len(row["line"].encode()) + 1
            if size > limit:
                raise Refused("the result is too large")
            out.append(row["line"])
        return "\n".join(out) + "\n"
    finally:
        timer.cancel()


def collection(rows: DataFrame, key: str, limit: int = 25, wanted: str | None = None) -> DataFrame:
    """A page of a collection by key, of 1 to 1000 rows, or the one row that is ``wanted``."""
    if not 1 <= limit <= 1000:
        raise Refused("a page has 1 to 1000 rows")
    return (rows.filter(F.col(key).cast("string") == wanted) if wanted is not None else rows).orderBy(key).limit(limit)
