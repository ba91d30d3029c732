"""Role-scoped tables: which tables a role may read, which rows of them, and whether personal
values are hidden.

A row filter is part of the scoped table's plan, so it applies before any join or aggregate
of the caller, and Catalyst moves it into the scan. Filters read their parent tables with the
rights of the lakehouse, not of the role.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchstone.functions.text import json_document
from touchstone.operators import profiling
from touchstone.operators.copies import keys
from touchstone.plans.lakehouse import TABLES, Lakehouse
from touchstone.session import isolated

ROLE_SETTING = "touchstone.role"
DEFAULT_ROLE = "analyst"
MAX_ROWS = 200
DESCRIBE = re.compile(r"\s*DESC(?:RIBE)?\s+(?:TABLE\s+)?`?(\w+)`?\s*;?\s*", re.I)
EXPLAIN = re.compile(r"\s*EXPLAIN\s+(?:EXTENDED\s+|FORMATTED\s+)?(.+)", re.I | re.S)


class AccessError(RuntimeError):
    """A role asked for something it may not have."""


class QueryError(RuntimeError):
    """A statement that is not a readable query over the role's tables."""


@dataclass(frozen=True)
class Grant:
    """A row of the role table: a role may read the rows of a table that meet a condition.

    With a path of (key, parent), the condition is on the last parent, and a row is read if its
    key is among the rows of the parent that are reached.
    """

    role: str
    table_name: str
    condition: str = "true"
    path: tuple[tuple[str, str], ...] = ()

    @property
    def covers_all(self) -> bool:
        return self.condition == "true" and not self.path


IN_LONDON, LANDED_IN_LONDON = "city = 'London'", "upper(trim(city)) = 'LONDON'"
BY_CUSTOMER = ("customer_id", "silver_customers")

# The roles, their tables and their rows, and the roles that see personal values.
GRANTS = [
    *[Grant("analyst", name) for name in TABLES],
    *[Grant("dq_auditor", name) for name in TABLES],
    Grant("branch_ops_london", "silver_customers", IN_LONDON),
    Grant("branch_ops_london", "silver_accounts", IN_LONDON, (BY_CUSTOMER,)),
    Grant("branch_ops_london", "silver_transactions", IN_LONDON, (("account_id", "silver_accounts"), BY_CUSTOMER)),
    # No rejected account has a silver customer, so its city is looked up in bronze.
    Grant("branch_ops_london", "silver_accounts_rejected", LANDED_IN_LONDON, (("customer_id", "bronze_customers"),)),
    Grant("branch_ops_london", "silver_customers_rejected", LANDED_IN_LONDON),
    Grant("branch_ops_london", "gold_customer_360", IN_LONDON),
]
REVEALING = {"dq_auditor"}


def role_table(spark: SparkSession, grants: Iterable[Grant] = GRANTS) -> DataFrame:
    """The grants as a table: role, table_name, condition, path, reveals."""
    rows = [(g.role, g.table_name, g.condition, list(g.path), g.role in REVEALING) for g in grants]
    path = "path ARRAY<STRUCT<key: STRING, parent: STRING>>"
    return spark.createDataFrame(rows, f"role STRING, table_name STRING, condition STRING, {path}, reveals BOOLEAN")


class Access:
    """The grants of one role by table."""

    def __init__(self, role: str, grants: Sequence[Grant] = GRANTS, reveals: bool | None = None) -> None:
        self.role = role
        self.reveals = role in REVEALING if reveals is None else reveals
        self.grants = {grant.table_name: grant for grant in grants if grant.role == role}
        if not self.grants:
            raise AccessError(f"unknown role {role}; known roles: {', '.join(sorted({g.role for g in grants}))}")

    def to(self, *tables: str) -> list[Grant]:
        """The grants to some tables; an error names all tables that there is none for."""
        if refused := sorted({*tables} - self.grants.keys()):
            raise AccessError(f"role {self.role} may not read {', '.join(refused)}")
        return [self.grants[table] for table in tables]


def access_from(table: DataFrame, role: str) -> Access:
    """What a role table grants a role. It has one row for each table the role may read; a role that one of its
    rows lets see personal values sees them."""
    rows = table.filter(F.col("role") == role).collect()
    grants = [
        Grant(r["role"], r["table_name"], r["condition"] or "true", tuple((p["key"], p["parent"]) for p in r["path"] or []))
        for r in rows
    ]
    known = grants or [Grant(r["role"], "") for r in table.select("role").distinct().collect()]
    return Access(role, known, any(r["reveals"] for r in rows))


ROLES = {name: Access(name) for name in dict.fromkeys(grant.role for grant in GRANTS)}


def current_role(spark: SparkSession) -> Access:
    """The role that whoever started the session has set; a query cannot change it."""
    return Access(spark.conf.get(ROLE_SETTING, DEFAULT_ROLE))


def granted_rows(df: DataFrame, grant: Grant, lake: Lakehouse) -> DataFrame:
    """The rows of a table that a grant covers, by way of the parents on its path."""
    chain = [df, *[lake[parent] for _, parent in grant.path]]
    rows = chain.pop().filter(grant.condition)
    for key, _ in reversed(grant.path):
        child = chain.pop()
        rows = child.join(keys(rows, key), key, "left_semi").select(*child.columns)
    return rows


# What a query's plan may consist of besides the role's views: rows it makes up itself, and names in it.
OWN_ROWS = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef"}
FOREIGN_CODE = {"CallMethodViaReflection", "TryReflect"}


def _require_scope(plan, names: set[str]) -> None:
    """Refuse an analysed plan that reads anything but the role's views, or calls into the JVM."""
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "View":
            view = node.desc().identifier()
            if view.table() not in names or view.database().isDefined() or view.catalog().isDefined():
                raise AccessError(f"{view.unquotedString()} is not in scope")
            continue
        expressions = _listed(node.expressions())
        while expressions:
            expression = expressions.pop()
            if expression.getClass().getSimpleName() in FOREIGN_CODE:
                raise AccessError("calls into the JVM are not in scope")
            expressions += _listed(expression.children())
        inner = _listed(node.children()) + _listed(node.innerChildren()) + _listed(node.subqueries())
        if not inner and kind.rstrip("$") not in OWN_ROWS:
            raise AccessError("only the tables of the role are in scope, not saved tables or files")
        nodes += inner


def _listed(sequence) -> list:
    """A sequence of the JVM as a list; a node may list itself with others that are not plans or expressions."""
    return [sequence.apply(i) for i in range(sequence.size())]


class ScopedCatalog:
    """What one role sees of a lakehouse."""

    def __init__(self, lake: Lakehouse, role: Access) -> None:
        self.lake = lake
        self.role = role

    @property
    def names(self) -> list[str]:
        return [name for name in TABLES if name in self.role.grants]

    def table(self, name: str, masked: bool = False) -> DataFrame:
        """The role's rows of a table; with `masked`, personal columns hidden as its rights say."""
        (grant,) = self.role.to(name)
        df = granted_rows(self._unfiltered(grant), grant, self.lake)
        return profiling.hide_personal(df) if masked and not self.role.reveals else df

    def _unfiltered(self, grant: Grant) -> DataFrame:
        """A path through the accounts makes the account check of the transactions unneeded."""
        if grant.table_name == "silver_transactions" and ("account_id", "silver_accounts") in grant.path:
            return self.lake.conformed_transactions
        return self.lake[grant.table_name]

    def listing(self, owners: Mapping[str, str], unowned: str) -> DataFrame:
        """The role's tables with layer, owner and the number of rows it can see.

        A table that the role sees whole has the rows that its build counted.
        """
        whole = [name for name in self.names if self.role.grants[name].covers_all]
        counts = [self.lake.row_counts(whole)] if whole else []
        counts += [
            self.table(name).selectExpr(f"'{name}' AS table_name", "count(*) AS n_rows")
            for name in self.names
            if name not in whole
        ]
        owner = F.create_map(*[F.lit(x) for name in self.names for x in (name, profiling.owner_of(name, owners, unowned))])
        return reduce(DataFrame.unionByName, counts).select(
            "table_name", F.substring_index("table_name", "_", 1).alias("layer"), owner[F.col("table_name")].alias("owner"), "n_rows"
        )

    def profile(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        """The profile of the role's rows; personal values are masked unless it may see them."""
        df = self.table(name)
        return profiling.profile(df.select(*columns) if columns else df, name, mask=not self.role.reveals)

    def query(self, statement: str) -> DataFrame:
        """Run one read statement on the role's rows: a query, DESCRIBE of a table, or EXPLAIN of a query.

        The statement runs in a session of its own that holds only the role's tables as views, and
        its plan must consist of them: global views, saved tables and other catalogs are found
        there whatever they are called. Inside the parentheses of a FROM clause Spark accepts a
        query and nothing else.
        """
        if described := DESCRIBE.fullmatch(statement):
            name = described[1].lower()
            self.role.to(name)
            return self.describe(name)
        if explained := EXPLAIN.fullmatch(statement):
            return self.lake.spark.createDataFrame([(self.explain(explained[1]),)], "plan STRING")
        return self._scoped(statement)[2]

    def _scoped(self, statement: str) -> tuple[SparkSession, str, DataFrame]:
        child, text = self._prepared(statement)
        try:
            result = child.sql(text)
        except (AnalysisException, ParseException) as error:
            raise QueryError(f"not a query over your tables: {error}") from error
        _require_scope(result._jdf.queryExecution().analyzed(), {*self.names})
        return child, text, result

    def _prepared(self, statement: str) -> tuple[SparkSession, str]:
        """A session with the role's views that a statement names, and the statement as a subquery."""
        text = statement.strip().rstrip(";")
        child = isolated(self.lake.spark)
        scoped = ScopedCatalog(self.lake.in_session(child), self.role)
        named = [name for name in TABLES if re.search(rf"\b{name}\b", text, re.I)]
        self.role.to(*named)
        for name in named:
            scoped.table(name).createOrReplaceTempView(name)
        return child, f"SELECT * FROM (\n{text}\n) AS result"

    def explain(self, statement: str) -> str:
        """The plan of a statement, with the row filters it runs under."""
        child, text, _ = self._scoped(statement)
        return child.sql(f"EXPLAIN FORMATTED {text}").first()[0]

    def fetch(self, statement: str) -> dict:
        """At most 200 rows of a statement as JSON-safe records, and whether there were more."""
        result = self.query(statement).limit(MAX_ROWS + 1)
        documents = [row[0] for row in result.select(json_document(result.schema)).collect()]
        return {
            "columns": result.columns,
            "rows": documents[:MAX_ROWS],
            "truncated": len(documents) > MAX_ROWS,
        }

    def describe(self, name: str) -> DataFrame:
        """Columns, types and filled values of the role's rows of a table."""
        return profiling.column_listing({name: self.table(name)})

    def contract_columns(self, columns: DataFrame, table_column: str = "contract_id") -> DataFrame:
        """The columns of the contracts of tables the role may read."""
        return columns.filter(F.col(table_column).isin(sorted(self.role.grants)))
