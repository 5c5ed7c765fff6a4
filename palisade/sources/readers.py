"""Spark readers for every source type. Credentials become reader options, never columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from palisade.sources.config import resolve_env

# Ports a database listens on unless told otherwise.
DEFAULT_PORTS = {"postgresql": 5432, "mysql": 3306, "mariadb": 3306}
FETCH_SIZE = "10000"


@dataclass(frozen=True)
class Split:
    """How to cut a database scan into parallel range scans. Without bounds, ``bounded`` asks
    the database for the least and the greatest value first, and the ranges are equally wide. With ``depth`` it is asked for
    the values that part its rows equally, so that no task has most of them; only a value that many rows share stays whole."""

    column: str
    parts: int
    lower: str | None = None
    upper: str | None = None
    depth: bool = False


def reader_options(source: Mapping, table: str | None = None, query: str | None = None, split: Split | None = None):
    """(format, options) of ``spark.read`` for one source definition."""
    kind, conn = source["type"], source["connection"]
    creds = {k: resolve_env(v) if isinstance(v, str) else v for k, v in source.get("credentials", {}).items()}
    if kind == "bigquery":
        # a query is run and landed by the service; a table is read directly
        target = {"query": query} if query else {"table": table}
        return "bigquery", {"parentProject": conn["project"], **target}
    if kind == "spanner":
        return "cloud-spanner", {
            "projectId": conn["project"],
            "instanceId": conn["instance"],
            "databaseId": conn["database"],
            "table": table,
        }
    if kind == "rest":
        # one landed folder per table
        return "json", {"multiLine": "true", "path": f"{conn['url'].rstrip('/')}/{table}" if table else conn["url"]}
    options = {
        "url": _jdbc_url(kind, conn, creds),
        "user": creds.get("username"),
        "password": creds.get("password"),
        "fetchsize": FETCH_SIZE,
    }
    # range scans need dbtable; a bare query cannot be split
    options["dbtable"] = f"({query}) AS src" if query else table
    if split:
        options |= {
            "partitionColumn": split.column,
            "lowerBound": split.lower,
            "upperBound": split.upper,
            "numPartitions": str(split.parts),
        }
    return "jdbc", {k: v for k, v in options.items() if v is not None}


def _jdbc_url(kind: str, conn: Mapping, creds: Mapping) -> str:
    database = conn.get("database") or creds.get("database") or ""
    if kind == "cloud-sql-postgres":
        return f"jdbc:postgresql:///{database}?{_cloud_socket(conn, 'postgres')}"
    if kind == "cloud-sql-mysql":
        return f"jdbc:mysql:///{database}?{_cloud_socket(conn, 'mysql')}"
    if kind == "alloydb" and conn.get("instance"):
        return f"jdbc:postgresql:///{database}?{_alloy_socket(conn)}"
    driver = {"postgres": "postgresql", "alloydb": "postgresql", "mysql": "mysql", "mariadb": "mariadb"}[kind]
    host = conn.get("host") or creds.get("host") or "localhost"
    return f"jdbc:{driver}://{host}:{conn.get('port') or DEFAULT_PORTS[driver]}/{database}"


def _cloud_socket(conn: Mapping, engine: str) -> str:
    name = f"{conn['project']}:{conn['region']}:{conn['instance']}"
    return f"cloudSqlInstance={name}&socketFactory=com.google.cloud.sql.{engine}.SocketFactory"


def _alloy_socket(conn: Mapping) -> str:
    place = f"projects/{conn['project']}/locations/{conn['region']}"
    return (
        f"alloydbInstanceName={place}/clusters/{conn.get('cluster', 'default')}/instances/{conn['instance']}"
        "&socketFactory=com.google.cloud.alloydb.SocketFactory"
    )


def bounds_query(table: str, column: str) -> str:
    return f"SELECT min({column}) AS lower_bound, max({column}) AS upper_bound FROM {table}"


def bounded(spark: SparkSession, source: Mapping, table: str, split: Split) -> Split | None:
    """The split with bounds; None for an empty table."""
    if split.lower is not None and split.upper is not None:
        return split
    least, most = read_source(spark, source, query=bounds_query(table, split.column)).first()
    return None if least is None else replace(split, lower=str(least), upper=str(most))


def cuts_query(table: str, column: str, parts: int) -> str:
    """The greatest value of each of ``parts`` equal shares of the rows, but for the last share: fewer than ``parts`` rows."""
    shares = f"SELECT {column} AS cut, ntile({parts}) OVER (ORDER BY {column}) AS share FROM {table} WHERE {column} IS NOT NULL"
    return f"SELECT max(cut) AS cut FROM ({shares}) AS shares WHERE share < {parts} GROUP BY share"


def _literal(value) -> str:
    if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def predicates(column: str, cuts: Iterable) -> list[str]:
    """One condition for each part; every row meets exactly one, those without a value the first."""
    cuts = sorted(set(cuts))
    if not cuts:
        return ["1 = 1"]
    texts = [_literal(c) for c in cuts]
    first = f"({column} <= {texts[0]} OR {column} IS NULL)"
    between = [f"({column} > {a} AND {column} <= {b})" for a, b in zip(texts, texts[1:], strict=False)]
    return [first, *between, f"{column} > {texts[-1]}"]


def read_by_depth(spark: SparkSession, source: Mapping, table: str, split: Split) -> DataFrame:
    """A database table read in parts of about as many rows each."""
    cuts = [r["cut"] for r in read_source(spark, source, query=cuts_query(table, split.column, split.parts)).collect()]
    _, options = reader_options(source, table)
    url, name = options.pop("url"), options.pop("dbtable")
    return spark.read.jdbc(url, name, predicates=predicates(split.column, cuts), properties=options)


def read_source(spark: SparkSession, source: Mapping, table=None, query=None, split: Split | None = None) -> DataFrame:
    """A database table is read in as many tasks as its split has parts, in one without a split."""
    if split and table and split.depth and reader_options(source, table)[0] == "jdbc":
        return read_by_depth(spark, source, table, split)
    if split and table:
        split = bounded(spark, source, table, split)
    fmt, options = reader_options(source, table, query, split)
    return spark.read.format(fmt).options(**options).load()


def read_landed_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Landed REST payloads, one per file: a JSON array gives its items, an object one row."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)
