"""Database tables as a source."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.functions.kinds import normalise_nulls

URLS = {
    "MySQL": "jdbc:mysql://{host}:{port}/{database}",
    "PostgreSQL": "jdbc:postgresql://{host}:{port}/{database}",
    "SQLite": "jdbc:sqlite:{database}",
}
DEFAULT_PORTS = {"MySQL": 3306, "PostgreSQL": 5432}
_IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_$]*(\.[A-Za-z_][A-Za-z0-9_$]*){0,2}$")


def jdbc_url(db_type: str, database: str, host: str | None = None, port: int | None = None) -> str:
    if db_type not in URLS:
        raise ValueError(f"no driver is known for {db_type!r}")
    if db_type != "SQLite" and not host:
        raise ValueError(f"{db_type} needs a host")
    return URLS[db_type].format(host=host, port=port or DEFAULT_PORTS.get(db_type), database=database)


def checked_identifier(name: str) -> str:
    """A table or column name that can be put into a query; anything else is refused."""
    if not _IDENTIFIER.match(name):
        raise ValueError(f"not a table or column name: {name!r}")
    return name


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    num_partitions: int = 64,
    bounds: tuple | None = None,
    properties: dict[str, str] | None = None,
    fetch_size: int = 10_000,
) -> DataFrame:
    """A table, read in parallel slices of ``partition_column``; without one it comes through one task.

    The slice bounds are asked from the database unless given. They only place the slices: rows outside
    them are read too. Filters and column choices made on the result are pushed into the database.
    """
    options = {"url": url, "dbtable": checked_identifier(table), "fetchsize": str(fetch_size), **(properties or {})}
    if partition_column:
        name = checked_identifier(partition_column)
        if bounds is None:
            query = f"SELECT MIN({name}) AS low, MAX({name}) AS high FROM {checked_identifier(table)}"
            ends = {k: v for k, v in options.items() if k != "dbtable"}
            bounds = tuple(spark.read.format("jdbc").options(**ends, query=query).load().first())
        if bounds[0] is not None:
            options |= {
                "partitionColumn": name, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]),
                "numPartitions": str(num_partitions),
            }
    return normalise_nulls(spark.read.format("jdbc").options(**options).load())


def tables_query(db_type: str) -> str:
    if db_type == "SQLite":
        return "SELECT name AS table_name FROM sqlite_master WHERE type = 'table'"
    if db_type == "MySQL":
        return "SELECT table_name AS table_name FROM information_schema.tables WHERE table_schema = DATABASE()"
    return (
        "SELECT table_name FROM information_schema.tables "
        "WHERE table_schema NOT IN ('pg_catalog', 'information_schema')"
    )


def list_tables(
    spark: SparkSession, url: str | None = None, db_type: str = "PostgreSQL", database: str | None = None,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Table names of a database, or of the Spark catalog when no URL is given."""
    if url is None:
        names: Sequence = spark.catalog.listTables(database) if database else spark.catalog.listTables()
        return spark.createDataFrame([(t.name,) for t in names], "table_name string").orderBy("table_name")
    options = {"url": url, "query": tables_query(db_type), **(properties or {})}
    return spark.read.format("jdbc").options(**options).load().select(F.col("table_name")).orderBy("table_name")
