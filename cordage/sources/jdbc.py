"""Tables of an operational database: read by ranges of their key in parallel, written through a stage table so that a rerun task adds nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

FETCH = 10_000


def read_rows(spark: SparkSession, url: str, table: str, key: str, parts: int = 8, **options: str) -> DataFrame:
    """The table, a connection for each of ``parts`` ranges of ``key``; filters and columns go into the database's queries.

    Ranges of numbers and times lie evenly between the key's least and greatest value, which the database tells. Keys of text are cut
    evenly by two leading hexadecimal digits, as UUIDs have them. Every row is in one range whatever its key: the first takes those below
    and without a key, the last those above.
    """
    whole = spark.read.format("jdbc").options(url=url, fetchsize=FETCH, **options)
    kind = next(f.dataType for f in whole.option("dbtable", table).load().schema if f.name.lower() == key.lower())
    if not isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)):
        return spark.read.options(fetchsize=FETCH).jdbc(url, table, predicates=hex_ranges(key, parts), properties=options)
    low, high = spark.read.format("jdbc").options(url=url, query=f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {table}", **options).load().first()
    if low is None or low == high:
        return whole.option("dbtable", table).load()
    return whole.options(dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=parts).load()


def hex_ranges(key: str, parts: int) -> list[str]:
    """Conditions, one of which holds for each row."""
    edges = sorted({f"{256 * k // parts:02x}" for k in range(1, min(parts, 256))})
    if not edges:
        return ["1 = 1"]
    between = [f"{key} >= '{a}' AND {key} < '{b}'" for a, b in zip(edges, edges[1:])]
    return [f"{key} < '{edges[0]}' OR {key} IS NULL", *between, f"{key} >= '{edges[-1]}'"]


def write_rows(df: DataFrame, url: str, table: str, key: str, parts: int = 8, batch: int = 5_000, **options: str) -> None:
    """Put ``df``'s rows into an existing table by ``key``: a row with a key that is there replaces it. All or none become visible.

    Tasks, ``parts`` at most at a time, write batches to a stage table of the same columns; then one transaction moves the stage's
    different rows over. So a task that Spark runs again after its rows were committed repeats nothing. ``df`` has each key once.
    """
    spark = df.sparkSession
    stage, columns = f"{table}_{uuid.uuid4().hex[:12]}", ", ".join(df.columns)
    _execute(spark, url, options, f"CREATE TABLE {stage} AS SELECT {columns} FROM {table} WITH NO DATA")
    try:
        df.write.format("jdbc").options(url=url, dbtable=stage, batchsize=batch, numPartitions=parts, **options).mode("append").save()
        move = f"INSERT INTO {table} ({columns}) SELECT DISTINCT {columns} FROM {stage}"
        _execute(spark, url, options, f"DELETE FROM {table} WHERE {key} IN (SELECT {key} FROM {stage})", move)
    finally:
        _execute(spark, url, options, f"DROP TABLE {stage}")


def _execute(spark: SparkSession, url: str, options: dict[str, str], *statements: str) -> None:
    """Statements in one transaction."""
    jvm = spark.sparkContext._jvm
    settings = jvm.java.util.Properties()
    for name, value in options.items():
        settings.setProperty(name, value)
    driver = options.get("driver") or jvm.java.sql.DriverManager.getDriver(url).getClass().getName()
    jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
    connection = jvm.java.sql.DriverManager.getConnection(url, settings)
    try:
        connection.setAutoCommit(False)
        for text in statements:
            connection.createStatement().execute(text)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()
