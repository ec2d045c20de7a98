"""Registration of queries with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.scalars import rounded

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def presentable(df: DataFrame) -> DataFrame:
    """Doubles at four decimals, whole numbers as long, timestamps as text."""

    def shown(field: T.StructField) -> Column:
        value = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = rounded(value)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            value = value.cast("long")
        elif isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            value = F.substring(value.cast("string"), 1, 19)
        return value.alias(field.name)

    return df.select(*[shown(f) for f in df.schema.fields])


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register ``build`` under ``name``; its result is made presentable."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: presentable(build(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def r4(*columns: str) -> str:
    """SQL list of doubles at four decimals; an entry is ``name`` or ``expression AS name``."""
    parts = []
    for column in columns:
        expression, _, name = column.rpartition(" AS ")
        parts.append(f"floor(({expression or name}) * 10000 + 0.5) / 10000 AS {name}")
    return ", ".join(parts)


def when(column: str) -> str:
    """SQL text of a timestamp."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {column}"


class Blocks:
    """Named SQL building blocks and what each one needs."""

    def __init__(self) -> None:
        self._needs: dict[str, tuple[str, ...]] = {}
        self._sql: dict[str, str] = {}

    def add(self, name: str, sql: str, needs: Iterable[str] = ()) -> None:
        self._needs[name] = tuple(needs)
        self._sql[name] = sql

    def _ordered(self, names: Iterable[str], done: dict[str, None]) -> None:
        for name in names:
            if name not in done:
                self._ordered(self._needs[name], done)
                done[name] = None

    def sql(self, body: str, *names: str) -> str:
        """``body`` preceded by the blocks it names and all they need."""
        done: dict[str, None] = {}
        self._ordered(names, done)
        parts = ",\n".join(f"{n} AS MATERIALIZED ({self._sql[n]})" for n in done)
        return f"WITH {parts}\n{body}"
