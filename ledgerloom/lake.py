"""A set of named tables that hands out only the columns a query asks for."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import scratch

def settled(frame: DataFrame, name: str = "table", rebalance: bool = True) -> DataFrame:
    """Write a frame to a fresh folder below the shared one and return the written copy."""
    path = scratch(frame.sparkSession, name)
    # Rebalanced, so that files are of even size however the rows were spread.
    (frame.hint("rebalance") if rebalance else frame).write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


Builder = Callable[["Lake", "set[str] | None"], DataFrame]


class Lake:
    """Maps a table name to a DataFrame, or to a builder called with the wanted columns.

    A stored table is simply projected. A derived table receives the wanted column set, so a
    fact builder can leave out every dimension join none of whose columns are read. Catalyst
    cannot do that by itself: it does not know that the dimension key is unique.
    """

    def __init__(self, tables: Mapping[str, DataFrame | Builder]):
        self._tables = dict(tables)

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def __getitem__(self, name: str) -> DataFrame:
        entry = self._tables[name]
        return entry if isinstance(entry, DataFrame) else entry(self, None)

    def pick(self, name: str, *columns: str, **renamed: str) -> DataFrame:
        """The given columns; keyword arguments name a column `new="old"`."""
        entry = self._tables[name]
        frame = entry if isinstance(entry, DataFrame) else entry(self, {*columns, *renamed.values()})
        return frame.select(*columns, *[F.col(old).alias(new) for new, old in renamed.items()])

    def extend(self, tables: Mapping[str, DataFrame | Builder]) -> "Lake":
        return Lake({**self._tables, **tables})

    def settle(self, *names: str) -> "Lake":
        """Write the named tables to the shared folder and use the written copies from here on.

        For tables a query reads several times: they are computed once, and a lost executor
        costs a re-read instead of a second derivation.
        """
        return self.extend({name: settled(self[name], name) for name in names})

    def names(self) -> list[str]:
        return list(self._tables)

    @classmethod
    def stored(cls, spark: SparkSession, paths: Mapping[str, str]) -> "Lake":
        return cls({name: spark.read.parquet(path) for name, path in paths.items()})
