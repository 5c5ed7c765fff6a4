"""Named sources: each maps a table name to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.functions.redaction import CREDENTIAL_SECRETS, redact_frame
from palisade.session import materialise
from palisade.sources.config import checked_source
from palisade.sources.policy import FLAG, SCHEMAS, TEXT, local_frame, source_row, struct
from palisade.sources.readers import Split, read_source
from palisade.sources.snapshots import SnapshotTable

Loader = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Source name to loader. Loaders are the plug-in point for any Spark data source."""

    def __init__(self):
        self._loaders: dict[str, Loader] = {}
        self._tables: dict[str, tuple[str, ...]] = {}
        self._sources: dict[str, dict] = {}

    def add(self, name: str, loader: Loader, tables: Iterable[str] = (), kind: str = "files") -> Registry:
        if name in self._loaders:
            raise ValueError(f"Duplicate source name: {name}")
        self._loaders[name] = loader
        self._tables[name] = tuple(tables)
        self._sources[name] = {"name": name, "type": kind, "connection": {}}
        return self

    def add_files(self, name: str, folder: str, tables: Iterable[str], fmt: str = "parquet", **options) -> Registry:
        """One file or folder per table: ``<folder>/<table>.<fmt>``."""

        def load(spark: SparkSession, table: str) -> DataFrame:
            return spark.read.format(fmt).options(**options).load(f"{folder}/{table}.{fmt}")

        return self.add(name, load, tables, fmt)

    def add_snapshots(self, name: str, folder: str, tables: Iterable[str]) -> Registry:
        """Tables of versions (``SnapshotTable``), each under ``<folder>/<table>``, read as they are when they are asked for."""
        return self.add(name, lambda spark, table: SnapshotTable(spark, f"{folder}/{table}").read(), tables, "snapshots")

    def add_source(
        self, raw: Mapping, tables: Iterable[str] = (), splits: Mapping[str, Split] | None = None
    ) -> Registry:
        """A source definition of the configuration (database, warehouse or landed REST).
        ``splits`` says, table by table, how a database scan is cut into parallel ones."""
        source, cuts = checked_source(raw), dict(splits or {})

        def load(spark: SparkSession, table: str) -> DataFrame:
            return read_source(spark, source, table, split=cuts.get(table))

        self.add(source["name"], load, tables, source["type"])
        self._sources[source["name"]] = source
        return self

    def names(self) -> list[str]:
        return list(self._loaders)

    def tables(self, name: str) -> tuple[str, ...]:
        return self._tables.get(name, ())

    def load(self, spark: SparkSession, name: str, table: str) -> DataFrame:
        if name not in self._loaders:
            raise KeyError(f"Unknown source: {name}. Available: {', '.join(self._loaders)}")
        return self._loaders[name](spark, table)

    def listing(self, spark: SparkSession) -> DataFrame:
        """All sources, without any secret."""
        rows = [source_row(i, s) for i, s in enumerate(self._sources.values())]
        return local_frame(spark, rows, SCHEMAS["sources"])

    def probe(self, spark: SparkSession) -> DataFrame:
        """(source, table, reachable, error): one job asks every listed table for one row. If it fails, each half of the
        tables is asked again, down to those that cannot be read."""
        schema = struct(source=TEXT, table=TEXT, reachable=FLAG, error=TEXT)

        def failed(listed: tuple[str, str], err: Exception) -> DataFrame:
            error = next(iter(str(err).splitlines()), type(err).__name__)
            return local_frame(spark, [{"source": listed[0], "table": listed[1], "reachable": False, "error": error}], schema)

        def answers(asked: list[tuple[tuple[str, str], DataFrame]]) -> list[DataFrame]:
            if not asked:
                return []
            rows = [
                df.limit(1).agg(F.count("*")).select(
                    F.lit(source).alias("source"), F.lit(table).alias("table"), F.lit(True).alias("reachable"), F.lit(None).cast("string").alias("error")
                )
                for (source, table), df in asked
            ]
            try:
                return [materialise(reduce(DataFrame.unionAll, rows), "probe")]
            except Exception as err:
                half = len(asked) // 2
                return answers(asked[:half]) + answers(asked[half:]) if half else [failed(asked[0][0], err)]

        found, out = [], [local_frame(spark, [], schema)]
        for listed in [(name, table) for name in self._loaders for table in self.tables(name)]:
            try:
                found.append((listed, self.load(spark, *listed)))
            except Exception as err:
                out.append(failed(listed, err))
        return reduce(DataFrame.unionAll, out + answers(found))


def list_without_secrets(sources: DataFrame) -> DataFrame:
    """A table of source definitions with passwords and keys hidden, however deep they sit."""
    return redact_frame(sources, CREDENTIAL_SECRETS)
