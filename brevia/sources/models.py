"""The model server's catalogue as DataFrames: a Python data source with three tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from brevia.sources.backends import BackendError, request_json

SCHEMAS = {
    "installed": "name string, size_gb double, parameter_size string, quantization string, family string, modified_at string",
    "running": "name string, size_gb double, vram_gb double, expires_at string",
    "version": "version string",
}


def gigabytes(n: int | None) -> float | None:
    return None if n is None else round(n / 1e9, 2)


def rows(base_url: str, table: str, timeout_ms: int) -> list[tuple]:
    root = base_url.rstrip("/")
    if table == "version":
        return [(request_json(f"{root}/api/version", None, timeout_ms).get("version") or "unknown",)]
    found = request_json(f"{root}/api/{'tags' if table == 'installed' else 'ps'}", None, timeout_ms).get("models") or []
    if table == "running":
        return [(m.get("name"), gigabytes(m.get("size")), gigabytes(m.get("size_vram")), m.get("expires_at")) for m in found]
    about = [m.get("details") or {} for m in found]
    return [(m.get("name"), gigabytes(m.get("size")), d.get("parameter_size"), d.get("quantization_level"), d.get("family"), m.get("modified_at")) for m, d in zip(found, about, strict=True)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition):
        yield from rows(self.options["base_url"], self.options.get("table", "installed"), int(self.options.get("timeout_ms", 10_000)))


class ModelCatalogue(DataSource):
    """spark.read.format("local_models").option("base_url", ...).option("table", "installed").load()"""

    @classmethod
    def name(cls) -> str:
        return "local_models"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "installed")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def catalogue(spark: SparkSession, base_url: str, table: str = "installed", timeout_ms: int = 10_000) -> DataFrame:
    spark.dataSource.register(ModelCatalogue)
    return spark.read.format("local_models").option("base_url", base_url).option("table", table).option("timeout_ms", timeout_ms).load()


def describe(models: list) -> str:
    """The catalogue as a text table."""
    if not models:
        return "no model is installed"
    lines = [" | ".join("-" if x is None else str(x) for x in (m.name, m.parameter_size, m.quantization, None if m.size_gb is None else f"{m.size_gb} GB", m.modified_at)) for m in models]
    return "\n".join(["name | parameters | quant | size | modified", "--- | --- | --- | --- | ---", *lines])


__all__ = ["BackendError", "ModelCatalogue", "catalogue", "describe", "rows"]
