"""Alignment sources by name: each yields one table, whatever its format."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import tables

#: Columns that every source yields.
COLUMNS = ("read_id", "reference", "reference_start", "reference_end", "strand", "is_secondary", "is_supplementary", "is_mapped", "mapping_quality", "cigar", "sequence", "qualities", "tags")


@dataclass(frozen=True)
class Capabilities:
    """What a source's files can say."""

    tags: bool
    splits_files: bool


class AlignmentSource(ABC):
    name: str
    capabilities: Capabilities

    @abstractmethod
    def load(self, spark: SparkSession, path: str) -> DataFrame: ...

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """The source's table with COLUMNS in order; a source that lacks one is an error."""
        df = self.load(spark, path)
        if missing := [c for c in COLUMNS if c not in df.columns]:
            raise ValueError(f"{self.name} lacks {', '.join(missing)}")
        return df.select(*COLUMNS)


class Sam(AlignmentSource):
    name, capabilities = "sam", Capabilities(tags=True, splits_files=True)

    def load(self, spark: SparkSession, path: str) -> DataFrame:
        return tables.read_sam(spark, path)


class ParquetTable(AlignmentSource):
    name, capabilities = "parquet", Capabilities(tags=True, splits_files=True)

    def load(self, spark: SparkSession, path: str) -> DataFrame:
        return spark.read.parquet(path)


SOURCES: dict[str, AlignmentSource] = {}


def register(source: AlignmentSource) -> None:
    if source.name in SOURCES:
        raise ValueError(f"{source.name} is registered")
    SOURCES[source.name] = source


def get(name: str) -> AlignmentSource:
    if name not in SOURCES:
        raise KeyError(f"{name}: known are {', '.join(sorted(SOURCES))}")
    return SOURCES[name]


register(Sam())
register(ParquetTable())
