"""Landed files: sites, cohorts, public statistics, result documents, survey files in Stata's format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

POSTINGS = (
    "posting_id string, site string, title string, company string, address string, education string, experience string, "
    "employment string, industry_text string, start_date date, end_date date, as_of date"
)
CODES = "code6 string, name string, major string"
GRADUATES = "field string, graduates bigint, year int"
POPULATION = "district string, subdistrict string, age_band string, people double"
POLICIES = "project string, budget double"


def combined(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """All sites or cohorts as one table, with where each row comes from; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(name, F.lit(k)) for k, df in parts.items()])


def without_sources(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Leaves out the sources that a licence excludes."""
    return df.join(excluded.select(key).distinct(), key, "left_anti")


def statistics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A public statistics file (CSV with a header, UTF-8), with an explicit schema."""
    return spark.read.csv(path, schema=schema, header=True)


def postings(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The landed postings of all sites (JSON lines, a path a site), with the site of each."""
    return combined({site: spark.read.schema(POSTINGS).json(path).drop("site") for site, path in paths.items()}, "site")


def graduates(spark: SparkSession, path: str) -> DataFrame:
    return statistics(spark, path, GRADUATES)


def population(spark: SparkSession, path: str) -> DataFrame:
    return statistics(spark, path, POPULATION)


def policies(spark: SparkSession, path: str) -> DataFrame:
    return statistics(spark, path, POLICIES)


def code_master(spark: SparkSession, path: str) -> DataFrame:
    """Codes stay strings: leading zeros count."""
    return statistics(spark, path, CODES)


def months(df: DataFrame, month: str, first: str, last: str) -> DataFrame:
    """Rows of a range of months, both ends included."""
    return df.filter(F.trunc(F.col(month).cast("date"), "month").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def document(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One JSON document of several result sets, as a row with a column for each."""
    return spark.read.schema(schema).json(path, multiLine=True)


def result_set(doc: DataFrame, name: str) -> DataFrame:
    """A result set of the document as rows: arrays of records become tables, maps become (category, value)."""
    kind = doc.schema[name].dataType.typeName()
    if kind == "map":
        return doc.select(F.explode(name).alias("category", "value"))
    return doc.select(F.inline(name)) if kind == "array" else doc.select(f"{name}.*")


class StataSource(DataSource):
    """spark.read.format("stata").schema(...).load(path): one task for each file, read in chunks of rows."""

    @classmethod
    def name(cls) -> str:
        return "stata"

    def schema(self) -> str:
        raise ValueError("give the schema: .schema(...)")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _StataReader(schema, self.options)


class _StataReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.columns, self.paths = schema.fieldNames(), [p.strip() for p in options["path"].split(",")]
        self.rows = int(options.get("chunk", "50000"))

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        import pandas as pd

        with pd.read_stata(partition.value, columns=self.columns, chunksize=self.rows, convert_categoricals=False) as chunks:
            for chunk in chunks:
                for row in chunk.astype(object).where(chunk.notna(), None).itertuples(index=False, name=None):
                    yield tuple(x.item() if hasattr(x, "item") else x for x in row)
