"""Result files: CSV for each set, one JSON document of all sets, a table for each panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(results: DataFrame, path: str) -> None:
    """One CSV file. For result sets (a row for each group), not for row-level tables."""
    results.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_evidence(sets: dict[str, DataFrame], folder: str) -> None:
    """A Parquet table for each result set; reruns replace it."""
    for name, df in sets.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def as_array(results: DataFrame, name: str, order: list[Column], fields: list[str]) -> DataFrame:
    """One row with the sorted records of a result set. Sorted by a leading struct, as collect_list has no order."""
    keyed = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.struct(*fields).alias("record"))
    return results.agg(F.transform(F.sort_array(F.collect_list(keyed)), lambda x: x["record"]).alias(name))


def json_document(sets: list[DataFrame]) -> DataFrame:
    """One row `document`: a JSON object with all result sets (each a one-row DataFrame of one column)."""
    out = sets[0]
    for s in sets[1:]:
        out = out.crossJoin(s)  # one row each
    return out.select(F.to_json(F.struct(*out.columns)).alias("document"))


def write_json(document: DataFrame, path: str) -> None:
    document.coalesce(1).write.mode("overwrite").text(path)
